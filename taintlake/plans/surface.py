"""The read-only SQL surface over index tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

#: What a query is made of before names are resolved; a statement with anything else in it is refused.
_QUERY = frozenset(
    "Aggregate Distinct Except Expand Filter Generate GlobalLimit InlineCTE Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation ParameterizedQuery Pivot Project "
    "Range ResolvedInlineTable Sample Sort SubqueryAlias Tail Transpose UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal UnresolvedPivot UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedUnpivot UnresolvedWith Union UnionLoop Unpivot Window With WithWindowDefinition".split()
)
#: Functions that call into the driver's or executors' process.
_CALLS = re.compile(r"(?i)\b(?:try_)?reflect`?\s*\(|\bjava_method`?\s*\(")


class ReadOnlyError(ValueError):
    """The statement is no query."""


class Surface:
    """Index tables as views, and SQL that can only read them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        for name in schemas.TABLES:
            tables.get(name, schemas.empty(spark, name)).createOrReplaceTempView(name)
        for name, frame in tables.items():
            frame.createOrReplaceTempView(name)
        for name, ends in (("v_sources_to_sinks", "source_symbol_id, sink_symbol_id"), ("v_sinks_from_sources", "sink_symbol_id, source_symbol_id")):
            spark.sql(_GROUPED.format(name=name, ends=ends))

    def sql(self, query: str) -> DataFrame:
        """The result of a query; commands, scripts, writes, files by path and calls into the process are refused."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        stack = [plan]
        while stack:
            node = stack.pop()
            kind = node.getClass().getSimpleName()
            if kind not in _QUERY:
                raise ReadOnlyError(f"only queries are allowed; this has {kind}")
            if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
                raise ReadOnlyError(f"only the index tables can be read, not {node.name()}")
            for below in (node.children(), node.innerChildren(), node.subqueries()):
                stack += [below.apply(i) for i in range(below.size()) if hasattr(below.apply(i), "subqueries")]
        if _CALLS.search(query):
            raise ReadOnlyError("functions that call into the process are not allowed")
        return self.spark.sql(query)


#: Flows by the symbols of both ends; ids and CWEs (nulls kept) in the order of ids.
_GROUPED = """
CREATE OR REPLACE TEMP VIEW {name} AS
SELECT {ends}, transform(r, x -> x.fid) AS fids, transform(r, x -> x.cwe) AS cwes
FROM (
  SELECT t.symbol_id AS source_symbol_id, k.symbol_id AS sink_symbol_id, array_sort(collect_list(struct(f.fid, f.cwe))) AS r
  FROM flows f JOIN taint_sources t ON t.tid = f.tid JOIN taint_sinks k ON k.sid = f.sid GROUP BY t.symbol_id, k.symbol_id
)
"""
