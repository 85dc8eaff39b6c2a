"""Calls of a code graph: where data enters and ends, and flows between the two that lie near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graph_rules, ids
from .code_views import lines_of
from .relational import nearest

#: Lines within which a source can explain a sink that no path reaches.
NEAR = 200


def sink_calls(calls: DataFrame) -> DataFrame:
    """The calls (language, file, line, name, code) that end a flow, once for each class: with cwe and sink_class."""
    own = calls.withColumn("language", graph_rules.language(F.col("language")))
    kinds = graph_rules.sink_classes(F.col("name"), F.coalesce("code", F.lit("")), F.col("language"))
    found = own.withColumn("sink_class", F.explode(kinds))
    return found.withColumn("cwe", graph_rules.cwe_of(F.col("sink_class")))


def source_calls(calls: DataFrame) -> DataFrame:
    own = calls.withColumn("language", graph_rules.language(F.col("language")))
    return own.where(graph_rules.is_source(F.col("code"), F.col("language")))


def _flows(rows: DataFrame) -> DataFrame:
    """As the records of graph flows."""
    fid = ids.graph_flow_id("source_file", "source_line", "sink_file", "sink_line", "cwe")
    return rows.select(fid.alias("fid"), "source_file", "source_line", "sink_file", "sink_line", "source_name", "sink_name", "cwe", "sink_class", F.lit("unknown").alias("parameterization"))


def traced_flows(paths: DataFrame) -> DataFrame:
    """Flows of paths that an engine found (source_* and sink_*, cwe, sink_class): once for each pair of places; none from a place to itself."""
    other = paths.where(~(F.col("source_file").eqNullSafe(F.col("sink_file")) & F.col("source_line").eqNullSafe(F.col("sink_line"))))
    key = ["source_file", "source_line", "sink_file", "sink_line", "cwe"]
    first = other.groupBy(*key).agg(F.min(F.struct("sink_class", "sink_name", "source_name")).alias("f"))
    return _flows(first.select(*key, "f.*"))


def near_flows(calls: DataFrame, traced: DataFrame, within: int = NEAR) -> DataFrame:
    """Flows to sinks that no traced flow reaches, from the nearest source of the file; not where the engine is trusted."""
    sinks = sink_calls(calls).where(~F.col("language").isin(*graph_rules.NO_FALLBACK)).groupBy("file", "line", "cwe").agg(F.min(F.struct("sink_class", "name")).alias("k")).select("file", "line", "cwe", "k.*")
    open_ends = sinks.join(traced.select(F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), "cwe").distinct(), ["file", "line", "cwe"], "left_anti")
    sources = source_calls(calls).select("file", "line", "code")
    near = nearest(open_ends, sources, ["file"], "line", "line", ["file", "line", "cwe"], ["line", "code"], within)
    rows = near.select(F.col("file").alias("source_file"), F.col("near_line").alias("source_line"), F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), F.col("near_code").alias("source_name"), F.col("name").alias("sink_name"), "cwe", "sink_class")
    return _flows(rows)


def secret_compares(files: DataFrame) -> DataFrame:
    """path, line, code of lines that compare a secret of the environment, or a name that holds one in the file, other than in constant time (CWE-208)."""
    lines = lines_of(files.where(F.rlike("path", F.lit("[.](?:[cm]?[jt]s|[jt]sx)$"))))
    held = lines.select("path", F.regexp_extract("code", rf"\b(?:const|let|var)\s+(\w+)\s*=\s*{graph_rules.SECRET}\s*;?\s*$", 1).alias("name")).where("name != ''").distinct()
    operand = r"[\w$.\[\]'\"]+"
    sides = F.concat(F.regexp_extract_all("code", F.lit(rf"({operand})\s*{graph_rules.COMPARES}"), F.lit(1)), F.regexp_extract_all("code", F.lit(rf"{graph_rules.COMPARES}\s*({operand})"), F.lit(1)))
    compared = lines.where(~F.rlike("code", F.lit(graph_rules.CONSTANT_TIME))).select("path", "line", "code", F.explode(sides).alias("name"))
    direct = compared.where(F.rlike("name", F.lit(graph_rules.SECRET))).select("path", "line", "code")
    named = compared.join(held, ["path", "name"], "left_semi").select("path", "line", "code")
    return direct.unionByName(named).distinct().withColumn("cwe", F.lit("CWE-208"))
