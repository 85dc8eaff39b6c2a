"""Schemas of the index tables and of the raw records, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STEP = "STRUCT<file: STRING, start: INT, end: INT, snippet: STRING>"

TABLES = {
    "files": "path STRING, sha256 STRING, lang STRING, project_id STRING, size BIGINT",
    "symbols": "id STRING, sym STRING, kind STRING, file STRING, range_start INT, range_end INT, type STRING, display_name STRING",
    "xrefs": "caller_id STRING, callee_id STRING, kind STRING, file STRING, line INT, callee_text STRING",
    "taint_sources": "tid STRING, symbol_id STRING, class STRING, key STRING, evidence_loc STRING",
    "taint_sinks": "sid STRING, symbol_id STRING, class STRING, lib STRING, parameterization STRING, tainted_slots ARRAY<STRING>",
    "flows": f"fid STRING, tid STRING, sid STRING, cwe STRING, engine STRING, steps ARRAY<{STEP}>, sarif_ref STRING, confidence STRING",
    "entrypoints": "symbol_id STRING, kind STRING, signature STRING, file STRING, line INT",
    "notes": "id STRING, symbol_id STRING, layer STRING, author STRING, content STRING, pinned BOOLEAN, ts TIMESTAMP",
    "storage_locations": "storage_id STRING, kind STRING, schema_evidence STRING",
    "storage_writes": "storage_id STRING, flow_id STRING, source_tid STRING, symbol_id STRING, call_shape STRING",
    "storage_reads": "storage_id STRING, symbol_id STRING, result_binding_id STRING",
    "storage_taint": "storage_id STRING, derived_tid STRING, contributing_tids ARRAY<STRING>, confidence STRING",
}

#: The columns by which a later row replaces an earlier one; tables without an entry only grow.
KEYS = {"files": ["path"], "symbols": ["id"], "taint_sources": ["tid"], "taint_sinks": ["sid"], "flows": ["fid"], "storage_locations": ["storage_id"]}

_PLACE = "STRUCT<artifactLocation: STRUCT<uri: STRING>, region: STRUCT<startLine: INT, endLine: INT>>"
SARIF = (
    "runs ARRAY<STRUCT<tool: STRUCT<driver: STRUCT<name: STRING, rules: ARRAY<STRUCT<id: STRING, properties: STRUCT<tags: ARRAY<STRING>>>>>>, "
    "results: ARRAY<STRUCT<ruleId: STRING, message: STRUCT<text: STRING>, properties: STRUCT<tags: ARRAY<STRING>>, "
    f"locations: ARRAY<STRUCT<physicalLocation: {_PLACE}>>, "
    f"codeFlows: ARRAY<STRUCT<threadFlows: ARRAY<STRUCT<locations: ARRAY<STRUCT<location: STRUCT<physicalLocation: {_PLACE}, message: STRUCT<text: STRING>>>>>>>>>>>>"
)
AST = (
    "type STRING, file STRING, kind STRING, name STRING, range ARRAY<INT>, syntheticId STRING, lang STRING, lineCount INT, line INT, "
    "callerSyntheticId STRING, calleeText STRING, moduleSpecifier STRING, src STRING, inline STRING, tag STRING, attr STRING, js STRING"
)
GRAPH_FLOWS = (
    "fid STRING, source_file STRING, source_line INT, sink_file STRING, sink_line INT, source_name STRING, sink_name STRING, cwe STRING, sink_class STRING, parameterization STRING"
)
MODEL_FLOWS = (
    "fid STRING, tid STRING, sid STRING, cwe STRING, engine STRING, confidence STRING, source STRUCT<file: STRING, line: INT, class: STRING, key: STRING>, "
    "sink STRUCT<file: STRING, line: INT, class: STRING, lib: STRING>, steps ARRAY<STRUCT<file: STRING, line: INT>>"
)
PROPOSALS = "call_id STRING, storage_id STRING, kind STRING, confidence DOUBLE, rationale STRING"
MANIFEST = "path STRING, sha256 STRING, size BIGINT, mtime DOUBLE"


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
