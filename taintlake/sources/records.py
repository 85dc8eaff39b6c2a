"""Readers of analyzer output: SARIF, JSON Lines of several kinds, AST records, markdown lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects, one a line; blank lines, broken lines and other values are skipped."""
    lines = spark.read.text(path)
    return from_lines(lines, schema)


def from_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same for lines that are in a column already; works on streams too."""
    return lines.where(F.rlike(column, F.lit(r"^\s*\{"))).select(F.from_json(column, f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).where("r is not null and r._broken is null").select("r.*").drop("_broken")


def sarif(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SARIF).option("multiLine", True).json(path)


def _place(p: Column, root: str) -> Column:
    given = F.coalesce(p["artifactLocation"]["uri"], F.lit(""))
    uri = F.when(F.startswith(given, F.lit("file://")), F.substring(given, 8, 2**31 - 1)).otherwise(given)
    file = F.when((uri == "") | F.startswith(uri, F.lit("/")), uri).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), uri))
    start = F.coalesce(p["region"]["startLine"], F.lit(0))
    return F.struct(file.alias("file"), start.alias("start"), F.coalesce(p["region"]["endLine"], start).alias("end"), F.lit(None).cast("string").alias("snippet"))


def sarif_rows(documents: DataFrame, project: str, root: str, engine: str, ref: str = "", confidence: str = "definite", distinct: bool = True) -> dict[str, DataFrame]:
    """taint_sources, taint_sinks and flows of SARIF documents; a result without a code flow is both ends itself.

    With ``distinct=False`` each result's rows stay.
    """
    once = (lambda df, key: df.dropDuplicates([key])) if distinct else (lambda df, key: df)
    runs = documents.select(F.explode("runs").alias("run"))
    results = runs.select(
        F.map_from_entries(F.transform(F.coalesce("run.tool.driver.rules", F.array()), lambda r: F.struct(r["id"], F.coalesce(r["properties"]["tags"], F.array().cast("array<string>"))))).alias("tags_of"),
        F.explode("run.results").alias("r"),
    )
    own = F.coalesce(F.col("r.properties.tags"), F.array().cast("array<string>"))
    tags = F.when(F.size(own) > 0, own).otherwise(F.coalesce(F.try_element_at("tags_of", F.col("r.ruleId")), own))
    base = results.select(F.col("r.ruleId").alias("rule"), text.cwe_of(F.col("r.ruleId"), tags).alias("cwe"), F.col("r.locations").alias("locations"), F.flatten(F.transform(F.coalesce("r.codeFlows", F.array()), lambda c: F.coalesce(c["threadFlows"], F.array()))).alias("threads"))
    #: Both kinds of results in one pass, since each pass would read the documents again.
    traced = F.transform("threads", lambda t: F.struct(F.transform(t["locations"], lambda x: _place(x["location"]["physicalLocation"], root)).alias("steps"), F.col("rule").alias("class")))
    alone = F.when(F.size("locations") > 0, F.array(F.struct(F.array(_place(F.try_element_at("locations", F.lit(1))["physicalLocation"], root)).alias("steps"), F.lit("pattern").alias("class"))))
    found = F.when(F.size(F.coalesce("threads", F.array())) == 0, alone).otherwise(traced)
    rows = base.select("rule", "cwe", F.explode(found).alias("f")).select("rule", "cwe", "f.steps", "f.class").where("size(steps) > 0")
    first, last = F.element_at("steps", 1), F.element_at("steps", -1)
    tid = ids.stable_id("src", F.lit(project), first["file"], first["start"], "rule")
    sid = ids.stable_id("sink", F.lit(project), last["file"], last["start"], "rule")
    rows = rows.withColumn("tid", tid).withColumn("sid", sid)
    null = F.lit(None).cast("string")
    flows = rows.select(ids.stable_id("flow", F.lit(project), "tid", "sid", "rule").alias("fid"), "tid", "sid", "cwe", F.lit(engine).alias("engine"), "steps", F.lit(ref).alias("sarif_ref"), F.lit(confidence).alias("confidence"))
    sources = rows.select("tid", null.alias("symbol_id"), "class", F.lit("").alias("key"), F.concat_ws(":", first["file"], first["start"]).alias("evidence_loc"))
    sinks = rows.select("sid", null.alias("symbol_id"), "class", F.lit("").alias("lib"), F.lit("").alias("parameterization"), F.array().cast("array<string>").alias("tainted_slots"))
    return {"taint_sources": once(sources, "tid"), "taint_sinks": once(sinks, "sid"), "flows": once(flows, "fid")}


def graph_flow_rows(rows: DataFrame, root: str, distinct: bool = True) -> dict[str, DataFrame]:
    """The same of graph-engine flows; ids don't hold the project, paths are put under its root.

    A stream asks for ``distinct=False``: there a later row of the same id is an update.
    """
    once = (lambda df, key: df.dropDuplicates([key])) if distinct else (lambda df, key: df)
    under = lambda c: F.when(F.startswith(c, F.lit("/")), F.col(c)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
    r = rows.withColumn("sf", under("source_file")).withColumn("kf", under("sink_file"))
    r = r.withColumn("tid", ids.stable_id("src", "sf", "source_line", "source_name")).withColumn("sid", ids.stable_id("sink", "kf", "sink_line", "sink_name"))
    null = F.lit(None).cast("string")
    step = lambda f, l: F.struct(F.col(f).alias("file"), F.col(l).alias("start"), F.col(l).alias("end"), null.alias("snippet"))
    fid = F.coalesce("fid", ids.graph_flow_id("source_file", "source_line", "sink_file", "sink_line", "cwe"))
    return {
        "taint_sources": once(r.select("tid", null.alias("symbol_id"), F.lit("joern").alias("class"), F.col("source_name").alias("key"), F.concat_ws(":", "sf", "source_line").alias("evidence_loc")), "tid"),
        "taint_sinks": once(r.select("sid", null.alias("symbol_id"), F.col("sink_class").alias("class"), F.col("sink_name").alias("lib"), "parameterization", F.array().cast("array<string>").alias("tainted_slots")), "sid"),
        "flows": once(r.select(fid.alias("fid"), "tid", "sid", "cwe", F.lit("joern").alias("engine"), F.array(step("sf", "source_line"), step("kf", "sink_line")).alias("steps"), F.lit("").alias("sarif_ref"), F.lit("inferred").alias("confidence")), "fid"),
    }


def model_flow_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """The same of flows that a language model proposed; ids and labels have defaults."""
    null = F.lit(None).cast("string")
    tid = F.coalesce("tid", ids.stable_id("T", F.col("source.file"), F.col("source.line"), F.col("source.class")))
    sid = F.coalesce("sid", ids.stable_id("S", F.col("sink.file"), F.col("sink.line"), F.col("sink.class")))
    r = rows.withColumn("tid", tid).withColumn("sid", sid)
    steps = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("start"), s["line"].alias("end"), null.alias("snippet")))
    return {
        "taint_sources": r.select("tid", null.alias("symbol_id"), F.col("source.class").alias("class"), F.col("source.key").alias("key"), F.concat_ws(":", "source.file", "source.line").alias("evidence_loc")).dropDuplicates(["tid"]),
        "taint_sinks": r.select("sid", null.alias("symbol_id"), F.col("sink.class").alias("class"), F.col("sink.lib").alias("lib"), F.lit("").alias("parameterization"), F.array().cast("array<string>").alias("tainted_slots")).dropDuplicates(["sid"]),
        "flows": r.select(F.coalesce("fid", ids.stable_id("F", "tid", "sid", "cwe")).alias("fid"), "tid", "sid", "cwe", F.coalesce("engine", F.lit("llm-heavy")).alias("engine"), steps.alias("steps"), F.lit("").alias("sarif_ref"), F.coalesce("confidence", F.lit("inferred")).alias("confidence")).dropDuplicates(["fid"]),
    }


def ast_rows(records: DataFrame, project: str, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, symbols and xrefs of AST records; ``names`` (file, start, end, symbol) gives better symbol ids.

    Records without an id are left out, as are types that no table holds; an error record raises.
    """
    bad = records.where("type = 'error'").limit(1).collect()
    if bad:
        raise ValueError(f"the extractor reports an error: {bad[0].asDict()}")
    s = records.where("type = 'symbol'").withColumn("start", F.try_element_at("range", F.lit(1))).withColumn("end", F.try_element_at("range", F.lit(2)))
    if names is not None:
        s = s.join(names.select("file", "start", "end", F.col("symbol").alias("better")), ["file", "start", "end"], "left")
        s = s.withColumn("id", F.coalesce("better", "syntheticId"))
    else:
        s = s.withColumn("id", F.col("syntheticId"))
    null = F.lit(None).cast("string")
    files = records.where("type = 'file'").select(F.col("file").alias("path"), null.alias("sha256"), "lang", F.lit(project).alias("project_id"), F.col("lineCount").cast("bigint").alias("size"))
    symbols = s.where("id is not null").select("id", F.col("id").alias("sym"), "kind", "file", F.col("start").alias("range_start"), F.col("end").alias("range_end"), null.alias("type"), F.col("name").alias("display_name"))
    xrefs = records.where("type = 'xref'").select(F.col("callerSyntheticId").alias("caller_id"), null.alias("callee_id"), "kind", "file", "line", F.coalesce("calleeText", "moduleSpecifier").alias("callee_text"))
    return {"files": files.dropDuplicates(["path"]), "symbols": symbols.dropDuplicates(["id"]), "xrefs": xrefs}


def scip_symbols(decoded: DataFrame) -> DataFrame:
    """file, start, end, symbol from decoded occurrences (file, range, symbol); ranges of three stay on one line."""
    r = F.col("range")
    start = F.element_at(r, 1) + 1
    return decoded.select("file", start.alias("start"), F.when(F.size(r) == 4, F.try_element_at(r, F.lit(3)) + 1).otherwise(start).alias("end"), "symbol").dropDuplicates(["file", "start", "end"])


def scip(spark: SparkSession, path: str) -> DataFrame:
    """file, range, symbol of the occurrences in index files (a message with documents: 2; of them path: 1, occurrences: 2; of these range: 1, symbol: 2)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_occurrences, "file string, range array<int>, symbol string")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.list_(pa.int32()), pa.string())
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            for field, document in protobuf_fields(content.as_buffer()):
                if field != 2:
                    continue
                parts = list(protobuf_fields(document))
                file = next((bytes(v).decode() for f, v in parts if f == 1), "")
                for f, v in parts:
                    if f == 2:
                        rows.append((file, *_occurrence(v)))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "range", "symbol"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "range", "symbol"])


def _occurrence(message: memoryview) -> tuple[list[int], str]:
    place: list[int] = []
    symbol = ""
    for field, value in protobuf_fields(message):
        if field == 1:  # numbers, packed in one field or one by one
            place += [value] if isinstance(value, int) else packed_numbers(value)
        elif field == 2:
            symbol = bytes(value).decode()
    return place, symbol


def _varint(data: memoryview, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if data[i - 1] < 128:
            return n, i


def packed_numbers(data: memoryview) -> list[int]:
    out, i = [], 0
    while i < len(data):
        n, i = _varint(data, i)
        out.append(n)
    return out


def protobuf_fields(data) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of a message's fields, in order: numbers, or bytes of all other kinds."""
    data, i = memoryview(data).cast("B"), 0
    while i < len(data):
        key, i = _varint(data, i)
        if key & 7 == 0:
            value, i = _varint(data, i)
        else:
            size, i = _varint(data, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def queue(lines: DataFrame) -> DataFrame:
    """The items (id, project, vector, loc) of a queue's lines (value); other lines are skipped."""
    line = r"^- \[[ xX]\] (\S+) \| ([^|]*) \| ([^|]*) \| (.*)$"
    part = lambda i: F.trim(F.regexp_extract("value", line, i))
    return lines.where(F.rlike("value", F.lit(line))).select(part(1).alias("id"), part(2).alias("project"), part(3).alias("vector"), part(4).alias("loc"))


STATUSES = ("poc_inconclusive", "rejected", "unverified", "verified")


def nominations(lines: DataFrame) -> DataFrame:
    """The nominations of lines (n, value), with the heading that stands above each."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*[c for c in lines.columns if c not in ("n", "value")]).orderBy("n")
    heading = F.last(F.when(F.rlike("value", F.lit(r"^##\s")), F.regexp_replace("value", r"^##\s+", "")), True).over(w)
    rest = [c for c in lines.columns if c != "value"]
    return lines.withColumn("heading", heading).select(*rest, "heading", *text.nomination(F.col("value"))).where("id != ''")


def finding(content: Column) -> dict[str, Column]:
    """Fields of a finding's front matter, and its body; text without one, or with a status that is none, is an error."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n?", 1)
    raw = lambda k: F.regexp_extract(head, rf"(?m)^{k}:\s*(.*?)\s*$", 1)
    plain = lambda c: F.when(F.rlike(c, F.lit("^'.*'$")), F.replace(F.regexp_extract(c, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(F.regexp_replace(c, '^"(.*)"$', "$1"))
    fields = {k: F.nullif(plain(raw(k)), F.lit("")) for k in ("finding_id", "nomination_id", "flow_id", "cwe", "title")}
    status = F.coalesce(F.nullif(plain(raw("status")), F.lit("")), F.lit("unverified"))
    bad = F.when(head == "", "no front matter").when(~status.isin(*STATUSES), F.concat(F.lit("unknown status "), status))
    fields["status"] = F.when(bad.isNotNull(), F.raise_error(F.coalesce(bad, F.lit(""))).cast("string")).otherwise(status)
    return fields | {"body": F.regexp_replace(content, r"(?s)^---\n.*?\n---\n*", "")}
