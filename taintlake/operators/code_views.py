"""Source text with what the index knows of it: annotations, slices, sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

SOURCES_PER_LINE, FLOWS_PER_LINE = 1, 3


def lines_of(files: DataFrame) -> DataFrame:
    """path, line, code of ``files`` (path, content); any line end ends a line, and the last one opens none."""
    parts = F.split("content", r"\R")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.select("path", F.posexplode(kept).alias("n", "code")).select("path", (F.col("n") + 1).alias("line"), "code")


def annotations(symbols: DataFrame, sources: DataFrame, flows: DataFrame) -> DataFrame:
    """file, line, part, note: symbols, then sources, then flows by CWE; long lists end in a count."""
    a = symbols.select("file", F.col("range_start").alias("line"), F.lit(0).alias("part"), F.format_string("[%s] symbol %s", "id", "display_name").alias("note"))
    at = sources.select("tid", text.file_of(F.col("evidence_loc")).alias("file"), text.line_of(F.col("evidence_loc")).alias("line")).where("line is not null")
    s = at.groupBy("file", "line").agg(F.min("tid").alias("t"), F.count("*").alias("n"))
    s = s.select("file", "line", F.lit(1).alias("part"), F.when(F.col("n") <= SOURCES_PER_LINE, F.format_string("[%s] SOURCE", "t")).otherwise(F.format_string("[%s] SOURCE (+%d more)", "t", F.col("n") - 1)).alias("note"))
    f = flows.join(at, "tid").groupBy("file", "line", "cwe").agg(F.array_sort(F.collect_list("fid")).alias("f"))
    cwe, n = F.coalesce("cwe", F.lit("None")), F.size("f")
    few = F.transform("f", lambda x: F.format_string("FLOW %s (%s)", x, cwe))
    many = F.array(F.format_string("FLOW %s (+%d more) [%s]", F.array_join(F.slice("f", 1, FLOWS_PER_LINE), ", "), n - FLOWS_PER_LINE, cwe))
    f = f.select("file", "line", F.lit(2).alias("part"), F.explode(F.when(n <= FLOWS_PER_LINE, few).otherwise(many)).alias("note"))
    return a.unionByName(s).unionByName(f)


def annotated(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Every line with its notes behind the language's comment mark."""
    marker = text.comment_marker(text.language_fence(F.col("path")))
    own = notes.groupBy("file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "note"))), lambda x: x["note"]), " | ").alias("notes"))
    joined = lines_of(files).join(own.withColumnRenamed("file", "path"), ["path", "line"], "left")
    return joined.select("path", "line", F.when(F.col("notes").isNull(), F.col("code")).otherwise(F.concat("code", F.lit("  "), marker, F.lit(" "), "notes")).alias("text"))


def slices(flows: DataFrame, sources: DataFrame, files: DataFrame, radius: int = 5) -> DataFrame:
    """The steps of flows with the code around them.

    Places (file, line) meet lines by number, each place once however many steps lie there; only the lines around go further.
    """
    steps = flows.join(sources.select("tid", "evidence_loc"), "tid").select("fid", "cwe", "sid", F.col("evidence_loc").alias("source_loc"), F.posexplode("steps").alias("n", "s"))
    steps = steps.select("fid", "cwe", "sid", "source_loc", "n", F.col("s.file").alias("file"), F.col("s.start").alias("line"))
    places = steps.select("file", "line").distinct().where("file is not null and line is not null")
    lines = files.select(F.col("path").alias("file"), F.split("content", "\n").alias("l"))
    sizes = lines.select("file", F.size("l").alias("size"))
    own = lines.select("file", F.posexplode("l").alias("k", "code")).select("file", (F.col("k") + 1).alias("line"), "code")
    low = F.greatest(F.col("line") - radius, F.lit(1))
    known = places.join(sizes, "file")
    around = known.select("file", F.col("line").alias("at"), F.explode(F.sequence(low, F.greatest(low, F.least(F.col("line") + radius, F.col("size"))))).alias("line"))
    code = around.join(own, ["file", "line"]).groupBy("file", F.col("at").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line").alias("k"), "code"))), lambda x: x["code"]), "\n").alias("code"))
    at = steps.join(known, ["file", "line"], "left").join(code, ["file", "line"], "left")
    high = F.coalesce(F.least(F.col("line") + radius, F.col("size")), F.col("line") + radius)
    return at.select("fid", "cwe", "source_loc", "sid", "n", "file", "line", low.alias("context_start"), F.greatest(high, low).alias("context_end"), F.coalesce("code", F.lit("")).alias("code"))


def sidecar_records(symbols: DataFrame, sources: DataFrame, sinks: DataFrame, flows: DataFrame, entrypoints: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file, kind, record (JSON) for all files at once.

    Entry points without a symbol belong to their own file; with ``files`` given, to every
    file, as older sidecars had it.
    """
    loc = text.file_of(F.col("evidence_loc"))
    js = lambda *c: F.to_json(F.struct(*c))
    a = symbols.select("file", F.lit("symbol").alias("kind"), js("id", F.lit("symbol").alias("kind"), F.col("kind").alias("sym_kind"), F.array("range_start", "range_end").alias("range"), F.col("display_name").alias("name")).alias("record"))
    b = sources.select(loc.alias("file"), F.lit("source").alias("kind"), js(F.col("tid").alias("id"), F.lit("source").alias("kind"), "class", "key", F.col("evidence_loc").alias("loc")).alias("record")).where("file != ''")
    c = sinks.join(symbols.select(F.col("id").alias("symbol_id"), "file"), "symbol_id").select("file", F.lit("sink").alias("kind"), js(F.col("sid").alias("id"), F.lit("sink").alias("kind"), "class", "lib", "parameterization").alias("record"))
    d = flows.join(sources.select("tid", "evidence_loc"), "tid").select(loc.alias("file"), F.lit("flow").alias("kind"), js(F.col("fid").alias("id"), F.lit("flow").alias("kind"), "tid", "sid", "cwe", "engine").alias("record")).where("file != ''")
    record = js(F.lit("entrypoint").alias("kind"), F.col("kind").alias("ep_kind"), "signature", "symbol_id").alias("record")
    named = entrypoints.where("symbol_id is not null").drop("file").join(symbols.select(F.col("id").alias("symbol_id"), "file"), "symbol_id").select("file", F.lit("entrypoint").alias("_k"), record)
    bare = entrypoints.where("symbol_id is null")
    own = bare.select("file", F.lit("entrypoint").alias("_k"), record)
    if files is not None:
        own = bare.drop("file").withColumn("_one", F.lit(1)).join(files.select(F.col("path").alias("file"), F.lit(1).alias("_one")), "_one").select("file", F.lit("entrypoint").alias("_k"), record)
    e = named.unionByName(own).withColumnRenamed("_k", "kind")
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def html_records(pages: DataFrame, path: str = "url", content: str = "html") -> DataFrame:
    """Scripts and event handlers of pages: file, type, line, src, inline, attr, js."""
    script = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
    parts = pages.select(F.col(path).alias("file"), F.col(content).alias("c"))
    found = parts.select("file", F.explode(F.arrays_zip(F.regexp_extract_all("c", F.lit(script), F.lit(1)).alias("a"), F.regexp_extract_all("c", F.lit(script), F.lit(2)).alias("b"))).alias("m"))
    src = F.regexp_extract(F.col("m.a"), r"(?i)\bsrc\s*=\s*[\"']?([^\"'\s>]+)", 1)
    none = F.lit(None).cast("string")
    scripts = found.select("file", F.lit("html_script").alias("type"), F.nullif(src, F.lit("")).alias("src"), F.nullif(F.trim("m.b"), F.lit("")).alias("inline"), none.alias("attr"), none.alias("js"))
    handler = r"(?i)\s(on[a-z]+)\s*=\s*[\"']([^\"']*)[\"']"
    on = parts.select("file", F.explode(F.arrays_zip(F.regexp_extract_all("c", F.lit(handler), F.lit(1)).alias("a"), F.regexp_extract_all("c", F.lit(handler), F.lit(2)).alias("b"))).alias("m"))
    handlers = on.select("file", F.lit("html_handler").alias("type"), none.alias("src"), none.alias("inline"), F.lower("m.a").alias("attr"), F.col("m.b").alias("js"))
    return scripts.unionByName(handlers)
