"""Findings of several engines: dedupe with consensus, navigation, queues, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules, text
from .relational import last_by

#: Engines that are counted as bits; others are collected by name.
ENGINES = ("codeql", "joern", "semgrep", "llm-heavy", "storage-taint-r2")
RANKS = ("unknown", "llm-suggested", "inferred", "definite")


def rank(confidence: Column) -> Column:
    out = F.lit(0)
    for i, name in enumerate(RANKS):
        out = F.when(confidence == name, i).otherwise(out)
    return out


def flow_key(compat: bool = False) -> list[Column]:
    """Where a flow starts and ends, and its CWE; null and empty CWE are one.

    A flow of one step starts and ends there. ``compat`` gives all flows of fewer than two
    steps of a CWE one key, as older indexes did.
    """
    size = F.size("steps")
    enough = size >= 2 if compat else size >= 1
    first, last = F.try_element_at("steps", F.lit(1)), F.try_element_at("steps", F.lit(-1))
    at = lambda step, field, other: F.coalesce(F.when(enough, step[field]), F.lit(other))
    return [
        at(first, "file", "").alias("k_file"),
        at(first, "start", 0).alias("k_line"),
        at(last, "file", "").alias("k_to_file"),
        at(last, "start", 0).alias("k_to_line"),
        F.coalesce("cwe", F.lit("")).alias("k_cwe"),
    ]


def dedupe(flows: DataFrame, order: str = "fid", compat: bool = False) -> DataFrame:
    """One flow of each key: the most confident, then the first by ``order`` (a distinct value of each flow); with all engines and a raised confidence.

    Two engines raise the label by one, three or more make it definite; a single engine, and a
    group of one row, leave it. The aggregate holds a short row for each key (order, engines as bits for the known ones), combined before
    the shuffle, so a hot key costs a row per task; the survivors, of distinct ``order`` values, are then joined to their whole rows.
    """
    keys = flow_key(compat)
    best = F.struct((-rank(F.col("confidence"))).alias("r"), F.col(order).alias("o"))
    engine = F.nullif(F.col("engine"), F.lit(""))
    bits = F.lit(0)
    for i, name in enumerate(ENGINES):
        bits = F.when(engine == name, 1 << i).otherwise(bits)
    grouped = flows.groupBy(*keys).agg(
        F.min(best).alias("best"),
        F.count("*").alias("merged"),
        F.bit_or(bits).alias("bits"),
        F.collect_set(F.when(bits == 0, engine)).alias("others"),
    )
    known = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, name) for i, name in enumerate(ENGINES)]), lambda e: e.isNotNull())
    engines = F.array_sort(F.concat(known, "others"))
    n = F.size("engines")
    base = -F.col("best.r")
    raised = F.when(n >= 3, 3).when(n == 2, F.least(base + 1, F.lit(3))).otherwise(base)
    label = F.element_at(F.array(*map(F.lit, RANKS)), raised + 1)
    marks = grouped.withColumn("engines", engines).select(F.col("best.o").alias("_o"), "merged", F.array_join("engines", "+").alias("_engines"), label.alias("_label"))
    one = F.col("merged") == 1
    changed = {"engine": F.when(one, F.col("engine")).otherwise(F.col("_engines")).alias("engine"), "confidence": F.when(one, F.col("confidence")).otherwise(F.col("_label")).alias("confidence")}
    return flows.join(marks, F.col(order) == F.col("_o")).select(*[changed.get(c, F.col(c)) for c in flows.columns], "merged")


def engine_counts(flows: DataFrame, prefixes: list[str]) -> DataFrame:
    return flows.agg(*[F.count(F.when(F.startswith("engine", F.lit(p)), 1)).alias(p) for p in prefixes], F.count("*").alias("all_flows"))


def paths(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Flows with both ends. The flows are the large side; broadcast or not is left to sizes at run time."""
    s = sources.select("tid", F.col("symbol_id").alias("source_symbol"), F.col("class").alias("source_class"), F.col("key").alias("source_key"), "evidence_loc")
    k = sinks.select("sid", F.col("symbol_id").alias("sink_symbol"), F.col("class").alias("sink_class"), "lib", "parameterization")
    return flows.join(s, "tid").join(k, "sid")


def grouped_paths(joined: DataFrame, by: list[str]) -> DataFrame:
    """Ids and CWEs of the flows of each group, nulls kept, in the order of ids."""
    rows = F.array_sort(F.collect_list(F.struct("fid", "cwe")))
    return joined.groupBy(*by).agg(rows.alias("r")).select(*by, F.col("r.fid").alias("fids"), F.col("r.cwe").alias("cwes"))


def sinks_without_flow(sinks: DataFrame, flows: DataFrame) -> DataFrame:
    """Sinks that no flow reaches. A null sink among the flows empties this, as NOT IN has it."""
    from .relational import not_in

    return not_in(sinks, "sid", flows, "sid")


def nomination_queue(flows: DataFrame, sources: DataFrame, sinks: DataFrame, symbols: DataFrame, cwes: DataFrame | None = None) -> DataFrame:
    """Stream A: flows of the wanted CWEs; stream B: sinks without a flow, then symbols that decide on access.

    The distinct CWEs, some thousand at most, are broadcast: a shuffle by CWE would put all flows into a few tasks.
    """
    wanted = flows.join(F.broadcast(cwes.select("cwe").distinct()), "cwe", "left_semi") if cwes is not None else flows
    a = paths(wanted, sources, sinks).select(
        F.lit("A").alias("stream"), F.lit(0).alias("part"), F.col("fid").alias("id"), "cwe", "engine", F.col("evidence_loc").alias("source_loc"), "sink_class", "lib", F.lit(None).cast("string").alias("concern")
    )
    empty = [F.lit(None).cast("string").alias(c) for c in ("cwe", "engine")]
    b = sinks_without_flow(sinks, flows).select(
        F.lit("B").alias("stream"), F.lit(1).alias("part"), F.col("sid").alias("id"), *empty, F.lit(None).cast("string").alias("source_loc"), F.col("class").alias("sink_class"), "lib", F.lit("sink-without-source").alias("concern")
    )
    c = symbols.where(rules.is_auth_name(F.col("display_name"))).select(
        F.lit("B").alias("stream"), F.lit(2).alias("part"), "id", *empty, F.concat_ws(":", "file", "range_start").alias("source_loc"),
        F.lit(None).cast("string").alias("sink_class"), F.lit(None).cast("string").alias("lib"), F.lit("auth").alias("concern"),
    )
    return a.unionByName(b).unionByName(c)


def graph_edges(joined: DataFrame, limit: int = 2000) -> DataFrame:
    """The first flows by id as edges between sources and sinks; at most 2000 of them, at least one."""
    n = max(1, min(limit, 2000))
    return joined.orderBy("fid").limit(n).select("fid", F.concat(F.lit("src:"), "tid").alias("src"), F.concat(F.lit("snk:"), "sid").alias("dst"), "cwe", "engine", "confidence", "source_class", "sink_class")


def graph_nodes(edges: DataFrame, most: int = 5000) -> DataFrame:
    s = edges.select(F.col("src").alias("id"), F.lit("source").alias("type"), F.col("source_class").alias("label"))
    k = edges.select(F.col("dst").alias("id"), F.lit("sink").alias("type"), F.col("sink_class").alias("label"))
    return s.unionByName(k).dropDuplicates(["id"]).orderBy("id").limit(most)


def dot_lines(edges: DataFrame, limit: int = 200) -> DataFrame:
    """A graph description, line by line: (part, line)."""
    own = edges.orderBy("fid").limit(limit)
    left, right = text.dot_id("src", F.col("src")), text.dot_id("snk", F.col("dst"))
    quoted = lambda c: F.regexp_replace(text.short_label(F.coalesce(c, F.lit(""))), '"', '\\\\"')
    nodes = own.select(F.format_string('  %s [shape=ellipse label="%s"];', left, quoted(F.col("source_class"))).alias("line"))
    nodes = nodes.unionByName(own.select(F.format_string('  %s [shape=box label="%s"];', right, quoted(F.col("sink_class"))).alias("line"))).distinct()
    lines = own.select(F.format_string('  %s -> %s [label="%s"];', left, right, F.coalesce("cwe", F.lit(""))).alias("line")).distinct()
    return nodes.select(F.lit(1).alias("part"), "line").unionByName(lines.select(F.lit(2).alias("part"), "line"))


def choose_flow(wanted: DataFrame, joined: DataFrame) -> DataFrame:
    """For each nomination (id, fid, loc) a flow: the named one, else one at its place, else one in its file."""
    by_id = wanted.join(joined.select("fid"), "fid").select("id", "fid", F.lit(0).alias("r"))
    #: Of the flows at one place, or in one file, only the first can be chosen.
    places = joined.groupBy("evidence_loc").agg(F.min("fid").alias("fid"))
    files = places.select("fid", text.file_of(F.col("evidence_loc")).alias("_f")).where("_f != ''").groupBy("_f").agg(F.min("fid").alias("fid"))
    at = wanted.drop("fid").join(places, F.col("loc") == F.col("evidence_loc")).select("id", "fid", F.lit(1).alias("r"))
    near = wanted.drop("fid").withColumn("_f", text.file_of(F.col("loc"))).join(files, "_f").select("id", "fid", F.lit(2).alias("r"))
    every = by_id.unionByName(at).unionByName(near)
    return every.groupBy("id").agg(F.min_by("fid", F.struct("r", "fid")).alias("fid"))


def entrypoints(xrefs: DataFrame, order: str = "ord") -> DataFrame:
    """Calls that are entry points, the first of each (file, line, kind)."""
    #: As an array that is exploded, so that the long CASE is evaluated once and no filter on the kind is pushed into it.
    kind = F.array_compact(F.array(rules.entrypoint_kind(F.col("callee_text"), F.col("file"))))
    found = xrefs.where("kind = 'call'").select("caller_id", "file", "line", "callee_text", order, F.explode(kind).alias("ep_kind"))
    first = found.groupBy("file", "line", "ep_kind").agg(F.min_by(F.struct("caller_id", "callee_text"), order).alias("f"))
    return first.select(F.col("f.caller_id").alias("symbol_id"), F.col("ep_kind").alias("kind"), F.col("f.callee_text").alias("signature"), "file", "line")


ENTRY_ORDER = tuple("http_route listener cron cli message_consumer".split())


def ordered_entrypoints(found: DataFrame) -> DataFrame:
    """Known kinds in their order, then file, line, signature; with the place as ``n``."""
    at = F.array_position(F.array(*map(F.lit, ENTRY_ORDER)), F.col("kind"))
    known = found.where(F.col("kind").isin(*ENTRY_ORDER))
    return known.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("file", "line", "signature", "symbol_id"))).withColumn("kind_order", at)


def file_entrypoints(symbols: DataFrame) -> DataFrame:
    """Routes by file layout: page and app routers, and exported loaders or actions."""
    f = F.col("file")
    under = lambda folder, rest, ends: F.rlike(f, F.lit(rf"(^|/){folder}/{rest}[.]({'|'.join(ends.split())})$"))
    pages = under("pages/api", ".*", "cjs js jsx mjs ts tsx") | under("app", ".*/route", "cjs js mjs ts")
    base = F.substring_index(f, "/", -1)
    nxt = symbols.where(pages).groupBy("file").agg(F.min_by("id", "ord").alias("symbol_id")).select("symbol_id", F.lit("http_route").alias("kind"), F.concat(F.lit("next:"), base).alias("signature"), "file", F.lit(1).alias("line"))
    loaders = symbols.where(under("app/routes", ".+", "js jsx ts tsx") & F.col("display_name").isin("action", "loader"))
    rmx = loaders.groupBy("file").agg(F.min_by("range_start", "ord").alias("line")).select(
        F.lit(None).cast("string").alias("symbol_id"), F.lit("http_route").alias("kind"), F.concat(F.lit("remix:"), base).alias("signature"), "file", F.coalesce("line", F.lit(1)).alias("line")
    )
    return nxt.unionByName(rmx)


def all_entrypoints(xrefs: DataFrame, symbols: DataFrame, order: str = "ord") -> DataFrame:
    """Entry points by calls and by file layout."""
    return entrypoints(xrefs, order).unionByName(file_entrypoints(symbols))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change: added, removed or modified (another hash)."""
    joined = old.select("path", F.col("sha256").alias("old_hash"), F.lit(True).alias("_o")).join(new.select("path", F.col("sha256").alias("new_hash"), F.lit(True).alias("_n")), "path", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return joined.select("path", change.alias("change"), "old_hash", "new_hash").where("change is not null")


def add_note(notes: DataFrame, new: DataFrame) -> DataFrame:
    return notes.unionByName(new, allowMissingColumns=True)


def visible_notes(notes: DataFrame, symbol_id: str, gone: DataFrame | None = None) -> DataFrame:
    """A symbol's notes, the latest first; ``gone`` has the ids of deleted ones."""
    own = notes.where(F.col("symbol_id") == symbol_id)
    own = own.join(gone, "id", "left_anti") if gone is not None else own
    return own.orderBy(F.desc("ts"), F.desc("id"))


def index_update(old: DataFrame, new: DataFrame, table: str, order: str) -> DataFrame:
    """New rows into an index table by its key."""
    from ..schemas import KEYS

    keys = KEYS.get(table)
    return last_by(old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True), keys, ["_age", order]).drop("_age") if keys else old.unionByName(new, allowMissingColumns=True)
