"""Queries for the operators over findings, storage and code, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, rules, text
from ..operators import code_views, findings, projects, relational, reports, storage, taxonomy
from . import relations as x
from .relations import table, with_sql
from .surface import Surface

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _dedupe_sql(enough: str) -> str:
    return (
        with_sql("x_flows")
        + f""", k AS (SELECT *, CASE WHEN {enough} THEN f1 ELSE '' END AS a1, CASE WHEN {enough} THEN n1 ELSE 0 END AS a2, CASE WHEN {enough} THEN f2 ELSE '' END AS a3,
    CASE WHEN {enough} THEN n2 ELSE 0 END AS a4, coalesce(cwe, '') AS a5, CASE confidence WHEN 'definite' THEN 3 WHEN 'inferred' THEN 2 WHEN 'llm-suggested' THEN 1 ELSE 0 END AS r FROM x_flows),
  w AS (SELECT *, row_number() OVER (PARTITION BY a1, a2, a3, a4, a5 ORDER BY r DESC, fid) AS rn, count(*) OVER (PARTITION BY a1, a2, a3, a4, a5) AS merged FROM k),
  e AS (SELECT a1, a2, a3, a4, a5, string_agg(DISTINCT engine, '+' ORDER BY engine) AS engines, count(DISTINCT engine) AS n FROM k GROUP BY ALL)
  SELECT fid, cwe, CASE WHEN merged = 1 THEN engine ELSE engines END AS engine,
    CASE WHEN merged = 1 THEN confidence ELSE (['unknown', 'llm-suggested', 'inferred', 'definite'])[1 + CASE WHEN n >= 3 THEN 3 WHEN n = 2 THEN least(r + 1, 3) ELSE r END] END AS confidence, merged
  FROM w JOIN e USING (a1, a2, a3, a4, a5) WHERE rn = 1"""
    )


@query(_dedupe_sql("TRUE"))
def consensus_dedupe(spark, d):
    return findings.dedupe(x.flows(spark, d)).select("fid", "cwe", "engine", "confidence", "merged")


@query(_dedupe_sql("NOT one"))
def consensus_dedupe_compat(spark, d):
    return findings.dedupe(x.flows(spark, d), compat=True).select("fid", "cwe", "engine", "confidence", "merged")


@query(with_sql("x_flows") + "SELECT count(*) FILTER (engine LIKE 'codeql%') AS codeql, count(*) FILTER (engine LIKE 'semgrep%') AS semgrep, count(*) FILTER (engine LIKE 'joern%') AS joern, count(*) AS all_flows FROM x_flows")
def engine_counts(spark, d):
    return findings.engine_counts(x.flows(spark, d), ["codeql", "semgrep", "joern"])


_PATHS = with_sql("x_flows", "x_sources", "x_sinks") + """, p AS (SELECT f.*, s.symbol_id AS source_symbol, s.class AS source_class, s.evidence_loc, k.symbol_id AS sink_symbol, k.class AS sink_class, k.lib
  FROM x_flows f JOIN x_sources s USING (tid) JOIN x_sinks k USING (sid)) """


def _paths(spark, d):
    return findings.paths(x.flows(spark, d), x.sources(spark, d), x.sinks(spark, d))


_LISTS = "string_agg(fid, ',' ORDER BY fid) AS fids, string_agg(coalesce(cwe, '-'), ',' ORDER BY fid) AS cwes"


def _listed(df, *by):
    return df.select(*by, F.array_join("fids", ",").alias("fids"), F.array_join("cwes", ",", "-").alias("cwes"))


@query(_PATHS + f"SELECT source_symbol, sink_symbol, sink_class, {_LISTS} FROM p GROUP BY ALL")
def sources_to_sinks(spark, d):
    return _listed(findings.grouped_paths(_paths(spark, d), ["source_symbol", "sink_symbol", "sink_class"]), "source_symbol", "sink_symbol", "sink_class")


@query(_PATHS + f"SELECT sink_symbol, source_class, {_LISTS} FROM p GROUP BY ALL")
def sinks_from_sources(spark, d):
    return _listed(findings.grouped_paths(_paths(spark, d), ["sink_symbol", "source_class"]), "sink_symbol", "source_class")


def _surface(spark, d):
    return Surface(spark, {"flows": x.flows(spark, d), "taint_sources": x.sources(spark, d), "taint_sinks": x.sinks(spark, d)})


@query(_PATHS + f"SELECT source_symbol AS source_symbol_id, sink_symbol AS sink_symbol_id, {_LISTS} FROM p GROUP BY ALL")
def view_sources_to_sinks(spark, d):
    return _surface(spark, d).sql("SELECT source_symbol_id, sink_symbol_id, array_join(fids, ',') AS fids, array_join(cwes, ',', '-') AS cwes FROM v_sources_to_sinks")


@query(_PATHS + f"SELECT sink_symbol AS sink_symbol_id, source_symbol AS source_symbol_id, {_LISTS} FROM p GROUP BY ALL")
def view_sinks_from_sources(spark, d):
    return _surface(spark, d).sql("SELECT sink_symbol_id, source_symbol_id, array_join(fids, ',') AS fids, array_join(cwes, ',', '-') AS cwes FROM v_sinks_from_sources")


@query(_PATHS + "SELECT fid, cwe, source_class, sink_class, lib FROM p WHERE source_symbol = 'S-7'")
def flows_by_symbol(spark, d):
    return _paths(spark, d).where("source_symbol = 'S-7'").select("fid", "cwe", "source_class", "sink_class", "lib")


#: Every line names a sink, of three one.
_SOME = "SELECT l_suppkey - l_suppkey % 3 AS l_suppkey FROM lineitem"


def _some(spark, d, null=False):
    n = F.col("l_suppkey") - F.col("l_suppkey") % 3
    sid = F.concat(F.lit("K-"), n.cast("string"))
    return table(spark, d, "lineitem").select(F.when(n % 7 != 0, sid).alias("sid") if null else sid.alias("sid"))


@query(with_sql("x_sinks") + f"SELECT sid, class, lib FROM x_sinks WHERE sid NOT IN (SELECT 'K-' || l_suppkey FROM ({_SOME}))")
def sink_without_source(spark, d):
    return findings.sinks_without_flow(x.sinks(spark, d), _some(spark, d)).select("sid", "class", "lib")


@query(with_sql("x_sinks") + f"SELECT sid, class, lib FROM x_sinks WHERE sid NOT IN (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN 'K-' || l_suppkey END FROM ({_SOME}))")
def not_in_null_trap(spark, d):
    return findings.sinks_without_flow(x.sinks(spark, d), _some(spark, d, null=True)).select("sid", "class", "lib")


_ILIKE = " OR ".join(f"display_name ILIKE '{p}'" for p in rules.AUTH_NAMES)


@query(with_sql("x_symbols") + f"SELECT id, file, display_name FROM x_symbols WHERE {_ILIKE}")
def auth_symbols(spark, d):
    return x.symbols(spark, d).where(rules.is_auth_name(F.col("display_name"))).select("id", "file", "display_name")


@query(
    with_sql("x_flows", "x_sources", "x_sinks", "x_symbols")
    + f""", k AS (SELECT sid, class, lib FROM x_sinks UNION ALL SELECT 'K-none', 'html', 'none')
  SELECT 'A' AS stream, f.fid AS id, f.cwe, f.engine, s.evidence_loc AS source_loc, k.class AS sink_class, k.lib, NULL AS concern FROM x_flows f JOIN x_sources s USING (tid) JOIN k USING (sid) WHERE f.cwe IN ('CWE-79', 'CWE-89')
  UNION ALL SELECT 'B', sid, NULL, NULL, NULL, class, lib, 'sink-without-source' FROM k WHERE sid NOT IN (SELECT sid FROM x_flows)
  UNION ALL SELECT 'B', id, NULL, NULL, file || ':' || range_start, NULL, NULL, 'auth' FROM x_symbols WHERE {_ILIKE}"""
)
def nomination_queue(spark, d):
    none = spark.createDataFrame([("K-none", "html", "none")], "sid STRING, class STRING, lib STRING")
    sinks = x.sinks(spark, d).unionByName(none, allowMissingColumns=True)
    cwes = spark.createDataFrame([("CWE-79",), ("CWE-89",)], "cwe STRING")
    return findings.nomination_queue(x.flows(spark, d), x.sources(spark, d), sinks, x.symbols(spark, d), cwes).drop("part")


@query(
    "SELECT o.o_orderpriority || '/' || o.o_orderstatus AS storage_id, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS writes,"
    " (SELECT count(*) FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0) AS reads, o.o_orderkey AS k FROM orders o"
)
def dirty_storage_report(spark, d):
    o, li, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    writes = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("writes"))
    reads = c.where("c_acctbal < 0").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.count("*").alias("reads"))
    joined = o.join(writes, "o_orderkey", "left").join(reads, "o_custkey", "left").na.fill(0, ["writes", "reads"])
    return joined.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("storage_id"), "writes", "reads", F.col("o_orderkey").alias("k")).orderBy("storage_id", "k")


@query(
    with_sql("x_flows")
    + ", n AS (SELECT sid, cwe, count(*) AS n, min(fid) AS seen FROM x_flows WHERE cwe IS NOT NULL GROUP BY ALL) SELECT sid, cwe FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, seen) AS r FROM n) WHERE r = 1"
)
def dominant_cwe(spark, d):
    return relational.mode_first_seen(x.flows(spark, d), ["sid"], "cwe", "fid")


@query(
    "WITH b AS (SELECT 0 AS age, c_custkey AS k, 'old' AS v, 0 AS ord FROM customer UNION ALL SELECT 1, o_custkey, o_orderstatus || o_orderpriority, o_orderkey FROM orders)"
    " SELECT k, v, ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age DESC, ord DESC) AS r FROM b) WHERE r = 1"
)
def upsert_last_wins(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"), F.lit(0).cast("bigint").alias("ord"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat("o_orderstatus", "o_orderpriority").alias("v"), F.col("o_orderkey").alias("ord"))
    return relational.upsert(old, new, ["k"], "ord")


@query("SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def insert_if_absent(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return relational.insert_if_absent(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])


@query("SELECT c_custkey AS k, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS v FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def update_and_delete(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    changed = relational.update(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])
    return relational.delete(changed, table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")), ["k"])


@query(
    """WITH o AS (SELECT 'd/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 0),
  n AS (SELECT 'd/' || doc_id AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 11 <> 0)
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.path IS NULL OR n.path IS NULL OR o.h <> n.h"""
)
def manifest_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    old = docs.where("doc_id % 7 <> 0").select(path, F.sha2("t", 256).alias("sha256"))
    new = docs.where("doc_id % 11 <> 0").select(path, F.sha2(F.concat("t", F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")), 256).alias("sha256"))
    return findings.manifest_diff(old, new).select("path", "change")


@query(
    """WITH s AS (SELECT user_id % 50 AS f, event_id // 10 AS at, event_id AS id FROM events WHERE event_type = 'click'), t AS (SELECT user_id % 50 AS f, event_id // 10 AS at, event_id AS id FROM events WHERE event_type = 'purchase'),
  p AS (SELECT t.id AS sink, s.id AS source, abs(s.at - t.at) AS distance FROM t JOIN s USING (f) WHERE abs(s.at - t.at) <= 200)
  SELECT sink, source, distance FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY distance, source) AS r FROM p) WHERE r = 1"""
)
def nearest_source(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("f"), F.floor(F.col("event_id") / 10).alias("at"), F.col("event_id").alias("id"), "event_type")
    s, t = (e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "purchase"))
    near = relational.nearest(t, s, ["f"], "at", "at", ["id"], ["id"], 200)
    return near.select(F.col("id").alias("sink"), F.col("near_id").alias("source"), "distance")


_EDGES = _PATHS + ", e AS (SELECT fid, 'src:' || tid AS src, 'snk:' || sid AS dst, cwe, source_class, sink_class FROM p ORDER BY fid LIMIT 300) "


def _edges(spark, d):
    return findings.graph_edges(_paths(spark, d), 300)


@query(_EDGES + "SELECT * FROM e")
def graph_edges(spark, d):
    return _edges(spark, d).select("fid", "src", "dst", "cwe", "source_class", "sink_class")


@query(_EDGES + "SELECT src AS id, 'source' AS type, min(source_class) AS label FROM e GROUP BY 1 UNION ALL SELECT dst, 'sink', min(sink_class) FROM e GROUP BY 1")
def graph_nodes(spark, d):
    return findings.graph_nodes(_edges(spark, d))


@query(
    _EDGES
    + """, o AS (SELECT * FROM e ORDER BY fid LIMIT 200), n AS (SELECT 'src_' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') AS a, 'snk_' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') AS b, * FROM o)
  SELECT DISTINCT 1 AS part, '  ' || a || ' [shape=ellipse label="' || source_class || '"];' AS line FROM n UNION SELECT 1, '  ' || b || ' [shape=box label="' || sink_class || '"];' FROM n
  UNION SELECT 2, '  ' || a || ' -> ' || b || ' [label="' || coalesce(cwe, '') || '"];' FROM n"""
)
def dot_lines(spark, d):
    return findings.dot_lines(_edges(spark, d))


@query(
    _PATHS
    + """, w AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'nothing' END AS fid, 'src/f' || (event_id % 60) || '.js:' || (event_id % 55) AS loc FROM events),
  l AS (SELECT evidence_loc, min(fid) AS fid FROM p GROUP BY 1), s AS (SELECT split_part(evidence_loc, ':', 1) AS file, min(fid) AS fid FROM l GROUP BY 1),
  c AS (SELECT w.id, l.fid, 1 AS r FROM w JOIN l ON w.loc = l.evidence_loc UNION ALL SELECT w.id, s.fid, 2 FROM w JOIN s ON split_part(w.loc, ':', 1) = s.file)
  SELECT id, arg_min(fid, r) AS fid FROM c GROUP BY id"""
)
def flow_choice(spark, d):
    e = table(spark, d, "events")
    loc = F.concat(F.lit("src/f"), (F.col("event_id") % 60).cast("string"), F.lit(".js:"), (F.col("event_id") % 55).cast("string"))
    return findings.choose_flow(e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "nothing").alias("fid"), loc.alias("loc")), _paths(spark, d))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind_sql() -> str:
    where = {"urls": "ends_with(file, 'urls.py')", "routes": "(ends_with(file, 'config/routes.rb') OR contains(file, '/config/routes/'))"}
    families = []
    for endings, own in rules.ENTRYPOINTS.values():
        case = "CASE " + " ".join(f"WHEN regexp_matches(callee_text, {_literal(p)}){' AND ' + where[w] if w else ''} THEN '{k}'" for k, p, w in own) + " END"
        families.append("WHEN " + " OR ".join(f"ends_with(file, '{e}')" for e in endings) + f" THEN {case}" if endings else f"ELSE {case}")
    return "CASE " + " ".join(families) + " END"


@query(with_sql("x_xrefs") + f"SELECT ord, file, callee_text, {_kind_sql()} AS ep FROM x_xrefs")
def entrypoint_classify(spark, d):
    return x.xrefs(spark, d).select("ord", "file", "callee_text", rules.entrypoint_kind(F.col("callee_text"), F.col("file")).alias("ep"))


_ENTRY = with_sql("x_xrefs") + f""", k AS (SELECT *, {_kind_sql()} AS ep FROM x_xrefs), e AS (SELECT caller_id AS symbol_id, ep AS kind, callee_text AS signature, file, line
  FROM (SELECT *, row_number() OVER (PARTITION BY file, line, ep ORDER BY ord) AS r FROM k WHERE ep IS NOT NULL) WHERE r = 1) """


@query(_ENTRY + "SELECT * FROM e")
def entrypoint_dedupe(spark, d):
    return findings.entrypoints(x.xrefs(spark, d))


@query(_ENTRY + "SELECT kind, file, line, signature, row_number() OVER (PARTITION BY kind ORDER BY file, line, signature, symbol_id) AS n, list_position(['http_route', 'listener', 'cron', 'cli', 'message_consumer'], kind) AS kind_order FROM e")
def entrypoint_order(spark, d):
    return findings.ordered_entrypoints(findings.entrypoints(x.xrefs(spark, d))).drop("symbol_id")


def _storage_sql(part: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(callee_text, {_literal(r[2])}) THEN '{r[part]}'" for r in rules.STORAGE_CALLS) + " END"


@query(with_sql("x_xrefs") + f"SELECT DISTINCT callee_text, {_storage_sql(0)} AS kind, {_storage_sql(1)} AS op FROM x_xrefs")
def storage_call_classify(spark, d):
    rows = x.xrefs(spark, d).select("callee_text").distinct().withColumn("s", rules.storage_call(F.col("callee_text")))
    return rows.select("callee_text", "s.kind", "s.op")


def _cwe_sql(values: dict[str, str]) -> str:
    return "CASE cwe " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE '{}' END"


@query(with_sql("x_flows") + f"SELECT fid, {_cwe_sql(rules.CWE_SEVERITY).format('informational')} AS severity, {_cwe_sql(rules.CWE_CLASS).format('unknown')} AS vuln_class FROM x_flows")
def severity_lookup(spark, d):
    return reports.severities(x.flows(spark, d)).select("fid", "severity", "vuln_class")


_TAX = "VALUES ('injection', 'xss'), ('injection', 'sqli'), ('file', 'lfi'), ('all', '@injection'), ('all', '@file'), ('everything', '@all'), ('everything', 'redos')"


@query(
    f"WITH RECURSIVE m(g, member) AS ({_TAX}), w AS (SELECT '@' || g AS root FROM m GROUP BY g), o(root, token) AS (SELECT root, root FROM w UNION SELECT o.root, m.member FROM o JOIN m ON o.token = '@' || m.g) SELECT root, token AS name FROM o WHERE token NOT LIKE '@%'"
)
def taxonomy_expand(spark, d):
    members = spark.createDataFrame([("injection", "xss"), ("injection", "sqli"), ("file", "lfi"), ("all", "@injection"), ("all", "@file"), ("everything", "@all"), ("everything", "redos")], "group_name STRING, member STRING")
    out = None
    for g in ("injection", "file", "all", "everything"):
        own = taxonomy.expand(members, spark.createDataFrame([(f"@{g}",)], "token STRING")).select(F.lit(f"@{g}").alias("root"), "name")
        out = own if out is None else out.unionByName(own)
    return out


_DOC_FILES = "docs AS (SELECT 'd/' || doc_id || '.py' AS path, text AS content FROM documents WHERE text IS NOT NULL)"


def _files(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))


_LINES = f"WITH {_DOC_FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS code, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM docs) "


@query(_LINES + "SELECT path, line, code FROM l WHERE NOT (code = '' AND line = (SELECT max(line) FROM l m WHERE m.path = l.path))")
def source_lines(spark, d):
    return code_views.lines_of(_files(spark, d))


_NOTES = with_sql("x_flows", "x_sources", "x_symbols") + """, places AS (SELECT tid, split_part(evidence_loc, ':', 1) AS file, split_part(evidence_loc, ':', 2)::INT AS line FROM x_sources),
  f AS (SELECT file, line, cwe, list(fid ORDER BY fid) AS f FROM x_flows JOIN places USING (tid) GROUP BY ALL),
  n AS (SELECT file, range_start AS line, 0 AS part, '[' || id || '] symbol ' || display_name AS note FROM x_symbols
    UNION ALL SELECT file, line, 1, '[' || min(tid) || '] SOURCE' || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END FROM places GROUP BY file, line
    UNION ALL SELECT file, line, 2, unnest(CASE WHEN len(f) <= 3 THEN [('FLOW ' || z || ' (' || coalesce(cwe, 'None') || ')') FOR z IN f] ELSE ['FLOW ' || array_to_string(f[1:3], ', ') || ' (+' || (len(f) - 3) || ' more) [' || coalesce(cwe, 'None') || ']'] END) FROM f) """


def _notes(spark, d):
    return code_views.annotations(x.symbols(spark, d), x.sources(spark, d), x.flows(spark, d))


@query(_NOTES + "SELECT file, line, part, note FROM n")
def line_annotations(spark, d):
    return _notes(spark, d)


def _scripts(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.col("text").alias("content"))


@query(
    _NOTES
    + """, g AS (SELECT file, line, string_agg(note, ' | ' ORDER BY part, note) AS notes FROM n GROUP BY file, line),
  t AS (SELECT 'src/f' || doc_id || '.js' AS path, text FROM documents WHERE text IS NOT NULL), l AS (SELECT path, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t)
  SELECT path, l.line, code || CASE WHEN notes IS NULL THEN '' ELSE '  // ' || notes END AS text FROM l LEFT JOIN g ON g.file = l.path AND g.line = l.line WHERE NOT (code = '' AND l.line = (SELECT max(line) FROM l m WHERE m.path = l.path))"""
)
def annotated_view(spark, d):
    return code_views.annotated(_scripts(spark, d), _notes(spark, d))


@query(
    with_sql("x_flows", "x_sources")
    + """, t AS (SELECT 'src/f' || doc_id || '.js' AS file, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
  p AS (SELECT fid, cwe, tid, sid, 0 AS n, f1 AS file, n1 AS line FROM x_flows UNION ALL SELECT fid, cwe, tid, sid, 1, f2, n2 FROM x_flows WHERE NOT one)
  SELECT p.fid, p.n, p.file, p.line, greatest(p.line - 5, 1) AS context_start, greatest(least(p.line + 5, coalesce(len(lines), p.line + 5)), greatest(p.line - 5, 1)) AS context_end,
    coalesce(array_to_string(lines[greatest(p.line - 5, 1):least(p.line + 5, len(lines))], chr(10)), '') AS code, s.evidence_loc AS source_loc FROM p JOIN x_sources s USING (tid) LEFT JOIN t USING (file)"""
)
def slice_context(spark, d):
    return code_views.slices(x.flows(spark, d), x.sources(spark, d), _scripts(spark, d)).select("fid", "n", "file", "line", "context_start", "context_end", "code", "source_loc")


_SELECTS = """q AS (SELECT 'q/' || o_orderkey || '.js' AS path, 'a' || chr(10) || 'db.query(' || chr(34) || 'SELECT ' || lower(o_orderstatus) || 'col, total FROM orders_' || (o_custkey % 5) || chr(34) || ')' || chr(10) || 'x(' || chr(39) || 'SELECT name FROM users' || chr(39) || ')' AS content FROM orders)"""


def _sql_files(spark, d):
    o = table(spark, d, "orders")
    content = F.concat(F.lit('a\ndb.query("SELECT '), F.lower("o_orderstatus"), F.lit("col, total FROM orders_"), (F.col("o_custkey") % 5).cast("string"), F.lit("\")\nx('SELECT name FROM users')"))
    return o.select(F.concat(F.lit("q/"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("path"), content.alias("content"))


@query(
    f"WITH {_SELECTS}, m AS (SELECT path, content, unnest(regexp_extract_all(content, '\"(SELECT[^\"]*)\"|''(SELECT[^'']*)''')) AS w FROM q) SELECT path, len(content[:position(w IN content) - 1]) - len(replace(content[:position(w IN content) - 1], chr(10), '')) + 1 AS line, w[2:-2] AS sql FROM m"
)
def select_literals(spark, d):
    return storage.literal_selects(_sql_files(spark, d))


_READS = """SELECT DISTINCT 'sql:orders_' || (o_custkey % 5) || '.' || c AS storage_id, 'read:q/' || o_orderkey || '.js:2' AS symbol_id FROM orders, (VALUES ('total'), (NULL)) v(c0), LATERAL (SELECT coalesce(c0, lower(o_orderstatus) || 'col') AS c) WHERE o_custkey % 5 < 3 AND o_orderkey % 4 <> 1"""


@query(_READS)
def storage_reads(spark, d):
    there = table(spark, d, "orders").where("o_orderkey % 4 = 1").select(F.format_string("read:q/%d.js:2", "o_orderkey").alias("symbol_id"), F.concat(F.lit("sql:orders_"), (F.col("o_custkey") % 5).cast("string")).alias("t"), F.lower("o_orderstatus").alias("s"))
    there = there.select("symbol_id", F.explode(F.array(F.concat("t", F.lit(".total")), F.concat("t", F.lit("."), "s", F.lit("col")))).alias("storage_id"))
    where = table(spark, d, "orders").where("o_custkey % 5 < 3").select(F.concat(F.lit("sql:orders_"), (F.col("o_custkey") % 5).cast("string")).alias("t"), F.lower("o_orderstatus").alias("s")).distinct()
    known = where.select(F.explode(F.array(F.concat("t", F.lit(".total")), F.concat("t", F.lit("."), "s", F.lit("col")))).alias("storage_id"))
    return storage.reads(_sql_files(spark, d), known, there).select("storage_id", "symbol_id")


#: Columns that INSERT and UPDATE texts name; without a text the sink names the place.
_WROTE = with_sql("x_sources", "x_flows", "x_sinks") + """, own AS (SELECT f.* FROM x_flows f JOIN x_sinks k USING (sid) WHERE k.class IN ('sql.exec', 'sql_column')),
  w AS (SELECT DISTINCT fid, tid, 'sql:' || q_table || '.' || unnest(['id', q_column]) AS storage_id, f2, cwe FROM own WHERE q_table IS NOT NULL
    UNION ALL SELECT fid, tid, 'sql:unknown.' || substr(sid, 1, 8), f2, cwe FROM own WHERE q_table IS NULL) """


@query(_WROTE + "SELECT storage_id, fid AS flow_id, tid AS source_tid FROM w")
def storage_round1(spark, d):
    return storage.writes(x.flows(spark, d), x.sinks(spark, d))[1].select("storage_id", "flow_id", "source_tid")


_TAINT = _WROTE + """, t AS (SELECT storage_id, 'T-stored-' || substr(sha1(storage_id), 1, 12) AS derived_tid, list(DISTINCT tid ORDER BY tid) AS tids FROM w WHERE storage_id <> 'sql:t3.c1' GROUP BY storage_id) """


def _taint(spark, d):
    """Writes, written down once, and what they derive beside a location that is known to be tainted already."""
    relational.ensure_checkpoint_dir(spark)
    wrote = storage.writes(x.flows(spark, d), x.sinks(spark, d))[1].select("storage_id", "flow_id", "source_tid").checkpoint()
    known = spark.createDataFrame([("sql:t3.c1",)], "storage_id string").select("storage_id", ids.derived_tid("storage_id").alias("derived_tid"), F.array().cast("array<string>").alias("contributing_tids"), F.lit("definite").alias("confidence"))
    return wrote, storage.derive(wrote, known)


@query(_TAINT + "SELECT storage_id, derived_tid, array_to_string(tids, ',') AS tids FROM t")
def storage_derive(spark, d):
    return _taint(spark, d)[1].select("storage_id", "derived_tid", F.array_join("contributing_tids", ",").alias("tids"))


@query(
    _TAINT
    + """, pairs AS (SELECT DISTINCT storage_id, tid FROM w), n AS (SELECT storage_id, cwe, count(*) AS n, min(f.fid) AS seen FROM pairs JOIN x_flows f USING (tid) WHERE cwe IS NOT NULL GROUP BY ALL),
  c AS (SELECT storage_id, cwe FROM (SELECT *, row_number() OVER (PARTITION BY storage_id ORDER BY n DESC, seen) AS r FROM n) WHERE r = 1),
  l AS (SELECT storage_id, arg_min(f2, fid) AS wrote FROM w GROUP BY storage_id), rd AS (SELECT storage_id, 'read:r.js:' || length(storage_id) AS rd FROM t),
  i AS (SELECT *, 'S-r2-' || substr(sha1(storage_id || chr(31) || rd), 1, 12) AS sid FROM t JOIN rd USING (storage_id) LEFT JOIN c USING (storage_id) LEFT JOIN l USING (storage_id) LEFT JOIN x_sources s ON s.tid = t.tids[1])
  SELECT 'f-r2-' || substr(sha1(derived_tid || chr(31) || sid), 1, 12) AS fid, derived_tid AS tid, sid, coalesce(cwe, '') AS cwe, evidence_loc AS origin, wrote, rd AS read FROM i"""
)
def storage_round2(spark, d):
    wrote, taint = _taint(spark, d)
    taint = taint.checkpoint()
    reads = taint.select("storage_id", F.concat(F.lit("read:r.js:"), F.length("storage_id").cast("string")).alias("symbol_id"), F.lit(None).cast("string").alias("result_binding_id"))
    made = storage.round_two(taint, reads, wrote, x.flows(spark, d), x.sources(spark, d))
    step = lambda i: F.element_at("steps", i)["file"]
    return made.select("fid", "tid", "sid", "cwe", step(1).alias("origin"), step(2).alias("wrote"), step(3).alias("read"))


@query(
    "WITH e AS (SELECT 'd/e' || event_id || '.js' AS path, event_id % 9 + 1 AS line, CASE event_type WHEN 'click' THEN 'cache.get(`user:${' || 'id}:p' || (event_id % 4) || '`)' WHEN 'view' THEN 'queue.process(' || chr(34) || 'jobs' || chr(34) || ')' ELSE 'nothing()' END AS code FROM events),"
    " k AS (SELECT * FROM (VALUES ('cache:user:*:p1', 'cache_key', '(?i)user:[^`''\"\\s]*:p1'), ('queue:jobs', 'queue_topic', '(?i)jobs')) v(storage_id, kind, p))"
    " SELECT storage_id, 'read:' || path || ':' || line AS symbol_id FROM e JOIN k ON (kind = 'cache_key' AND code LIKE 'cache.get(%' OR kind = 'queue_topic' AND code LIKE 'queue.process(%') AND regexp_matches(code, p) WHERE NOT (storage_id = 'queue:jobs' AND line = 5)"
)
def dynamic_reads(spark, d):
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "click", F.concat(F.lit("cache.get(`user:${id}:p"), (F.col("event_id") % 4).cast("string"), F.lit("`)"))).when(F.col("event_type") == "view", 'queue.process("jobs")').otherwise("nothing()")
    files = e.select(F.concat(F.lit("d/e"), F.col("event_id").cast("string"), F.lit(".js")).alias("path"), F.concat(F.expr("repeat('\\n', cast(event_id % 9 as int))"), code).alias("content"))
    keys = spark.createDataFrame([("cache:user:*:p1", "cache_key"), ("queue:jobs", "queue_topic")], "storage_id STRING, kind STRING")
    there = e.where("event_id % 9 = 4").select(F.lit("queue:jobs").alias("storage_id"), F.format_string("read:d/e%d.js:5", "event_id").alias("symbol_id"))
    return storage.dynamic_reads(files, keys, there).select("storage_id", "symbol_id")


@query(
    "WITH e AS (SELECT 'd/e' || event_id || '.js' AS file, 2 AS line, CASE WHEN event_id % 2 = 0 THEN '  cache.get(`u:${' || 'id' || event_id || '}`)' WHEN event_id % 3 = 0 THEN 'queue.publish(\"a\" + name)' ELSE 'cache.get(\"fixed\")' END AS code FROM events)"
    " SELECT 'S-dyn' || substr(sha1(file || chr(31) || line || chr(31) || code), 1, 9) AS call_id, file, CASE WHEN contains(code, 'cache.get') THEN 'cache.get' ELSE 'queue.publish' END AS callee, trim(code) AS code_snippet, 'a' || chr(10) || code || chr(10) || 'b' AS context FROM e WHERE NOT contains(code, 'fixed')"
)
def unresolved_calls(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    code = F.when(n % 2 == 0, F.concat(F.lit("  cache.get(`u:${id"), n.cast("string"), F.lit("}`)"))).when(n % 3 == 0, 'queue.publish("a" + name)').otherwise('cache.get("fixed")')
    rows = e.select(F.concat(F.lit("d/e"), n.cast("string"), F.lit(".js")).alias("path"), F.concat(F.lit("a\n"), code, F.lit("\nb")).alias("content"))
    calls = rows.select(F.lit("call").alias("kind"), F.col("path").alias("file"), F.lit(2).alias("line"))
    return storage.unresolved_calls(calls, rows).select("call_id", "file", "callee", "code_snippet", F.array_join("context_lines", "\n").alias("context"))


@query(
    with_sql("x_flows", "x_sources", "x_sinks", "x_symbols")
    + _ENTRY.replace("WITH ", ", ", 1)
    + """, o AS (SELECT CASE WHEN line % 5 <> 0 THEN symbol_id END AS symbol_id, kind, signature, file FROM e)
  SELECT file, 'symbol' AS kind, id FROM x_symbols UNION ALL SELECT split_part(evidence_loc, ':', 1), 'source', tid FROM x_sources UNION ALL SELECT y.file, 'sink', sid FROM x_sinks JOIN x_symbols y ON y.id = symbol_id
  UNION ALL SELECT split_part(evidence_loc, ':', 1), 'flow', fid FROM x_flows JOIN x_sources USING (tid)
  UNION ALL SELECT y.file, 'entrypoint', signature || ' ' || symbol_id FROM o JOIN x_symbols y ON y.id = symbol_id UNION ALL SELECT file, 'entrypoint', signature || ' -' FROM o WHERE symbol_id IS NULL"""
)
def sidecar_records(spark, d):
    entries = findings.entrypoints(x.xrefs(spark, d)).withColumn("symbol_id", F.when(F.col("line") % 5 != 0, F.col("symbol_id")))
    rows = code_views.sidecar_records(x.symbols(spark, d), x.sources(spark, d), x.sinks(spark, d), x.flows(spark, d), entries)
    get = lambda k: F.get_json_object("record", f"$.{k}")
    return rows.select("file", "kind", F.coalesce(get("id"), F.concat_ws(" ", get("signature"), F.coalesce(get("symbol_id"), F.lit("-")))).alias("id"))


@query("SELECT url AS file, trim(unnest(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script\\s*>', 1))) AS code FROM pages")
def html_scripts(spark, d):
    rows = code_views.html_records(table(spark, d, "pages")).where("type = 'html_script'")
    return rows.select("file", F.coalesce("inline", F.lit("")).alias("code"))


@query("WITH p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS p FROM pages) SELECT p FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE starts_with(a.p, b.p || '/') AND b.p <> '') AND p <> ''")
def outermost_dirs(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]*/(.*)$", 1).alias("p")).where("p <> ''")
    return relational.outermost(rows, "p")


@query(
    "WITH f(kind, dep, framework) AS (VALUES " + ", ".join(f"('{k}', '{dep}', '{f}')" for k, dep, f in projects.FRAMEWORKS) + "),"
    " d AS (SELECT p_partkey AS project, CASE p_size % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'python' ELSE 'go' END AS kind, (['express', 'Flask>=2.0', 'x github.com/gin-gonic/gin v1', 'react-dom', 'django [extra]', 'nothing'])[p_partkey % 6 + 1] AS name FROM part)"
    " SELECT DISTINCT project, framework FROM d JOIN f USING (kind) WHERE CASE kind WHEN 'node' THEN name = dep WHEN 'python' THEN lower(trim(regexp_split_to_array(name, '[<>=!~;\\s\\[]')[1])) = dep ELSE contains(name, dep) END"
)
def framework_match(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "node").when(F.col("p_size") % 3 == 1, "python").otherwise("go")
    names = F.array(*map(F.lit, ("express", "Flask>=2.0", "x github.com/gin-gonic/gin v1", "react-dom", "django [extra]", "nothing")))
    return projects.frameworks(p.select(F.col("p_partkey").alias("project"), kind.alias("kind"), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("name")))


_TREE = "f AS (SELECT 'p' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '/sub' ELSE '' END || '/' || (['package.json', 'yarn.lock', 'package-lock.json', 'pyproject.toml', 'uv.lock', 'requirements.txt', 'a.ts'])[p_partkey % 7 + 1] AS path FROM part)"


@query(
    f"""WITH {_TREE}, g AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM f),
  n AS (SELECT 'node' AS kind, dir, 'package.json' AS manifest, 'unknown' AS package_manager FROM g WHERE name = 'package.json'),
  c AS (SELECT dir, min(CASE name WHEN 'pyproject.toml' THEN 0 ELSE 3 END) AS r FROM g WHERE name IN ('pyproject.toml', 'requirements.txt') AND dir NOT IN (SELECT dir FROM n) GROUP BY dir),
  p AS (SELECT 'python' AS kind, dir, CASE r WHEN 0 THEN 'pyproject.toml' ELSE 'requirements.txt' END AS manifest, coalesce((SELECT arg_min(m, r) FROM (VALUES ('uv.lock', 'uv', 1), ('requirements.txt', 'pip', 5)) v(l, m, r) JOIN g h ON h.name = l AND h.dir = c.dir), 'unknown') AS package_manager
    FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE starts_with(c.dir, b.dir || '/'))) SELECT *, false AS workspace_member FROM n UNION ALL SELECT *, false FROM p"""
)
def stack_detect(spark, d):
    names = F.array(*map(F.lit, ("package.json", "yarn.lock", "package-lock.json", "pyproject.toml", "uv.lock", "requirements.txt", "a.ts")))
    k = F.col("p_partkey")
    path = F.concat(F.lit("p"), (k % 40).cast("string"), F.when(k % 3 == 0, "/sub").otherwise(""), F.lit("/"), F.element_at(names, (k % 7 + 1).cast("int")))
    return projects.detect(table(spark, d, "part").select(path.alias("path")).distinct())


@query("SELECT l_returnflag AS step, count(*) AS calls, sum(l_partkey)::BIGINT AS input_tokens, sum(l_suppkey)::BIGINT AS output_tokens, round(sum(l_discount), 6) AS total_usd FROM lineitem GROUP BY 1")
def cost_ledger(spark, d):
    li = table(spark, d, "lineitem")
    calls = li.select(F.col("l_returnflag").alias("step"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_discount").alias("usd"))
    return reports.cost_ledger(calls, ["step"]).withColumn("total_usd", F.round("total_usd", 6))


@query("SELECT (SELECT count(*) FROM events) AS nominations, (SELECT count(*) FROM events WHERE event_type = 'click') AS accepted, (SELECT count(*) FROM orders) AS findings, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS verified")
def artefact_counts(spark, d):
    n = table(spark, d, "events").select(F.when(F.col("event_type") == "click", "y").alias("decision"))
    return reports.artefact_counts(n, table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "verified").alias("status")))


@query("SELECT o_custkey AS run, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_run(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("latest"), "o_orderdate")
    return relational.latest(rows.withColumn("k", F.col("latest")), ["run"], ["o_orderdate", "k"]).select("run", "latest")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 300 AS src, l_suppkey % 300 AS dst FROM lineitem), r(root, node, steps) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT root, dst, steps + 1 FROM r JOIN e ON src = node WHERE steps < 2) SELECT root::BIGINT AS root, node::BIGINT AS node, min(steps) AS steps FROM r GROUP BY 1, 2"
)
def reachability(spark, d):
    edges = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("src"), (F.col("l_suppkey") % 300).alias("dst")).distinct()
    return relational.reachable(edges, edges.select(F.col("src").alias("node")).distinct(), 2)

