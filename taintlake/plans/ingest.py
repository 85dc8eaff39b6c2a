"""Queries for readers, renderers and rules over records that are made of the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import graph_rules
from ..operators import findings, graph_calls, projects, reports, storage
from ..sources import files, records
from . import relations as x
from .navigation import _ENTRY
from .relations import _list, table, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _sha(*parts: str) -> str:
    return f"substr(sha1(concat_ws('|', {', '.join(parts)})), 1, 16)"


#: A SARIF document for each order; each line is a result, of two steps or, where its number is 7, without a code flow.
_SARIF = f"""WITH r AS (SELECT 'js/r' || (l_suppkey % 9) AS rule, CASE WHEN l_suppkey % 9 < 8 THEN 'CWE-' || (l_suppkey % 9 + 70) END AS cwe, '/r/a' || (l_partkey % 50) || '.js' AS f1, l_linenumber + 1 AS n1,
    CASE WHEN l_linenumber = 7 THEN '/r/a' || (l_partkey % 50) || '.js' ELSE '/r/b' || (l_orderkey % 90) || '.js' END AS f2, CASE WHEN l_linenumber = 7 THEN l_linenumber + 1 ELSE l_suppkey END AS n2, l_linenumber = 7 AS one FROM lineitem),
  i AS (SELECT *, 'src:' || {_sha("'p'", "f1", "n1", "rule")} AS tid, 'sink:' || {_sha("'p'", "f2", "n2", "rule")} AS sid FROM r),
  f AS (SELECT DISTINCT 'flow:' || {_sha("'p'", "tid", "sid", "rule")} AS fid, tid, sid, cwe, f1 || ':' || n1 AS origin, f2 || ':' || n2 AS sink, rule FROM i) """


def _sarif(spark, d, **options):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    place = lambda f, line: F.struct(F.struct(f.alias("uri")).alias("artifactLocation"), F.struct(line.cast("int").alias("startLine")).alias("region"))
    first, last = place(F.concat(F.lit("a"), (F.col("l_partkey") % 50).cast("string"), F.lit(".js")), n + 1), place(F.concat(F.lit("file:///r/b"), (F.col("l_orderkey") % 90).cast("string"), F.lit(".js")), F.col("l_suppkey"))
    step = lambda p: F.struct(F.struct(p.alias("physicalLocation")).alias("location"))
    flow = F.array(F.struct(F.array(F.struct(F.array(step(first), step(last)).alias("locations"))).alias("threadFlows")))
    result = F.struct(F.concat(F.lit("js/r"), (F.col("l_suppkey") % 9).cast("string")).alias("ruleId"), F.array(F.struct(first.alias("physicalLocation"))).alias("locations"), F.when(n != 7, flow).alias("codeFlows"))
    tags = lambda i: F.array(F.lit("security"), F.lit(f"external/cwe/cwe-0{i + 70}")) if i < 8 else F.array(F.lit("security"))
    rules = F.array(*[F.struct(F.lit(f"js/r{i}").alias("id"), F.struct(tags(i).alias("tags")).alias("properties")) for i in range(9)])
    run = F.struct(F.struct(F.struct(rules.alias("rules")).alias("driver")).alias("tool"), F.collect_list(result).alias("results"))
    text = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array(run).alias("runs"))).alias("t"))
    return records.sarif_rows(text.select(F.from_json("t", schemas.SARIF).alias("d")).select("d.*"), "p", "/r", "codeql", **options)


@query(_SARIF + "SELECT fid, tid, sid, cwe FROM f")
def sarif_flows(spark, d):
    return _sarif(spark, d)["flows"].select("fid", "tid", "sid", "cwe")


@query(_SARIF + "SELECT DISTINCT tid, f1 || ':' || n1 AS evidence_loc, min(CASE WHEN one THEN 'pattern' ELSE rule END) AS class FROM i GROUP BY ALL HAVING count(DISTINCT one) = 1")
def sarif_sources(spark, d):
    """Sources whose results are all with, or all without, a code flow (else either class may stay)."""
    found = _sarif(spark, d, distinct=False)["taint_sources"].select("tid", "evidence_loc", "class").distinct()
    one = F.col("class").eqNullSafe(F.lit("pattern"))
    return found.groupBy("tid", "evidence_loc").agg(F.any_value("class").alias("class"), F.every(one).alias("all"), F.some(one).alias("some")).where("all = some").drop("all", "some")


def _lines(df: DataFrame, *columns) -> DataFrame:
    """As lines of JSON, with a broken one for each of them."""
    good = df.select(F.to_json(F.struct(*columns)).alias("value"))
    return good.unionByName(good.select(F.concat(F.lit("{"), "value").alias("value")))


_GRAPH = """WITH r AS (SELECT event_id AS n, 'a' || (event_id % 40) || '.js' AS sf, event_id % 300 AS sl, 'b' || (event_id % 30) || '.js' AS kf, event_id % 200 AS kl, 'CWE-' || (event_id % 7) AS cwe, event_type AS name FROM events)"""


@query(_GRAPH + f" SELECT 'joern-' || substr(sha1(sf || ':' || sl || ':' || kf || ':' || kl || ':' || cwe), 1, 16) AS fid, 'src:' || {_sha("'/r/' || sf", 'sl', 'name')} AS tid, cwe, '/r/' || sf AS source, '/r/' || kf AS sink FROM r GROUP BY ALL")
def graph_flow_records(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    file = lambda p, k: F.concat(F.lit(p), (n % k).cast("string"), F.lit(".js"))
    rows = _lines(e, file("a", 40).alias("source_file"), (n % 300).alias("source_line"), file("b", 30).alias("sink_file"), (n % 200).alias("sink_line"), F.col("event_type").alias("source_name"), F.lit("k").alias("sink_name"), F.concat(F.lit("CWE-"), (n % 7).cast("string")).alias("cwe"))
    made = records.graph_flow_rows(records.from_lines(rows, schemas.GRAPH_FLOWS), "/r", distinct=False)["flows"]
    return made.select("fid", "tid", "cwe", F.col("steps")[0]["file"].alias("source"), F.col("steps")[1]["file"].alias("sink")).distinct()


@query(f"WITH r AS (SELECT o_orderkey AS n, 'm' || (o_custkey % 60) || '.js' AS f, o_orderkey % 500 AS l FROM orders) SELECT 'O-' || n AS fid, 'T:' || {_sha('f', 'l', chr(39) + 'http' + chr(39))} AS tid, CASE WHEN n % 3 = 0 THEN 'llm-suggested' ELSE 'inferred' END AS confidence, 'llm-heavy' AS engine, 2 AS steps FROM r")
def model_flow_records(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    file = F.concat(F.lit("m"), (F.col("o_custkey") % 60).cast("string"), F.lit(".js"))
    end = F.struct(file.alias("file"), (n % 500).alias("line"), F.lit("http").alias("class"))
    step = F.struct(file.alias("file"), F.lit(1).alias("line"))
    rows = _lines(o, F.concat(F.lit("O-"), n.cast("string")).alias("fid"), F.when(n % 3 == 0, "llm-suggested").alias("confidence"), end.alias("source"), end.alias("sink"), F.array(step, step).alias("steps"))
    return records.model_flow_rows(records.from_lines(rows, schemas.MODEL_FLOWS))["flows"].select("fid", "tid", "confidence", "engine", F.size("steps").alias("steps"))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'scip:' || p_partkey ELSE 's' || p_partkey END AS id, 'f' || (p_partkey % 90) || '.ts' AS file, p_partkey AS range_start, p_partkey + p_size AS range_end, p_name AS display_name FROM part WHERE p_partkey % 5 <> 0")
def ast_symbols(spark, d):
    """Records of symbols, some without an id, whose ids a second index betters by place."""
    p, n = table(spark, d, "part"), F.col("p_partkey")
    file = F.concat(F.lit("f"), (n % 90).cast("string"), F.lit(".ts")).alias("file")
    rows = _lines(p, F.lit("symbol").alias("type"), file, F.lit("function").alias("kind"), F.col("p_name").alias("name"), F.array(n, n + F.col("p_size")).alias("range"), F.when(n % 5 != 0, F.concat(F.lit("s"), n.cast("string"))).alias("syntheticId"))
    names = p.where(n % 4 == 0).where(n % 5 != 0).select(file, n.cast("int").alias("start"), (n + F.col("p_size")).cast("int").alias("end"), F.concat(F.lit("scip:"), n.cast("string")).alias("symbol"))
    return records.ast_rows(records.from_lines(rows, schemas.AST), "p", names)["symbols"].select("id", "file", "range_start", "range_end", "display_name")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'S' || (event_id % 40) END AS caller_id, 'f' || (event_id % 9) || '.ts' AS file, event_id AS line, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'mod') AS callee_text FROM events")
def ast_xrefs(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    rows = _lines(e, F.lit("xref").alias("type"), F.concat(F.lit("f"), (n % 9).cast("string"), F.lit(".ts")).alias("file"), n.alias("line"), F.lit("call").alias("kind"), F.when(n % 2 == 0, F.concat(F.lit("S"), (n % 40).cast("string"))).alias("callerSyntheticId"), F.when(n % 3 != 0, F.col("event_type")).alias("calleeText"), F.lit("mod").alias("moduleSpecifier"))
    return records.ast_rows(records.from_lines(rows, schemas.AST), "p")["xrefs"].select("caller_id", "file", "line", "callee_text")


CALLS = ("send", "query", "Exec", "readFile", "executeQuery", "eval", "ECHO", "where", "open", "Popen", "Decode", "doc", "Start", "html_safe", "nothing")
CODES = ("res.send(a)", "queue.send(a)", "req.body.x", "$_GET['a']", "c.Query(\"a\")", "params[:a]", "request.args.get", "getParameter(a)", "x")
LANGS = ("javascript", "Python", "java", "golang", "php", "rubysrc", "csharp", "kotlin", "odd")


def _calls(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return e.select(n.alias("id"), pick(LANGS, n % len(LANGS)).alias("language"), F.concat(F.lit("f"), (n % 20).cast("string")).alias("file"), n.alias("line"), pick(CALLS, F.floor(n / 9) % len(CALLS)).alias("name"), pick(CODES, F.floor(n / 7) % len(CODES)).alias("code"))


_CALLS = f"""c AS (SELECT event_id AS id, CASE lower(g) WHEN 'golang' THEN 'go' WHEN 'rubysrc' THEN 'ruby' WHEN 'odd' THEN 'javascript' ELSE lower(g) END AS language, 'f' || (event_id % 20) AS file, event_id AS line, name, code
  FROM (SELECT event_id, ({_list(LANGS)})[event_id % {len(LANGS)} + 1] AS g, ({_list(CALLS)})[(event_id // 9) % {len(CALLS)} + 1] AS name, ({_list(CODES)})[(event_id // 7) % {len(CODES)} + 1] AS code FROM events))"""
_RULES = "r(language, cwe, class, names) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{e}')" for a, b, c, e in graph_rules.rules()) + ")"
_SINKS = f"k AS (SELECT DISTINCT id, file, line, cwe, class AS sink_class, language FROM c JOIN r USING (language) WHERE regexp_matches(name, '(?i)^(?:' || names || ')$') AND (class <> 'html.write' OR language = 'python' OR regexp_matches(code, '{graph_rules.RECEIVER}')))"
_SOURCES = "s AS (SELECT id, file, line FROM c WHERE " + " OR ".join(f"language = '{g}' AND regexp_matches(code, '{graph_rules.source_pattern(g)}')" for g in graph_rules.SOURCES) + ")"


@query(f"WITH {_CALLS}, {_RULES}, {_SINKS} SELECT id, cwe, sink_class FROM k")
def graph_sinks(spark, d):
    return graph_calls.sink_calls(_calls(spark, d)).select("id", "cwe", "sink_class")


@query(f"WITH {_CALLS}, {_SOURCES} SELECT id, file, line FROM s")
def graph_sources(spark, d):
    return graph_calls.source_calls(_calls(spark, d)).select("id", "file", "line")


@query(
    f"WITH {_CALLS}, {_RULES}, {_SINKS}, {_SOURCES}, t AS (SELECT DISTINCT file, line, cwe FROM k WHERE id % 3 = 0), o AS (SELECT DISTINCT file, line, cwe FROM k WHERE language NOT IN ('python', 'java', 'go') EXCEPT SELECT * FROM t),"
    " p AS (SELECT o.file, o.line, o.cwe, s.line AS source_line, row_number() OVER (PARTITION BY o.file, o.line, o.cwe ORDER BY abs(o.line - s.line), s.line) AS n FROM o JOIN s USING (file) WHERE abs(o.line - s.line) <= 200) SELECT file, line AS sink_line, cwe, source_line FROM p WHERE n = 1"
)
def graph_near_flows(spark, d):
    calls = _calls(spark, d)
    traced = graph_calls.sink_calls(calls.where("id % 3 = 0")).select(F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), "cwe")
    return graph_calls.near_flows(calls, traced).select(F.col("sink_file").alias("file"), "sink_line", "cwe", "source_line")


@query(
    "SELECT 'e' || event_id || '.ts' AS path, CASE WHEN event_id % 4 = 1 THEN 2 ELSE 1 END AS line FROM events WHERE event_id % 4 < 2"
)
def secret_compares(spark, d):
    """A secret compared where it stands, or by a name; in constant time; and something else compared."""
    e, n = table(spark, d, "events"), F.col("event_id") % 4
    code = F.when(n == 0, "if (given !== process.env['KEY']) {}").when(n == 1, "const key = process.env.KEY;\nif (key == given) {}").when(n == 2, "if (timingSafeEqual(a, b) === true) {}").otherwise("let key = 1;\nif (key == given) {}")
    return graph_calls.secret_compares(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".ts")).alias("path"), code.alias("content"))).select("path", "line")


_ENDS = (".kt", ".java", ".py", ".ts", ".kts", ".txt", ".yml")
_PATHS = f"f AS (SELECT 'p' || (p_partkey % 30) AS project, (['src', 'node_modules', 'build', 'lib'])[p_partkey % 4 + 1] || '/x' || p_partkey || ({_list(_ENDS)})[(p_partkey // 3) % 7 + 1] AS path, p_size AS size FROM part)"


def _tree(spark, d):
    p, n = table(spark, d, "part"), F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return p.select(F.concat(F.lit("p"), (n % 30).cast("string")).alias("project"), F.concat(pick(("src", "node_modules", "build", "lib"), n % 4), F.lit("/x"), n.cast("string"), pick(_ENDS, F.floor(n / 3) % 7)).alias("path"), F.col("p_size").alias("size"))


@query(
    f"WITH {_PATHS}, l AS (SELECT project, CASE regexp_extract(path, '[.][a-z]+$') WHEN '.kt' THEN 'kotlin' WHEN '.kts' THEN 'kotlin' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.yml' THEN 'yaml' END AS language FROM f),"
    " j AS (SELECT project, CASE WHEN count(*) FILTER (language = 'kotlin') > count(*) FILTER (language = 'java') THEN 'kotlin' WHEN count(*) FILTER (language = 'java') > 0 THEN 'java' END AS jvm FROM l GROUP BY project)"
    " SELECT project, language, count(*) AS files, any_value(jvm) AS jvm FROM l JOIN j USING (project) WHERE language IS NOT NULL GROUP BY project, language"
)
def files_per_language(spark, d):
    return projects.files_per_language(_tree(spark, d), ["project"])


_FILE_LISTS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, path FROM f WHERE ({' OR '.join(f'''ends_with(path, '{e}')''' for e in ends)}) AND NOT list_has_any(string_split(path, '/'), {_list(skip)})" for kind, (ends, skip) in files.FILE_LISTS.items()
)


@query(f"WITH {_PATHS} {_FILE_LISTS}")
def file_lists(spark, d):
    return files.file_lists(_tree(spark, d))


@query(f"WITH {_PATHS}, a AS (SELECT project || '/' || path AS path, size FROM f), b AS (SELECT unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS folder, size FROM a) SELECT folder, count(*) AS files, sum(size)::BIGINT AS size FROM b GROUP BY folder")
def folder_sizes(spark, d):
    return files.folder_sizes(_tree(spark, d).select(F.concat_ws("/", "project", "path").alias("path"), "size"))


@query(f"WITH {_PATHS}, l AS (SELECT project AS dir, list_sort(list(DISTINCT CASE regexp_extract(path, '[.][a-z]+$') WHEN '.kt' THEN 'kotlin' WHEN '.kts' THEN 'kotlin' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.yml' THEN 'yaml' END) FILTER (path NOT LIKE '%.txt')) AS l FROM f GROUP BY project) SELECT dir, array_to_string(l, ',') AS languages, CASE WHEN list_has_any(l, ['java', 'kotlin']) THEN 'java' END AS analyzed FROM l")
def project_languages(spark, d):
    tree = _tree(spark, d)
    own = projects.project_languages(tree.select(F.lit("java").alias("kind"), F.col("project").alias("dir")).distinct(), tree.select(F.concat_ws("/", "project", "path").alias("path")))
    return own.select("dir", F.array_join("languages", ",").alias("languages"), projects.analyzed_language(F.col("kind"), F.col("languages")).alias("analyzed"))


@query(f"WITH {_PATHS} SELECT project, path, CASE WHEN project < 'p2' THEN 'in/' || path ELSE split_part(path, '/', 2) END || '.enrich.jsonl' AS sidecar FROM f")
def sidecar_paths(spark, d):
    file = F.concat(F.when(F.col("project") < "p2", "/root/in/").otherwise("/other/"), "path")
    return _tree(spark, d).select("project", "path", files.sidecar_path(file, "/root").alias("sidecar"))


@query("SELECT 'F' || o_orderkey AS finding_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'CWE-' || (o_orderkey % 99) END AS cwe, (['verified', 'rejected', 'unverified'])[o_orderkey % 3 + 1] AS status, 'it''s ' || o_orderpriority AS title, 'body' || chr(10) || '---' || chr(10) || o_orderstatus AS body FROM orders")
def finding_documents(spark, d):
    """Written as documents, and read back."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("verified", "rejected", "unverified"))), (n % 3 + 1).cast("int"))
    rows = o.select(F.concat(F.lit("F"), n.cast("string")).alias("finding_id"), F.lit("N").alias("nomination_id"), F.lit("f").alias("flow_id"), F.when(n % 4 != 0, F.concat(F.lit("CWE-"), (n % 99).cast("string"))).alias("cwe"), status.alias("status"), F.concat(F.lit("it's "), "o_orderpriority").alias("title"), F.concat(F.lit("body\n---\n"), "o_orderstatus").alias("body"))
    back = reports.finding_markdown(rows).select(*[c.alias(k) for k, c in records.finding(F.col("markdown")).items()])
    return back.select("finding_id", "cwe", "status", "title", "body")


@query("SELECT '# Findings queue' || chr(10, 10) || string_agg('- [ ] N' || s_suppkey || ' | p | ' || s_name || ' | f:' || s_nationkey, chr(10) ORDER BY s_suppkey) || chr(10) AS markdown FROM supplier".replace("chr(10, 10)", "chr(10) || chr(10)"))
def queue_document(spark, d):
    s = table(spark, d, "supplier")
    return reports.queue_markdown(s.select(F.col("s_suppkey").alias("n"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("p").alias("project"), F.col("s_name").alias("vector"), F.concat(F.lit("f:"), F.col("s_nationkey").cast("string")).alias("loc")), "n")


@query("SELECT 'N' || s_suppkey AS id, 'p q' AS project, s_name AS vector, 'f:' || s_nationkey AS loc FROM supplier")
def queue_items(spark, d):
    s = table(spark, d, "supplier")
    lines = s.select(F.format_string("- [ ] N%d | p q | %s | f:%d", "s_suppkey", "s_name", "s_nationkey").alias("value")).unionByName(s.select(F.concat(F.lit("# "), "s_name").alias("value")))
    return records.queue(lines)


@query(
    _ENTRY
    + """, o AS (SELECT *, list_position(['http_route', 'listener', 'cron', 'cli', 'message_consumer'], kind) AS k FROM e WHERE kind IN ('http_route', 'listener', 'cron', 'cli', 'message_consumer')),
  g AS (SELECT k, '## ' || kind || chr(10) || chr(10) || string_agg('- `' || signature || '` at `' || file || ':' || line || '`', chr(10) ORDER BY file, line, signature, symbol_id) || chr(10) AS t FROM o GROUP BY k, kind)
  SELECT '# Entrypoints: events' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY k) AS markdown FROM g"""
)
def entrypoints_document(spark, d):
    return reports.entrypoints_markdown(findings.ordered_entrypoints(findings.entrypoints(x.xrefs(spark, d))), "events")


@query(
    _ENTRY
    + """, y AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pages/api/u' || (event_id % 50) || '.ts' WHEN 1 THEN 'app/routes/r' || (event_id % 40) || '.tsx' ELSE 'src/x.ts' END AS file, CASE WHEN event_id % 2 = 0 THEN 'loader' ELSE 'other' END AS name, event_id % 30 + 1 AS line FROM events)
  SELECT kind, signature, file, line FROM e
  UNION ALL SELECT DISTINCT 'http_route', 'next:' || split_part(file, '/', 3), file, 1 FROM y WHERE file LIKE 'pages/%'
  UNION ALL SELECT 'http_route', 'remix:' || split_part(file, '/', 3), file, arg_min(line, id) FROM y WHERE file LIKE 'app/%' AND name = 'loader' GROUP BY file"""
)
def all_entrypoints(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    file = F.when(n % 3 == 0, F.format_string("pages/api/u%d.ts", n % 50)).when(n % 3 == 1, F.format_string("app/routes/r%d.tsx", n % 40)).otherwise("src/x.ts")
    symbols = e.select(n.cast("string").alias("id"), file.alias("file"), F.when(n % 2 == 0, "loader").otherwise("other").alias("display_name"), (n % 30 + 1).cast("int").alias("range_start"), n.alias("ord"))
    return findings.all_entrypoints(x.xrefs(spark, d), symbols).select("kind", "signature", "file", "line")


@query("WITH p AS (SELECT event_id AS n, 'cache:k' || (event_id % 300) AS storage_id, event_type AS kind, (event_id % 10) / 10.0 AS confidence FROM events) SELECT storage_id, arg_min(kind, n) AS kind FROM p WHERE confidence >= 0.4 AND storage_id <> 'cache:k7' GROUP BY 1 UNION ALL SELECT 'cache:k7', 'own'")
def merged_proposals(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    rows = _lines(e, n.cast("string").alias("call_id"), F.concat(F.lit("cache:k"), (n % 300).cast("string")).alias("storage_id"), F.col("event_type").alias("kind"), ((n % 10) / 10).alias("confidence"))
    proposals = records.from_lines(rows, schemas.PROPOSALS).withColumn("ord", F.col("call_id").cast("bigint"))
    known = spark.createDataFrame([("cache:k7", "own", 1.0, "", "")], "storage_id string, kind string, confidence double, rationale string, call_id string")
    return storage.merge_proposals(known, proposals).select("storage_id", "kind")


@query("SELECT event_id::VARCHAR AS id, event_type AS content, row_number() OVER (ORDER BY ts DESC, event_id::VARCHAR DESC) AS n FROM events WHERE user_id % 40 = 3 AND event_id % 7 <> 0")
def notes_of_a_symbol(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    notes = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 40).cast("string")).alias("symbol_id"), F.col("event_type").alias("content"), "ts")
    gone = e.where("event_id % 7 = 0").select(F.col("event_id").cast("string").alias("id"))
    return findings.visible_notes(notes, "S3", gone).select("id", "content", F.row_number().over(W.orderBy(F.desc("ts"), F.desc("id"))).alias("n"))
