"""Queries for the scalar functions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import reports, taxonomy
from ..sources import records
from .relations import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'CWE-' || (event_id % 900) WHEN event_id % 4 = 1 THEN 'CWE-' || (event_id % 50) END AS cwe FROM events"
)
def cwe_extract(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    rule = F.when(n % 4 == 0, F.concat(F.lit("js/cwe-0"), (n % 900).cast("string"))).otherwise("js/rule")
    tags = F.when(n % 4 == 1, F.array(F.lit("security"), F.concat(F.lit("external/CWE/cwe-00"), (n % 50).cast("string")))).when(n % 4 == 2, F.array(F.lit("x")))
    return e.select("event_id", text.cwe_of(rule, tags).alias("cwe"))


@query(
    """SELECT o_orderkey, 'src:' || substr(sha1(o_orderkey || '|' || o_orderstatus || '|' || '' || '|' || o_custkey), 1, 16) AS stable, 'S-r2-' || substr(sha1(o_orderstatus || chr(31) || o_custkey), 1, 12) AS row_id,
  'T-stored-' || substr(sha1(o_orderpriority), 1, 12) AS tid, 'synthetic:' || substr(sha1('f.js|function|' || o_orderstatus || '|' || o_orderkey), 1, 12) AS sym, 'joern-' || substr(sha1('a.js:' || o_orderkey || ':b.js:2:CWE-1'), 1, 16) AS fid, 'S-dyn' || substr(sha1('a.js' || chr(31) || o_orderkey || chr(31) || 'x'), 1, 9) AS call FROM orders"""
)
def stable_ids(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", ids.stable_id("src", "o_orderkey", "o_orderstatus", F.lit(None), "o_custkey").alias("stable"), ids.storage_row_id("S-r2-", "o_orderstatus", "o_custkey").alias("row_id"), ids.derived_tid("o_orderpriority").alias("tid"),
        ids.synthetic_symbol_id(F.lit("f.js"), F.lit("function"), "o_orderstatus", "o_orderkey").alias("sym"), ids.graph_flow_id(F.lit("a.js"), "o_orderkey", F.lit("b.js"), F.lit(2), F.lit("CWE-1")).alias("fid"),
        ids.unresolved_call_id(F.lit("a.js"), "o_orderkey", F.lit("x")).alias("call"),
    )


@query(
    """SELECT p_partkey, CASE WHEN len(p_name || p_type) <= 20 THEN p_name || p_type ELSE (p_name || p_type)[1:19] || '…' END AS label, 'src_' || regexp_replace(p_brand || ':' || p_type, '[^A-Za-z0-9]', '_', 'g') AS node,
  CASE WHEN p_partkey * 37 < 1024 THEN (p_partkey * 37) || ' B' WHEN p_partkey * 37 < 1048576 THEN printf('%.1f KB', p_partkey * 37 / 1024.0) ELSE printf('%.1f MB', p_partkey * 37 / 1048576.0) END AS size FROM part"""
)
def labels_and_sizes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.short_label(F.concat("p_name", "p_type"), 20).alias("label"), text.dot_id("src", F.concat_ws(":", "p_brand", "p_type")).alias("node"), text.human_size(F.col("p_partkey") * 37).alias("size"))


_NAMES = ("a.ts", "b.py", "c.kt", "d.rb", "e.html", "f.unknown", "dir/g.razor", "h.yml")


@query(
    f"""WITH n AS (SELECT event_id, ({_sql_list(_NAMES)})[event_id % 8 + 1] AS f FROM events), l AS (SELECT *, CASE regexp_extract(f, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'kt' THEN 'kotlin' WHEN 'rb' THEN 'ruby' WHEN 'html' THEN 'html' WHEN 'razor' THEN 'csharp' WHEN 'yml' THEN 'yaml' ELSE '' END AS fence FROM n)
  SELECT event_id, fence, CASE WHEN fence IN ('python', 'ruby', 'bash', 'yaml') THEN '#' WHEN fence = 'html' THEN '<!--' ELSE '//' END AS mark, f AS file, event_id % 100 AS line FROM l"""
)
def fences_and_locations(spark, d):
    f = _pick(_NAMES, F.col("event_id") % 8)
    loc = F.concat(f, F.lit(":"), (F.col("event_id") % 100).cast("string"))
    fence = text.language_fence(f)
    return table(spark, d, "events").select("event_id", fence.alias("fence"), text.comment_marker(fence).alias("mark"), text.file_of(loc).alias("file"), text.line_of(loc).alias("line"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_json(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT").alias("p"))
    return e.select("event_id", "p.k")


_LINES = ("- [ ] N-{n} | proj | sqli | src/a.js:{n} | rec: high | y/n: ", "- [x] N-{n} | p 2 | xss | b.py:{n} | rec: low | y/n: n", "- [!] N-{n} | p | idor | c | rec: med | y/n:y  ", "## Stream B", "- [ ] bad line")


@query(
    "WITH l AS (SELECT event_id AS n, CASE event_id % 5 WHEN 0 THEN '- [ ] N-' || event_id || ' | proj | sqli | src/a.js:' || event_id || ' | rec: high | y/n: ' WHEN 1 THEN '- [x] N-' || event_id || ' | p 2 | xss | b.py:' || event_id || ' | rec: low | y/n: n' WHEN 2 THEN '- [!] N-' || event_id || ' | p | idor | c | rec: med | y/n:y  ' ELSE '' END AS v FROM events)"
    " SELECT n, 'N-' || n AS id, v[4:4] AS mark, trim(split_part(v, '|', 2)) AS project, trim(split_part(v, '|', 3)) AS vector, trim(split_part(v, '|', 4)) AS loc, split_part(split_part(v, 'rec: ', 2), ' ', 1) AS rec, trim(split_part(v, 'y/n:', 2)) AS decision,"
    " CASE WHEN n % 5 = 0 THEN rtrim(v) || ' y' ELSE v END AS yes FROM l WHERE v <> ''"
)
def nomination_parse(spark, d):
    n = F.col("event_id")
    lines = [F.replace(F.lit(t), F.lit("{n}"), n.cast("string")) for t in _LINES]
    e = table(spark, d, "events").select(n.alias("n"), F.element_at(F.array(*lines), (n % 5 + 1).cast("int")).alias("v"))
    return e.select("n", *text.nomination(F.col("v")), text.say_yes(F.col("v")).alias("yes")).where("id <> ''")


@query(
    "WITH l AS (SELECT event_id AS n, event_id % 6 AS k FROM events) SELECT n, CASE k WHEN 0 THEN 'verified' WHEN 1 THEN 'rejected' WHEN 2 THEN 'poc_inconclusive' WHEN 3 THEN CASE WHEN n % 4 = 3 THEN 'verified' WHEN n % 8 = 1 THEN 'rejected' ELSE 'poc_inconclusive' END WHEN 4 THEN CASE WHEN n % 8 = 0 THEN 'rejected' ELSE 'poc_inconclusive' END ELSE 'verified' END AS status FROM l"
)
def verdict_status(spark, d):
    n = F.col("event_id")
    out = ('x {"verdict": "vulnerable", "n": 1}', '{"verdict": "vulnerable"} {"verdict": "Not_Vulnerable"}', '{"verdict": "inconclusive"}', "OK", '{"verdict": "other"}', '{"a": 1} {"verdict": "vulnerable"} {bad}')
    e = table(spark, d, "events").select(n.alias("n"), _pick(out, n % 6).alias("out"))
    return e.select("n", text.finding_status(F.col("out"), (F.col("n") % 6 == 3) & (F.col("n") % 4 == 3), (F.col("n") % 4).cast("int") - F.when(F.col("n") % 8 == 1, 1).otherwise(0), F.col("n") % 8 == 4).alias("status"))


@query(
    "WITH l AS (SELECT event_id AS n, (['ok', 'HTTP 429 now', 'Rate-Limit hit', 'error 401', 'fine', 'Please LOGIN'])[event_id % 6 + 1] AS s, (['apiVersion: v1', 'x: y', 'kind: Pod', 'a' || repeat('b', 300) || 'kind: Pod'])[event_id % 4 + 1] AS y FROM events) SELECT n, n % 6 IN (1, 2, 3, 5) AS trouble, n % 4 IN (0, 2) AS cluster FROM l"
)
def keyword_checks(spark, d):
    n = F.col("event_id")
    e = table(spark, d, "events").select(n.alias("n"), _pick(("ok", "HTTP 429 now", "Rate-Limit hit", "error 401", "fine", "Please LOGIN"), n % 6).alias("s"), _pick(("apiVersion: v1", "x: y", "kind: Pod", "a" + "b" * 300 + "kind: Pod"), n % 4).alias("y"))
    return e.select("n", text.is_rate_or_auth(F.col("s")).alias("trouble"), text.is_cluster_manifest(F.col("y")).alias("cluster"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '--' || CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' ELSE 'informational' END || '--' || CASE o_orderkey % 3 WHEN 0 THEN 'sqli' WHEN 1 THEN 'info-disclosure' ELSE 'unknown' END || '--' || CASE o_orderkey % 2 WHEN 0 THEN 'a.b' ELSE 'unknown' END || '.md' AS report FROM orders"
)
def report_names(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("day"), F.when(k % 3 == 0, "CWE-89").when(k % 3 == 1, "CWE-200").alias("cwe"), F.lit("title").alias("title"), F.when(k % 2 == 0, "see src/x/a.b.js:12 and c.py").otherwise("no path").alias("body"))
    return reports.report_metadata(o).select("o_orderkey", "report")


@query("SELECT o_orderkey, date_diff('second', o_orderdate, TIMESTAMP '1996-01-01') // 86400 >= 7 AS stale FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def stale_checks(spark, d):
    o = table(spark, d, "orders").where("o_orderdate < timestamp_ntz '1996-01-01'")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", taxonomy.is_stale(at, F.lit("1996-01-01").cast("timestamp")).alias("stale"))


@query("SELECT DISTINCT 'security/cwe/cwe-0' || (event_id % 40) AS tag, 'CWE-' || (event_id % 40) AS cwe FROM events WHERE event_id % 40 >= 20")
def missing_tags(spark, d):
    e = table(spark, d, "events")
    tag = F.concat(F.lit("security/cwe/cwe-0"), (F.col("event_id") % 40).cast("string"))
    texts = e.select(F.concat(F.lit("@tags "), tag, F.lit("\n quality")).alias("content"))
    return taxonomy.missing_tags(texts, e.where("event_id % 40 < 20").select(tag.alias("tag")))


@query("SELECT DISTINCT 'CWE-' || (p_size % 9) AS cwe, 'hint ' || (SELECT min(q.p_partkey) FROM part q WHERE q.p_size % 9 = part.p_size % 9 AND q.p_partkey % 3 = 0) AS hint FROM part WHERE p_partkey % 3 = 0")
def hints_for_cwe(spark, d):
    p = table(spark, d, "part")
    classes = p.select(F.array(F.concat(F.lit("CWE-"), (F.col("p_size") % 9).cast("string"))).alias("cwes"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.lit("hint "), F.col("p_partkey").cast("string")))).otherwise(F.array().cast("array<string>")).alias("hints"))
    return taxonomy.hints_by_cwe(classes).select("cwe", F.element_at("hints", 1).alias("hint"))


@query("SELECT event_id AS n, user_id AS a, CASE WHEN event_id % 3 = 0 THEN event_type END AS b FROM events WHERE event_id % 5 <> 0")
def json_lines(spark, d):
    n = F.col("event_id")
    row = F.struct(n.alias("n"), F.col("user_id").alias("a"), F.when(n % 3 == 0, F.col("event_type")).alias("b"))
    line = F.when(n % 10 == 0, "").when(n % 5 == 0, '{"n": 1, "a"').otherwise(F.to_json(row))
    return records.from_lines(table(spark, d, "events").select(line.alias("value")), "n BIGINT, a BIGINT, b STRING")
