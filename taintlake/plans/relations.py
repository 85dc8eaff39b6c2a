"""The index relations over the driver's tables, in DataFrames and in SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: an order line is a place, its return flag the engine that found it."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")]
    m = F.col("l_orderkey") % 8
    cwe = F.when(m == 0, F.when(F.col("l_partkey") % 2 == 0, F.lit(None)).otherwise("")).otherwise(F.concat(F.lit("CWE-"), F.element_at(F.array(*map(F.lit, (22, 78, 79, 89, 94, 200, 9999))), m.cast("int"))))
    engine = F.when(F.col("l_returnflag") == "A", "codeql").when(F.col("l_returnflag") == "N", "semgrep").otherwise("joern")
    n = F.col("l_linenumber") % 4
    confidence = F.when((F.col("l_linestatus") == "F") & (n == 0), "definite").when(n == 1, "inferred").when(n == 2, "llm-suggested").otherwise("unknown")
    file = F.concat(F.lit("src/f"), (F.col("l_orderkey") % 100).cast("string"), F.lit(".js"))
    null = F.lit(None).cast("string")
    table_name, column = F.concat(F.lit("t"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string"))
    sql = F.when(F.col("l_linenumber") % 3 == 0, F.format_string("INSERT INTO %s (id, %s) VALUES (?, ?)", table_name, column)).when(F.col("l_linenumber") % 3 == 1, F.format_string("UPDATE %s SET %s = ? WHERE id = ?", table_name, column))
    step = lambda f, line, code: F.struct(f.alias("file"), line.cast("int").alias("start"), line.cast("int").alias("end"), code.alias("snippet"))
    two = F.array(step(file, F.col("l_orderkey"), null), step(F.concat(F.lit("lib/"), file), F.col("l_linenumber"), sql))
    steps = F.when(F.col("l_linenumber") == 7, F.slice(two, 1, 1)).otherwise(two)
    return li.select(
        ids.stable_id("flow", *key).alias("fid"), F.concat(F.lit("T-"), F.col("l_partkey").cast("string")).alias("tid"), F.concat(F.lit("K-"), F.col("l_suppkey").cast("string")).alias("sid"),
        cwe.alias("cwe"), engine.alias("engine"), steps.alias("steps"), F.lit("/sarif").alias("sarif_ref"), confidence.alias("confidence"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    loc = F.concat(F.lit("src/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".js:"), F.col("p_size").cast("string"))
    return p.select(F.concat(F.lit("T-"), k).alias("tid"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("S-"), (F.col("p_partkey") % 40).cast("string"))).alias("symbol_id"), F.col("p_type").alias("class"), F.col("p_brand").alias("key"), loc.alias("evidence_loc"))


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("sql.exec", "html", "shell", "file", "sql_column"))), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return s.select(
        F.concat(F.lit("K-"), F.col("s_suppkey").cast("string")).alias("sid"), F.concat(F.lit("S-"), (F.col("s_suppkey") % 40).cast("string")).alias("symbol_id"), kind.alias("class"),
        F.col("s_name").alias("lib"), F.when(F.col("s_suppkey") % 2 == 0, "bound").otherwise("template-literal").alias("parameterization"), F.array().cast("array<string>").alias("tainted_slots"),
    )


#: Callee texts of many languages, and files to call them in.
CALLEES = (
    "app.get", "router.use", "app.route", "@Get()", "emitter.on", "button.on", "x.addEventListener", "cron.schedule", "process.argv", "queue.process", "kafkajs.run.consume", "console.log",
    "@app.route", "@bp.post", "path", "@celery.task", "sys.argv", "print", "@GetMapping", "@Path", "@KafkaListener", "@Scheduled", "http.HandleFunc", "r.GET", "consumer.Consume", "flag.Parse",
    "get '/x' do", "resources :users", "include Sidekiq::Job", "ARGV", "Route::get", "$app->post", "add_action(", "Artisan::command", "[HttpGet]", "app.MapGet", "[Function]", "routing {", "get(\"/u\")",
    "getopts", "eval", "on: push", "run: make", "db.query", "conn.executemany", "redis.set", "cache.get", "jedis.hget", "producer.send", "worker.onMessage", "$pdo->query", "mysqli_query", "sqlx.Get", "fs.readFile",
)
FILES = ("a.js", "b.py", "api/urls.py", "C.java", "d.go", "config/routes.rb", "e.rb", "f.php", "g.cs", "h.kt", "i.sh", "j.yml")


def xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls: an event picks a callee and a file."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    return e.select(
        F.concat(F.lit("S-"), (F.col("user_id") % 40).cast("string")).alias("caller_id"), F.lit(None).cast("string").alias("callee_id"), F.lit("call").alias("kind"),
        pick(FILES, F.floor(F.col("event_id") / len(CALLEES)) % len(FILES)).alias("file"), (F.col("event_id") % 97).cast("int").alias("line"), pick(CALLEES, F.col("event_id") % len(CALLEES)).alias("callee_text"), F.col("event_id").alias("ord"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("verifyToken", "apiXkey", "api_key", "requireRole", "is_owner", "render", "Guard", "hasAccess", "parse", "checkauth")))
    n = F.col("event_id")
    return e.select(
        F.concat(F.lit("S-"), n.cast("string")).alias("id"), F.concat(F.lit("sym"), n.cast("string")).alias("sym"), F.lit("function").alias("kind"),
        F.concat(F.lit("src/f"), (n % 50).cast("string"), F.lit(".js")).alias("file"), (n % 30 + 1).cast("int").alias("range_start"), (n % 30 + 5).cast("int").alias("range_end"), F.lit(None).cast("string").alias("type"),
        F.element_at(names, (n % 10 + 1).cast("int")).alias("display_name"), n.alias("ord"),
    )


#: The same relations for DuckDB; joined steps are four scalar columns.
SQL = {
    "x_flows": """x_flows AS (SELECT 'flow:' || substr(sha1(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)), 1, 16) AS fid,
  'T-' || l_partkey AS tid, 'K-' || l_suppkey AS sid,
  CASE WHEN l_orderkey % 8 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE '' END ELSE 'CWE-' || ([22, 78, 79, 89, 94, 200, 9999])[l_orderkey % 8] END AS cwe,
  CASE l_returnflag WHEN 'A' THEN 'codeql' WHEN 'N' THEN 'semgrep' ELSE 'joern' END AS engine,
  CASE WHEN l_linestatus = 'F' AND l_linenumber % 4 = 0 THEN 'definite' WHEN l_linenumber % 4 = 1 THEN 'inferred' WHEN l_linenumber % 4 = 2 THEN 'llm-suggested' ELSE 'unknown' END AS confidence,
  'src/f' || (l_orderkey % 100) || '.js' AS f1, l_orderkey AS n1,
  CASE WHEN l_linenumber = 7 THEN 'src/f' || (l_orderkey % 100) || '.js' ELSE 'lib/src/f' || (l_orderkey % 100) || '.js' END AS f2,
  CASE WHEN l_linenumber = 7 THEN l_orderkey ELSE l_linenumber END AS n2, l_linenumber = 7 AS one,
  CASE WHEN l_linenumber <> 7 AND l_linenumber % 3 <> 2 THEN 't' || (l_suppkey % 7) END AS q_table, 'c' || (l_partkey % 5) AS q_column FROM lineitem)""",
    "x_sources": """x_sources AS (SELECT 'T-' || p_partkey AS tid, CASE WHEN p_partkey % 5 <> 0 THEN 'S-' || (p_partkey % 40) END AS symbol_id, p_type AS class, p_brand AS key,
  'src/f' || (p_partkey % 50) || '.js:' || p_size AS evidence_loc FROM part)""",
    "x_sinks": """x_sinks AS (SELECT 'K-' || s_suppkey AS sid, 'S-' || (s_suppkey % 40) AS symbol_id, (['sql.exec', 'html', 'shell', 'file', 'sql_column'])[s_nationkey % 5 + 1] AS class,
  s_name AS lib, CASE WHEN s_suppkey % 2 = 0 THEN 'bound' ELSE 'template-literal' END AS parameterization FROM supplier)""",
    "x_symbols": """x_symbols AS (SELECT 'S-' || event_id AS id, 'function' AS kind, 'src/f' || (event_id % 50) || '.js' AS file, event_id % 30 + 1 AS range_start, event_id % 30 + 5 AS range_end,
  (['verifyToken', 'apiXkey', 'api_key', 'requireRole', 'is_owner', 'render', 'Guard', 'hasAccess', 'parse', 'checkauth'])[event_id % 10 + 1] AS display_name, event_id AS ord FROM events)""",
}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL["x_xrefs"] = (
    f"x_xrefs AS (SELECT 'S-' || (user_id % 40) AS caller_id, 'call' AS kind, ({_list(FILES)})[(event_id // {len(CALLEES)}) % {len(FILES)} + 1] AS file, "
    f"event_id % 97 AS line, ({_list(CALLEES)})[event_id % {len(CALLEES)} + 1] AS callee_text, event_id AS ord FROM events)"
)


def with_sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
