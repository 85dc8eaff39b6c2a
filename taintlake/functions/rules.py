"""Rule packs: ordered patterns over callee text, and lookups by CWE. Java's regular expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _any(words: str) -> str:
    """An alternation, sorted."""
    return "(?:" + "|".join(sorted(words.split())) + ")"


def _call(receivers: str, methods: str, end: str = r"\b", dot: str = r"\.", fold: bool = False) -> str:
    return f"{'(?i)' if fold else ''}\\b{_any(receivers)}{dot}{_any(methods)}{end}"


_VERBS = "delete get head options patch post put"
_SPRING = "@" + _any("Controller DeleteMapping GetMapping PatchMapping PostMapping PutMapping RequestMapping RestController") + r"\b"
_JAXRS = "@" + _any("DELETE GET HEAD OPTIONS PATCH POST PUT Path") + r"\b"
_JVM_QUEUE = "@" + _any("JmsListener KafkaListener MessageMapping RabbitListener SqsListener") + r"\b"
_JVM_CRON = "@" + _any("Cron Schedule Scheduled") + r"\b"
_JVM = [("http_route", f"^{_SPRING}", None), ("http_route", f"^{_JAXRS}", None), ("message_consumer", f"^{_JVM_QUEUE}", None), ("cron", f"^{_JVM_CRON}", None)]
_URLS, _ROUTES = "urls", "routes"

#: Language family -> (endings, rules in order: kind, pattern, which files).
ENTRYPOINTS: dict[str, tuple[tuple[str, ...], list[tuple[str, str, str | None]]]] = {
    "python": (
        (".py", ".pyi"),
        [
            ("http_route", rf"(?i)^@?{_any('admin api app blueprint bp ns router')}\.{_any(_VERBS + ' route websocket')}\b", None),
            ("http_route", rf"(?i)^@?{_any('api api_router app router')}\.{_any(_VERBS + ' websocket')}\b", None),
            ("http_route", rf"\b{_any('path re_path url')}\b", _URLS),
            ("message_consumer", rf"(?i)^@?{_any('app broker celery dramatiq rq')}\.{_any('actor job task')}\b", None),
            ("cli", r"\bargparse\.ArgumentParser\b|\bsys\.argv\b", None),
        ],
    ),
    "java": ((".java",), _JVM),
    "go": (
        (".go",),
        [
            ("http_route", _call("http m mux r router sm", "Handle HandleFunc"), None),
            ("http_route", _call("api app e engine group grp r router", "Connect Delete GET DELETE Get Group HEAD Handle Head OPTIONS Options PATCH POST PUT Patch Post Put Route Trace"), None),
            ("message_consumer", _call("consumer nc reader sub subscriber", "Consume FetchMessage ReadMessage Receive Subscribe"), None),
            ("cli", r"\b(?:flag\.Parse|os\.Args)\b", None),
        ],
    ),
    "ruby": (
        (".rb", ".rake"),
        [
            ("http_route", rf"^\s*{_any('delete get match patch post put resource resources root')}\b", _ROUTES),
            ("http_route", rf"^\s*{_any(_VERBS)}\s+['\"]/", None),
            ("message_consumer", r"<\s*(?:ActiveJob::Base|ApplicationJob)\b|^\s*include\s+Sidekiq::(?:Worker|Job)\b", None),
            ("cli", r"\bOptionParser\.new\b|\bARGV\b", None),
        ],
    ),
    "php": (
        (".php", ".phtml"),
        [
            ("http_route", _call("App Route Router api app router", "any apiResource delete get group head map match options patch post put resource", dot="(?:->|::)", fold=True), None),
            ("http_route", r"^#\[Route\b", None),
            ("http_route", rf"\b{_any('add_action add_filter add_shortcode register_rest_route')}\s*\(", None),
            ("cli", r"#\[AsCommand\b|\bArtisan::command\b|\bWP_CLI::add_command\b", None),
        ],
    ),
    "csharp": (
        tuple(".cs .cshtml .razor".split()),
        [
            ("http_route", rf"^\[(?:AcceptVerbs|ApiController|Route|Http{_any('Delete Get Head Options Patch Post Put')})\b", None),
            ("http_route", _call("api app builder endpoints group grp router", "MapDelete MapGet MapGroup MapHead MapMethods MapPatch MapPost MapPut"), None),
            ("http_route", r"^\[Function(?:Name)?\b", None),
        ],
    ),
    "kotlin": ((".kt", ".kts"), [("http_route", rf"(?i)^{_any(_VERBS)}\s*\(\s*['\"]", None), ("http_route", r"(?i)^routing\s*\{", None), *_JVM]),
    "bash": ((".bash", ".sh"), [("cli", r"^(?:read\s+-[pr]|getopts)\b", None), ("cli", r"^(?:bash\s+-c|source|eval|\.\s)\b", None)]),
    "yaml": ((".yaml", ".yml"), [("http_route", r"(?i)^on:\s+", None), ("cli", r"(?i)^run:\s+", None), ("cli", r"^[$][{]{2}\s*github[.]event[.]", None)]),
    "js": (
        (),
        [
            ("http_route", _call("api app fastify route router server", _VERBS + " all use", "$", fold=True), None),
            ("http_route", _call("app router", "route", "$", fold=True), None),
            ("http_route", r"^@?" + _any("All Controller Delete Get Head Options Patch Post Put") + r"\b", None),
            ("listener", _call("broker bus child client emitter io process server socket stream", "on once", "$", fold=True) + r"|\.(?:addEventListener|addListener)$", None),
            ("cron", r"@Cron\(|" + _call("cron node-cron node-schedule", "job schedule", "$"), None),
            ("cli", r"\bprocess\.argv\b", None),
            ("message_consumer", r"(?i)\b(?:amqplib|bullmq|kafkajs)\..*?\.(?:consume|process|subscribe)$|" + _call("consumer queue worker", "consume process subscribe", "$"), None),
        ],
    ),
}

_SQL = "|".join(
    (
        _call("conn cur cursor db em engine entityManager jdbcTemplate knex pool preparedStatement session statement stmt tx",
              "Exec ExecContext Prepare PrepareContext Query QueryContext QueryRow QueryRowContext Raw createNativeQuery createQuery execute executeQuery executeUpdate executemany prepareStatement query queryForList queryForObject raw run", "$"),
        _call("c client", "Exec ExecContext Prepare PrepareContext Query QueryContext Raw execute executeQuery executeUpdate executemany query raw run", "$"),
        _call("sqlx", "Exec Get NamedExec Query QueryRow Select", "$"),
        _call("ActiveRecord::Base Mysql2::Client PG::Connection SQLite3::Database connection", "exec_query execute find_by_sql query select_all where", "$"),
        rf"\${_any('conn connection db mysqli pdo wpdb')}->{_any('exec execute executeQuery executeStatement get_results get_row get_var prepare query raw select selectRaw statement whereRaw')}$",
        r"\bmysqli_(?:multi_|real_)?query$",
        _call("Database cmd command conn connection db dbContext sqlCommand",
              "ExecuteNonQuery ExecuteNonQueryAsync ExecuteReader ExecuteReaderAsync ExecuteScalar ExecuteScalarAsync ExecuteSqlRaw ExecuteSqlRawAsync FromSqlRaw SqlQueryRaw", "$"),
        _call("Database Transaction TransactionManager transaction tx", "exec execAndMap execInBatch", "$"),
    )
)
_CACHES = "cache client jedis kv mc memcache opsForValue r rdb redis redisTemplate valueOps"

#: (storage kind, direction, pattern), in order; case is ignored.
STORAGE_CALLS = [
    ("sql_column", "unknown", "(?i)" + _SQL),
    ("cache_key", "write", _call(_CACHES, "hmset hset mset opsForValue psetex put set setIfAbsent setex setnx", "$", fold=True)),
    ("cache_key", "read", _call(_CACHES, "get getAndExpire get_multi hget hgetall mget", "$", fold=True)),
    ("queue_topic", "write", _call("amqp celery jmsTemplate jobs kafka kafkaTemplate producer publisher queue rabbit rabbitTemplate sqs", "add apply_async convertAndSend delay emit publish send sendDefault send_message send_task", "$", fold=True)),
    ("queue_topic", "read", _call("consumer listener queue subscriber task worker", "consume on onMessage process receive_messages subscribe task", "$", fold=True)),
]

_LINE_CACHES = "cache client kv mc memcache r redis"
#: The same for calls inside a line of code.
LINE_CALLS = [
    ("cache_key", "write", _call(_LINE_CACHES, "hmset hset mset psetex set setex", fold=True)),
    ("cache_key", "read", _call(_LINE_CACHES, "get get_multi hget hgetall mget", fold=True)),
    ("queue_topic", "write", _call("amqp celery jobs kafka producer publisher queue rabbit sqs", "add apply_async delay emit publish send send_message send_task", fold=True)),
    ("queue_topic", "read", _call("consumer queue subscriber task worker", "consume on process receive_messages subscribe task", fold=True)),
]
#: Reading calls with their opening bracket, by storage kind.
READ_CALLS = {
    "cache_key": _call(_LINE_CACHES, "get get_multi hget hgetall mget", r"\s*\(", fold=True),
    "queue_topic": _call("consumer queue subscriber task worker", "consume on process receive_messages subscribe task", r"\s*\(", fold=True),
}

#: Names of symbols that decide on access; ``ilike`` patterns.
AUTH_NAMES = sorted(
    [f"%{stem}%" for stem in ("authent", "authoriz", "guard", "permission", "verify")]
    + [f"%{a}{mid}{b}%" for a, b in (("admin", "key"), ("api", "key"), ("check", "auth"), ("check", "role"), ("has", "access"), ("has", "role"), ("is", "admin"), ("is", "owner")) for mid in ("", "_")]
    + [f"%require%{what}%" for what in ("admin", "auth", "login", "role")]
)

SEVERITIES = ("critical", "high", "medium", "low", "informational")
_BY_SEVERITY = {
    "critical": (78, 89, 94, 502),
    "high": (22, 79, 90, 98, 287, 345, 347, 444, 611, 918, 943, 1336),
    "medium": (93, 327, 328, 338, 352, 384, 601, 639, 862, 915, 942, 1321, 1427),
    "low": (200, 330, 1333),
}
_BY_CLASS = {
    "auth-bypass": (287,), "bfla": (862,), "cmdi": (78,), "code-injection": (94,), "cors-misconfig": (942,), "crlf-injection": (93,), "csrf": (352,),
    "file-inclusion": (98,), "idor": (639,), "info-disclosure": (200,), "insecure-random": (330, 338), "jwt-misuse": (345, 347), "ldap-injection": (90,),
    "mass-assignment": (915,), "nosqli": (943,), "open-redirect": (601,), "path-traversal": (22,), "prompt-injection": (1427,), "prototype-pollution": (1321,),
    "redos": (1333,), "request-smuggling": (444,), "session-fixation": (384,), "sqli": (89,), "ssrf": (918,), "ssti": (1336,),
    "unsafe-deserialization": (502,), "weak-crypto": (327, 328), "xss": (79,), "xxe": (611,),
}
CWE_SEVERITY = {f"CWE-{n}": s for s, own in _BY_SEVERITY.items() for n in own}
CWE_CLASS = {f"CWE-{n}": c for c, own in _BY_CLASS.items() for n in own}


def ends_with(file: Column, endings: Iterable[str]) -> Column:
    out = F.lit(False)
    for end in endings:
        out = out | F.endswith(file, F.lit(end))
    return out


def family_of(file: Column) -> Column:
    out = None
    for name, (endings, _) in ENTRYPOINTS.items():
        if endings:
            out = F.when(ends_with(file, endings), name) if out is None else out.when(ends_with(file, endings), name)
    return out.otherwise("js")


def entrypoint_kind(callee: Column, file: Column) -> Column:
    """http_route, listener, cron, cli or message_consumer by the rules of the file's language; else null."""
    where = {_URLS: F.endswith(file, F.lit("urls.py")), _ROUTES: F.endswith(file, F.lit("config/routes.rb")) | F.contains(file, F.lit("/config/routes/"))}
    family, out = family_of(file), None
    for name, (_, own) in ENTRYPOINTS.items():
        kind = None
        for what, pattern, files in own:
            hit = F.rlike(callee, F.lit(pattern))
            hit = hit & where[files] if files else hit
            kind = F.when(hit, what) if kind is None else kind.when(hit, what)
        out = F.when(family == name, kind) if out is None else out.when(family == name, kind)
    return out


def storage_call(callee: Column, rules=STORAGE_CALLS) -> Column:
    """``struct(kind, op)`` of the first rule that the callee meets; else null."""
    out = None
    for kind, op, pattern in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(op).alias("op"))
        hit = F.rlike(callee, F.lit(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_auth_name(name: Column) -> Column:
    out = F.lit(False)
    for pattern in AUTH_NAMES:
        out = out | name.ilike(pattern)
    return out


def cwe_table(spark: SparkSession) -> DataFrame:
    """cwe, severity, vuln_class: a few dozen rows."""
    return spark.createDataFrame([(c, s, CWE_CLASS.get(c, "unknown")) for c, s in CWE_SEVERITY.items()], "cwe STRING, severity STRING, vuln_class STRING")
