"""Names of calls that data enters by and ends in, as a code graph shows them, language by language (data, compiled to one filter)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CWE_OF_CLASS = {
    "cmd.shell": "CWE-78", "code.exec": "CWE-94", "deser.unsafe": "CWE-502", "firestore.idor": "CWE-639", "firestore.query": "CWE-943",
    "firestore.write": "CWE-915", "fs.read": "CWE-22", "html.write": "CWE-79", "sql.exec": "CWE-89", "ssrf": "CWE-918",
}

_JVM_SQL = "createNativeQuery createQuery executeQuery executeUpdate prepareStatement queryForList queryForObject"
#: language -> class -> names of calls that end a flow; ``a|b`` is one rule of two names.
SINKS: dict[str, dict[str, tuple[str, ...]]] = {
    lang: {k: tuple(names.split()) for k, names in own.items()}
    for lang, own in {
        "kotlin": {"cmd.shell": "ProcessBuilder exec", "deser.unsafe": "readObject", "fs.read": "FileInputStream newInputStream readBytes readText", "html.write": "respondHtml respondText", "sql.exec": _JVM_SQL},
        "java": {"cmd.shell": "ProcessBuilder exec", "deser.unsafe": "deserialize readObject", "fs.read": "FileInputStream newBufferedReader newInputStream readAllBytes", "html.write": "addAttribute getWriter println", "sql.exec": _JVM_SQL},
        "csharp": {
            "cmd.shell": "Start", "deser.unsafe": "Deserialize DeserializeObject ReadObject", "fs.read": "Open OpenRead ReadAllBytes ReadAllText", "html.write": "Write WriteAsync",
            "sql.exec": "Execute ExecuteNonQuery ExecuteReader ExecuteScalar ExecuteSqlRaw FromSqlRaw Query QueryAsync",
        },
        "php": {
            "cmd.shell": "passthru popen proc_open shell_exec system", "code.exec": "assert create_function eval", "deser.unsafe": "unserialize", "fs.read": "file_get_contents fopen include readfile require",
            "html.write": "echo print", "sql.exec": "exec get_results get_row get_var multi_query mysqli_query query", "ssrf": "curl_exec",
        },
        "ruby": {
            "cmd.shell": "Open3 popen spawn system", "code.exec": "class_eval eval instance_eval", "deser.unsafe": "load restore", "fs.read": "binread open read", "html.write": "html_safe raw",
            "sql.exec": "exec_query execute find_by_sql select_all where",
        },
        "go": {"cmd.shell": "Command CommandContext", "deser.unsafe": "Decode Unmarshal", "fs.read": "Open OpenFile ReadFile", "html.write": "Fprint Fprintf Fprintln", "sql.exec": "Exec Prepare Query QueryRow Raw"},
        "python": {
            "cmd.shell": "system|popen|check_output|check_call|Popen eval", "deser.unsafe": "loads load|full_load|unsafe_load", "fs.read": "open", "html.write": "render_template_string Markup|mark_safe",
            "sql.exec": "execute executemany",
        },
        "javascript": {
            "cmd.shell": "exec|execSync spawn|spawnSync", "firestore.idor": "doc", "firestore.query": "where|orderBy", "firestore.write": "set|update|create", "fs.read": "readFile|createReadStream|readFileSync",
            "html.write": "send|write|end", "sql.exec": "execute query",
        },
    }.items()
}
#: language -> what code starts with where data of the outside enters.
SOURCES: dict[str, tuple[str, ...]] = {
    lang: tuple(names.split())
    for lang, names in {
        "kotlin": "call.parameters call.receive call.request.headers call.request.queryParameters PathVariable RequestBody RequestHeader RequestParam",
        "java": "getCookies getFormParam getHeader getHeaderString getInputStream getParameter getPathInfo getPathParam getQueryParam getQueryString getReader getRemoteUser getRequestURI getRequestURL "
        "getServletPath PathVariable RequestBody RequestHeader RequestParam",
        "csharp": "FromBody FromForm FromHeader FromQuery FromRoute HttpContext.Request HttpRequest QueryString Request.Body Request.Cookies Request.Form Request.Headers Request.Query Request.RouteValues",
        "php": "$_COOKIE $_ENV $_FILES $_GET $_POST $_REQUEST $_SERVER getenv php://input",
        "ruby": "cookies env params request.GET request.POST request.body request.cookies request.headers request.params session",
        "go": "c.Cookie c.FormValue c.GetHeader c.GetRawData c.Param c.PostForm c.Query c.QueryArray ctx.Body ctx.Cookie ctx.FormValue ctx.Header ctx.Param ctx.Query ctx.QueryParam r.Body r.Cookie r.FormValue "
        "r.Header.Get r.PostFormValue r.URL.Query",
        "python": "request.COOKIES request.GET request.META request.POST request.args request.body request.cookies request.data request.files request.form request.headers request.json request.values sys.argv",
        "javascript": "process.argv req.body req.cookies req.headers req.params req.query req.rawBody req.url request.auth request.body request.data request.headers request.params request.query",
    }.items()
}
#: Other names of the languages; what is none of them is read as JavaScript.
ALIASES = {"csharpsrc": "csharp", "rubysrc": "ruby", "golang": "go"}
#: Languages whose data-flow engine is trusted where it finds nothing.
NO_FALLBACK = ("python", "java", "go")
_ESCAPED = str.maketrans({c: "\\" + c for c in ".$"})
RECEIVER = r"(?is)\b(?:res|response|reply|ctx)[.](?:send|write|end)\b"


def rules() -> list[tuple[str, str, str, str]]:
    """(language, CWE, class, names) of every rule."""
    return [(lang, CWE_OF_CLASS[k], k, names) for lang, own in SINKS.items() for k, every in own.items() for names in every]


def language(name: Column) -> Column:
    """The language whose rules hold."""
    low = F.lower(name)
    for alias, lang in ALIASES.items():
        low = F.when(low == alias, lang).otherwise(low)
    return F.when(low.isin(*SINKS), low).otherwise("javascript")


def name_pattern(names: tuple[str, ...]) -> str:
    return "(?i)^(?:" + "|".join(names) + ")$"


def source_pattern(lang: str) -> str:
    """Of code that starts with one of the names."""
    return "(?i)^(?:" + "|".join(n.translate(_ESCAPED) for n in SOURCES[lang]) + ")"


def sink_classes(name: Column, code: Column, lang: Column) -> Column:
    """Classes that a call is of; what writes HTML must be called on a response, but in Python."""
    found = []
    for own, classes in SINKS.items():
        for k, names in classes.items():
            hit = (lang == own) & F.rlike(name, F.lit(name_pattern(names)))
            if k == "html.write" and own != "python":
                hit = hit & F.rlike(code, F.lit(RECEIVER))
            found.append(F.when(hit, k))
    return F.array_compact(F.array(*found))


def is_source(code: Column, lang: Column) -> Column:
    hit = F.lit(False)
    for own in SOURCES:
        hit = hit | ((lang == own) & F.rlike(code, F.lit(source_pattern(own))))
    return hit


def cwe_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CWE_OF_CLASS.items() for x in pair]), kind)


#: Secrets of the environment, what compares them a byte at a time, and what compares in constant time.
SECRET, COMPARES, CONSTANT_TIME = r"process[.]env(?:[.]\w+|\[[^\]]+\])", "[=!]==?", r"\btimingSafeEqual\s*\("
