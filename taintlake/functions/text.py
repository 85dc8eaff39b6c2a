"""Scalar functions over locations, labels, manifests and model output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cwe_of(rule_id: Column, tags: Column) -> Column:
    """``CWE-<n>`` of the first of rule and tags that names one, without leading zeros; else null."""
    found = F.transform(F.concat(F.array(F.coalesce(rule_id, F.lit(""))), F.coalesce(tags, F.array().cast("array<string>"))), lambda t: F.regexp_extract(t, r"(?i)cwe[-/](\d+)", 1))
    first = F.try_element_at(F.filter(found, lambda d: d != ""), F.lit(1))
    return F.concat(F.lit("CWE-"), first.cast("decimal(38,0)").cast("string"))


def line_of(loc: Column) -> Column:
    """The line of ``file:line``; null if there is none."""
    return F.substring_index(loc, ":", -1).try_cast("int")


def file_of(loc: Column) -> Column:
    return F.regexp_extract(loc, r"^(.*):([0-9]+)$", 1)


def in_file(loc: Column, file: Column) -> Column:
    """Whether a ``file:line`` lies in the file; wildcards in paths mean nothing."""
    return F.startswith(loc, F.concat(file, F.lit(":")))


def short_label(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def dot_id(prefix: str, raw: Column) -> Column:
    """A node name for graphs: other characters than letters and digits become ``_``, 64 at most."""
    return F.substring(F.concat(F.lit(f"{prefix}_"), F.regexp_replace(raw, r"[^\p{L}\p{N}]", "_")), 1, 64)


def human_size(size: Column) -> Column:
    """1023 B, 1.0 KB, ... TB; halves go to the even digit."""
    out, scale = None, 1024.0
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for unit in ("KB", "MB", "GB"):
        out = out.when(size < scale * 1024, F.format_string(f"%.1f {unit}", F.bround(size / scale, 1)))
        scale *= 1024
    return out.otherwise(F.format_string("%.1f TB", F.bround(size / scale, 1)))


_ENDINGS = (
    "typescript .ts .tsx .mts .cts; javascript .cjs .js .jsx .mjs; python .py .pyi; java .java; kotlin .kt .kts; go .go; ruby .rake .rb; "
    "php .php .phtml; csharp .cs .cshtml .razor; bash .bash .sh; yaml .yaml .yml; html .htm .html"
)
FENCES = {lang: tuple(ends) for lang, *ends in map(str.split, _ENDINGS.split(";"))}


def language_fence(file: Column) -> Column:
    out = None
    for name, ends in FENCES.items():
        hit = F.lit(False)
        for end in ends:
            hit = hit | F.endswith(file, F.lit(end))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def comment_marker(fence: Column) -> Column:
    return F.when(fence.isin("python", "ruby", "bash", "yaml"), "#").when(fence == "html", "<!--").otherwise("//")


def excerpt(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Lines ``start - radius`` to ``end + radius`` of a text, clipped to it."""
    lines = F.split(text, "\n")
    low = F.greatest(start - radius, F.lit(1))
    high = F.least(end + radius, F.size(lines))
    return F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")


def dependency_name(spec: Column) -> Column:
    """The name in front of a version, marker or extra."""
    return F.lower(F.trim(F.element_at(F.split(spec, r"[<>=!~;\s\[]"), 1)))


def key_pattern(storage_id: Column) -> Column:
    """A regular expression for keys: the kind before the first colon goes, ``*`` stands for no quote and no blank."""
    rest = F.substring(storage_id, F.instr(storage_id, ":") + 1, 1 << 20)
    tail = F.when(rest == "", storage_id).otherwise(rest)
    parts = F.transform(F.split(tail, r"\*"), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    return F.concat(F.lit("(?i)"), F.array_join(parts, r"[^`'\"\s]*"))


_Q, _NQ = "[\"']", "[^\"']*"
DYNAMIC = "|".join((r"[.]format[(]", r"[+]\s*[A-Za-z_]", r"[$][{][^}]", "`[^`]*[$]", rf"{_Q}{_NQ}{_Q}\s*%", rf"\bf{_Q}{_NQ}[{{][^}}]+[}}]"))


def is_dynamic(code: Column) -> Column:
    """Whether a call builds its argument: a template with a hole, a format, or text put together."""
    return F.rlike(code, F.lit(DYNAMIC))


VERDICTS = ("inconclusive", "not_vulnerable", "vulnerable")


def verdict_of(stdout: Column) -> Column:
    """The last flat JSON object of a program's output whose verdict is a known one; else null."""
    objects = F.regexp_extract_all(F.coalesce(stdout, F.lit("")), F.lit(r"(\{[^{}]*\})"), F.lit(1))
    held = F.filter(objects, lambda o: F.lower(F.get_json_object(o, "$.verdict")).isin(*VERDICTS))
    return F.try_element_at(held, F.lit(-1))


def finding_status(stdout: Column, signal_seen: Column, exit_code: Column, timed_out: Column) -> Column:
    """What a run says of a finding: its verdict first, then the signal, then its exit."""
    said = F.lower(F.get_json_object(verdict_of(stdout), "$.verdict"))
    return (
        F.when(said == "vulnerable", "verified")
        .when(said == "not_vulnerable", "rejected")
        .when(said.isNotNull(), "poc_inconclusive")
        .when(signal_seen, "verified")
        .when((exit_code == 0) & ~timed_out, "rejected")
        .otherwise("poc_inconclusive")
    )


NOMINATION = r"^- \[([ !x])\] (N-[\w-]+) \| ([^|]+) \| ([^|]+) \| ([^|]+) \| rec: (low|med|high) \| y/n: ?([ny]?)\s*$"
NOMINATION_FIELDS = ("mark", "id", "project", "vector", "loc", "rec", "decision")


def nomination(line: Column) -> list[Column]:
    """The fields of a nomination line, without blanks around them; empty text where the line is none."""
    return [(F.regexp_extract(line, NOMINATION, i + 1) if i == 0 else F.trim(F.regexp_extract(line, NOMINATION, i + 1))).alias(name) for i, name in enumerate(NOMINATION_FIELDS)]


def say_yes(line: Column) -> Column:
    """A nomination line without a decision gets a ``y``."""
    undecided = F.rlike(line, F.lit(NOMINATION)) & (F.regexp_extract(line, NOMINATION, 7) == "")
    return F.when(undecided, F.concat(F.rtrim(line), F.lit(" y"))).otherwise(line)


TROUBLE = tuple(
    sorted(
        [f" {code}" for code in (401, 403, 429)]
        + [f"rate{c}limit" for c in " -_"]
        + ["api key", "credentials", "invalid api key", "not logged in", "quota exceeded", "too many requests"]
        + ["please log in", "please login", "unauthenticated", "unauthorized"]
    )
)


def is_rate_or_auth(stderr: Column) -> Column:
    low = F.lower(F.coalesce(stderr, F.lit("")))
    return F.exists(F.array(*map(F.lit, TROUBLE)), lambda k: F.contains(low, k))


CLUSTER_MARKS = tuple(
    [f"kind: {k}" for k in sorted("Pod Job CronJob Ingress Secret Service ConfigMap DaemonSet StatefulSet Deployment".split())]
    + [f"apiVersion: {v}" for v in ("apps/", "batch/", "networking.", "rbac.", "v1")]
)


def is_cluster_manifest(text: Column) -> Column:
    """Whether the first 256 characters look like a manifest of a cluster's objects."""
    head = F.substring(text, 1, 256)
    return F.exists(F.array(*map(F.lit, CLUSTER_MARKS)), lambda k: F.contains(head, k))


SOURCE_PATH = r"([^\s:]+\.(?:cjs|html|js|jsx|mjs|py|ts|tsx))(?::\d+)?"


def component_of(body: Column, title: Column) -> Column:
    """The base name of the first source path in a finding's body, else in its title; else ``unknown``."""
    there = F.regexp_extract(F.coalesce(body, F.lit("")), SOURCE_PATH, 1)
    path = F.when(there != "", there).otherwise(F.regexp_extract(F.coalesce(title, F.lit("")), SOURCE_PATH, 1))
    base = F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")
    return F.when(base == "", "unknown").otherwise(base)


def report_name(day: Column, severity: Column, vuln_class: Column, component: Column) -> Column:
    return F.concat(F.concat_ws("--", F.date_format(day, "yyyy-MM-dd"), severity, vuln_class, component), F.lit(".md"))
