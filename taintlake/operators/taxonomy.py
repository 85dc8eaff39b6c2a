"""Classes of weaknesses and their groups; expansion, lookup and what a tag list lacks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import checkpointed

CLASS_DDL = "name STRING, ord INT, group_name STRING, cwes ARRAY<STRING>, tags ARRAY<STRING>, aliases ARRAY<STRING>, needs_semantic BOOLEAN, hints ARRAY<STRING>"


def read_yaml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members of groups) of a taxonomy file: some dozens of entries, read on the driver."""
    import yaml

    with Path(path).open(encoding="utf-8") as source:
        raw = yaml.safe_load(source)
    own = {k: v for k, v in (raw or {}).items() if k != "groups"}
    groups = (raw or {}).get("groups") or {}
    rows = [(k, i, v.get("group"), v.get("cwes") or [], v.get("codeql_tags") or [], v.get("aliases") or [], bool(v.get("needs_semantic")), v.get("validation_hints") or []) for i, (k, v) in enumerate(own.items())]
    members = [(g, m) for g, own in groups.items() for m in own]
    return spark.createDataFrame(rows, CLASS_DDL), spark.createDataFrame(members, "group_name STRING, member STRING")


SUGGESTED_DDL = "storage_id STRING, kind STRING, confidence DOUBLE, rationale STRING, call_id STRING"


def read_suggested(spark: SparkSession, path: str) -> DataFrame:
    """The suggested locations of an annotation file, which people look over; a missing file has none."""
    import yaml

    file = Path(path)
    raw = yaml.safe_load(file.read_text(encoding="utf-8")) if file.is_file() else None
    own = (raw or {}).get("llm_suggested") or {}
    rows = [(k, str(v.get("kind", "unknown")), float(v.get("confidence") or 0.0), str(v.get("rationale", "")), str(v.get("call_id", ""))) for k, v in own.items()]
    return spark.createDataFrame(rows, SUGGESTED_DDL)


def write_suggested(rows: DataFrame, path: str, most: int = 100_000) -> int:
    """Puts suggested locations into the file, keys sorted; what else it holds stays. A file for people: more than ``most`` raise an error."""
    import yaml

    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} suggestions; a file for people to read is not the place for them")
    file = Path(path)
    raw = (yaml.safe_load(file.read_text(encoding="utf-8")) if file.is_file() else None) or {}
    raw["llm_suggested"] = {r["storage_id"]: {k: r[k] for k in ("kind", "confidence", "rationale", "call_id")} for r in found}
    file.write_text(yaml.safe_dump(raw, sort_keys=True), encoding="utf-8")
    return len(found)


def expand(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The classes that ``wanted`` (token) names: ``@group`` stands for its members, groups within groups too."""
    #: Groups that hold themselves, or each other, are opened once: only tokens that are new go on.
    seen = wanted.select("token").distinct()
    front = seen
    while not front.isEmpty():
        inner = front.join(members, F.col("token") == F.concat(F.lit("@"), "group_name")).select(F.col("member").alias("token")).distinct()
        front = checkpointed(inner.join(seen, "token", "left_anti"))
        seen = checkpointed(seen.unionByName(front))
    return seen.where(~F.startswith("token", F.lit("@"))).select(F.col("token").alias("name"))


def resolve(classes: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Known classes by name or alias, in the order of names."""
    names = classes.select(F.col("name").alias("token"), "name").unionByName(classes.select(F.explode("aliases").alias("token"), "name"))
    own = expand(members, wanted).select(F.col("name").alias("token"))
    return classes.join(own.join(names, "token").select("name").distinct(), "name", "left_semi").orderBy("name")


def suggest(names: DataFrame, unknown: DataFrame) -> DataFrame:
    """For each unknown token the nearest name by edit distance (an approximation of other measures)."""
    spark = names.sparkSession
    known = [r[0] for r in names.select("name").distinct().limit(10_001).collect()]
    if len(known) > 10_000:
        raise ValueError("a taxonomy of over 10,000 names is not looked through name by name")
    best = F.array_min(F.transform(F.array(*map(F.lit, known)), lambda n: F.struct(F.levenshtein(n, F.col("token")).alias("d"), n.alias("n"))))
    return unknown.select("token", best["n"].alias("name"), best["d"].alias("distance")) if known else spark.createDataFrame([], "token STRING, name STRING, distance INT")


def missing_tags(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Tags ``security/...`` of query texts (content) that no class has, with the CWE they name."""
    tags = texts.select(F.explode(F.regexp_extract_all("content", F.lit(r"(security/[\w./-]+)"), F.lit(1))).alias("tag"))
    gone = tags.distinct().join(known.select("tag").distinct(), "tag", "left_anti")
    return gone.select("tag", cwe_of_tag(F.col("tag")).alias("cwe"))


def cwe_of_tag(tag: Column) -> Column:
    n = F.regexp_extract(tag, r"(?i)cwe-0*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def hints_by_cwe(classes: DataFrame) -> DataFrame:
    """cwe, hints: of the first class, in the order of the file, that has the CWE and any hints."""
    rows = classes.where("size(hints) > 0").select(F.explode("cwes").alias("cwe"), "ord", "hints")
    return rows.groupBy("cwe").agg(F.min_by("hints", "ord").alias("hints"))


def is_stale(checked: Column, now: Column, days: int = 7) -> Column:
    """Whether the last check lies ``days`` whole days back, or was never made."""
    return F.coalesce(F.floor((F.unix_timestamp(now) - F.unix_timestamp(checked)) / 86400) >= days, F.lit(True))
