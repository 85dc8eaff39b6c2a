"""Reports, ledgers and run state as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def severities(rows: DataFrame) -> DataFrame:
    """Adds severity and vuln_class by CWE; unknown ones are informational."""
    table = F.broadcast(rules.cwe_table(rows.sparkSession))
    joined = rows.join(table, "cwe", "left")
    return joined.withColumn("severity", F.coalesce("severity", F.lit("informational"))).withColumn("vuln_class", F.coalesce("vuln_class", F.lit("unknown")))


def report_metadata(findings: DataFrame) -> DataFrame:
    """finding_id, severity, vuln_class, component, file name of ``findings`` (finding_id, cwe, title, body, day)."""
    rows = severities(findings).withColumn("component", text.component_of(F.col("body"), F.col("title")))
    return rows.withColumn("report", text.report_name(F.col("day"), F.col("severity"), F.col("vuln_class"), F.col("component")))


def rendered(findings: DataFrame) -> DataFrame:
    """Each finding as a markdown report."""
    rows = report_metadata(findings)
    line = lambda k, c: F.concat(F.lit(f"- **{k}**: "), F.coalesce(c, F.lit("-")))
    return rows.select("finding_id", "report", F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), line("Severity", F.col("severity")), line("Class", F.col("vuln_class")), line("CWE", F.col("cwe")), line("Component", F.col("component")), F.lit(""), F.col("body")).alias("markdown"))


def text_table(rows: DataFrame, most: int = 1000) -> str:
    """The first rows as a table of text, columns to the right, for a terminal; a few rows only, on the driver."""
    found = rows.limit(most).collect()
    if not found:
        return "(no rows)"
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in found]]
    widths = [max(map(len, column)) for column in zip(*cells)]
    return "\n".join("  ".join(cell.rjust(w) for cell, w in zip(line, widths)) for line in cells)


def _joined(lines: DataFrame, head: Column, none: str, tail: str = "") -> DataFrame:
    """One document (markdown) of the lines (part, line), in order, below the head."""
    all_lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])
    return lines.agg(all_lines.alias("l")).select(F.concat(head, F.when(F.size("l") == 0, F.lit(none)).otherwise(F.concat(F.array_join("l", "\n"), F.lit(tail)))).alias("markdown"))


def entrypoints_markdown(ordered: DataFrame, name: str) -> DataFrame:
    """The entry points (of ``ordered_entrypoints``) as a list under each kind."""
    item = F.format_string("- `%s` at `%s:%d`", "signature", "file", "line")
    groups = ordered.groupBy(F.struct("kind_order").alias("part")).agg(F.first("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"))
    return _joined(groups.select("part", F.concat(F.lit("## "), "kind", F.lit("\n\n"), "items", F.lit("\n")).alias("line")), F.lit(f"# Entrypoints: {name}\n\n"), "No entrypoints detected.\n")


def repository_markdown(projects: DataFrame, name: str) -> DataFrame:
    """Projects (name, dir, kind, languages, frameworks, package_manager, has_tsconfig, workspace_member), in the order of folders."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", ")).otherwise(F.lit("\u2014"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    folder = F.when(F.col("dir") == "", F.lit(".")).otherwise(F.col("dir"))
    facts = (("Path", F.concat(F.lit("`"), folder, F.lit("`"))), ("Kind", F.col("kind")), ("Languages", listed("languages")), ("Frameworks", listed("frameworks")), ("Package manager", F.col("package_manager")), ("TS config", yes("has_tsconfig")), ("Workspace member", yes("workspace_member")))
    body = F.concat_ws("\n", F.concat(F.lit("## Project: "), "name"), F.lit(""), *[F.concat(F.lit(f"- {k}: "), v) for k, v in facts])
    return _joined(projects.select(F.struct("dir", "kind").alias("part"), F.concat(body, F.lit("\n")).alias("line")), F.lit(f"# Repository: {name}\n\n"), "No projects detected.\n")


def queue_markdown(items: DataFrame, order: str = "id") -> DataFrame:
    """The accepted nominations (id, project, vector, loc) as a list to work off; ``sources.records.queue`` reads it back."""
    return _joined(items.select(F.struct(order).alias("part"), F.format_string("- [ ] %s | %s | %s | %s", "id", "project", "vector", "loc").alias("line")), F.lit("# Findings queue\n\n"), "", "\n")


def finding_markdown(findings: DataFrame) -> DataFrame:
    """finding_id, markdown of each finding: its fields before the body; ``sources.records.finding`` reads it back."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))
    fields = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), quoted(c)) for c in ("cwe", "finding_id", "flow_id", "nomination_id", "status", "title")])
    return findings.select("finding_id", F.concat(F.lit("---\n"), fields, F.lit("\n---\n\n"), F.coalesce("body", F.lit(""))).alias("markdown"))


def cost_ledger(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and cost of each group, the cost to twelve places."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("usd"), 12).alias("total_usd"))


def artefact_counts(nominations: DataFrame, findings: DataFrame) -> DataFrame:
    n = nominations.agg(F.count("*").alias("nominations"), F.count(F.when(F.col("decision") == "y", 1)).alias("accepted"))
    f = findings.agg(F.count("*").alias("findings"), F.count(F.when(F.col("status") == "verified", 1)).alias("verified"))
    return n.withColumn("_k", F.lit(1)).join(f.withColumn("_k", F.lit(1)), "_k").drop("_k")


PHASES = tuple("prep nominate gate-1 analyze gate-2 validate gate-3 report".split())


def select_phases(names: str = "", first: str = "", last: str = "", known: tuple[str, ...] = PHASES) -> list[str]:
    """The phases of a run, in order: those named (by commas), or those from one to another."""
    named = re.findall(r"[^,\s]+", names)
    if odd := {*named, *filter(None, (first, last))} - set(known):
        raise ValueError(f"unknown phases: {', '.join(sorted(odd))}")
    if named:
        return sorted(set(named), key=known.index)
    low, high = known.index(first or known[0]), known.index(last or known[-1])
    if low > high:
        raise ValueError("the first phase comes after the last")
    return list(known[low : high + 1])
