"""Identifiers: byte-exact hashes over joined parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(separator: str, *parts: Column | str) -> Column:
    """``concat_ws`` that keeps the place of nulls (as empty text) instead of skipping them."""
    return F.concat_ws(separator, *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix:sixteen hex digits."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha1(joined("|", *parts)), 1, 16))


def storage_row_id(prefix: str, *parts: Column | str) -> Column:
    """prefix and twelve hex digits over parts joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined("\x1f", *parts)), 1, 12))


def derived_tid(storage_id: Column | str) -> Column:
    return storage_row_id("T-stored-", storage_id)


def synthetic_symbol_id(file: Column | str, kind: Column | str, name: Column | str, line: Column | str) -> Column:
    return F.concat(F.lit("synthetic:"), F.substring(F.sha1(joined("|", file, kind, name, line)), 1, 12))


def graph_flow_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("joern-"), F.substring(F.sha1(joined(":", *parts)), 1, 16))


def unresolved_call_id(file: Column | str, line: Column | str, callee: Column | str) -> Column:
    """Only nine hex digits survive the cut to twelve characters."""
    return F.concat(F.lit("S-"), F.substring(storage_row_id("dyn", file, line, callee), 1, 12))
