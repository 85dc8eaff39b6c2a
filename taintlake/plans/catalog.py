"""The registered queries and the SQL that a second engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ingest, navigation, scalars, tier3

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (navigation, ingest, scalars, tier3):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
