"""Writes as pure functions of old and new rows, and the joins that a plain join gets wrong."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets ``checkpoint()`` work where no folder is set: in the one that the session names; a local one only in local mode."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes last by ``order``; one aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in rows.columns])


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """New rows replace old ones of the same key; among the new the last by ``order`` counts."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return last_by(both, keys, ["_age", order]).drop("_age")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows and those of the new whose key isn't there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``changes`` put in by key."""
    own = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in own], F.lit(True).alias("_hit"))
    joined = rows.join(marked, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_project(old: DataFrame, new: DataFrame, project: str) -> DataFrame:
    """Append without repeats: what the project had goes first."""
    return old.join(new.select(project).distinct(), project, "left_anti").unionByName(new)


def not_in(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN, nulls and all: one null among the others empties the result.

    The engine would broadcast the others for this; here they meet the rows in an equi-join of any size, and
    two scalar subqueries tell whether they are empty or hold a null.
    """
    v = others.select(F.col(other).alias("_v"))
    seen = v.agg(F.count("*").alias("_all"), F.count_if(F.col("_v").isNull()).alias("_nulls"))
    kept = rows.join(v.distinct(), F.col(column) == F.col("_v"), "left_anti")
    #: One row, so the join to it is a scalar subquery.
    marked = kept.select("*", seen.select("_all").scalar().alias("_all"), seen.select("_nulls").scalar().alias("_nulls"))
    return marked.where((F.col("_all") == 0) | (F.col(column).isNotNull() & (F.col("_nulls") == 0))).drop("_all", "_nulls")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, left_key: list[str], right_order: list[str], within: int, self_too: Column | None = None) -> DataFrame:
    """For each left row the right row of the same ``on`` that is nearest, at most ``within`` away.

    Of the right rows at one place only the first by ``right_order`` can be the nearest, so the others go before the join,
    and no file is dense. Rows meet by ``on`` and by the band of ``within`` that they lie in: each left row looks
    into its own band and the two beside it, so a file with very many rows on both sides is spread and
    the join stays an equi-join. Ties go to the first by ``right_order``. (With ``self_too``, a condition on pairs, all right rows meet.)
    """
    band = max(within, 1)
    if self_too is None:
        right = first_by(right, [*on, right_at], right_order)
    l = left.withColumn("_band", F.explode(F.array(*[F.floor(F.col(left_at) / band) + d for d in (-1, 0, 1)])))
    r = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in on]).withColumn("_band", F.floor(F.col(f"_r_{right_at}") / band))
    gap = F.abs(F.col(left_at) - F.col(f"_r_{right_at}"))
    pairs = l.join(r, [*on, "_band"]).where(gap <= within)
    if self_too is not None:
        pairs = pairs.where(self_too)
    best = pairs.groupBy(*left_key).agg(F.min_by(F.struct("*"), F.struct(gap.alias("gap"), *[F.col(f"_r_{c}") for c in right_order])).alias("b"), F.min(gap).alias("distance"))
    own = [c for c in left.columns]
    return best.select(*[F.col(f"b.{c}").alias(c) for c in own], *[F.col(f"b._r_{c}").alias(f"near_{c}") for c in right.columns if c not in on], "distance")


def outermost(paths: DataFrame, path: str) -> DataFrame:
    """Paths that lie under no other of them: each path's ancestors are looked up, which is an equi-join."""
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    given = paths.distinct()
    up = given.select(path, F.explode_outer(F.when(F.size(parts) > 1, above)).alias("_above"))
    nested = up.join(given.select(F.col(path).alias("_above")), "_above", "left_semi").select(path).distinct()
    return given.join(nested, path, "left_anti")


def mode_first_seen(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one seen first by ``order``."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_seen"))
    return counted.groupBy(*group).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col("_seen"))).alias(value))


def latest(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return last_by(rows, group, order)


def top_per(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def reachable(edges: DataFrame, roots: DataFrame, most_steps: int) -> DataFrame:
    """(root, node, steps) of what ``roots`` reach over ``edges`` (src, dst) in at most ``most_steps``.

    A frontier of new nodes only is joined in each round, and lineage is cut in the shared folder.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("steps")).distinct().checkpoint()
    front = seen
    for step in range(1, most_steps + 1):
        found = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = found.join(seen, ["root", "node"], "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    return seen
