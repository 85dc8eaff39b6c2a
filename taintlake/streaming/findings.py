"""Findings and events as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.relational import last_by
from ..schemas import GRAPH_FLOWS
from ..sources.records import from_lines, graph_flow_rows


def graph_flows(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Flows of JSON Lines files as they come; broken lines are skipped."""
    return graph_flow_rows(from_lines(spark.readStream.text(path), GRAPH_FLOWS), root, distinct=False)["flows"]


def first_of_each(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the time that late rows have."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def upsert_into(stream: DataFrame, folder: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each batch merges into a table of ``buckets`` folders by hashed key; only the buckets that a batch touches are written again.

    A version of a bucket is ``folder/in_batch=<batch>/in_bucket=<b>``: of one key the row stays that is last by ``order`` (event time, then
    what tells rows of one time apart), whatever the batches or partitions were. A batch that runs again writes its own version again, from
    those before it, so it is idempotent. ``latest`` reads the table.
    """

    def put(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("in_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        before = latest(batch.sparkSession, folder, batch.schema, number).join(new.select("in_bucket").distinct(), "in_bucket", "left_semi")
        merged = last_by(before.unionByName(new), [*keys, "in_bucket"], order)
        merged.repartition("in_bucket").write.mode("overwrite").partitionBy("in_bucket").parquet(f"{folder}/in_batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The table with its ``in_bucket``: of each bucket the last version (of those before a batch)."""
    whole = StructType([*schema.fields, StructField("in_batch", LongType()), StructField("in_bucket", IntegerType())])
    try:
        known = spark.read.schema(whole).parquet(folder)
    except AnalysisException:  # nothing is written yet
        return spark.createDataFrame([], whole).drop("in_batch")
    known = known.where(F.col("in_batch") < before) if before is not None else known
    #: Of two columns that folders name; the data columns are not read for it.
    versions = known.groupBy("in_bucket").agg(F.max("in_batch").alias("in_batch"))
    return known.join(versions, ["in_bucket", "in_batch"], "left_semi").drop("in_batch")
