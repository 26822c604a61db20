"""Incremental ingest, sessions and metrics as streaming queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.graph import upsert
from lexloom.session import materialize


def stream_table(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number per batch; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


#: Key ranges of an upserted table: a batch rewrites only those that it touches.
BUCKETS = 64


def upsert_stream(stream: DataFrame, target: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` as one row per key: each batch's latest rows fill or replace what is there.

    The table lies in BUCKETS folders by a hash of the key (column ``bucket``). A batch reads and
    overwrites the folders of its own keys; run again after a failure, it writes the same rows again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in (key, order)]
        last = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])
        last = materialize(last)
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in last.select(bucket.alias("b")).distinct().collect()]  # BUCKETS numbers at most
        try:
            old = spark.read.parquet(target).where(F.col("bucket").isin(touched)).drop("bucket")
        except AnalysisException:  # the first batch
            old = last.limit(0)
        new = materialize(upsert(old, last, key).drop("upsert_state")).withColumn("bucket", bucket)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Turns per user and session; a session ends after ``gap`` without a turn, rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_turns"))


def stage_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts, means and extremes of each stage's values per window of event time."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("total"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
