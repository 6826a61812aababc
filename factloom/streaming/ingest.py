"""Incremental ingest of posts into a knowledge-base table with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.storage import materialize


def read_posts(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A file stream of Parquet posts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(posts: DataFrame, target: str, checkpoint: str, key: str, sequence: str, buckets: int = 64) -> None:
    """Run the available input through the upsert, batch by batch: per key the row with the latest ``sequence``.

    The target is partitioned into hash buckets of the key and only the buckets a batch touches are
    rewritten, by dynamic partition overwrite. A batch that runs twice gives the same table.
    """
    spark = posts.sparkSession

    def apply(batch: DataFrame, _: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        fresh = fresh.persist()
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
        try:
            old = spark.read.schema(fresh.schema).parquet(target).where(F.col("_bucket").isin(touched))
            merged = fresh.unionByName(old)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = fresh
        best = materialize(_latest(merged, key, sequence), "upsert")
        best.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(target)
        fresh.unpersist()

    posts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _latest(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    # a missing sequence counts as the earliest; of equal ones a hash decides, so that reruns agree
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(sequence), F.xxhash64(*others))).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others]).select(*rows.columns)


def first_seen(events: DataFrame, time: str, key: list[str], delay: str = "1 day") -> DataFrame:
    """A stream without repeats of a key inside the watermark's delay."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, by, n) of tumbling windows over a stream or table."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, delay) if timed.isStreaming else timed
    return timed.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
