"""Knowledge-base tables: de-duplication, upsert, delete, stable splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (nulls first); rows with a null key form one group per key.

    An aggregate that combines on the map side: a key with very many rows, as the null key may be, sends one row a task.
    """
    return df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_first")).select("_first.*")


def backfilled(df: DataFrame, key: Column, text: str, time: str, order: str) -> DataFrame:
    """(dedup_key, text, ts): a key's first text and its first time that is not null. Aggregates, no sort."""
    return df.groupBy(key.alias("dedup_key")).agg(
        F.min_by(text, order).alias("text"), F.min_by(time, F.when(F.col(time).isNotNull(), F.col(order))).alias("ts"), F.min(order).alias("first_row"))


def upsert(table: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """``table`` with the batch's rows put in by key, the last of a key winning; rows without key are an error of the caller."""
    last = batch.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(sequence)))).where("_rn = 1").drop("_rn")
    last = last.select(*table.columns)
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def create(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``table`` with new rows; a key that exists already fails the job when its row is read."""
    known = table.select(key, F.lit(True).alias("_known")).dropDuplicates([key])
    checked = batch.join(known, key, "left")
    guard = F.when(F.col("_known"), F.raise_error(F.concat(F.lit("exists already: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return table.unionByName(checked.withColumn(key, guard.cast(batch.schema[key].dataType)).select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` without the given keys."""
    return table.join(ids.select(key), key, "left_anti")


def in_split(key: Column, share: float, seed: int = 42) -> Column:
    """Whether a row belongs to the first part of a stable split: by a hash, so it never moves."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % 10_000 < int(share * 10_000)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, from 1, in the given order: partitions by range are counted first, so no task sees all rows.

    The order must tell rows apart; equal rows are numbered in any order.
    """
    from factloom.storage import materialize

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return rows.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
