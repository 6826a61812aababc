"""Queries of the core, by name, with the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import timelines
from factloom.plans import more_queries, search_queries, source_queries, text_queries  # noqa: F401
from factloom.plans.registry import QUERIES, SQL, query
from factloom.plans.search_queries import flagship  # noqa: F401
from factloom.sources.tables import table

# record_kind, table, key, raw value, arrival
_TIMED = (
    ("web_post", "web_posts", "post_key", "date_raw", "fetched_at"),
    ("social_post", "social_posts", "social_key", "post_date", "fetched_at"),
    ("claim", "labeled_claims", "sample_id", "timestamp_raw", "loaded_at"),
)


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for kind, name, key, raw, arrived in _TIMED:
        one = table(spark, sf, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), "source", F.col(arrived).alias("arrived"), F.col(raw).alias("raw"))
        out = one if out is None else out.unionByName(one)
    return timelines.with_readings(out, F.col("raw"), table(spark, sf, "feed_sources"))


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return timelines.choose_instants(_timed(spark, sf)).select("record_kind", "record_key", timelines.utc_text(F.col("instant")).alias("utc_time"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
