"""Readers for the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
