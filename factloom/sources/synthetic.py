"""Synthetic claims from a table of concepts and templates; picks come from hashes, so a seed fixes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import leak_free_claim, lower_first, strip_period
from factloom.operators.kb import keep_first


def pick(options: list[str], *seeds: Column | str | int) -> Column:
    """One of the options, chosen by a hash of the seeds."""
    columns = [F.lit(s) if isinstance(s, int) else s for s in seeds]
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(*columns), F.lit(len(options))).cast("int"))


def claims(concepts: DataFrame, per_concept: int, prefixes: list[str], tails: list[str], seed: int = 42) -> DataFrame:
    """(claim, evidence, label, type): for each concept (topic, true_stmt, evidence_core, contradict_stmt) true and false claims.

    Repeats and claims that fail the quality gate are left out.
    """
    rows = concepts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_concept - 1)))).withColumn("truth", F.explode(F.array(F.lit(True), F.lit(False))))
    stem = F.when(F.col("truth"), F.col("true_stmt")).otherwise(F.col("contradict_stmt"))
    text = F.trim(F.concat(pick(prefixes, "topic", "i", "truth", seed), F.lit(" "), lower_first(strip_period(stem)), pick(tails, "topic", "i", "truth", seed + 1)))
    made = rows.select(text.alias("claim"), F.col("evidence_core").alias("evidence"), F.when(F.col("truth"), "true").otherwise("false").alias("label"), F.lit("rule").alias("type"), "topic", "i")
    good = made.where(leak_free_claim(F.col("claim")))
    return keep_first(good, ["claim"], ["topic", "i", "label"]).select("claim", "evidence", "label", "type")
