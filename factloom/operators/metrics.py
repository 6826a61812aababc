"""Classification metrics and label statistics from one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: Column, predicted: Column, *by: str) -> DataFrame:
    """(*by, y, p, n); everything below works on these few rows."""
    return df.groupBy(*by, gold.alias("y"), predicted.alias("p")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, classes: list[int], *by: str) -> DataFrame:
    """(*by, class, tp, gold_n, pred_n, precision, recall, f1) for each class; 0 where a denominator is 0."""
    rows = conf.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = rows.groupBy(*by, "cls").agg(
        hit((F.col("y") == F.col("cls")) & (F.col("p") == F.col("cls"))).alias("tp"), hit(F.col("y") == F.col("cls")).alias("gold_n"), hit(F.col("p") == F.col("cls")).alias("pred_n"))
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.withColumns({"precision": zero("tp", "pred_n"), "recall": zero("tp", "gold_n")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def summary(conf: DataFrame, classes: list[int], *by: str) -> DataFrame:
    """(*by, n, accuracy, macro_*, weighted_f1); the macro means take the classes that occur."""
    pc = per_class(conf, classes, *by)
    seen = (F.col("gold_n") > 0) | (F.col("pred_n") > 0)
    mean = lambda c: F.avg(F.when(seen, F.col(c)))
    return pc.groupBy(*by).agg(
        F.sum("gold_n").alias("n"), (F.sum("tp") / F.sum("gold_n")).alias("accuracy"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"),
        mean("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("gold_n")) / F.sum("gold_n")).alias("weighted_f1"))


def label_shares(df: DataFrame, label: Column, classes: list[int]) -> DataFrame:
    """(label, n, percent, weight) for every class, present or not; the weight is total / (classes * n), null for none."""
    counts = [F.sum((label == c).cast("long")).alias(f"n{c}") for c in classes]
    wide = df.agg(F.count("*").alias("total"), *counts)
    rows = wide.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(F.col(f"n{c}"), F.lit(0)).alias("n")) for c in classes])).alias("r"))
    n = F.col("r.n")
    return rows.select(F.col("r.label").alias("label"), n.alias("n"), (100.0 * F.try_divide(n, F.col("total"))).alias("percent"), F.try_divide(F.col("total"), len(classes) * n).alias("weight"))
