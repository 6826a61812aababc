"""File sources: labeled CSV, claims files, feed lists, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.clock import lenient
from factloom.functions.labels import label_id
from factloom.functions.urls import feed_kind
from factloom.operators.evidence import joined_evidence, with_evidence_list


def labeled_csv(spark: SparkSession, path: str, as_of: str, policy: str = "loader") -> DataFrame:
    """(text, evidence, label, [timestamp]) of a CSV with text (or claim), evidence and label; other columns go along."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if "text" not in df.columns and "claim" in df.columns:
        df = df.withColumnRenamed("claim", "text")
    missing = sorted({"text", "evidence", "label"} - set(df.columns))
    if missing:
        raise ValueError(f"the CSV lacks the columns {', '.join(missing)}")
    df = df.withColumn("evidence", joined_evidence(F.col("evidence"))).withColumn("label", label_id(F.col("label"), policy))
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", lenient(F.col("timestamp"), F.lit(as_of).cast("timestamp")))
    return df


def claims_file(spark: SparkSession, path: str) -> DataFrame:
    """(claim) of a text file with a claim per line, or JSON holding a list or {"claims": list}; blank ones left out."""
    if path.endswith(".txt"):
        rows = spark.read.text(path).select(F.trim("value").alias("claim"))
    elif path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True)
        listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "struct<claims:array<string>>")["claims"])
        rows = whole.select(F.explode(listed).alias("claim")).select(F.trim("claim").alias("claim"))
    else:
        raise ValueError("a claims file ends in .txt or .json")
    return rows.where("claim <> ''")


def feed_list(spark: SparkSession, path: str) -> DataFrame:
    """(link, kind) of a text file with a link per line."""
    return spark.read.text(path).select(F.trim("value").alias("link")).where("link <> ''").withColumn("kind", feed_kind(F.col("link")))


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Write the index tables (postings, lengths, vectors, ...) below one path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Read index tables back."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def claim_evidence_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims, report) of a CSV with claim and evidence.

    Claims that are blank or "nan", null evidence and empty evidence lists are left out and counted in the report.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = with_evidence_list(raw, "evidence", "evidences").select(F.trim("claim").alias("claim"), "evidences")
    good = (F.coalesce(F.col("claim"), F.lit("")) != "") & (F.lower("claim") != "nan") & (F.coalesce(F.size("evidences"), F.lit(0)) > 0)
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    n = F.when(F.col("ok"), F.size("evidences"))
    report = rows.agg(F.count("*").alias("total"), F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("skipped"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
    return rows.where("ok").select("claim", "evidences"), report
