"""File sinks for posts and claims: JSON, Markdown, CSV, Parquet, laid out by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import collapse_blank, safe_name
from factloom.functions.urls import slug
from factloom.operators.posts import flat_rows, markdown


def write_posts(posts: DataFrame, path: str, kind: str) -> None:
    """Canonical posts as ``kind``: json keeps comments nested, csv and parquet are flat with text columns, md is one document a row."""
    if kind == "json":
        posts.withColumn("source_slug", safe_name(F.col("source"))).write.mode("overwrite").partitionBy("source_slug").json(path)
    elif kind == "md":
        markdown(posts).select(F.col("md").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    elif kind in ("csv", "parquet"):
        flat = flat_rows(posts)
        flat = flat.select(*[F.col(c).cast("string").alias(c) for c in flat.columns]).withColumn("source_slug", safe_name(F.col("source")))
        writer = flat.write.mode("overwrite").partitionBy("source_slug")
        writer.csv(path, header=True, escape='"') if kind == "csv" else writer.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")


def write_web_posts(posts: DataFrame, path: str, kind: str) -> None:
    """Web posts (source, title, date, url, content, ...) as ``kind``, by source; md is one document a row."""
    named = posts.withColumn("source_slug", safe_name(F.coalesce(F.nullif("source", F.lit("")), F.lit("web")))).withColumn("url_slug", slug(F.col("url")))
    if kind == "md":
        head = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.concat(F.lit("**URL:** <"), "url", F.lit(">")), F.lit(""), F.coalesce("content", F.lit("")))
        named.select(head.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    elif kind == "json":
        named.write.mode("overwrite").partitionBy("source_slug").json(path)
    elif kind in ("csv", "parquet"):
        flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in named.dtypes]
        writer = named.select(*flat).write.mode("overwrite").partitionBy("source_slug")
        writer.csv(path, header=True, escape='"') if kind == "csv" else writer.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")


def crawl_rows(pages: DataFrame, crawled_at: str) -> DataFrame:
    """(id, title, content, article_url, source_url, published_at) as crawl JSON has them: blanks collapsed, the id from the
    address, the crawl's time where a page has none."""
    return pages.select(
        F.md5(F.concat("article_url", F.lit("_0"))).alias("id"), collapse_blank(F.col("title")).alias("title"), collapse_blank(F.col("content")).alias("content"),
        "article_url", "source_url", F.coalesce("published_at", F.lit(crawled_at)).alias("published_at"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Synthetic samples as CSV with the header claim,evidence,label,type."""
    samples.select("claim", "evidence", "label", "type").write.mode("overwrite").csv(path, header=True, escape='"')


def write_clusters(members: DataFrame, path: str) -> None:
    """(cluster, claim, is_medoid) as one JSON object per cluster with its size, representative and claims."""
    out = members.groupBy(F.col("cluster").alias("cluster_id")).agg(
        F.count("*").alias("size"), F.min(F.when(F.col("is_medoid"), F.col("claim"))).alias("representative_claim"), F.array_sort(F.collect_list("claim")).alias("claims"))
    out.write.mode("overwrite").json(path)
