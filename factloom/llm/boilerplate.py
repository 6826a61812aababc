"""Lines that one source repeats from document to document (problem 1).

A line counts as the same line apart from letter case, blank space, running figures and the way its
characters are encoded. Each document becomes an array of line digests once; counts, clusters and
dates are aggregates over those digests, so the texts themselves are never shuffled.

Copies are collapsed first: documents of a source whose long lines are the same, leaving aside the lines that
source repeats, are one cluster, whatever furniture surrounds them. A line's weight is its number of distinct
clusters and publication dates, and its share is taken over the source's clusters. A republished article
therefore raises the row count of its lines but not their cluster count. ``line_statistics`` gives all
these figures for each line that may be a site's own; the caller decides by which of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.charform import folded_column
from factloom.storage import count_at_most, materialize

BROADCAST_SOURCES = 20_000


def line_keys(text: Column) -> Column:
    """Array of the comparison forms of a text's lines, as many as cutting at line feeds gives."""
    whole = F.regexp_replace(folded_column(text, keep_lines=True), "[0-9]+(?:[.,][0-9]+)*", "#")
    return F.transform(F.split(whole, "\n", -1), lambda x: F.trim(x))


def digest_lines(posts: DataFrame, key: str, source: str, text: str, day: Column, long_line: int = 60,
                 keep: tuple[str, ...] = (), keep_lines: bool = False, sourceless: bool = False) -> DataFrame:
    """(doc_key, source, src, day, lines, long) per document; ``lines`` holds null for a blank line, ``long`` whether a line is long.

    Documents without text or source stay out: they have no lines, or no site whose habit could be counted. With
    ``sourceless`` those without source stay in, with a null ``src``.
    ``keep`` names further columns to carry along; with ``keep_lines`` the comparison forms stay as column ``k``.
    """
    # the filter names input columns only: on the computed lines it would be pushed down and compute them twice
    posts = posts.where(F.col(text).isNotNull() & (F.lit(sourceless) | F.col(source).isNotNull()))
    rows = posts.select(F.col(key).alias("doc_key"), F.col(source).alias("source"), day.alias("day"), *keep, line_keys(F.col(text)).alias("k"))
    digests = F.transform("k", lambda x: F.when(x != "", F.xxhash64(x)))
    long = F.transform("k", lambda x: F.length(x) >= long_line)
    return rows.select("doc_key", "source", F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("src"), "day", digests.alias("lines"), long.alias("long"), *keep, *(("k",) if keep_lines else ()))


def repeated_lines(digests: DataFrame, min_rows: int = 4) -> DataFrame:
    """(src, line, n_rows): lines standing in at least that number of a source's rows."""
    lines = digests.select("src", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line"))
    return lines.groupBy("src", "line").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)


def frequent_lines(digests: DataFrame, min_share: float = 0.05, min_rows: int = 4) -> DataFrame:
    """(src, line, n_rows, src_rows): lines standing in at least that share and number of a source's rows."""
    totals = digests.groupBy("src").agg(F.count("*").alias("src_rows"))
    # the right side has at most a row per source; counts are already reduced to repeated lines
    return repeated_lines(digests, min_rows).join(totals, "src").where(F.col("n_rows") >= F.lit(min_share) * F.col("src_rows"))


def per_source(lines: DataFrame) -> DataFrame:
    """(src, repeated): a source's repeated lines as an array.

    Lines in a share s of a source's rows number at most 1/s times its mean lines per row, so the
    array is bounded, whatever the size of the source.
    """
    return lines.groupBy("src").agg(F.collect_set("line").alias("repeated"))


def attach(digests: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join the arrays to the documents: broadcast while the counted sources allow it, else by a join AQE can split."""
    if count_at_most(by_source, BROADCAST_SOURCES) <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    return digests.join(by_source, "src", how)


def clustered(digests: DataFrame, furniture: DataFrame) -> DataFrame:
    """``digests`` with ``cluster``: the same for documents of a source with the same long lines besides the ``furniture`` (src, line, n_rows).

    A document without lines of its own, such as one that is itself repeated often, is known by its rarest line, a long one if there is any.
    """
    by_source = furniture.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_rows", "line"))), lambda x: x["line"]).alias("repeated"))
    marked = attach(digests, materialize(by_source, "per_source"), "left")
    known = F.coalesce("repeated", F.array().cast("array<bigint>"))
    lines = F.filter("lines", lambda x: x.isNotNull())
    longs = F.filter("lines", lambda x, i: x.isNotNull() & F.get("long", i))
    choices = (F.array_except(longs, known), F.array_except(lines, known), F.slice(F.array_intersect(known, longs), 1, 1), F.slice(F.array_intersect(known, lines), 1, 1))
    whole = F.array().cast("array<bigint>")
    for c in reversed(choices):
        whole = F.when(F.size(c) > 0, c).otherwise(whole)
    return marked.select(*digests.columns, F.xxhash64(F.array_sort(whole)).alias("cluster"))


def line_statistics(digests: DataFrame, min_share: float = 0.05, min_rows: int = 4) -> DataFrame:
    """(src, line, n_rows, src_rows, n_clusters, src_clusters, n_days) of every line that stands in the given share and number of
    its source's rows or of its clusters: rows, distinct clusters and publication dates of the line, rows and clusters of the source.
    """
    counts = materialize(repeated_lines(digests, min_rows), "repeated_lines")
    rows = digests.groupBy("src").agg(F.count("*").alias("src_rows"))
    frequent = counts.join(rows, "src").where(F.col("n_rows") >= F.lit(min_share) * F.col("src_rows"))
    docs = materialize(clustered(digests, frequent).select("src", "day", "lines", "cluster"), "clustered")
    sizes = docs.groupBy("src", "cluster").agg(F.count("*").alias("n")).groupBy("src").agg(F.sum("n").alias("src_rows"), F.count("*").alias("src_clusters"))
    # a line stands in no more clusters than rows, and a source has no more clusters than rows: nothing that counts is left out
    possible = counts.join(sizes, "src").where(F.col("n_rows") >= F.lit(min_share) * F.col("src_clusters"))
    possible = materialize(possible, "possible_lines")
    marked = attach(docs, materialize(per_source(possible), "per_source"))
    hits = marked.select("src", "cluster", "day", F.explode(F.array_intersect("lines", "repeated")).alias("line"))
    once = hits.groupBy("src", "line", "cluster").agg(F.collect_set("day").alias("days"))
    days = once.select("src", "line", F.explode_outer("days").alias("day")).groupBy("src", "line").agg(F.countDistinct("day").alias("n_days"))
    clusters = once.groupBy("src", "line").agg(F.count("*").alias("n_clusters"))
    return possible.join(clusters, ["src", "line"]).join(days, ["src", "line"])


def occurrences(digests: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_key, line_no): each occurrence of a frequent line."""
    marked = attach(digests, materialize(per_source(frequent), "per_source"))
    placed = marked.select("doc_key", "repeated", F.posexplode("lines").alias("line_no", "line"))
    return placed.where(F.array_contains("repeated", F.col("line"))).select("doc_key", "line_no")


def boilerplate(digests: DataFrame, min_share: float = 0.05, min_clusters: int = 4, min_days: int = 2) -> DataFrame:
    """Lines that stand in enough of a source's distinct clusters, and on enough dates, to be the site's own."""
    share = F.col("n_clusters") >= F.lit(min_share) * F.col("src_clusters")
    return line_statistics(digests, min_share, min_clusters).where(share & (F.col("n_clusters") >= min_clusters) & (F.col("n_days") >= min_days))


def strip_lines(posts: DataFrame, key: str, text: str, digests: DataFrame, lines: DataFrame) -> DataFrame:
    """``posts`` with ``body`` (the text without those lines, else unchanged) and ``n_removed``.

    Rows without text or source come out unchanged with 0 removed lines.
    """
    marked = attach(digests.select("doc_key", "src", "lines"), materialize(per_source(lines), "per_source"))
    flags = marked.select(F.col("doc_key").alias(key), F.transform("lines", lambda x: F.coalesce(F.array_contains("repeated", x), F.lit(False))).alias("_drop"))
    out = posts.join(flags, key, "left")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.element_at(F.col("_drop"), (i + 1).cast("int")))
    n = F.coalesce(F.size(F.filter("_drop", lambda x: x)), F.lit(0))
    n = F.when(F.col("_drop").isNull(), 0).otherwise(n)
    return out.withColumn("body", F.when(n > 0, F.array_join(kept, "\n")).otherwise(F.col(text))).withColumn("n_removed", n).drop("_drop")
