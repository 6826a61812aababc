"""The queries of the training-data problems, by name, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import boilerplate, charform, leakage, mixing, overlap, pii, quality, residue, splitting
from factloom.operators.timelines import with_readings
from factloom.sources.tables import table
from factloom.storage import materialize


def _web_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Line digests of the posts; the day is the publication's, read from its text, else that of the fetch."""
    posts = table(spark, sf, "web_posts").select("post_key", "source", "content", "date_raw", "fetched_at")
    posts = with_readings(posts, F.col("date_raw"), table(spark, sf, "feed_sources"))
    day = F.coalesce(F.to_date(F.timestamp_seconds(F.get("instants", F.lit(0)))), F.to_date("fetched_at"))
    return materialize(boilerplate.digest_lines(posts, "post_key", "source", "content", day), "digests")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    digests = _web_digests(spark, sf)
    # the stated case counts plain rows; clusters and dates of the same lines decide what p1_clean removes
    lines = boilerplate.line_statistics(digests).where("n_rows >= 4 and n_rows >= 0.05 * src_rows")
    return boilerplate.occurrences(digests, materialize(lines, "lines")).select(F.col("doc_key").alias("post_key"), "line_no")


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    posts, digests = table(spark, sf, "web_posts"), _web_digests(spark, sf)
    clean = boilerplate.strip_lines(posts.select("post_key", "source", "content"), "post_key", "content", digests, materialize(boilerplate.boilerplate(digests), "lines"))
    return clean.select("post_key", "source", "body", "n_removed")


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    web = charform.with_forms(table(spark, sf, "web_posts"), "post_key", "content", "web_post")
    return web.unionByName(charform.with_forms(table(spark, sf, "social_posts"), "social_key", "post_text", "social_post"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return charform.look_alike_pairs(_forms(spark, sf))


def p2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    web = table(spark, sf, "web_posts").select(F.lit("web_post").alias("record_kind"), F.col("post_key").alias("record_key"), charform.form_column(F.col("content"), True).alias("text"))
    own = table(spark, sf, "social_posts")
    return web.unionByName(own.select(F.lit("social_post").alias("record_kind"), F.col("social_key").alias("record_key"), charform.form_column(F.col("post_text"), True).alias("text")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    posts = pii.with_kinds(table(spark, sf, "social_posts"), "social_key", "post_text", "social_post")
    return posts.unionByName(pii.with_kinds(table(spark, sf, "flat_comments"), "comment_key", "comment_text", "comment"))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    posts = table(spark, sf, "social_posts").select(F.lit("social_post").alias("record_kind"), F.col("social_key").alias("record_key"), F.col("post_text").alias("text"))
    comments = table(spark, sf, "flat_comments").select(F.lit("comment").alias("record_kind"), F.col("comment_key").alias("record_key"), F.col("comment_text").alias("text"))
    return pii.redacted(posts.unionByName(comments), "text")


def _residue(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(bodies, scored) of all posts; the fit alone reads a sample."""
    posts = table(spark, sf, "web_posts")
    digests = boilerplate.digest_lines(posts, "post_key", "source", "content", F.to_date("fetched_at"), keep=("title",), keep_lines=True, sourceless=True)
    digests = materialize(digests, "digests")
    repeated = materialize(boilerplate.frequent_lines(digests.where("src is not null")), "frequent")
    rows = materialize(residue.weak_label(residue.bodies(residue.sample(digests), repeated)), "sample")
    bodies = residue.bodies(digests, repeated)
    return bodies, residue.score(bodies, residue.fit(rows))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf)[1].where("score > 0").select(F.col("doc_key").alias("post_key"))


def p5_validation(spark: SparkSession, sf: str) -> DataFrame:
    bodies, scored = _residue(spark, sf)
    # written first: a filter on the labels would be pushed down and compute them twice
    return residue.validation(materialize(residue.weak_label(bodies).select("doc_key", "weak"), "labels"), scored)


def _overlaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return overlap.class_overlaps(table(spark, sf, "labeled_claims"), "sample_id", "split_name", ["text", "evidence"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    both = [F.col("eval_key"), F.col("train_key")]
    return overlap.expanded(*_overlaps(spark, sf)).where("eval_key <> train_key").select("field_name", F.least(*both).alias("key_a"), F.greatest(*both).alias("key_b")).distinct()


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.report(*_overlaps(spark, sf), table(spark, sf, "labeled_claims"), "sample_id", "split_name", "source")


def _limits(spark: SparkSession, sf: str) -> dict[str, tuple[int, int]]:
    """The limits by table: a fixed table of two rows."""
    return {r["table_name"]: (r["max_chars"], r["overlap_chars"]) for r in table(spark, sf, "split_limits").limit(1000).collect()}


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limits = _limits(spark, sf)
    web = splitting.split_long(table(spark, sf, "web_posts"), "post_key", "content", *limits["web_posts"], "web_post")
    return web.unionByName(splitting.split_long(table(spark, sf, "labeled_claims"), "sample_id", "evidence", *limits["labeled_claims"], "claim_evidence"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pieces(spark, sf).where("piece_no = 0 and n_pieces > 1").select("record_kind", "record_key")


P7_SQL = """
SELECT 'web_post' AS record_kind, post_key AS record_key FROM web_posts
WHERE length(content) > (SELECT max_chars FROM split_limits WHERE table_name = 'web_posts')
UNION ALL
SELECT 'claim_evidence' AS record_kind, sample_id AS record_key FROM labeled_claims
WHERE length(evidence) > (SELECT max_chars FROM split_limits WHERE table_name = 'labeled_claims')
"""


def _leaks(spark: SparkSession, sf: str, **how) -> DataFrame:
    return leakage.leak_spans(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text", **how)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf, places=False).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf, min_coverage=0.5)


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return leakage.remove_spans(docs, "doc_id", "text", materialize(_leaks(spark, sf, min_coverage=0.5), "leaks"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed, _ = mixing.mix(mixing.sized_documents(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))
    return mixed.where("copies > 0")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "mix_targets")
    mixed, _ = mixing.mix(mixing.sized_documents(table(spark, sf, "documents")), targets)
    return mixing.report(mixed, targets)


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    stats = materialize(quality.statistics(table(spark, sf, "documents"), "text", ["doc_id"]), "statistics")
    return quality.classify(stats, quality.learn(stats, "doc_id", table(spark, sf, "doc_labels"), "kind_label"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf).where("kind <> 'prose'").select("doc_id")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        p1_found, p1_clean, p2_found, p2_normalized, p3_found, p3_redacted, p5_found, p5_validation, p6_found, p6_report, p7_found, p7_pieces, p8_found, p8_spans, p8_clean, p9_mix, p9_shares, p10_found, p10_statistics,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL}
