"""Queries of the file sources, stored indexes, feed responses and page filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import feeds, html, retrieval, spans
from factloom.plans.registry import query
from factloom.plans.search_queries import _BM25, _RANKED, _claims
from factloom.plans.text_queries import _LABELS
from factloom.sources import files
from factloom.sources.tables import table
from factloom.storage import materialize, shared_dir, temporary

AS_OF = "2026-01-01 00:00:00"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among the intermediate tables, which is removed with them."""
    return temporary(spark, f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}")


@query(f"""SELECT sample_id, md5(text) AS text_md5, md5(coalesce(CASE WHEN trim(evidence) LIKE '[%]' THEN array_to_string(try_cast(trim(evidence) AS varchar[]), '|||') END, trim(evidence), '')) AS evidence_md5,
 coalesce(CASE WHEN n IN (0, 1, 2) THEN CAST(n AS int) END, {_LABELS["loader"]}, 2) AS label FROM (SELECT *, try_cast(label AS double) AS n FROM labeled_claims)""")
def src1_labeled_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "claims-csv")
    table(spark, sf, "labeled_claims").select("sample_id", "text", "evidence", "label").write.csv(path, header=True, escape='"')
    read = files.labeled_csv(spark, path, AS_OF)
    return read.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.md5("text").alias("text_md5"), F.md5("evidence").alias("evidence_md5"), F.coalesce("label", F.lit(2)).alias("label"))


@query("SELECT trim(title) AS claim, count(*) AS n FROM documents WHERE trim(title) <> '' AND NOT contains(title, chr(10)) GROUP BY 1")
def src3_claims_file(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "claims") + ".txt"
    temporary(spark, path)
    table(spark, sf, "documents").where("title is not null and not contains(title, '\\n')").select("title").write.text(path)
    return files.claims_file(spark, path).groupBy("claim").agg(F.count("*").alias("n"))


@query("SELECT trim(post_url) AS link, CASE WHEN post_url LIKE '%/groups/%' OR post_url LIKE '%/group/%' THEN 'group' ELSE 'page' END AS kind, count(*) AS n FROM social_posts WHERE trim(post_url) <> '' GROUP BY ALL")
def src4_feed_list(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "feeds")
    table(spark, sf, "social_posts").where("post_url is not null").select("post_url").write.text(path)
    return files.feed_list(spark, path).groupBy("link", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_BM25}, {_RANKED} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank < 5")
def src11_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    path, docs, tokens = _folder(spark, "index"), table(spark, sf, "documents"), text.word_tokens(F.col("text"))
    files.save_index({"documents": retrieval.document_index(docs, "doc_id", tokens)}, path)
    index = files.load_index(spark, path, ["documents"])["documents"]
    found = retrieval.LexicalSearch(index, "doc_id", F.col("terms"), _claims(spark, sf), "sample_id", tokens, stored=True)
    return found.top(5).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), 'http\S+|www\.\S+', ' ', 'g'), '[\p{L}\p{N}]+'), lambda w: NOT list_contains(string_split('"""
       + " ".join(text.STOPWORDS) + """', ' '), w)), ' ') AS words FROM documents""")
def t7_retrieval_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.retrieval_tokens(F.col("text")), " ").alias("words"))


@query("SELECT comment_key, coalesce(comment_text, '') AS text, coalesce(nullif(comment_reactions, ''), '0') AS reactions FROM flat_comments")
def j4_comment_responses(spark: SparkSession, sf: str) -> DataFrame:
    node = F.struct(F.struct(F.struct(F.col("comment_text").alias("text")).alias("body"), F.struct(F.struct(F.nullif("comment_reactions", F.lit("")).alias("count_reduced")).alias("reactors")).alias("feedback")).alias("node"))
    response = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(node).alias("edges")).alias("comments")).alias("node")).alias("data")))
    found = table(spark, sf, "flat_comments").select("comment_key", F.explode(feeds.comments_of(response)).alias("c"))
    return found.select("comment_key", "c.text", F.col("c.reaction_count").alias("reactions"))


@query("""SELECT social_key, array_to_string(list_concat(list_transform(coalesce(image_urls, []), lambda u: 'photo ' || u), list_transform(coalesce(video_urls, []), lambda u: 'video ' || u)), '; ') AS media,
 len(coalesce(video_urls, [])) > 0 OR contains(lower(array_to_string(coalesce(image_urls, []), ' ')), 'reel') AS video FROM social_posts""")
def j11_media(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    listed = lambda c, kind: F.transform(F.coalesce(c, none), lambda u: F.struct(F.struct(F.lit(kind).alias("__typename"), u.alias("url")).alias("media")))
    node = F.to_json(F.struct(F.concat(listed("image_urls", "Photo"), listed("video_urls", "Video")).alias("attachments")))
    own = table(spark, sf, "social_posts").select("social_key", node.alias("n"))
    media = F.transform(feeds.media_of(F.col("n")), lambda m: F.concat_ws(" ", m["type"], m["url"]))
    return own.select("social_key", F.array_join(media, "; ").alias("media"), feeds.has_video(F.col("n")).alias("video"))


@query("SELECT post_key, CAST(epoch(fetched_at) AS bigint) AS seconds FROM web_posts")
def t20_published_at(spark: SparkSession, sf: str) -> DataFrame:
    # a fifth of the pages with each of the five marks of a publication time, and the zone written in three ways
    stamp = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.when(F.col("post_key") % 3 == 0, F.concat(stamp, F.lit("Z"))).when(F.col("post_key") % 3 == 1, F.concat(stamp, F.lit("+00:00"))).otherwise(F.concat(F.date_format(F.col("fetched_at") + F.expr("interval 7 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00")))
    mark = F.lit("")
    for i, (attribute, value) in enumerate(html.PUBLISHED):
        mark = F.when(F.col("post_key") % len(html.PUBLISHED) == i, F.concat(F.lit(f"<meta {attribute}='{value}' content='"), zoned, F.lit("'>"))).otherwise(mark)
    page = F.concat(F.lit("<html><head><meta charset='utf-8'>"), mark, F.lit("</head><body><article><p>Some words that make an article of a few lines.</p></article></body></html>"))
    got = table(spark, sf, "web_posts").select("post_key", html.article(page).alias("a"))
    return got.select("post_key", F.unix_timestamp(F.to_timestamp("a.published_at")).alias("seconds"))


@query("SELECT post_key FROM web_posts WHERE trim(coalesce(content, '')) = '' OR length(content) < 2500 AND contains(lower(content), 'javascript')")
def f9_retry_set(spark: SparkSession, sf: str) -> DataFrame:
    walled = (F.length("content") < 2500) & F.lower("content").contains("javascript")
    content = F.when(walled, "").otherwise(F.col("content"))
    pages = table(spark, sf, "web_posts").select("post_key", content.alias("content"), F.lit(False).alias("skipped"))
    return html.retry_set(pages).select("post_key")


@query(r"""WITH t AS (SELECT sample_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS c, list_transform(list_filter(string_split(coalesce(evidence, ''), '|||'), lambda s: trim(s) <> ''), lambda s: len(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'))) AS e FROM labeled_claims),
u AS (SELECT sample_id, least(c, 52) AS c, 60 - 8 - least(c, 52) AS room, e FROM t),
k AS (SELECT sample_id, c, list_filter(e, lambda x, i: list_sum(e[1:i]) <= room) AS kept FROM u)
SELECT sample_id, 8 + c + coalesce(list_sum(kept), 0) - 2 AS n FROM k""")
def m18_truncated(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda c: F.transform(text.word_tokens(c), lambda w: F.pmod(F.hash(w), F.lit(30_000)).cast("int"))
    items = F.transform(F.filter(F.split(F.coalesce("evidence", F.lit("")), "\\|\\|\\|"), lambda s: F.trim(s) != ""), ids)
    fixed = lambda n: F.array_repeat(F.lit(1), n)
    prompt = spans.truncated(fixed(3), ids(F.col("text")), fixed(2), items, fixed(1), 60)
    return table(spark, sf, "labeled_claims").select("sample_id", F.size(prompt).cast("bigint").alias("n"))


@query("""WITH c AS (SELECT sample_id, lower(substr(text, 1, 60)) AS head FROM labeled_claims WHERE sample_id % 100 = 0 AND length(text) >= 60)
SELECT sample_id, count(d.doc_id) AS n FROM c LEFT JOIN documents d ON contains(lower(d.text), c.head) GROUP BY sample_id""")
def jn12_containment(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "labeled_claims").where("sample_id % 100 = 0 and length(text) >= 60").select("sample_id", F.lower(F.substring("text", 1, 60)).alias("head"))
    found = retrieval.containing(table(spark, sf, "documents"), "doc_id", "text", materialize(asked, "asked"), "sample_id", "head")
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(counts, F.col("query_id") == F.col("sample_id"), "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("n"))
