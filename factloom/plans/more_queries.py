"""Queries of spans, embedding evaluation, set operations, JSON and ordered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import feeds, kb, models, search, spans
from factloom.operators.retrieval import cosine, small
from factloom.plans.registry import query
from factloom.plans.search_queries import _COS, _LG, _LM, _logits
from factloom.sources import synthetic
from factloom.sources.tables import table


@query("""WITH t AS (SELECT sample_id, text, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS i FROM labeled_claims),
s AS (SELECT sample_id, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t), u AS (SELECT *, a + length(token) AS b FROM s WHERE length(token) > 0),
c AS (SELECT sample_id, unnest(range(0, greatest(1, CAST(ceil(length(text) / 60.0) AS bigint)))) AS chunk_no, length(text) AS n FROM labeled_claims)
SELECT c.sample_id, chunk_no, count(*) AS n_tokens, round(avg(length(token)), 6) AS mean FROM c JOIN u ON u.sample_id = c.sample_id AND a < least(n, (chunk_no + 1) * 60) AND b > chunk_no * 60 GROUP BY ALL""")
def a10_span_pooling(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "labeled_claims").select("sample_id", "text")
    tokens, chunks = spans.token_spans(claims, "sample_id", F.col("text")), spans.fixed_chunks(claims, "sample_id", F.col("text"), 60)
    return spans.pooled(tokens, chunks, "sample_id", F.length("token")).select("sample_id", "chunk_no", "n_tokens", F.round("mean", 6).alias("mean"))


@query(f"""WITH o AS (SELECT label, arg_min(embedding, vec_id) AS e, min(vec_id) AS v FROM embeddings GROUP BY label), k AS (SELECT count(*) AS k FROM o),
n AS (SELECT m.vec_id, m.embedding, p.e AS pe, q.e AS oe FROM embeddings m JOIN o p ON p.label = m.label AND p.v <> m.vec_id JOIN o q ON q.label = (m.label + 1) % (SELECT k FROM k)),
s AS (SELECT a.vec_id, {_COS.replace("b.embedding", "a.pe")} AS pos, {_COS.replace("b.embedding", "a.oe")} AS neg FROM n a)
SELECT count(*) AS n, round(avg(pos), 5) AS positive, round(avg(neg), 5) AS negative, round(avg(pos - neg), 5) AS gap, round(1 - avg(pos), 5) AS positive_distance, round(1 - avg(neg), 5) AS negative_distance, round(avg(CASE WHEN round(pos, 9) > round(neg, 9) THEN 1.0 ELSE 0 END), 5) AS separated FROM s""")
def a9_embedding_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"), F.min("vec_id").alias("v"))
    n_labels = max(1, first.count())
    own = first.select("label", F.col("e").alias("pe"), "v")
    other = first.select(F.pmod(F.col("label") + n_labels - 1, F.lit(n_labels)).alias("label"), F.col("e").alias("oe"))
    both = v.join(small(own), "label").where("v <> vec_id").join(small(other), "label")
    s = both.select(cosine(F.col("embedding"), F.col("pe")).alias("pos"), cosine(F.col("embedding"), F.col("oe")).alias("neg"))
    won = F.when(F.round("pos", 9) > F.round("neg", 9), 1.0).otherwise(0.0)
    return s.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(a) for c, a in ((F.col("pos"), "positive"), (F.col("neg"), "negative"), (F.col("pos") - F.col("neg"), "gap"), (1 - F.col("pos"), "positive_distance"), (1 - F.col("neg"), "negative_distance"), (won, "separated"))])


@query()
def m16_late_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.operators.evidence import packed

    docs = table(spark, sf, "documents").select("doc_id", "text", packed(F.col("text"), 400).alias("pieces"))
    out = spans.late_chunks(docs, "doc_id", "text", "pieces", _length_encoder, 2)
    return out.select("doc_id", "chunk_no", F.round(F.col("embedding")[0], 6).alias("mean_length"))


def _length_encoder(tokens: list[str]):
    import numpy as np

    return np.array([[len(t), 1.0] for t in tokens]).reshape(len(tokens), 2)


@query(r"""WITH t AS (SELECT sample_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS n FROM labeled_claims)
SELECT sample_id, 2048 AS length, n + 2 AS attended, n AS ignored_before FROM t""")
def m18_supervised(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(text.word_tokens(F.col("text")), lambda w: F.pmod(F.hash(w), F.lit(30_000)).cast("int"))
    s = table(spark, sf, "labeled_claims").select("sample_id", spans.supervised(ids, F.lit(7), 2, 2048).alias("s"))
    return s.select("sample_id", F.size("s.input_ids").alias("length"), F.aggregate("s.attention", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"), (F.array_position("s.labels", F.lit(7)) - 1).alias("ignored_before"))


@query("SELECT source FROM feed_sources WHERE source IS NOT NULL EXCEPT SELECT source FROM web_posts WHERE source IS NOT NULL")
def w13_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (table(spark, sf, t).where("source is not null").select("source") for t in ("feed_sources", "web_posts"))
    return a.subtract(b)


@query("SELECT post_key AS record_key, source, 'web' AS kind FROM web_posts UNION ALL SELECT social_key, source, 'social' FROM social_posts")
def w14_union(spark: SparkSession, sf: str) -> DataFrame:
    web = table(spark, sf, "web_posts").select(F.col("post_key").alias("record_key"), "source", F.lit("web").alias("kind"))
    return web.unionByName(table(spark, sf, "social_posts").select(F.col("social_key").alias("record_key"), "source", F.lit("social").alias("kind")))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def w9_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("""SELECT social_key, array_to_string(list_filter(l, lambda u, i: list_position(l, u) = i), '; ') AS urls FROM (SELECT social_key, list_concat(coalesce(image_urls, []), coalesce(video_urls, []), coalesce(image_urls, [])) AS l FROM social_posts)""")
def w10_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("image_urls", none), F.coalesce("video_urls", none), F.coalesce("image_urls", none))
    return table(spark, sf, "social_posts").select("social_key", F.array_join(F.array_distinct(both), "; ").alias("urls"))


@query("SELECT sample_id, row_number() OVER (ORDER BY md5('42|' || sample_id), sample_id) AS place FROM labeled_claims")
def w12_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    order = table(spark, sf, "labeled_claims").select("sample_id", F.md5(F.concat_ws("|", F.lit("42"), F.col("sample_id").cast("string"))).alias("h"))
    return kb.numbered(order, ["h", "sample_id"]).select("sample_id", F.col("place").alias("place"))


@query("""SELECT post_key, concat_ws('|', 'title=' || title, 'date_raw=' || date_raw, 'url=' || url) AS metadata FROM web_posts""")
def j14_open_metadata(spark: SparkSession, sf: str) -> DataFrame:
    own = feeds.open_metadata(table(spark, sf, "web_posts").select("post_key", "title", "date_raw", "url"), ["post_key"])
    pairs = F.transform(F.array(*[F.lit(k) for k in ("title", "date_raw", "url")]), lambda k: F.concat(k, F.lit("="), F.try_element_at("metadata", k)))
    return own.select("post_key", F.array_join(pairs, "|").alias("metadata"))


@query("SELECT post_id, coalesce(post_text, '') AS text, source AS author, coalesce(comment_count, 0) AS comment_count FROM social_posts")
def j9_story_nodes(spark: SparkSession, sf: str) -> DataFrame:
    node = F.struct(
        F.col("post_id"), F.struct(F.col("post_text").alias("text")).alias("message"), F.array(F.struct(F.col("source").alias("name"))).alias("actors"),
        F.struct(F.struct(F.col("comment_count").alias("total_count")).alias("comments")).alias("feedback"))
    edges = F.array(F.struct(node.alias("node"))).alias("edges")
    # a third of the posts in each of the three shapes of a response
    timeline, group = (F.to_json(F.struct(F.struct(F.struct(F.struct(edges).alias(name)).alias("node")).alias("data"))) for name in ("timeline_list_feed_units", "group_feed"))
    story = node.withField("__typename", F.lit("Story"))
    single = F.to_json(F.struct(F.struct(story.alias("node")).alias("data")))
    shape = F.when(F.col("social_key") % 3 == 0, timeline).when(F.col("social_key") % 3 == 1, group).otherwise(single)
    raw = table(spark, sf, "social_posts").select(feeds.first_line(F.concat(F.lit("for (;;);"), shape, F.lit("\n{}"))).alias("r"))
    return feeds.post_rows(raw, "r").select("post_id", "text", "author", "comment_count")


@query("""SELECT f.source, CAST(sum(CASE WHEN c.comment_key IS NOT NULL THEN 1 ELSE 0 END) AS bigint) AS n FROM feed_sources f LEFT JOIN flat_comments c ON c.source = f.source AND c.is_reply GROUP BY f.source""")
def jn7_replies_per_source(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "flat_comments").where("is_reply").groupBy("source").agg(F.count("*").alias("c"))
    return table(spark, sf, "feed_sources").join(counts, "source", "left").groupBy("source").agg(F.coalesce(F.max("c"), F.lit(0)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation), s AS (SELECT min(n_nationkey) AS start FROM nation GROUP BY n_regionkey),
w AS (SELECT start, 0 AS step, start AS node FROM s UNION ALL SELECT w.start, w.step + 1, e.b FROM w JOIN e ON e.a = w.node WHERE e.b IS NOT NULL AND w.step < 50) SELECT start, step, node FROM w""")
def src10_linked_walk(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    edges = nation.select("n_nationkey", F.lead("n_nationkey").over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("b"))
    return feeds.walk(edges, "n_nationkey", "b", nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("start")))


@query()
def src12_synthetic_claims(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("title is not null").select(F.col("doc_id").cast("string").alias("topic"), F.col("title").alias("true_stmt"), F.col("text").alias("evidence_core"), F.concat(F.lit("It is wrong that "), text.lower_first(F.col("title"))).alias("contradict_stmt"))
    return synthetic.claims(docs, 2, ["Reportedly,", "Analysts say", "Theo tin mới,"], ["", " this year", " hôm nay"])


@query(f"""SELECT sample_id, v, CASE WHEN v THEN s ELSE s || {" || ".join(f"CASE WHEN contains(lower(s), '{t}') THEN ' {' '.join(y[:2])}' ELSE '' END" for t, y in text.GLOSSARY)} END AS search_text
FROM (SELECT sample_id, s, length(s) >= 1200 OR len(regexp_extract_all(lower(s), '[a-z0-9]+')) >= 200 AS v FROM (SELECT sample_id, trim(regexp_replace(coalesce(text, ''), '[{text.BLANK}]+', ' ', 'g')) AS s FROM labeled_claims))""")
def r22_prepared_queries(spark: SparkSession, sf: str) -> DataFrame:
    return search.prepared(table(spark, sf, "labeled_claims"), "text").select("sample_id", F.col("verbatim").alias("v"), "search_text")


@query("SELECT label, avg(CASE WHEN len(embedding) = 64 THEN 1.0 ELSE 0.0 END) AS share_ok FROM embeddings GROUP BY label")
def f12_dimension_check(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.when(F.size(F.when(F.size("embedding") == 64, F.col("embedding"))) == 64, 1.0).otherwise(0.0)
    return table(spark, sf, "embeddings").groupBy("label").agg(F.avg(ok).alias("share_ok"))


@query(f"""WITH {_LG}, e AS (SELECT sample_id, y, list_transform({_LM}, lambda v: exp(v::double)) AS e FROM lg)
SELECT sample_id, round(-[0.5, 2.0, 1.0][y + 1] * ln(e[y + 1] / list_sum(e) + 1e-12) + 0.01 * 0.36, 6) AS loss FROM e""")
def m6_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    p = models.softmax(F.col("lm"))
    return _logits(spark, sf).select("sample_id", F.round(models.cross_entropy(p, F.col("y"), [0.5, 2.0, 1.0], models.ridge(0.01, F.lit(0.6))), 6).alias("loss"))


@query()
def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.plans.search_queries import _hybrid
    from factloom.plans.verify import predictions

    claims = table(spark, sf, "labeled_claims").where("sample_id % 100 = 0").select("sample_id", "text")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("link"))
    out = predictions(claims, "sample_id", "text", _hybrid(spark, sf), docs, models.lexical_scorer, models.SlotNetwork(5))
    return out.select("sample_id", "verdict", "label_id", F.round("confidence", 6).alias("confidence"), F.size("evidence").alias("n_evidence"), F.array_join("source_links", "; ").alias("links"))
