"""Queries of retrieval, ranking, metrics, vectors, fusion and posts.

Searches take as queries every claim (or vector) whose id is divisible by 100, against all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import labels, text
from factloom.operators import metrics, models, posts, retrieval, search
from factloom.plans.registry import query
from factloom.sources.tables import table
from factloom.storage import gathered, materialize

AS_OF = "2026-01-01 00:00:00"
_AS_OF_US = f"epoch_us(TIMESTAMPTZ '{AS_OF}+00:00')"


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _claims(spark: SparkSession, sf: str, every: int = 100) -> DataFrame:
    """The stated query set: claims whose id is divisible by ``every``."""
    return table(spark, sf, "labeled_claims").where(F.col("sample_id") % every == 0).select("sample_id", "text")


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_BM25 = rf"""d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
po AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM po GROUP BY ALL),
q AS (SELECT DISTINCT sample_id AS query_id, unnest({_TOKENS}) AS term FROM labeled_claims WHERE sample_id % 100 = 0),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), c GROUP BY query_id, doc_id)"""
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM s)"


def _search(spark: SparkSession, sf: str, every: int = 100) -> retrieval.LexicalSearch:
    tokens = text.word_tokens(F.col("text"))
    return retrieval.LexicalSearch(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", tokens, _claims(spark, sf, every), "sample_id", tokens)


@query(f"WITH {_BM25}, {_RANKED} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank < 20")
def r2_bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf).top(20).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query()
def r4_bm25_fields(spark: SparkSession, sf: str) -> DataFrame:
    return search.fielded_top(table(spark, sf, "documents"), "doc_id", ("title^3", "text"), _claims(spark, sf), "sample_id", "text", 20)


_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = f"{_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')}))"


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COS}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), {_RANKED}
SELECT query_id, doc_id, round(score, 5) AS score, rank FROM r WHERE rank < 10""")
def r5_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    best = retrieval.nearest(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return best.select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_BM25}, {_RANKED}, l AS (SELECT query_id, doc_id, rank FROM r WHERE rank < 50),
e AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, doc_id) - 1 AS rank FROM (SELECT DISTINCT query_id FROM l) CROSS JOIN (SELECT doc_id, published_at FROM documents WHERE published_at IS NOT NULL ORDER BY published_at DESC, doc_id LIMIT 50)),
f AS (SELECT query_id, doc_id, l.rank AS r1, e.rank AS r2, greatest(50, count(*) OVER (PARTITION BY query_id)) AS m FROM l FULL JOIN e USING (query_id, doc_id))
SELECT query_id, doc_id, round(1.0 / (60 + coalesce(r1, m)) + 1.0 / (60 + coalesce(r2, m)), 9) AS rrf_score FROM f""")
def r8_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    lexical = materialize(_search(spark, sf).top(50), "lexical")
    latest = table(spark, sf, "documents").where("published_at is not null").orderBy(F.desc("published_at"), "doc_id").limit(50).select("doc_id", "published_at")
    w = W.partitionBy("query_id").orderBy(F.desc("published_at"), "doc_id")
    dense = lexical.select("query_id").distinct().withColumn("_", F.lit(1)).join(F.broadcast(latest.withColumn("_", F.lit(1))), "_").select("query_id", "doc_id", (F.row_number().over(w) - 1).alias("rank"))
    return retrieval.fuse(lexical, dense, 50).select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"SELECT doc_id, round(coalesce(exp(-0.05 * greatest(0, ({_AS_OF_US} - epoch_us(published_at)) / 8.64e10)), 0), 6) AS recency FROM documents")
def r13_recency(spark: SparkSession, sf: str) -> DataFrame:
    age = F.greatest(F.lit(0.0), (F.unix_micros(_as_of()) - F.unix_micros("published_at")) / 8.64e10)
    return table(spark, sf, "documents").select("doc_id", F.round(retrieval.recency(age, F.lit(0.05)), 6).alias("recency"))


_TREND = f"""h AS (SELECT coalesce(nullif(source, ''), 'default') AS grp, published_at AS ts FROM documents WHERE published_at IS NOT NULL),
t AS (SELECT grp, floor(({_AS_OF_US} - epoch_us(ts)) / 8.64e10) AS days, row_number() OVER (PARTITION BY grp ORDER BY ts DESC) AS rn FROM h),
a AS (SELECT grp, count(*) AS n, sum(CASE WHEN days <= 7 THEN 1 ELSE 0 END) AS w1, sum(CASE WHEN days > 14 AND days <= 21 THEN 1 ELSE 0 END) AS w3 FROM t WHERE rn <= 30 GROUP BY grp),
tr AS (SELECT grp, n, CASE WHEN n < 5 THEN 0.0 ELSE least(3.0, greatest(-3.0, CASE WHEN w3 > 0 THEN (w1 - w3) / (w3 + 1) ELSE w1 / 3 END)) END AS trend FROM a)"""


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", retrieval.group_key(F.col("source")).alias("grp"), F.col("published_at").alias("ts"))


@query(f"WITH {_TREND} SELECT grp, round(trend, 6) AS trend, round(0.1 / (1 + exp(-trend)), 6) AS decay FROM tr")
def r14_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = retrieval.trend(_history(spark, sf), "grp", "ts", _as_of())
    return t.select("grp", F.round("trend", 6).alias("trend"), F.round(retrieval.adapted_decay(F.col("trend")), 6).alias("decay"))


_CYCLE = """sp AS (SELECT grp, count(*) AS n, min(epoch_us(ts)) AS lo, floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 8.64e10) + 1 AS days FROM h GROUP BY grp),
cn AS (SELECT grp, days, floor((epoch_us(ts) - lo) / 8.64e10) AS day, count(*) AS c FROM h JOIN sp USING (grp) WHERE n >= 10 AND days >= 7 GROUP BY ALL),
bk AS (SELECT *, unnest(range(0, CAST(floor(days / 2) AS bigint))) AS k FROM cn),
pw AS (SELECT grp, k, pow(sum(c * cos(2 * pi() * ((k * day) % days) / days)), 2) + pow(sum(c * sin(2 * pi() * ((k * day) % days) / days)), 2) AS p FROM bk GROUP BY grp, k),
mk AS (SELECT *, lag(p) OVER (PARTITION BY grp ORDER BY k) AS pp, lead(p) OVER (PARTITION BY grp ORDER BY k) AS np, avg(p) OVER (PARTITION BY grp) AS m FROM pw),
bs AS (SELECT grp, max(CASE WHEN p > pp AND p > np AND p >= m THEN p END) AS peak, sum(p) AS total FROM mk GROUP BY grp),
cy AS (SELECT grp, CASE WHEN bs.grp IS NULL THEN 0.5 WHEN peak IS NULL THEN 0.3 ELSE least(1.0, 5 * peak / (total + 1e-8)) END AS cyclicity FROM (SELECT sp.grp, bs.grp AS bgrp, peak, total FROM sp LEFT JOIN bs ON sp.grp = bs.grp) AS bs(grp, bgrp, peak, total))"""
_CYCLE = _CYCLE.replace("CASE WHEN bs.grp IS NULL", "CASE WHEN bs.bgrp IS NULL").replace("(SELECT grp, CASE", "(SELECT bs.grp, CASE")


@query(f"WITH {_TREND}, {_CYCLE} SELECT grp, round(cyclicity, 5) AS cyclicity FROM cy")
def r16_cyclicity(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.cyclicity(_history(spark, sf), "grp", "ts").select("grp", F.round("cyclicity", 5).alias("cyclicity"))


def _hybrid(spark: SparkSession, sf: str, k: int = 5, every: int = 100) -> DataFrame:
    """The hybrid ranking over all documents; without dense vectors for the texts, a document's order stands in for its dense rank."""
    asked = _claims(spark, sf, every).where(F.trim("text") != "").select(F.col("sample_id").alias("query_id"))
    ranked = retrieval.fuse_whole(_search(spark, sf, every), table(spark, sf, "documents"), asked)
    history = _history(spark, sf)
    groups = retrieval.trend(history, "grp", "ts", _as_of()).select("grp", "trend").join(retrieval.cyclicity(history, "grp", "ts"), "grp", "full")
    return retrieval.hybrid(ranked, history, groups, _as_of(), k=k)


_HYBRID = f"""{_BM25}, {_TREND}, {_CYCLE},
al AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, doc_id) - 1 AS rank
 FROM (SELECT sample_id AS query_id FROM labeled_claims WHERE sample_id % 100 = 0 AND trim(text) <> '') CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN s USING (query_id, doc_id)),
fu AS (SELECT query_id, doc_id, 1.0::double / (60 + rank) + 1.0::double / (60 + doc_id) AS rrf FROM al),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, doc_id) AS pos FROM fu QUALIFY pos <= 20),
nm AS (SELECT *, rrf / greatest(max(rrf) OVER (PARTITION BY query_id), 1e-8) AS norm FROM ca),
sc AS (SELECT query_id, nm.doc_id, pos, norm, coalesce(exp(-coalesce(0.1 / (1 + exp(-trend)), 0.1) * greatest(0, ({_AS_OF_US} - epoch_us(published_at)) / 8.64e10)), 0) AS rec, coalesce(cyclicity, 0.5) AS cyc
 FROM nm JOIN documents dd ON dd.doc_id = nm.doc_id LEFT JOIN tr ON tr.grp = coalesce(nullif(dd.source, ''), 'default') LEFT JOIN cy ON cy.grp = coalesce(nullif(dd.source, ''), 'default')),
fi AS (SELECT *, 0.7 * norm + 0.3 * (0.5 * rec + 0.5 * cyc) AS score FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos) AS final_rank FROM fi)"""


# Fixed value: about as many pairs of a query and its term are searched, fused and ranked together.
_BLOCK_TERMS = 60_000
_POOLED = "query_id bigint, doc_id bigint, score double, norm double, recency_score double, cyclicity_score double, verbatim boolean, final_rank int"


def _pooled(spark: SparkSession, sf: str, column: str = "text", k: int = 5, use_temporal: bool = True, every: int = 100) -> DataFrame:
    """Two searches of a bounded pool each, fused: BM25 and the nearest of hashed text vectors.

    Whole articles as queries are searched by words only, which then weigh 1.35, and re-ranked by how much of them stands in the
    document. A group's history is that of the documents in a query's pool. The candidates are 10 times ``k``, at least 20.
    Equal queries are asked once. Pools are formed for a block of queries at a time; only the best ``k`` stay.
    """
    claims = table(spark, sf, "labeled_claims").where(F.col("sample_id") % every == 0).select(F.col("sample_id").alias("query_id"), F.col(column).alias("asked"))
    claims = search.prepared(claims, "asked").withColumn("flat", text.collapse_blank(F.col("asked"))).where("flat <> ''")
    first = F.min("query_id").over(W.partitionBy("flat", "verbatim", "search_text"))
    claims = materialize(claims.select("query_id", "flat", "verbatim", "search_text", first.alias("first_id")), "asked")
    asked = claims.where("query_id = first_id").drop("first_id")
    docs, tokens = table(spark, sf, "documents"), text.word_tokens(F.col("text"))
    n_docs, wide = docs.count(), max(20, 10 * k)
    pool = search.pool_size(n_docs, wide)
    words = retrieval.LexicalSearch(docs, "doc_id", tokens, asked, "query_id", text.word_tokens(F.col("search_text")), block=_BLOCK_TERMS)
    encode = retrieval.word_hash_encoder(64)
    vectors = materialize(retrieval.encoded(docs, ["doc_id"], tokens, encode), "vectors")
    meant = materialize(retrieval.encoded(asked.where("not verbatim"), ["query_id"], text.word_tokens(F.col("search_text")), encode), "asked_vectors")
    known = docs.select("doc_id", retrieval.group_key(F.col("doc_type"), F.col("source")).alias("grp"), F.col("published_at").alias("ts"), F.col("text").alias("body"))
    usual, whole = (retrieval.rrf((F.coalesce("r1", "missing"), w), (F.coalesce("r2", "missing"), 1.0)) for w in (1.0, 1.35))
    bonus = F.when(F.col("verbatim"), retrieval.verbatim_bonus(F.col("flat"), text.collapse_blank(F.col("body")), text.overlap_ratio(F.col("flat"), F.col("body")))).otherwise(0.0)

    def block(i: int, own: Column) -> DataFrame:
        dense = retrieval.nearest(vectors, "doc_id", "vector", meant.where(own), "query_id", "vector", pool, itself=True, stored=True)
        both = retrieval.fuse(words.top(pool, i), dense, pool).join(retrieval.small(asked.where(own).select("query_id", "verbatim")), "query_id")
        fused = materialize(both.select("query_id", "doc_id", F.when(F.col("verbatim"), whole).otherwise(usual).alias("rrf_score"), "union_no", "verbatim"), "pool")
        history = fused.join(known.drop("body"), "doc_id").select(F.struct("query_id", "grp").alias("own"), "ts")
        groups = retrieval.trend(history, "own", "ts", _as_of()).select("own", "trend").join(retrieval.cyclicity(history, "own", "ts"), "own", "full").select("own.*", "trend", "cyclicity")
        # the candidates are cut as ``hybrid`` cuts them, before the queries' texts are joined
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "union_no"))
        ranked = fused.withColumn("place", place).where(F.col("place") <= wide).drop("place").join(retrieval.small(asked.where(own).select("query_id", "flat")), "query_id")
        return retrieval.hybrid(ranked, known, groups, _as_of(), wide, k, use_temporal=use_temporal, bonus=bonus).selectExpr(*[f"cast({c} as {t}) {c}" for c, t in (x.split() for x in _POOLED.split(", "))])

    best = gathered(spark, [lambda i=i, own=own: block(i, own) for i, own in enumerate(words.blocks())], _POOLED, "best")
    return best.withColumnRenamed("query_id", "first_id").join(retrieval.small(claims.select("query_id", "first_id")), "first_id")


def _pooled_sql(column: str, use_temporal: bool = True, pool: int = 500, wide: int = 50, every: int = 100) -> str:
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
    plain = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
    synonyms = " || ".join(f"CASE WHEN contains(lower(flat), '{t}') THEN ' {' '.join(y[:2])}' ELSE '' END" for t, y in text.GLOSSARY)
    code = "SELECT {0}, c % 64 AS k, CAST(sum(1 - 2 * ((c // 64) % 2)) AS double) AS x FROM (SELECT {0}, CAST('0x' || substr(md5(w), 1, 4) AS int) AS c FROM (SELECT {0}, unnest(t) AS w FROM {1})) GROUP BY ALL"
    temporal = "coalesce(exp(-coalesce(0.1 / (1 + exp(-trend)), 0.1) * greatest(0, (" + _AS_OF_US + " - epoch_us(published_at)) / 8.64e10)), 0) AS rec, coalesce(cyclicity, 0.5) AS cyc"
    trends = _TREND[_TREND.index("t AS ("):]
    return f"""WITH fl AS (SELECT sample_id AS query_id, trim(regexp_replace(coalesce({column}, ''), '[{text.BLANK}]+', ' ', 'g')) AS flat FROM labeled_claims{"" if every == 1 else f" WHERE sample_id % {every} = 0"}),
qq AS (SELECT *, CASE WHEN v THEN flat ELSE flat || {synonyms} END AS st FROM (SELECT *, length(flat) >= 1200 OR len(regexp_extract_all(lower(flat), '[a-z0-9]+')) >= 200 AS v FROM fl WHERE flat <> '')),
qt AS (SELECT query_id, v, {words("st")} AS t FROM qq), d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS al, least(count(*), {pool}) AS pool FROM d),
po AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM po GROUP BY ALL), q AS (SELECT DISTINCT query_id, unnest(t) AS term FROM qt),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), c GROUP BY query_id, doc_id),
l AS (SELECT query_id, doc_id, r1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS r1 FROM s), c WHERE r1 < pool),
dv AS ({code.format("doc_id", "d")}), qv AS ({code.format("query_id", "(SELECT * FROM qt WHERE NOT v)")}),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS dn FROM dv GROUP BY doc_id), qn AS (SELECT query_id, sqrt(sum(x * x)) AS qn FROM qv GROUP BY query_id),
dt AS (SELECT query_id, doc_id, sum(qv.x * dv.x) AS dot FROM qv JOIN dv USING (k) GROUP BY ALL),
e AS (SELECT query_id, doc_id, r2 FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0) / (dn * qn), 9) DESC, doc_id) - 1 AS r2 FROM (SELECT * FROM qn, dn WHERE qn > 0 AND dn > 0) LEFT JOIN dt USING (query_id, doc_id)), c WHERE r2 < pool),
f AS (SELECT query_id, doc_id, r1, r2, greatest((SELECT pool FROM c), count(*) OVER (PARTITION BY query_id)) AS m FROM l FULL JOIN e USING (query_id, doc_id)),
g AS (SELECT query_id, doc_id, v, flat, CASE WHEN v THEN 1.35::double ELSE 1.0::double END / (60 + coalesce(r1, m)) + 1.0::double / (60 + coalesce(r2, m)) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY r1 NULLS LAST, r2) AS un FROM f JOIN qq USING (query_id)),
h AS (SELECT query_id || '|' || coalesce(nullif(doc_type, ''), nullif(source, ''), 'default') AS grp, published_at AS ts FROM g JOIN documents USING (doc_id) WHERE published_at IS NOT NULL), {trends}, {_CYCLE},
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, un) AS pos FROM g QUALIFY pos <= {wide}),
nm AS (SELECT *, rrf / greatest(max(rrf) OVER (PARTITION BY query_id), 1e-8) AS norm FROM ca),
sc AS (SELECT query_id, nm.doc_id, pos, norm, {temporal if use_temporal else "0.5 AS rec, 0.5 AS cyc"}, trim(regexp_replace(coalesce(text, ''), '[{text.BLANK}]+', ' ', 'g')) AS body, flat, v
 FROM nm JOIN documents dd USING (doc_id) LEFT JOIN tr ON tr.grp = query_id || '|' || coalesce(nullif(doc_type, ''), nullif(source, ''), 'default') LEFT JOIN cy ON cy.grp = query_id || '|' || coalesce(nullif(doc_type, ''), nullif(source, ''), 'default')),
bo AS (SELECT *, CASE WHEN NOT v THEN 0 WHEN length(flat) >= 40 AND contains(lower(body), lower(flat)) THEN 0.35 WHEN len({plain("flat")}) = 0 OR len({plain("body")}) = 0 THEN 0 ELSE 0.15 * len(list_intersect({plain("flat")}, {plain("body")})) / len({plain("flat")}) END AS bonus FROM sc),
fi AS (SELECT *, {"0.7 * norm + 0.3 * (0.5 * rec + 0.5 * cyc)" if use_temporal else "norm"} + bonus AS score FROM bo), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, pos) AS final_rank FROM fi)
"""


@query(_pooled_sql("evidence", every=1) + "SELECT query_id, doc_id, round(score, 5) AS score, round(norm, 6) AS rrf_score, round(rec, 6) AS recency_score, round(cyc, 5) AS cyclicity_score, v AS verbatim, final_rank FROM rk WHERE final_rank <= 5")
def r9_pooled_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim's evidence is asked."""
    best = _pooled(spark, sf, "evidence", every=1)
    rounded = [F.round(c, n).alias(a) for c, n, a in (("score", 5, "score"), ("norm", 6, "rrf_score"), ("recency_score", 6, "recency_score"), ("cyclicity_score", 5, "cyclicity_score"))]
    return best.select("query_id", "doc_id", *rounded, "verbatim", "final_rank")


@query(_pooled_sql("text", use_temporal=False) + "SELECT query_id, doc_id, round(score, 5) AS score, final_rank FROM rk WHERE final_rank <= 5")
def r18_without_time(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, use_temporal=False).select("query_id", "doc_id", F.round("score", 5).alias("score"), "final_rank")


@query(_pooled_sql("text") + """, lf AS (SELECT query_id, final_rank - 1 AS slot, unnest([0, 1, 2, 3]) AS feature, unnest([score, norm, rec, cyc]) AS x FROM rk WHERE final_rank <= 5)
SELECT query_id, slot, feature, round(coalesce(x, 0), 4) AS x FROM (SELECT * FROM (SELECT DISTINCT query_id FROM rk), (SELECT unnest(range(0, 8)) AS slot), (SELECT unnest([0, 1, 2, 3]) AS feature)) LEFT JOIN lf USING (query_id, slot, feature)""")
def r24_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = retrieval.feature_matrix(_pooled(spark, sf), 8).select("query_id", F.posexplode("features").alias("slot", "f"))
    return rows.select("query_id", F.col("slot").cast("long").alias("slot"), F.posexplode("f").alias("feature", "x")).select("query_id", "slot", "feature", F.round("x", 4).alias("x"))


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, round(score, 5) AS score, final_rank FROM rk WHERE final_rank <= 5")
def r21_hybrid_top(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select("query_id", "doc_id", F.round("score", 5).alias("score"), "final_rank")


@query(f"WITH {_HYBRID} SELECT query_id, list_transform(list(struct_pack(f := final_rank, x := round(score, 4)) ORDER BY final_rank), lambda s: s.x) AS scores, count(*) AS n FROM rk WHERE final_rank <= 5 GROUP BY query_id")
def r24_feature_slots(spark: SparkSession, sf: str) -> DataFrame:
    best = _hybrid(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", F.round("score", 4).alias("x")))).alias("s"), F.count("*").alias("n"))
    return best.select("query_id", F.transform("s", lambda r: r["x"]).alias("scores"), "n")


@query(f"WITH {_HYBRID} SELECT query_id, string_agg(DISTINCT source, '; ' ORDER BY source) AS links FROM rk JOIN documents USING (doc_id) WHERE final_rank <= 3 GROUP BY query_id")
def r25_source_links(spark: SparkSession, sf: str) -> DataFrame:
    best = _hybrid(spark, sf, 3).select("query_id", "doc_id").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return best.groupBy("query_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("source")), "; "), F.lit("")).alias("links"))


@query(r"""WITH p AS (SELECT sample_id, lower(text) AS q, lower(evidence) AS d, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(evidence, '')), '[a-z0-9]+')) AS b FROM labeled_claims WHERE text IS NOT NULL AND evidence IS NOT NULL)
SELECT sample_id, round(CASE WHEN length(q) >= 40 AND contains(d, q) THEN 0.35 ELSE 0.15 * (CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END) END, 6) AS bonus FROM p""")
def r20_verbatim_bonus(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labeled_claims").where("text is not null and evidence is not null")
    q, d = F.col("text"), F.col("evidence")
    return own.select("sample_id", F.round(retrieval.verbatim_bonus(q, d, text.overlap_ratio(q, d)), 6).alias("bonus"))


_ALIASES = labels.ALIASES["loader"]
_CLASS = "coalesce(CASE WHEN try_cast(label AS double) IN (0, 1, 2) THEN CAST(try_cast(label AS double) AS int) END, CASE " + " ".join(
    f"WHEN upper(trim(label)) IN ({', '.join(repr(a) for a in names)}) THEN {k}" for k, names in enumerate(_ALIASES)) + " END, 2)"
_SHARE = """CASE WHEN len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) = 0 OR len(list_distinct(regexp_extract_all(lower(coalesce(evidence, '')), '[a-z0-9]+'))) = 0 THEN 0.0
 ELSE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) END"""
_DENIED = "regexp_matches(lower(coalesce(evidence, '')), 'không|phủ nhận|not|denied')"
_EVAL = f"""v AS (SELECT sample_id, split_name, {_CLASS} AS y, {_SHARE} AS share, {_DENIED} AS denied FROM labeled_claims),
x AS (SELECT sample_id, split_name, y, CASE WHEN denied AND share >= 0.2 THEN 1 WHEN share >= 0.4 THEN 0 ELSE 2 END AS p FROM v)"""


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, split_name, y, share, denied): the label, how much of the claim stands in its evidence, and whether that denies something."""
    denied = F.lower(F.coalesce("evidence", F.lit(""))).rlike("không|phủ nhận|not|denied")
    share = text.overlap_ratio(F.col("text"), F.col("evidence"))
    return table(spark, sf, "labeled_claims").select("sample_id", "split_name", labels.label_id(F.col("label")).alias("y"), share.alias("share"), denied.alias("denied"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.when(F.col("denied") & (F.col("share") >= 0.2), 1).when(F.col("share") >= 0.4, 0).otherwise(2)
    return _shares(spark, sf).withColumn("p", guess)


@query(f"""WITH {_EVAL}, m AS (SELECT 'words, gold' AS split_name, y, CASE WHEN share >= 0.4 THEN 0 ELSE 2 END AS p FROM v UNION ALL SELECT 'words, none', y, 2 FROM v UNION ALL
SELECT 'fused, gold', y, p FROM x UNION ALL SELECT 'fused, none', y, CASE WHEN denied THEN 1 ELSE 2 END FROM v), pc AS (SELECT split_name, c AS cls, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS g, count(*) FILTER (p = c) AS q FROM m, (VALUES (0), (1), (2)) l(c) GROUP BY ALL),
pf AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS pr, coalesce(tp / nullif(g, 0), 0) AS re FROM pc), ff AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM pf)
SELECT split_name AS mode, CAST(sum(g) AS bigint) AS n, round(sum(tp) / sum(g), 6) AS accuracy, round(avg(f1) FILTER (g > 0 OR q > 0), 6) AS macro_f1, round(sum(f1 * g) / sum(g), 6) AS weighted_f1 FROM ff GROUP BY split_name""")
def a5_four_modes(spark: SparkSession, sf: str) -> DataFrame:
    share, denied = F.col("share"), F.col("denied")
    modes = {
        "words, gold": F.when(share >= 0.4, 0).otherwise(2), "words, none": F.lit(2),
        "fused, gold": F.when(denied & (share >= 0.2), 1).when(share >= 0.4, 0).otherwise(2), "fused, none": F.when(denied, 1).otherwise(2),
    }
    rows = _shares(spark, sf).select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), p.alias("p")) for m, p in modes.items()])).alias("m")).select("y", "m.*")
    out = metrics.summary(metrics.confusion(rows, F.col("y"), F.col("p"), "mode"), [0, 1, 2], "mode")
    return out.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(f"""WITH {_EVAL} SELECT l.c AS label, count(y) AS n, round(100.0 * count(y) / (SELECT count(*) FROM x), 6) AS percent, round((SELECT count(*) FROM x) / (3.0 * nullif(count(y), 0)), 6) AS weight
FROM (VALUES (0), (1), (2)) l(c) LEFT JOIN x ON x.y = l.c GROUP BY l.c""")
def a1_label_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.label_shares(_judged(spark, sf), F.col("y"), [0, 1, 2])
    return out.select("label", "n", F.round("percent", 6).alias("percent"), F.round("weight", 6).alias("weight"))


_PER = "pc AS (SELECT split_name, c AS cls, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y = c) AS g, count(*) FILTER (p = c) AS q FROM x, (VALUES (0), (1), (2)) l(c) GROUP BY ALL), pf AS (SELECT *, coalesce(tp / nullif(q, 0), 0) AS pr, coalesce(tp / nullif(g, 0), 0) AS re FROM pc), ff AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM pf)"


@query(f"""WITH {_EVAL}, {_PER} SELECT split_name, CAST(sum(g) AS bigint) AS n, round(sum(tp) / sum(g), 6) AS accuracy, round(avg(pr) FILTER (g > 0 OR q > 0), 6) AS macro_precision, round(avg(re) FILTER (g > 0 OR q > 0), 6) AS macro_recall,
 round(avg(f1) FILTER (g > 0 OR q > 0), 6) AS macro_f1, round(sum(f1 * g) / sum(g), 6) AS weighted_f1 FROM ff GROUP BY split_name""")
def a3_metrics_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.summary(metrics.confusion(_judged(spark, sf), F.col("y"), F.col("p"), "split_name"), [0, 1, 2], "split_name")
    return out.select("split_name", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("split_name", "n")])


@query(f"WITH {_EVAL} SELECT l.c AS cls, round(count(*) FILTER (y = l.c AND p = l.c) / greatest(1, count(*) FILTER (y = l.c)), 6) AS accuracy FROM x, (VALUES (0), (1), (2)) l(c) GROUP BY l.c")
def a4_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.per_class(metrics.confusion(_judged(spark, sf), F.col("y"), F.col("p")), [0, 1, 2])
    return out.select("cls", F.round(F.col("tp") / F.greatest(F.lit(1), F.col("gold_n")), 6).alias("accuracy"))


@query("SELECT lang, doc_type, count(*) AS n FROM documents GROUP BY ALL")
def a8_type_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "doc_type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::double AS x FROM embeddings)
SELECT label, d, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS m FROM (SELECT label, d, avg(x) AS m FROM p GROUP BY label, d)""")
def a11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    out = models.centroids(table(spark, sf, "embeddings"), "label", "embedding", normalized=True)
    return out.select("label", F.posexplode("centroid").alias("d", "m")).select("label", "d", F.round("m", 6).alias("m"))


@query(f"""WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::double AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM p GROUP BY label, d),
c AS (SELECT label, list(m ORDER BY d) AS embedding FROM m GROUP BY label), s AS (SELECT a.label, a.vec_id, round({_COS}, 9) AS sim FROM embeddings a JOIN c b ON a.label = b.label)
SELECT label, arg_max(vec_id, struct_pack(a := sim, b := -vec_id)) AS medoid, count(*) AS size FROM s GROUP BY label""")
def m13_medoids(spark: SparkSession, sf: str) -> DataFrame:
    return models.medoids(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


_LG = f"lg AS (SELECT sample_id, {_CLASS} AS y, {_SHARE} AS share, CASE WHEN {_DENIED} THEN 1.0 ELSE 0.0 END AS neg, length(coalesce(text, '')) / 100.0 AS len FROM labeled_claims)"
_LM = "[2 * share - neg, share + neg - 0.5, 1 - share]"
_RT = "[share * len, neg, 0.5 * len]"


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, y, lm, rt): logits of a claim from its words in the evidence, denials and its length."""
    share, neg, n = F.col("share"), F.col("denied").cast("double"), F.length(F.coalesce("text", F.lit(""))) / 100.0
    own = _shares(spark, sf).join(table(spark, sf, "labeled_claims").select("sample_id", "text"), "sample_id")
    return own.select("sample_id", "y", F.array(2 * share - neg, share + neg - 0.5, 1 - share).alias("lm"), F.array(share * n, neg, 0.5 * n).alias("rt"))


@query(f"""WITH {_LG}, f AS (SELECT sample_id, list_transform(list_zip({_LM}, {_RT}), lambda z: 0.6 * z[1]::double + 0.4 * z[2]::double) AS x FROM lg),
e AS (SELECT sample_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM f), p AS (SELECT sample_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)
SELECT sample_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(list_max(p), 6) AS confidence, CASE list_position(list_transform(p, lambda v: round(v, 9)), round(list_max(p), 9)) WHEN 1 THEN 'Đúng' WHEN 2 THEN 'Sai' ELSE 'Chưa chắc chắn' END AS verdict FROM p""")
def m3_gated_fusion(spark: SparkSession, sf: str) -> DataFrame:
    p = _logits(spark, sf).select("sample_id", models.gated(F.col("lm"), F.col("rt"), F.lit(0.6)).alias("x")).select("sample_id", models.softmax(F.col("x")).alias("p"))
    pick = models.argmax(F.transform("p", lambda v: F.round(v, 9)))
    return p.select("sample_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)], F.round(F.array_max("p"), 6).alias("confidence"), labels.verdict(pick).alias("verdict"))


@query(f"""WITH {_LG}, x AS (SELECT sample_id, {_LM} AS s FROM lg) SELECT sample_id, round(-ln(exp(s[1]::double / 0.7) / (exp(s[1]::double / 0.7) + exp(s[2]::double / 0.7) + exp(s[3]::double / 0.7) + 1e-8) + 1e-8) + 0.01 * 0.25, 6) AS loss FROM x""")
def m5_info_nce(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("lm")
    return _logits(spark, sf).select("sample_id", F.round(models.info_nce(s[0], F.slice(s, 2, 2), 0.7, models.ridge(0.01, F.lit(0.5))), 6).alias("loss"))


@query(f"SELECT sample_id, round(ln(q / (1 - q)), 6) AS logit FROM (SELECT sample_id, least(greatest({_SHARE}, 1e-6), 1 - 1e-6)::double AS q FROM labeled_claims)")
def m4_inverse_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return _shares(spark, sf).select("sample_id", F.round(models.inverse_sigmoid(F.col("share")), 6).alias("logit"))


@query("""WITH t AS (SELECT sample_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM labeled_claims), g AS (SELECT sample_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
f AS (SELECT sample_id, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), w AS (SELECT sample_id, term, tf * (ln((1.0 + (SELECT count(*) FROM labeled_claims)) / (1.0 + df)) + 1) AS w FROM f JOIN d USING (term))
SELECT sample_id, count(*) AS terms, round(max(v), 5) AS heaviest FROM (SELECT sample_id, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS v FROM w) GROUP BY sample_id""".replace("\\\\", "\\"))
def m10_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    claims = table(spark, sf, "labeled_claims").select("sample_id", "text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    w = models.tf_idf(claims, "sample_id", tokens, claims.count())
    return w.groupBy("sample_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 5).alias("heaviest"))


@query(f"SELECT vec_id, d, round(x, 6) AS x FROM (SELECT vec_id, generate_subscripts(u, 1) - 1 AS d, unnest(u) AS x FROM (SELECT vec_id, list_transform(embedding, lambda v: v::double / (CASE WHEN {_DOT.format('embedding', 'embedding')} = 0 THEN 1 ELSE sqrt({_DOT.format('embedding', 'embedding')}) END)) AS u FROM embeddings))")
def m14_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "embeddings").select("vec_id", models.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.posexplode("u").alias("d", "x")).select("vec_id", "d", F.round("x", 6).alias("x"))


@query()
def m15_similarity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labeled_claims").select("sample_id", F.round(models.similarity_ratio(F.col("text"), F.col("evidence")), 6).alias("ratio"))


@query()
def m12_cluster_choice(spark: SparkSession, sf: str) -> DataFrame:
    out = models.choose_clusters(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def m9_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return models.triplets(table(spark, sf, "labeled_claims"), "sample_id", "text", "evidence")


@query()
def m17_label_scores(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "labeled_claims").select("sample_id", text.prompt(F.col("text"), F.col("evidence")).alias("prompt"))
    scored = models.with_scores(own, "prompt", models.lexical_scorer).withColumn("features", F.array(*[F.array(*[F.lit(0.1 * (i + j)) for j in range(4)]) for i in range(3)]))
    both = models.with_slot_logits(scored.select("sample_id", "lm_logits", "features"), "features", models.SlotNetwork(5))
    fused = models.softmax(models.gated(F.col("lm_logits"), F.col("retrieval_logits"), F.lit(0.7)))
    return both.select("sample_id", models.argmax(fused).alias("label_id"), F.round(F.array_max(fused), 6).alias("confidence"))


def _latest_posts(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("source", "post_date", "post_url", "post_text", "image_urls", "video_urls", "comment_count")
    return table(spark, sf, "social_posts").groupBy("post_id").agg(F.max_by(F.struct(*fields), "social_key").alias("p")).select("post_id", "p.*")


_LATEST = "p AS (SELECT post_id, arg_max(struct_pack(source := source, post_date := post_date, post_url := post_url, post_text := post_text, image_urls := image_urls, video_urls := video_urls), social_key) AS p FROM social_posts GROUP BY post_id)"


@query(f"""WITH {_LATEST} SELECT p.post_id, p.p.post_url AS post_url, md5(p.p.post_text) AS text_md5, array_to_string(p.p.image_urls, '; ') AS image_urls, coalesce(c.comment_text, '') AS comment_text, coalesce(c.comment_reactions, '') AS comment_reactions,
 coalesce(c.is_reply, false) AS is_reply, coalesce(CASE WHEN c.is_reply THEN c.parent_comment END, '') AS parent_comment FROM p LEFT JOIN flat_comments c ON c.post_id = p.post_id""")
def j8_flat_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = posts.joined_rows(_latest_posts(spark, sf), table(spark, sf, "flat_comments"))
    return rows.select("post_id", "post_url", F.md5("post_text").alias("text_md5"), "image_urls", "comment_text", "comment_reactions", "is_reply", "parent_comment")


@query(f"""WITH {_LATEST}, h AS (SELECT post_id, comment_text AS parent, min(comment_key) AS head FROM flat_comments WHERE NOT coalesce(is_reply, false) GROUP BY ALL),
r AS (SELECT c.*, h.head FROM flat_comments c LEFT JOIN h ON h.post_id = c.post_id AND h.parent IS NOT DISTINCT FROM c.parent_comment WHERE c.is_reply),
u AS (SELECT head, string_agg('- ' || coalesce(comment_text, '') || ' *(Reactions: ' || coalesce(comment_reactions, '0') || ')*', chr(10) ORDER BY comment_key) AS replies FROM r WHERE head IS NOT NULL GROUP BY head),
a AS (SELECT comment_key, post_id, comment_text, comment_reactions FROM flat_comments WHERE NOT coalesce(is_reply, false) UNION ALL SELECT comment_key, post_id, comment_text, comment_reactions FROM r WHERE head IS NULL),
n AS (SELECT a.*, row_number() OVER (PARTITION BY post_id ORDER BY comment_key) AS i, replies FROM a LEFT JOIN u ON u.head = a.comment_key),
c AS (SELECT post_id, count(*) AS k, string_agg('### ' || i || '. ' || coalesce(comment_text, '') || chr(10) || '*Reactions: ' || coalesce(comment_reactions, '0') || '*' || coalesce(chr(10) || chr(10) || '**Replies:**' || chr(10) || replies, '') || chr(10), chr(10) ORDER BY i) AS body FROM n GROUP BY post_id)
SELECT p.post_id, md5(concat_ws(chr(10), '# Post ' || p.post_id || chr(10), '**Source:** ' || nullif(p.p.source, '') || chr(10), '**Date:** ' || nullif(p.p.post_date, '') || chr(10), '**URL:** <' || nullif(p.p.post_url, '') || '>' || chr(10),
 '**Content:**' || chr(10) || chr(10) || coalesce(nullif(p.p.post_text, ''), '(no text)') || chr(10), CASE WHEN len(p.p.image_urls) > 0 THEN '**Images:**' || chr(10) || array_to_string(list_transform(p.p.image_urls, lambda x: '- ' || x), chr(10)) || chr(10) END,
 CASE WHEN len(p.p.video_urls) > 0 THEN '**Videos:**' || chr(10) || array_to_string(list_transform(p.p.video_urls, lambda x: '- ' || x), chr(10)) || chr(10) END, '---' || chr(10) || '## Comments (' || coalesce(k, 0) || ')' || chr(10), body)) AS md5 FROM p LEFT JOIN c ON c.post_id = p.post_id""")
def snk6_markdown(spark: SparkSession, sf: str) -> DataFrame:
    own = _latest_posts(spark, sf).fillna("", ["source", "post_date", "post_url", "post_text"])
    return posts.markdown(own.join(posts.nested(table(spark, sf, "flat_comments")), "post_id", "left")).select("post_id", F.md5("md").alias("md5"))


@query("SELECT social_key, CASE WHEN social_key % 6 = 5 THEN 0 ELSE coalesce(comment_count, 0) END AS n FROM social_posts")
def j3_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    # the count stands at another of the five places in each post's node; in a sixth of them at none
    node, count = F.lit('{"other": {"total_count": 9}}'), F.coalesce(F.col("comment_count").cast("string"), F.lit("null"))
    for i, path in enumerate(posts.COMMENT_COUNT_PATHS):
        keys = path.removeprefix("$.").split(".")
        node = F.when(F.col("social_key") % 6 == i, F.concat(F.lit("".join(f'{{"{k}":' for k in keys)), count, F.lit("}" * len(keys)))).otherwise(node)
    return table(spark, sf, "social_posts").select("social_key", posts.comment_count(node).alias("n"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS varchar)[:10] AS day, count(*) AS n FROM events GROUP BY ALL")
def s4_daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    from factloom.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, sf, "events"), "ts", "event_type")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid ranking of all claims over the documents; meant for small tables of claims."""
    return _hybrid(spark, sf, every=1).select("query_id", "doc_id", F.round("score", 5).alias("score"), "final_rank")
