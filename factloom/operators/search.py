"""Search over several fields with boosts, the sum of up to four kinds of clause, and helpers of the search path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import collapse_blank, expand_query, field_boost, is_verbatim, word_tokens
from factloom.operators.retrieval import BROADCAST_ROWS, TermSums, _Best, bm25, document_blocks, postings, small, term_vectors, top
from factloom.storage import materialize

# How many terms of a query count, and how many of them as a phrase.
MAX_TERMS, MAX_PHRASE = 60, 32


def in_order(document: Column, phrase: Column, slop: int = 2) -> Column:
    """Whether the document's tokens hold the phrase's in order, with at most ``slop`` further tokens between."""
    n = F.size(phrase)

    def starts(i: Column) -> Column:
        part = F.slice(document, i, n + slop)
        matched = F.aggregate(part, F.lit(0), lambda k, w: F.when(w == F.get(phrase, k), k + 1).otherwise(k))
        return (F.get(document, i - 1) == F.get(phrase, F.lit(0))) & (matched == n)

    return F.when((n > 0) & (F.size(document) >= n), F.exists(F.sequence(F.lit(1), F.size(document)), starts)).otherwise(False)


def fielded(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """(query_id, doc_id, score): the sum of the clauses that hold.

    * the best field's BM25 times its boost;
    * with 3 terms and more, twice the sum of each term's best field, if the fields together hold all terms;
    * with 6 terms and more, 1.5 times the sum of the fields that hold 60 % of the terms (70 % from 12 terms on);
    * with 4 terms and more, per field that holds the first 32 terms as a phrase (slop 2), its boost times 4, at least 2.

    Queries are cut at 60 terms; blank ones find nothing.
    """
    flat = queries.select(F.col(query_key).alias("query_id"), F.slice(word_tokens(collapse_blank(F.col(query_text))), 1, MAX_TERMS).alias("t")).where(F.size("t") > 0)
    flat = materialize(flat.withColumn("n", F.size(F.array_distinct("t"))), "queries")
    lead = F.slice("t", 1, MAX_PHRASE)
    terms = flat.select("query_id", lead.alias("p"), F.explode(F.array_distinct("t")).alias("term")).select("query_id", "term", F.array_contains("p", F.col("term")).alias("lead"))
    scores = hits = phrases = None
    n_docs = docs.count()
    for field, boost in fields.items():
        tokens = word_tokens(F.col(field))
        mean = docs.agg(F.avg(F.size(tokens))).first()[0] or 0.0
        post = postings(docs, key, tokens)
        one = bm25(post, n_docs, mean, flat, "query_id", F.col("t")).withColumns({"field": F.lit(field), "boost": F.lit(boost)})
        held = post.join(small(terms), "term").select("query_id", "doc_id", "term", "lead", F.lit(field).alias("field"))
        scores = one if scores is None else scores.unionByName(one)
        hits = held if hits is None else hits.unionByName(held)
    hits = materialize(hits, "field_hits")
    per_field = hits.groupBy("query_id", "doc_id", "field").agg(F.count("*").alias("matched"))
    whole = hits.select("query_id", "doc_id", "term", "lead").distinct().groupBy("query_id", "doc_id").agg(F.count("*").alias("all_matched"), F.count_if("lead").alias("lead_matched"))
    joined = scores.join(per_field, ["query_id", "doc_id", "field"]).join(small(flat.select("query_id", "n")), "query_id")
    least = F.floor(F.col("n") * F.when(F.col("n") < 12, 0.6).otherwise(0.7))
    base = joined.groupBy("query_id", "doc_id", "n").agg(
        F.max(F.col("score") * F.col("boost")).alias("best"), F.sum(F.col("score") * F.col("boost")).alias("sum_all"),
        F.sum(F.when(F.col("matched") >= least, F.col("score") * F.col("boost")).otherwise(0.0)).alias("most"))
    base = base.join(whole, ["query_id", "doc_id"])
    # a document with the phrase holds the phrase's terms; further terms of the query may be missing
    phrased = small(flat.select("query_id", lead.alias("p"), F.size(F.array_distinct(lead)).alias("n_lead")))
    full = base.where("n >= 4").join(phrased, "query_id").where("lead_matched = n_lead").select("query_id", "doc_id", "p")
    texts = docs.select(F.col(key).alias("doc_id"), *[word_tokens(F.col(f)).alias(f"_{f}") for f in fields])
    near = full.join(texts, "doc_id")
    bonus = F.lit(0.0)
    for field, boost in fields.items():
        bonus = bonus + F.when(in_order(F.col(f"_{field}"), F.col("p")), max(2.0, boost * 4.0)).otherwise(0.0)
    phrases = near.select("query_id", "doc_id", bonus.alias("phrase"))
    out = base.join(phrases, ["query_id", "doc_id"], "left")
    score = F.col("best") + F.when((F.col("n") >= 3) & (F.col("all_matched") == F.col("n")), 2 * F.col("best")).otherwise(0.0)
    score = score + F.when(F.col("n") >= 6, 1.5 * F.col("most")).otherwise(0.0) + F.coalesce("phrase", F.lit(0.0))
    return out.select("query_id", "doc_id", score.alias("score"))


def fielded_top(docs: DataFrame, key: str, fields: tuple[str, ...], queries: DataFrame, query_key: str, query_text: str, k: int, digits: int = 9,
                k1: float = 1.5, b: float = 0.75, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best of ``fielded`` for each query; ``fields`` are written as ``name^boost``.

    The clauses are formed as arrays where the documents lie. A task sends its ``k`` best of each query and every document
    that holds the terms of a query's phrase, whose order is then looked at in the text; nothing else is shuffled. A query
    set of more than ``limit`` distinct terms goes through ``fielded``.
    """
    boosts = dict(field_boost(f) for f in fields)
    flat = queries.select(F.col(query_key).cast("bigint").alias("query_id"), F.slice(word_tokens(collapse_blank(F.col(query_text))), 1, MAX_TERMS).alias("t")).where(F.size("t") > 0)
    asked = {r["query_id"]: list(r["t"]) for r in flat.limit(limit + 1).collect()}
    terms = sorted({t for ts in asked.values() for t in ts})
    if len(asked) > limit or sum(len(set(t)) for t in asked.values()) > limit:
        return top(fielded(docs, key, boosts, queries, query_key, query_text).withColumn("score", F.round("score", digits)), k)
    place, ids = {t: i for i, t in enumerate(terms)}, sorted(asked)
    pairs = sorted((place[t], i, t in asked[q][:MAX_PHRASE]) for i, q in enumerate(ids) for t in set(asked[q]))
    starts = np.searchsorted([p[0] for p in pairs], np.arange(len(terms) + 1))
    sizes, leads = np.array([len(set(asked[q])) for q in ids]), np.array([len(set(asked[q][:MAX_PHRASE])) for q in ids])
    vectors = None
    for n, field in enumerate(boosts):
        one = materialize(term_vectors(docs, key, word_tokens(F.col(field)), terms), "field_vectors").select("doc_id", F.lit(n).alias("field"), "dl", "t", "tf")
        vectors = one if vectors is None else vectors.unionByName(one)
    stats = {r["field"]: (r["n"], float(r["mean"] or 1) or 1.0) for r in vectors.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).collect()}
    idf, held = np.zeros((len(boosts), len(terms))), np.zeros((len(boosts), len(terms)))
    for r in vectors.select("field", F.explode("t").alias("t")).groupBy("field", "t").agg(F.count("*").alias("df")).collect():  # at most a row per field and asked term
        held[r["field"], r["t"]] = r["df"]
        idf[r["field"], r["t"]] = np.log(1 + (stats[r["field"]][0] - r["df"] + 0.5) / (r["df"] + 0.5))
    # a document's fields beside each other: a few numbers per document are moved for it
    one_row = F.transform(F.array_sort(F.collect_list(F.struct("field", "dl", "t", "tf"))), lambda x: x)
    wide = materialize(vectors.where(F.size("t") > 0).groupBy("doc_id").agg(one_row.alias("f")), "documents_fields")
    model = docs.sparkSession.sparkContext.broadcast((
        idf, starts, np.array([p[1] for p in pairs], dtype=np.int64), np.array([p[2] for p in pairs], dtype=bool), np.array(ids, dtype=np.int64), sizes, leads,
        np.array(list(boosts.values())), [stats.get(n, (0, 1.0))[1] for n in range(len(boosts))], k1, b, digits, held, max([n for n, _ in stats.values()], default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sure = _Best(model.value[4], k), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for docs_at, score, possible in _clause_blocks(batches, model.value):
            best.add(score, docs_at, (score > 0) & ~possible)
            d, q = np.nonzero(possible)
            sure.append((q, docs_at[d], score[d, q]))
        sides = best.rows(), [np.concatenate(x) for x in zip(*sure, strict=True)]
        q, d, s = (np.concatenate(x) for x in zip(*sides, strict=True))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (model.value[4][q], d, s, np.arange(len(q)) >= len(sides[0][0]))], names=["query_id", "doc_id", "base", "possible"])

    found = materialize(wide.mapInArrow(run, "query_id bigint, doc_id bigint, base double, possible boolean"), "found")
    near = found.where("possible").join(small(flat.select("query_id", F.slice("t", 1, MAX_PHRASE).alias("p"))), "query_id")
    texts = docs.withColumn("doc_id", F.col(key).cast("bigint")).join(small(found.where("possible").select("doc_id").distinct()), "doc_id", "left_semi")
    near = near.join(texts.select("doc_id", *[word_tokens(F.col(f)).alias(f"_{f}") for f in boosts]), "doc_id")
    bonus = F.lit(0.0)
    for field, boost in boosts.items():
        bonus = bonus + F.when(in_order(F.col(f"_{field}"), F.col("p")), max(2.0, boost * 4.0)).otherwise(0.0)
    out = found.join(near.select("query_id", "doc_id", bonus.alias("bonus")), ["query_id", "doc_id"], "left")
    return top(out.select("query_id", "doc_id", F.round(F.col("base") + F.coalesce("bonus", F.lit(0.0)), digits).alias("score")), k)


def _clause_blocks(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, scores without the phrase, whether the phrase's terms are all there), the latter two documents by queries."""
    idf, starts, columns, is_lead, queries, sizes, leads, boosts, means, k1, b, digits, held, n_docs = model
    n_q, n_f = len(queries), len(boosts)
    step = max(1, 250_000 // max(1, n_q))
    least = np.floor(sizes * np.where(sizes < 12, 0.6, 0.7))
    # counts are whole numbers of few figures, so the short form is exact; a term of the lead counts 64 more, beyond all terms of a query
    sums = [TermSums(starts, columns, n_q, df, n_docs) for df in held]
    counts = [TermSums(starts, columns, n_q, df, n_docs, dtype=np.float32) for df in held]
    either_of = TermSums(starts, columns, n_q, held.max(0, initial=0), n_docs, 1.0 + 64 * is_lead, np.float32)
    for batch in batches:
        flat = batch.column("f").flatten().field("t")
        terms_of = np.concatenate(([0], np.cumsum(sum(x.weights(np.asarray(flat.flatten())) for x in sums))))
        ends = np.concatenate(([0], np.cumsum(np.diff(flat.offsets.to_numpy()))))[batch.column("f").offsets.to_numpy() - batch.column("f").offsets[0].as_py()]
        for lo, hi in document_blocks(np.diff(terms_of[ends]), step):
            part = batch.slice(lo, hi - lo)
            n_d, fields = len(part), part.column("f")
            rows = fields.flatten()
            doc = np.repeat(np.arange(n_d), np.diff(fields.offsets.to_numpy()))
            field, dl = (np.asarray(rows.field(c)) for c in ("field", "dl"))
            lists, tfs = rows.field("t"), rows.field("tf")
            n_t = np.diff(lists.offsets.to_numpy())
            t, tf, row = np.asarray(lists.flatten()), np.asarray(tfs.flatten()).astype(float), np.repeat(np.arange(len(doc)), n_t)
            weight = boosts[field[row]] * (idf[field[row], t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / np.array(means)[field[row]])))
            best, most = np.zeros((n_d, n_q)), np.zeros((n_d, n_q))
            for f in range(n_f):
                at = np.flatnonzero(field[row] == f)
                if len(at):
                    score = sums[f](doc[row[at]], t[at], weight[at], n_d)
                    np.maximum(best, score, out=best)
                    score *= counts[f](doc[row[at]], t[at], np.ones(len(at)), n_d) >= least
                    most += score
            either = np.unique(doc[row] * len(idf[0]) + t)
            whole = either_of(either // len(idf[0]), either % len(idf[0]), np.ones(len(either)), n_d)
            total = best + np.where((sizes >= 3) & (whole == sizes + 64 * leads), 2 * best, 0.0) + np.where(sizes >= 6, 1.5 * most, 0.0)
            yield part.column("doc_id").to_numpy(), np.where(best > 0, np.round(total, digits), 0.0), (sizes >= 4) & (whole >= 64 * leads) & (best > 0)


def pool_size(n_docs: int, top: int, failed: bool = False) -> int:
    """Size of the candidate pool: 5 times ``top``, at least 200; of a known, non-empty index at least 500, at most all."""
    pool = max(5 * top, 200)
    if failed:
        return max(pool, 300)
    return min(n_docs, max(5 * top, 500)) if n_docs > 0 else pool


def prepared(queries: DataFrame, text: str) -> DataFrame:
    """``queries`` with ``search_text`` and ``verbatim``: whole articles are neither expanded nor searched densely."""
    flat = collapse_blank(F.col(text))
    return queries.withColumn("verbatim", is_verbatim(F.col(text))).withColumn("search_text", F.when(F.col("verbatim"), flat).otherwise(expand_query(flat)))


def in_range(time: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Whether a time lies between two bounds, both included; a missing bound is none."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (time >= low)
    return keep & (time <= high) if high is not None else keep
