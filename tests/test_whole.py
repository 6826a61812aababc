"""Results that take in every row: what a bounded pool, neighbourhood or sample would leave out."""

import math
import random
from datetime import datetime

import pytest

from factloom.operators import models, retrieval, search
from factloom.plans import search_queries
from factloom.plans.registry import SQL


def _corpus(spark, path, texts, claims):
    docs = [(i + 1, t, None, datetime(2025, 12, 1)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, published_at timestamp").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(claims, "sample_id long, text string").write.parquet(f"{path}/labeled_claims.parquet")


def _fused(texts, claim):
    """{doc_id: fused score} over all documents, ranked by brute force."""
    docs = [t.split() for t in texts]
    mean, terms = sum(map(len, docs)) / len(docs), set(claim.split())
    df = {t: sum(t in d for d in docs) for t in terms}
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    score = lambda d: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in terms)
    order = sorted(range(len(docs)), key=lambda i: (-round(score(docs[i]), 9), i))
    return {i + 1: 1 / (60 + r) + 1 / (61 + i) for r, i in enumerate(order)}


@pytest.mark.parametrize(("n", "early_rows"), [(400, 2_000_000), (15, 2_000_000), (400, 0)])
def test_hybrid_fuses_all_documents(spark, tmp_path, monkeypatch, n, early_rows):
    monkeypatch.setattr(retrieval, "EARLY_ROWS", early_rows)
    r = random.Random(n)
    # the longer and the more alien a text, the worse it ranks: the first ones are the worst
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(1, 4)) + ["z"] * (n // (i + 1) % 50)) if i % 7 else "y y" for i in range(n)]
    claims = [(1, "a b"), (2, "c"), (3, "a c e g"), (4, "unseen")]
    _corpus(spark, tmp_path, texts, claims)
    got = {}
    for row in search_queries.flagship(spark, str(tmp_path)).collect():
        got.setdefault(row.query_id, {})[row.final_rank] = row.doc_id
    for key, claim in claims:
        want = _fused(texts, claim)
        assert [got[key][i] for i in sorted(got[key])] == sorted(want, key=lambda d: (-want[d], d))[:5], claim
    every = {}
    for row in search_queries._hybrid(spark, str(tmp_path), k=20, every=1).collect():
        every.setdefault(row.query_id, {})[row.doc_id] = row.rrf_score
    for key, claim in claims:
        want = _fused(texts, claim)
        best = sorted(want, key=lambda d: (-want[d], d))[:20]
        assert every[key] == pytest.approx({d: want[d] for d in best}), claim


def test_triplets_keep_every_claim_with_evidence(spark):
    kind = "k int, c string, e string"
    rows = [(i, f"c{i}", "same" if i % 50 else f"e{i}") for i in range(200)]
    got = models.triplets(spark.createDataFrame(rows, kind), "k", "c", "e", 3, 50).collect()
    assert sorted(r.k for r in got) == list(range(200))
    assert all(len(r.negatives) == 3 and r.positive not in r.negatives for r in got)
    # only one evidence text: it pads, as in the original
    for n in (1, 8):
        alone = models.triplets(spark.createDataFrame([(i, f"c{i}", "same") for i in range(n)], kind), "k", "c", "e").collect()
        assert [r.negatives for r in alone] == [["same"] * 3] * n
    assert models.triplets(spark.createDataFrame([], kind), "k", "c", "e").count() == 0


def test_phrase_of_a_long_query(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:32]), " ".join(reversed(words[:32])), " ".join(words[:31]), "other text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words))], "k long, q string")
    got = {r.doc_id: r.score for r in search.fielded(docs, "doc_id", {"text": 1.0}, asked, "k", "q").collect()}
    assert got[0] == pytest.approx(got[1] + 4.0) and got[2] < got[1] and 3 not in got


def test_pooled_hybrid_asks_every_claim(spark, tmp_path, monkeypatch):
    """Every claim's evidence is a query, equal ones too; blocks of queries give what the SQL gives in one piece."""
    import duckdb

    monkeypatch.setattr(search_queries, "_BLOCK_TERMS", 40)
    r = random.Random(4)
    voc = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(voc, k=30)), r.choice(["a", "b"]), r.choice(["x", None, ""]), datetime(2025, 12, 1 + i % 28)) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, doc_type string, published_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    evidence = [" ".join(r.choices(voc, k=6)) for _ in range(25)] + [" ".join(r.choices(voc, k=230)), docs[3][1], docs[3][1], "...", "unseen", " ", None]
    spark.createDataFrame(list(enumerate(evidence, 1)), "sample_id long, evidence string").write.parquet(f"{tmp_path}/labeled_claims.parquet")
    got = search_queries.r9_pooled_hybrid(spark, str(tmp_path)).toPandas()
    assert set(got["query_id"]) == set(range(1, 31)) - {29} and got["verbatim"].sum() == 5
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in ("documents", "labeled_claims"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cells = lambda df: sorted(tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert cells(got) == cells(con.sql(SQL["r9_pooled_hybrid"]).df())
