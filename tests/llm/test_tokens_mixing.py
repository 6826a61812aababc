import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing as M
from factloom.llm import tokens as T

needs_tokenizer = pytest.mark.skipif(not os.path.exists(T.TOKENIZER_FILE), reason="no tokenizer file")


@needs_tokenizer
def test_counts_equal_direct_encoding():
    r = random.Random(1)
    bits = ["word", " two", "  ", "\n\n", "\t", " ", " ", "　", "don't", "12,5%", "đồng", "😀", "à ", "é", "​", "\x1c", "."]
    texts = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(500)] + [None, "", " ", "x" * 5000]
    enc = T._encoding(T.TOKENIZER_FILE)
    got = T.count_batch(pa.array(texts), T.TOKENIZER_FILE)
    assert got.tolist() == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert T.count_batch(pa.array(texts).slice(100, 50), T.TOKENIZER_FILE).tolist() == got[100:150].tolist()


@needs_tokenizer
def test_count_rows(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "a b", None), (2, "a b", "s")], "k bigint, text string, source string")
    assert sorted(r.n_tokens for r in T.with_token_counts(df, "k", "text", ["source"]).collect()) == [0, 2, 2]
    assert T.with_token_counts(df.limit(0), "k", "text", []).count() == 0


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 2000):
        x, p = r.integers(1, 900, n), r.random(n)
        q = M.fly(p, x, r.random(n))
        assert ((q > M.EPS) & (q < 1 - M.EPS)).sum() <= 2 and q.min() >= 0 and q.max() <= 1
        assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
    same = M.fly(np.full(10, 0.5), np.full(10, 7), r.random(10))
    assert same.sum() == pytest.approx(5)


def test_flight_is_fair():
    r = np.random.default_rng(2)
    x = r.integers(1, 900, 12)
    hits = sum(M.land(M.fly(np.full(12, 0.3), x, r.random(12)), x, r.random(12)) for _ in range(4000)) / 4000
    assert np.abs(hits - 0.3).max() < 0.05


def test_water_fill():
    t = {"a": 100, "b": 100, "c": 10}
    w = M.water_fill(t, {"a": 0.5, "b": 0.3, "c": 0.2, "z": 0.0}, {"a": 9, "b": 9, "c": 2, "z": 1}, 210)
    assert w["c"] == 20 and w["z"] == 0 and w["a"] / w["b"] == pytest.approx(5 / 3) and sum(w.values()) == pytest.approx(210)
    assert sum(M.water_fill(t, {"a": 1.0}, {"a": 1}, 210).values()) == 100  # the caps don't allow more


@pytest.mark.parametrize("block_rows", [50, 20_000])
def test_mix(spark, block_rows):
    r = random.Random(3)
    rows = [(i, s, r.randint(5, 60)) for i, s in enumerate(["hot"] * 900 + ["mid"] * 200 + ["tiny"] * 5 + ["other"] * 20)]
    rows += [(5000, None, 50), (5001, "hot", 0)]
    df = spark.createDataFrame(rows, "doc_key bigint, source string, n_tokens bigint")
    goals = spark.createDataFrame([("hot", 0.3, 2), ("mid", 0.5, 4), ("tiny", 0.2, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, plan = M.mix(df, goals, block_rows=block_rows)
    mixed = mixed.cache()
    assert mixed.count() == len(rows) - 1 and mixed.select("doc_key").distinct().count() == len(rows) - 1
    total = sum(n for _, s, n in rows if s)
    out = {x.source: x for x in M.report(mixed, goals).collect()}
    assert out["tiny"].most_repeats == 3 and out["hot"].most_repeats <= 2 and out["absent"].mixed_tokens == 0
    assert sum(x.mixed_tokens for x in out.values()) == pytest.approx(total, rel=0.01)
    for s in ("hot", "mid"):
        assert out[s].mixed_tokens == pytest.approx(plan[s]["wanted"], rel=0.02)
    again, _ = M.mix(df, goals, block_rows=block_rows)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert mixed.where((F.col("source") == "other") & (F.col("copies") > 0)).count() == 0


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_key bigint, source string, n_tokens bigint")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, _ = M.mix(df, goals)
    assert mixed.count() == 0 and M.report(mixed, goals).first().actual_share == 0.0
    mixed, _ = M.mix(df, goals.limit(0))
    assert mixed.count() == 0
