import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import quality as Q


def _texts():
    r = random.Random(1)
    prose = [" ".join(r.choice(["The board said that the price of the coin was higher.", "Its users asked why it had not been paid.", "Giá của đồng này đã tăng và không giảm trong tuần."]) for _ in range(r.randint(1, 8))) for _ in range(60)]
    lists = ["\n".join(f"- {r.choice(['loan book', 'token sale', 'phí rút tiền'])}" for _ in range(r.randint(5, 20))) for _ in range(20)]
    tables = ["\n".join(f"| {r.randint(1, 999)}.{r.randint(1, 99)} | {r.randint(1, 9999)}% |" for _ in range(r.randint(4, 20))) for _ in range(20)]
    junk = [" ".join("".join(r.choices("abcxyz0123456789", k=r.randint(3, 30))) for _ in range(r.randint(10, 60))) for _ in range(20)]
    return [(t, k) for ts, k in ((prose, "prose"), (lists, "list"), (tables, "table"), (junk, "junk")) for t in ts]


def test_rules_tell_kinds_apart(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate(_texts())]
    wrong = [(i, t, "junk" if i % 29 == 3 else k) for i, t, k in rows]  # a few mistaken ratings
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t, _ in rows] + [(900, None, 1, 1), (901, "", 1, 1), (902, "word " * 100_000, 1, 1)], "doc_id bigint, text string, n_words int, w int")
    labels = spark.createDataFrame([(i, k) for i, _, k in wrong] + [(5, None), (77777, "list"), (0, "prose")], "doc_id bigint, kind string")
    stats = Q.statistics(docs, "text", ["doc_id"])
    rules = Q.learn(stats, "doc_id", labels, "kind")
    got = {r.doc_id: r.kind for r in Q.classify(stats, rules).collect()}
    assert len(got) == len(rows) + 3 and got[900] == got[901] == "junk"
    assert sum(got[i] == k for i, _, k in rows) / len(rows) > 0.95


def test_statistics_by_hand(spark):
    r = Q.statistics(spark.createDataFrame([(1, "The cat, sat.\n- a b1\n\n12")], "k int, text string"), "text", ["k"]).first()
    assert (r.n_words, r.n_lines) == (7.0, 3.0)
    assert r.end_punctuation_share == 1 / 3 and r.bullet_share == 1 / 3 and r.mixed_word_share == 1 / 7
    assert r.symbol_ratio == 3 / 24 and r.digit_ratio == 3 / 24 and abs(r.common_word_share - 2 / 7) < 1e-9


def test_exported_sql_equals_rules(spark):
    g = np.random.default_rng(1)
    x = {f: g.random(200).round(3) for f in Q.FEATURES}
    y = np.where(x["digit_ratio"] > 0.8, "table", np.where(x["symbol_ratio"] < 0.15, "junk", "prose"))
    rules = Q.induce(x, y)
    want = np.full(200, "prose", dtype=object)
    for rule in reversed(rules):
        want[rule.holds(x)] = rule.kind
    df = spark.createDataFrame([tuple(float(x[f][i]) for f in Q.FEATURES) + (i,) for i in range(200)], ", ".join(f"{f} double" for f in Q.FEATURES) + ", i int")
    got = {r.i: r.kind for r in Q.classify(df, rules).collect()}
    assert [got[i] for i in range(200)] == list(want) and (want == y).mean() > 0.95


def test_without_ratings(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    stats = Q.statistics(docs, "text", ["doc_id"])
    assert Q.learn(stats, "doc_id", spark.createDataFrame([], "doc_id bigint, kind string"), "kind") == []
    assert Q.classify(stats, []).first().kind == "prose" and Q.classify(stats.limit(0), []).count() == 0
    assert Q.statistics(docs, "text", []).agg(F.max("n_words")).first()[0] == 2.0
