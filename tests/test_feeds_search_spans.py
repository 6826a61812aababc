import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import feeds, models, retrieval, search, spans
from factloom.sources import files, sinks, synthetic


def test_story_nodes_of_three_shapes(spark):
    node = {"post_id": "1", "message": {"text": "hi"}, "actors": [{"name": "A"}], "metadata": [{}, {"creation_time": 7}], "permalink_url": "u", "feedback": {"comments": {"total_count": 3}},
            "attachments": [{"media": {"__typename": "Photo", "url": "p"}, "subattachments": [{"media": {"__typename": "Video", "url": "v"}}]}]}
    shapes = [{"data": {"node": {"timeline_list_feed_units": {"edges": [{"node": node}]}}}}, {"data": {"node": {"group_feed": {"edges": [{"node": node}, {"node": {"message": None}}]}}}}, {"data": {"node": {"__typename": "Story", **node}}}, {"x": 1}]
    df = spark.createDataFrame([(json.dumps(s),) for s in shapes] + [(None,), ("broken",)], "r string")
    rows = feeds.post_rows(df, "r").collect()
    assert len(rows) == 3 and all(tuple(r) == ("1", "hi", "A", 7, "u", 3) for r in rows)
    n = spark.createDataFrame([(json.dumps(node),), (json.dumps({"post_id": "2"}),)], "n string").select(feeds.media_of(F.col("n")).alias("m"), feeds.has_video(F.col("n")).alias("v")).collect()
    assert [(m.type, m.url) for m in n[0].m] == [("photo", "p"), ("video", "v")] and [r.v for r in n] == [True, False]


def test_responses(spark):
    df = spark.createDataFrame([('for (;;);{"a":1,"errors":[2]}\n{"b":3}',)], "r string")
    assert df.select(feeds.without_keys(feeds.first_line(F.col("r"))).alias("x")).first().x == {"a": "1"}
    c = {"data": {"node": {"comments": {"edges": [{"node": {"body": {"text": "t"}, "feedback": {"reactors": {"count_reduced": "1.2K"}}}}, {"node": {"body": None}}]}}}}
    got = spark.createDataFrame([(json.dumps(c),), ("{}",)], "r string").select(feeds.comments_of(F.col("r")).alias("c")).collect()
    assert [tuple(x) for x in got[0].c] == [("t", "1.2K"), ("", "0")] and got[1].c == []
    m = feeds.open_metadata(spark.createDataFrame([(1, "a", None)], "k int, x string, y int"), ["k"]).first()
    assert m.metadata == {"x": "a"}


def test_walk_ends_at_known_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, None), (7, 8)], "a int, b int")
    s = spark.createDataFrame([(1,), (5,), (7,), (9,)], "start int")
    got = sorted((r.start, r.step, r.node) for r in feeds.walk(e, "a", "b", s).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (5, 0, 5), (7, 0, 7), (7, 1, 8), (9, 0, 9)]
    assert feeds.walk(e, "a", "b", s, 1).count() == 6


def test_phrases_in_order(spark):
    df = spark.createDataFrame([(d, q) for d, q in [("a b c", "b c"), ("a b x c", "b c"), ("b x y c", "b c"), ("b x y z c", "b c"), ("c b", "b c"), ("", "b"), ("b b c", "b c"), ("a", "")]], "d string, q string")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    assert [r.x for r in df.select(search.in_order(words("d"), words("q")).alias("x")).collect()] == [True, True, True, False, False, False, True, False]


def test_fielded_search(spark):
    docs = spark.createDataFrame([(1, "red fox", "the red fox runs fast today"), (2, None, "a fox and a red hen run today"), (3, "blue", "nothing here"), (4, "fast red fox today", "")], "id bigint, title string, body string")
    q = spark.createDataFrame([(1, "red fox runs fast"), (2, "zebra"), (3, " "), (4, None)], "q bigint, text string")
    got = {(r.query_id, r.doc_id): r.score for r in search.fielded(docs, "id", {"title": 3.0, "body": 1.0}, q, "q", "text").collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 4)} and got[1, 1] > got[1, 4] > got[1, 2]  # the phrase stands in 1's body
    assert [search.pool_size(*a) for a in ((0, 20), (50, 20), (10_000, 20), (10_000, 200), (10, 20, True))] == [200, 50, 500, 1000, 300]


def test_fielded_bests_equal_the_joined_form(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    text = lambda n: " ".join(r.choices(words, k=n)) if r.random() < 0.9 else r.choice(["", None])
    rows = [(i, text(r.randint(1, 4)), text(r.randint(1, 30))) for i in range(150)]
    asked = [(i, " ".join(r.choices(words, k=r.randint(1, 8)))) for i in range(12)] + [(20, " ".join(words * 3)), (21, None), (22, "none"), (23, rows[3][2] or "w1")]
    d, q = spark.createDataFrame(rows, "id bigint, title string, body string").repartition(4), spark.createDataFrame(asked, "q bigint, text string")
    want = retrieval.top(search.fielded(d, "id", {"title": 3.0, "body": 1.0}, q, "q", "text").withColumn("score", F.round("score", 9)), 7)
    for limit in (200_000, 5):
        got = search.fielded_top(d, "id", ("title^3", "body"), q, "q", "text", 7, limit=limit)
        key = lambda x: (x.query_id, x.rank)
        a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
        assert [(x.query_id, x.rank, x.doc_id) for x in a] == [(x.query_id, x.rank, x.doc_id) for x in b] and [x.score for x in a] == pytest.approx([x.score for x in b])
    assert search.fielded_top(d.limit(0), "id", ("title^3", "body"), q, "q", "text", 7).count() == 0 and search.fielded_top(d, "id", ("body",), q.limit(0), "q", "text", 7).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, "ab cde f"), (2, "")], "k int, t string")
    tokens, chunks = spans.token_spans(df, "k", F.col("t")), spans.fixed_chunks(df, "k", F.col("t"), 4)
    got = sorted((r.k, r.chunk_no, r.n_tokens, r.mean) for r in spans.pooled(tokens, chunks, "k", F.length("token")).collect())
    assert got == [(1, 0, 2, 2.5), (1, 1, 2, 2.0)]
    late = spark.createDataFrame([(1, "ab cde f", ["ab cde", "f", "zz", ""]), (2, None, ["x"])], "k int, t string, p array<string>")
    out = {r.chunk_no: r.embedding for r in spans.late_chunks(late, "k", "t", "p", lambda ts: np.array([[float(len(t))] for t in ts]).reshape(len(ts), 1), 1).collect()}
    assert out == {0: [2.5], 1: [1.0], 2: [0.0], 3: [0.0]}
    s = spark.createDataFrame([([5, 6],)], "p array<int>").select(spans.supervised(F.col("p"), F.lit(9), 2, 6).alias("s")).first().s
    assert (s.input_ids, s.labels, s.attention) == ([5, 6, 9, 2, 0, 0], [-100, -100, 9, -100, -100, -100], [1, 1, 1, 1, 0, 0])
    with pytest.raises(Exception, match="longer"):
        spark.createDataFrame([([1] * 9,)], "p array<int>").select(spans.supervised(F.col("p"), F.lit(9), 2, 6).alias("s")).collect()


def test_synthetic_claims(spark):
    c = spark.createDataFrame([("t", "The rate rose by two points.", "e", "The rate fell by two points."), ("u", "Json is a file format today.", "e", "x")], "topic string, true_stmt string, evidence_core string, contradict_stmt string")
    a, b = (sorted(map(tuple, synthetic.claims(c, 3, ["Reports say", "They say"], ["", " now"]).collect())) for _ in range(2))
    assert a == b and {r[2] for r in a} == {"true", "false"} and all("json" not in r[0].lower() for r in a) and len({r[0] for r in a}) == len(a)


def test_networks(spark):
    net = models.SlotNetwork(3)
    df = spark.createDataFrame([(1, [[0.1] * 4, [0.2] * 4], "p"), (2, None, "q")], "k int, f array<array<double>>, prompt string")
    got = {r.k: r.retrieval_logits for r in models.with_slot_logits(df, "f", net).collect()}
    x = np.zeros((1, 3, 4))
    x[0, 0], x[0, 1] = 0.1, 0.2
    assert got[1] == pytest.approx(net.logits(x)[0].tolist()) and len(got[2]) == 3
    assert len(models.with_scores(df.select("k", "prompt"), "prompt", models.lexical_scorer).first().lm_logits) == 3


def test_more_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("claim,evidence\nx,\"['a long statement', 'short']\"\nnan,some long evidence\ny,\n ,other long evidence\nz,first long line.  second long line\n", encoding="utf-8")
    good, report = files.claim_evidence_csv(spark, str(tmp_path / "a.csv"))
    assert {r.claim: len(r.evidences) for r in good.collect()} == {"x": 1, "z": 2} and tuple(report.first())[:3] == (5, 2, 3)
    posts = spark.createDataFrame([("S", "T", None, "https://s/a/b", "c", ["i"])], "source string, title string, date string, url string, content string, images array<string>")
    for kind in ("json", "csv", "parquet", "md"):
        sinks.write_web_posts(posts, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).first().url_slug == "a_b"
    rows = sinks.crawl_rows(spark.createDataFrame([("u", "s", " a  b ", None, None)], "article_url string, source_url string, title string, content string, published_at string"), "now").first()
    assert rows.title == "a b" and rows.published_at == "now" and rows.content == ""
    sinks.write_clusters(spark.createDataFrame([(0, "a", True), (0, "b", False)], "cluster int, claim string, is_medoid boolean"), str(tmp_path / "cl"))
    assert spark.read.json(str(tmp_path / "cl")).first().representative_claim == "a"
    sinks.write_samples(spark.createDataFrame([("c", "e", "true", "rule", 1)], "claim string, evidence string, label string, type string, x int"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == ["claim", "evidence", "label", "type"]


def test_truncated_prompts(spark):
    ids = lambda n, k: list(range(k, k + n))
    rows = [(ids(5, 0), [ids(3, 10), ids(4, 20), ids(1, 30)]), (ids(30, 0), [ids(1, 9)]), ([], [])]
    df = spark.createDataFrame(rows, "c array<int>, e array<array<int>>")
    fixed = lambda n: F.array_repeat(F.lit(-1), n)
    got = [r.x for r in df.select(spans.truncated(fixed(2), F.col("c"), fixed(1), F.col("e"), fixed(1), 16).alias("x")).collect()]
    assert got[0] == [-1, -1, *ids(5, 0), -1, *ids(3, 10), -1]  # the item that does not fit ends the evidence
    assert got[1] == [-1, -1, *ids(10, 0), -1, -1] and got[2] == [-1] * 4
    with pytest.raises(Exception, match="template is too long"):
        df.select(spans.truncated(fixed(9), F.col("c"), fixed(9), F.col("e"), fixed(1), 16)).collect()
