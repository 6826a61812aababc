import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evidence, html, kb, metrics, models, posts, retrieval
from factloom.sources import files, sinks
from factloom.streaming import ingest


def test_bm25_against_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(i, " ".join(r.choices(words, k=5))) for i in range(4)] + [(4, "absent"), (5, None)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "q bigint, text string")
    tok = text.word_tokens(F.col("text"))
    lengths = [len((t or "").split()) for _, t in docs]
    mean = sum(lengths) / len(lengths)
    got = {(x.query_id, x.doc_id): x.score for x in retrieval.bm25(retrieval.postings(d, "doc_id", tok), len(docs), mean, q, "q", tok).collect()}
    for qi, qt in queries:
        for di, dt in docs:
            t, s = (dt or "").split(), 0.0
            for w in set((qt or "").split()):
                df = sum(w in (x or "").split() for _, x in docs)
                tf = t.count(w)
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) if tf else 0
            assert got.get((qi, di), 0.0) == pytest.approx(s)


@pytest.mark.parametrize("limit", [1000, 3])
def test_lexical_search_and_its_bests_against_brute_force(spark, limit):
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(90)] + [(90, None), (91, "")]
    queries = [(i, " ".join(r.choices(words, k=5))) for i in range(4)] + [(4, "absent"), (5, None), (6, "w1 w1")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(queries, "q bigint, text string")
    tok = text.word_tokens(F.col("text"))
    mean = sum(len((t or "").split()) for _, t in docs) / len(docs)
    want = {}
    for qi, qt in queries:
        for di, dt in docs:
            t, s = (dt or "").split(), 0.0
            for w in set((qt or "").split()):
                df = sum(w in (x or "").split() for _, x in docs)
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) if w in t else 0
            if s:
                want[qi, di] = s
    found = retrieval.LexicalSearch(d, "doc_id", tok, q, "q", tok, limit=limit)
    assert {(x.query_id, x.doc_id): x.score for x in found.scores().collect()} == pytest.approx(want)
    for k in (1, 7, 500):
        got = {(x.query_id, x.rank): x.doc_id for x in found.top(k).collect()}
        for qi, _ in queries:
            best = sorted((di for a, di in want if a == qi), key=lambda di: (-round(want[qi, di], 9), di))[:k]
            assert [got[qi, i] for i in range(len(best))] == best and (qi, len(best)) not in got
    none = retrieval.LexicalSearch(d.limit(0), "doc_id", tok, q, "q", tok)
    assert none.top(3).count() == 0 and retrieval.LexicalSearch(d, "doc_id", tok, q.limit(0), "q", tok).top(3).count() == 0


def test_nearest_in_blocks_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(150)] + [(150, None), (151, [0.0] * 4), (152, [1.0] * 3), (153, [2.0] * 3), (None, [1.0] * 4), (154, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))  # noqa: E731, B905
    known = {i: v for i, v in rows if i is not None and v and None not in v and any(v)}
    asked = [i for i in known if i % 9 == 0] + [152]
    for block in (1000, 5):
        got = {}
        for x in retrieval.nearest(df, "id", "v", df.where("id % 9 = 0 or id in (150, 151, 152)"), "id", "v", 6, block=block).collect():
            got.setdefault(x.query_id, {})[x.rank] = x.doc_id
        want = {q: sorted((d for d in known if d != q and len(known[d]) == len(known[q])), key=lambda d: (-round(cos(known[q], known[d]), 9), d))[:6] for q in asked}
        assert {q: [g[i] for i in range(len(g))] for q, g in got.items()} == want
    assert retrieval.nearest(df, "id", "v", df.limit(0), "id", "v", 3).count() == 0 and retrieval.nearest(df.limit(0), "id", "v", df, "id", "v", 3).count() == 0
    assert df.where("id = 152").select(retrieval.of_dimension(F.col("v"), 3).alias("v")).first().v == [1.0] * 3
    with pytest.raises(Exception, match="a vector of 4 elements"):
        df.where("id = 152").select(retrieval.of_dimension(F.col("v"), 4)).collect()


def _cyclicity(days):
    counts = np.bincount(days)
    if len(days) < 10 or len(counts) < 7:
        return 0.5
    p = np.abs(np.fft.fft(counts))[: len(counts) // 2] ** 2
    peaks = [p[i] for i in range(1, len(p) - 1) if p[i] > p[i - 1] and p[i] > p[i + 1] and p[i] >= p.mean()]
    return min(1.0, 5 * max(peaks) / (p.sum() + 1e-8)) if peaks else 0.3


def test_cyclicity_against_numpy(spark):
    r = random.Random(2)
    groups = {
        "few": [0, 3, 9], "short": [0] * 12 + [5], "random": [0] + [r.randint(0, 60) for _ in range(80)] + [60],
        "weekly": [d for d in range(0, 57, 7) for _ in range(5)], "noisy": [0] + [d for d in range(0, 90) for _ in range(6 if d % 7 == 0 else 1)],
    }
    rows = [(g, d * 86400 + 100) for g, days in groups.items() for d in days] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, s bigint").select("g", F.timestamp_seconds("s").alias("ts"))
    got = {x.g: x.cyclicity for x in retrieval.cyclicity(df, "g", "ts").collect()}
    for g, days in groups.items():
        assert got[g] == pytest.approx(_cyclicity(days), abs=1e-6), g


def test_trend(spark):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = [("up", d) for d in (0, 1, 2, 3, 15)] + [("few", 1)] * 4 + [("cap", 0)] * 30 + [("future", -3)] * 3 + [("future", 16)] * 2 + [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, d int").select("g", (F.timestamp_seconds(F.unix_seconds(as_of) - F.col("d") * 86400)).alias("ts"))
    got = {x.g: x.trend for x in retrieval.trend(df, "g", "ts", as_of).collect()}
    assert got == {"up": pytest.approx(1.5), "few": 0.0, "cap": 3.0, "future": pytest.approx(1 / 3)}


def test_rank_fusion_missing_ranks_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 10, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    got = {x.doc_id: x.rrf_score for x in retrieval.fuse(a, b, 5).collect()}
    assert got[10] == got[11] == pytest.approx(1 / 60 + 1 / 61) and got[12] == pytest.approx(1 / 65 + 1 / 62)


def _pack(parts, most):
    out, cur = [], ""
    for s in parts:
        if cur and len(cur) + len(s) + 1 > most:
            out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}" if cur else s
    return out + ([cur] if cur else [])


def test_packing(spark):
    r = random.Random(3)
    texts = [" ".join("x" * r.randint(1, 40) + r.choice([".", "!", "?"]) for _ in range(r.randint(1, 60))) for _ in range(40)] + ["", " ", "A. B. " + "y" * 300, "z" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", "t", evidence.packed(F.col("t"), 200).alias("c")).collect():
        if len(row.t) <= 200:
            assert row.c == ([row.t] if row.t.strip() else [])
        else:
            assert row.c == _pack([s for s in re.split(r"(?<!\b[A-Z]\.)(?<=[.!?])\s+", row.t) if s.strip()], 200)


def test_budget_keeps_numbers(spark):
    df = spark.createDataFrame([(1, ["aa", " ", "bbb", "c" * 50, "d"]), (2, []), (3, None), (4, ["x" * 10]), (5, ["x" * 11])], "k int, items array<string>")
    got = {r.k: (r.evidence, r.n_items) for r in evidence.budgeted(df, "k", F.col("items"), 10, F.length("item")).collect()}
    assert got[1] == ("1. aa\n3. bbb\n", 2) and got[2] == got[3] == ("", 0) and got[4][1] == 1 and got[5][1] == 0


def test_evidence_literals(spark):
    df = spark.createDataFrame([(1, "['a, b', \"c\"]"), (2, "[broken"), (3, None), (4, "[1, 2"), (5, "{'a': 1}"), (6, " plain ")], "k int, e string")
    got = {r.k: r.x for r in df.select("k", evidence.joined_evidence(F.col("e")).alias("x")).collect()}
    assert got == {1: "a, b|||c", 2: "[broken", 3: "", 4: "[1, 2", 5: "{'a': 1}", 6: "plain"}


def test_metrics_against_python(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randint(0, 2), r.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "m string, y int, p int")
    for got in metrics.summary(metrics.confusion(df, F.col("y"), F.col("p"), "m"), [0, 1, 2], "m").collect():
        own = [(y, p) for m, y, p in rows if m == got.m]
        f1 = []
        for c in (0, 1, 2):
            tp, g, q = sum(y == p == c for y, p in own), sum(y == c for y, _ in own), sum(p == c for _, p in own)
            pr, re_ = tp / q if q else 0, tp / g if g else 0
            f1.append((2 * pr * re_ / (pr + re_) if pr + re_ else 0, g))
        assert got.accuracy == pytest.approx(sum(y == p for y, p in own) / len(own))
        assert got.macro_f1 == pytest.approx(sum(f for f, _ in f1) / 3) and got.weighted_f1 == pytest.approx(sum(f * g for f, g in f1) / len(own))


def test_label_shares_of_missing_class(spark):
    got = metrics.label_shares(spark.createDataFrame([(0,), (0,), (2,)], "y int"), F.col("y"), [0, 1, 2]).orderBy("label").collect()
    assert [(r.n, r.weight) for r in got] == [(2, 0.5), (0, None), (1, 1.0)]


def test_kb(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "x", 1)], "id int, v string, seq int")
    once = kb.upsert(t, b, "id", "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, kb.upsert(once, b, "id", "seq").collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(Exception, match="exists already"):
        kb.create(t, b.select("id", "v"), "id").collect()
    assert kb.create(t, b.where("id = 3").select("id", "v"), "id").count() == 3
    assert kb.delete(t, b, "id").count() == 1
    d = spark.createDataFrame([(1, "A b!", None), (2, "a B", 7), (3, "a b", 9)], "i int, t string, ts int")
    assert tuple(kb.backfilled(d, text.normalize(F.col("t")), "t", "ts", "i").select("text", "ts").first()) == ("A b!", 7)


def test_posts(spark):
    schema = ("post_id string, page_name string, group_name string, text string, message string, created_time string, permalink string, media array<struct<type:string,url:string>>, photos array<string>, "
              "videos array<string>, image_urls array<string>, comment_count bigint, comments array<struct<text:string,reaction_count:string,replies:array<struct<text:string,reaction_count:string>>>>")  # fmt: skip
    rows = [("1", "", "G", None, "hi", "2024-01-02 03:04", None, [("photo", "a"), ("video", "v")], ["a", "b"], None, [""], None, [("c1", "3", [("r1", "1")]), ("c2", None, None)]), ("2", None, None, None, None, None, None, None, None, None, None, 7, None)]
    canon = posts.canonical(spark.createDataFrame(rows, schema))
    a, b = canon.orderBy("post_id").collect()
    assert (a.source, a.post_date, a.post_text, a.image_urls, a.video_urls, a.comment_count) == ("G", "2024-01-02", "hi", ["a", "b"], ["v"], 2)
    assert (b.source, b.post_text, b.comment_count, b.image_urls) == ("", "", 7, [])
    flat = [(r.post_id, r.comment_text, r.is_reply, r.parent_comment) for r in posts.flat_rows(canon).collect()]
    assert sorted(flat) == [("1", "c1", False, ""), ("1", "c2", False, ""), ("1", "r1", True, "c1"), ("2", "", False, "")]
    md = {r.post_id: r.md for r in posts.markdown(canon).collect()}
    assert "# Post 1\n\n**Source:** G\n" in md["1"] and "### 1. c1\n*Reactions: 3*\n\n**Replies:**\n- r1 *(Reactions: 1)*" in md["1"] and "(no text)" in md["2"] and "## Comments (0)" in md["2"]


def test_html(spark):
    page = ('<html><head><title>T</title><script type="application/ld+json">{"@graph":[{"datePublished":"2024-05-01T10:00:00+07:00"}]}</script></head><body><nav><p>' + "menu " * 20
            + '</p></nav><div class="x news-detail"><p>' + "First paragraph of the story. " * 3 + "</p><p>short</p><ul><li>" + "An item that is long enough. " * 3 + "</li></ul></div><a href='/tin/2024/a.html'>Read</a>"
            + "<a href=\"javascript:go('//m.s.vn/b')\">b</a><a onclick=\"open('/c')\" href='mailto:x'>c</a></body>")
    a = spark.createDataFrame([(page,), (None,), ("",), ("<p>" * 3000,)], "h string").select(html.article(F.col("h")).alias("a")).collect()
    assert a[0].a.published_at == "2024-05-01T03:00:00Z" and a[0].a.title == "T" and a[0].a.content.startswith("First paragraph") and "menu" not in a[0].a.content and "short" not in a[0].a.content
    assert a[1].a.content is None and a[2].a.content == ""
    df = spark.createDataFrame([(1, page, "https://s.vn/x"), (2, None, "y")], "k int, h string, b string")
    assert sorted(r.url for r in html.links(df, "h", "b", ["k"]).collect()) == ["https://m.s.vn/b", "https://s.vn/c", "https://s.vn/tin/2024/a.html"]
    assert html.json_blocks('{"data": {"a": "}"}} junk "data": {broken "data":{"b":{"c":1}}') == [{"a": "}"}, {"b": {"c": 1}}]


def test_models(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [0.5])], "x array<double>, r array<double>")
    row = df.select(models.softmax(F.col("x")).alias("s"), models.argmax(F.col("x")).alias("a"), models.gated(F.slice("x", 1, 2), F.col("r"), F.lit(0.5)).alias("g"), models.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()
    e = np.exp(np.array([1.0, 2, 2]) - 2)
    assert row.s == pytest.approx(list(e / e.sum())) and row.a == 1 and row.g == pytest.approx([0.75, 0.75]) and row.z == [0.0, 0.0]
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 0, [0.0, 1.0]), (4, 1, [0.0, 0.0]), (5, 1, [0.0, 0.0])], "k int, c int, v array<double>")
    assert {r.c: r.medoid for r in models.medoids(v, "k", "c", "v").collect()} == {0: 2, 1: 4}
    t = models.triplets(spark.createDataFrame([(i, f"c{i}", f"e{i % 5}") for i in range(40)] + [(99, "x", None), (98, "x", " ")], "k int, c string, e string"), "k", "c", "e", 3, 10).collect()
    assert len(t) == 40 and all(len(r.negatives) == 3 and r.positive not in r.negatives for r in t)
    two = spark.createDataFrame([(i, [1.0 + i % 3 * 0.01, 0.0] if i % 2 else [0.0, 1.0 + i % 3 * 0.01]) for i in range(20)], "k int, v array<double>")
    assert models.choose_clusters(two, "v", 2, 4).select("cluster").distinct().count() == 2


def test_file_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('claim,evidence,label,timestamp\n"x, y","[\'e1\', \'e2\']",TRUE,2024-01-01\nz,,junk,\n', encoding="utf-8")
    got = files.labeled_csv(spark, str(tmp_path / "a.csv"), "2030-01-01 00:00:00").collect()
    assert [(r.text, r.evidence, r.label) for r in got] == [("x, y", "e1|||e2", 0), ("z", "", 2)] and got[1].timestamp.year == 2030
    (tmp_path / "b.csv").write_text("text,label\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="evidence"):
        files.labeled_csv(spark, str(tmp_path / "b.csv"), "2030-01-01")
    (tmp_path / "c.txt").write_text(" a \n\nb\n", encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"claims": ["a", " ", "b"]}), encoding="utf-8")
    (tmp_path / "d.json").write_text(json.dumps(["a", "b"]), encoding="utf-8")
    for name in ("c.txt", "c.json", "d.json"):
        assert [r.claim for r in files.claims_file(spark, str(tmp_path / name)).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        files.claims_file(spark, "x.pdf")
    (tmp_path / "links").write_text("https://s/groups/1\nhttps://s/p\n", encoding="utf-8")
    assert [r.kind for r in files.feed_list(spark, str(tmp_path / "links")).collect()] == ["group", "page"]
    files.save_index({"postings": spark.range(3).toDF("x")}, str(tmp_path / "idx"))
    assert files.load_index(spark, str(tmp_path / "idx"), ["postings"])["postings"].count() == 3
    schema = "post_id string, source string, post_date string, post_url string, post_text string, image_urls array<string>, video_urls array<string>, comment_count bigint, comments array<struct<text:string,reaction_count:string,replies:array<struct<text:string,reaction_count:string>>>>"
    df = spark.createDataFrame([("1", "S", "", "", "t", [], [], 0, [("c", "1", [])])], schema)
    for kind in ("json", "csv", "parquet", "md"):
        sinks.write_posts(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).first().comment_text == "c"
    with pytest.raises(ValueError):
        sinks.write_posts(df, str(tmp_path / "x"), "xml")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"p{i % 7}", i, f"t{i}") for i in range(40)] + [(None, 1, "x")]
    for n in range(3):
        spark.createDataFrame(rows[n::3], "post_id string, seq bigint, body string").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    for run in range(2):  # the second run has nothing new to do
        stream = ingest.read_posts(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "0")).schema, 1)
        ingest.upsert_stream(stream, str(tmp_path / "kb"), str(tmp_path / "cp"), "post_id", "seq", 4)
    got = {r.post_id: r.body for r in spark.read.parquet(str(tmp_path / "kb")).collect()}
    assert got == {f"p{k}": f"t{max(i for i in range(40) if i % 7 == k)}" for k in range(7)}


def test_nested_and_joined_comments(spark):
    rows = [(1, "p", "a", "1", False, None), (2, "p", "r", "2", True, "a"), (3, "p", "a", None, False, None), (4, "p", "x", "0", True, "gone"), (5, "q", None, None, False, None), (6, "p", None, "3", None, None)]
    c = spark.createDataFrame(rows, "comment_key bigint, post_id string, comment_text string, comment_reactions string, is_reply boolean, parent_comment string")
    got = {r.post_id: [(x.text, x.reaction_count, [tuple(y) for y in x.replies]) for x in r.comments] for r in posts.nested(c).collect()}
    assert got == {"p": [("a", "1", [("r", "2")]), ("a", None, []), ("x", "0", []), (None, "3", [])], "q": [(None, None, [])]}
    own = spark.createDataFrame([("p", ["u", "v"]), ("z", None)], "post_id string, image_urls array<string>")
    flat = sorted((r.post_id, r.comment_text, r.comment_reactions, r.is_reply, r.parent_comment) for r in posts.joined_rows(own, c).collect())
    assert flat == [("p", "", "3", False, ""), ("p", "a", "", False, ""), ("p", "a", "1", False, ""), ("p", "r", "2", True, "a"), ("p", "x", "0", True, "gone"), ("z", "", "", False, "")]
    assert posts.nested(c.limit(0)).count() == 0


def test_numbered_rows(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v bigint").repartition(6)
    assert [(r.place, r.v) for r in kb.numbered(df, ["v"]).orderBy("place").collect()] == [(i + 1, i) for i in range(1000)]
    assert kb.numbered(df.limit(0), ["v"]).count() == 0


def test_containing_and_feature_matrix(spark):
    d = spark.createDataFrame([(1, "The Cat sat"), (2, "a cat"), (3, None), (4, "")], "id bigint, t string")
    q = spark.createDataFrame([(1, "cat"), (2, "CAT S"), (3, " "), (4, None), (5, "cat")], "q bigint, t string")
    got = sorted((r.query_id, r.doc_id) for r in retrieval.containing(d, "id", "t", q, "q", "t").collect())
    assert got == [(1, 1), (1, 2), (2, 1), (5, 1), (5, 2)] and retrieval.containing(d, "id", "t", q.limit(0), "q", "t").count() == 0
    with pytest.raises(ValueError, match="at most 2"):
        retrieval.containing(d, "id", "t", q, "q", "t", limit=2)
    r = spark.createDataFrame([(1, 1, 0.9, 1.0, 0.5, 0.3), (1, 2, 0.8, 0.5, 0.4, 0.3)], "query_id int, final_rank int, score double, norm double, recency_score double, cyclicity_score double")
    assert retrieval.feature_matrix(r, 3).first().features == [[0.9, 1.0, 0.5, 0.3], [0.8, 0.5, 0.4, 0.3], [0.0] * 4]


def test_scope_removes_its_tables(spark):
    from factloom import storage

    kept = storage.materialize(spark.range(3), "kept")
    with storage.scope():
        inner = storage.materialize(spark.range(5), "inner")
        assert inner.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not_found|no such"):
        spark.read.parquet(*inner.inputFiles()).count()


def test_sums_of_common_and_rare_terms():
    """Common terms need no row per pair of a document and a query; the sums are those of all pairs."""
    r = np.random.default_rng(3)
    asked, held = r.random((40, 30)) < np.linspace(0.02, 0.9, 40)[:, None], r.random((50, 40)) < np.linspace(0.02, 0.9, 40)
    t, q = np.nonzero(asked)
    sums = retrieval.TermSums(np.searchsorted(t, np.arange(41)), q, 30, held.sum(0), 50)
    doc, term = np.nonzero(held)
    numbers = r.random(len(doc))
    full = np.zeros((50, 40))
    full[doc, term] = numbers
    assert np.allclose(sums(doc, term, numbers, 50), full @ asked)
    assert 0 < sums.weights(term).sum() < 0.05 * asked.sum(1)[term].sum()


def test_large_pools_in_blocks_of_queries(spark, monkeypatch):
    """A query set of few distinct terms but many pairs is scored where the documents lie, and of large pools no more than a few times the pool is sent."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(i, " ".join(r.choices(words, k=12))) for i in range(3_000)], "doc_id bigint, text string").repartition(6)
    q = spark.createDataFrame([(i, " ".join(r.choices(words, k=5))) for i in range(12)], "q bigint, text string")
    tok = text.word_tokens(F.col("text"))
    sent = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, name, own=retrieval.materialize: (lambda one: (name == "pools" and sent.append(one.count()), one)[1])(own(df, name)))
    found = retrieval.LexicalSearch(d, "doc_id", tok, q, "q", tok, limit=35)
    assert found.joined is None and len(found.models) > 1
    key = lambda x: (x.query_id, x.rank, x.doc_id)
    want = sorted(key(x) for x in retrieval.top(found.scores(), 200).collect())
    assert sorted(key(x) for x in found.top(200).collect()) == want and sum(sent) < 3 * 200 * 12
    everything = found.scores()

    def misled(rows, k, bounds):
        """A sample whose bounds are far too high: every query comes out short and is asked again."""
        own = everything if bounds else everything.withColumn("score", F.col("score") + 1e6)
        return own.where(F.col("score") >= F.lit(min(bounds.values(), default=0.0)))

    assert sorted(key(x) for x in retrieval.best_of(misled, found.vectors, 200).collect()) == want


def test_stored_index_has_a_row_per_document(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "c")], "id bigint, text string").coalesce(1)
    index = retrieval.document_index(d, "id", text.word_tokens(F.col("text")))
    rows = {x.doc_id: (x.dl, dict(zip(x.terms, x.tfs, strict=True))) for x in index.collect()}
    assert rows == {1: (3, {"a": 1, "b": 2}), 2: (0, {}), 3: (0, {}), 4: (1, {"c": 1})}
    q = spark.createDataFrame([(7, "b c")], "q bigint, text string")
    for limit in (200_000, 1):
        got = [retrieval.LexicalSearch(x, "id", tok, q, "q", text.word_tokens(F.col("text")), limit=limit, stored=stored).top(5).orderBy("rank").collect() for x, tok, stored in ((d, text.word_tokens(F.col("text")), False), (index, F.col("terms"), True))]
        assert got[0] == got[1] and [x.doc_id for x in got[0]] == [4, 1]
