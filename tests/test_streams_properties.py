import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions.timestamps import as_text, readings
from factloom.operators import html, posts, retrieval
from factloom.streaming import ingest


def test_first_seen_and_windows(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [("a", t(0)), ("a", t(1)), ("b", t(2)), ("a", t(30)), ("b", None)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    out = ingest.first_seen(stream, "ts", ["k"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    out.trigger(availableNow=True).start().awaitTermination()
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}
    batch = {(r.start, r.k): r.n for r in ingest.windowed_counts(spark.read.parquet(str(tmp_path / "in")).where("ts is not null"), "ts", "k").collect()}
    assert batch == {(t(0), "a"): 2, (t(0), "b"): 1, (t(24), "a"): 1}


def test_private_keys(spark):
    df = spark.createDataFrame([({"_x": "1", "y": "2"},), ({},)], "m map<string,string>")
    assert [r.m for r in df.select(posts.without_private(F.col("m")).alias("m")).collect()] == [{"y": "2"}, {}]


def test_nearest_skips_zero_vectors_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0])], "id int, v array<double>")
    got = [(r.doc_id, r.rank) for r in retrieval.nearest(v, "id", "v", v.where("id = 1"), "id", "v", 5).orderBy("rank").collect()]
    assert got == [(2, 0), (4, 1)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1_000_000_000, 2_500_000_000), st.integers(-14 * 4, 14 * 4))
def test_written_instants_are_read_back(seconds, quarter):
    zone = datetime.timezone(datetime.timedelta(minutes=15 * quarter))
    when = datetime.datetime.fromtimestamp(seconds, zone)
    for form in ("%Y-%m-%dT%H:%M:%S%z", "%a, %d %b %Y %H:%M:%S %z", "%d %B %Y %H:%M:%S %z", "%Y%m%dT%H%M%S%z"):
        assert [s for _, s in readings(when.strftime(form))] == [seconds], form
    assert [as_text(s) for _, s in readings(str(seconds))] == [as_text(seconds)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_can_be_read(text):
    for order, _ in readings(text, "Asia/Ho_Chi_Minh"):
        assert order in (0, 1, 2)
    root = html.parse(text)
    html.article_text(root)
    html.section_candidates(root, text)


@given(st.lists(st.integers(0, 400), min_size=2, max_size=2, unique=True))
def test_rank_fusion_is_symmetric(ranks):
    a, b = ranks
    assert 1 / (60 + a) + 1 / (60 + b) == 1 / (60 + b) + 1 / (60 + a)
