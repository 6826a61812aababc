"""Results of problem 5 that take in every row."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from factloom.llm import boilerplate, residue
from factloom.llm import queries as llm


def test_validation_labels_all_posts(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    prose = "The board said that the price of the coin of {} rose by three million dollars before the long holiday this year."
    word = lambda: "".join(r.choices("abcdefghij", k=9))
    body = lambda i: f"404 Not Found {word()} nginx" if i % 4 == 0 else "\n".join(prose.format(word()) for _ in range(3))
    rows = [(i, f"s{i % 9}", f"Title {word()}", body(i), datetime(2025, 12, 1)) for i in range(400)]
    kind = "post_key long, source string, title string, content string, fetched_at timestamp"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/web_posts.parquet")
    small = residue.sample
    monkeypatch.setattr(residue, "sample", lambda digests: small(digests, 80))
    posts = spark.createDataFrame(rows, kind)
    digests = boilerplate.digest_lines(posts, "post_key", "source", "content", F.to_date("fetched_at"), keep=("title",), keep_lines=True)
    weak = residue.weak_label(residue.bodies(digests, boilerplate.frequent_lines(digests))).where("weak is not null")
    group = F.when(residue.held_out(F.col("source")), "unseen").otherwise("trained")
    want = {(x.hosts, x.weak): x["count"] for x in weak.groupBy(group.alias("hosts"), "weak").count().collect()}
    got = llm.p5_validation(spark, str(tmp_path)).collect()
    assert {(x.hosts, k): n for x in got for k, n in ((1, x.positives), (0, x.negatives))} == want and sum(want.values()) == 400
    assert all(x.positives_found == x.positives and x.negatives_found == 0 for x in got)


def test_posts_without_source_are_scored(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=9))
    prose = "The board said that the price of the coin of {} rose by three million dollars before the long holiday this year."
    body = lambda i: f"404 Not Found {word()} nginx" if i % 4 == 0 else "\n".join(prose.format(word()) for _ in range(3))
    rows = [(i, None if i % 10 == 0 else f"s{i % 9}", f"Title {word()}", body(i), datetime(2025, 12, 1)) for i in range(400)]
    rows.append((400, None, "t", None, None))
    spark.createDataFrame(rows, "post_key long, source string, title string, content string, fetched_at timestamp").write.parquet(f"{tmp_path}/web_posts.parquet")
    assert {x.post_key for x in llm.p5_found(spark, str(tmp_path)).collect()} == set(range(0, 400, 4))
