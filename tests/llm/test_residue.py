import random

from pyspark.sql import functions as F

from factloom.llm import boilerplate, residue


def _posts():
    r = random.Random(1)
    said = ["The board said that the price of the coin of {} rose by three million dollars before the long holiday this year.", "Nhóm phân tích cho biết phí rút tiền của {} đã tăng hai tỷ đồng và nhà đầu tư nhỏ lẻ chuyển sang quan sát."]
    odd = ["404 Not Found\n/a/{}.html\nnginx", "Access denied\nYour request was blocked by the site firewall. Reference: {}", "{{{{title}}}}\nDear {{{{name}}}}, the price is now ${{price}} ({})", "Please enable JavaScript to read this page {}.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit {}."]
    rows = []
    for i in range(400):
        site, kind = f"s{i % 7}", i % 10 == 0
        body = r.choice(odd).format(i) if kind else "\n".join(r.choice(said).format("".join(r.choices("abcdefghij", k=9))) for _ in range(r.randint(2, 6))) + ("\nUsers saw a 404 Not Found page for an hour." if i % 10 == 1 else "")
        rows.append((i, site, None if i % 50 == 0 else f"Title {i}", body + "\nShare this story", kind))
    return rows


def test_classifier_on_all_and_unseen_hosts(spark):
    rows = _posts()
    df = spark.createDataFrame([(*x[:4], 1) for x in rows] + [(900, None, None, None, 1), (901, None, "t", "", 1), (902, "s1", "t", "Prose goes on and on for the reader of this page. " * 8000, 1)], "id bigint, site string, title string, body string, left int")
    digests = boilerplate.digest_lines(df, "id", "site", "body", F.lit(None).cast("date"), keep=("title",), keep_lines=True)
    lines = boilerplate.frequent_lines(digests)
    own = residue.bodies(digests, lines)
    weak = residue.weak_label(own)
    model = residue.fit(weak)
    got = {r.doc_key: r.score for r in residue.score(own, model).collect()}
    assert sum((got[i] > 0) == kind for i, *_, kind in rows) / len(rows) > 0.97 and got[902] is not None and 900 not in got
    rep = {r.hosts: r for r in residue.validation(weak, residue.score(own, model)).collect()}
    assert rep["unseen"].positives > 0 and rep["unseen"].positives_found >= 0.9 * rep["unseen"].positives and rep["unseen"].negatives_found <= 0.05 * rep["unseen"].negatives


def test_without_positives(spark):
    df = spark.createDataFrame([(1, "s", "t", "a b c")], "id bigint, site string, title string, body string")
    for part in (df, df.limit(0)):
        digests = boilerplate.digest_lines(part, "id", "site", "body", F.lit(None).cast("date"), keep=("title",), keep_lines=True)
        own = residue.bodies(residue.sample(digests), boilerplate.frequent_lines(digests))
        assert residue.fit(residue.weak_label(own)) is None
        assert [r.score for r in residue.score(own, None).collect()] == [None] * part.count()
