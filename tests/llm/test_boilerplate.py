from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factloom.llm import boilerplate as B
from factloom.llm.charform import folded


def _key(line):
    import re

    return re.sub(r"[0-9]+(?:[.,][0-9]+)*", "#", folded(line)).strip()


def _posts():
    rows, k = [], 0
    for s, n in (("a", 60), ("b", 12), ("c", 3)):
        for i in range(n):
            lines = [f"Paragraph {s}{chr(97 + i % 26)}{chr(97 + i // 26)} tells something long enough to be prose, as articles do."]
            lines += [["Share this", "SHARE  THIS", "Ｓｈａｒｅ this\r", "Sha​re this "][i % 4]] if i % 3 else []
            lines += [f"Read in {i} min"] if i % 10 == 0 else []
            lines += ["", "Rare line"] if s == "a" and i in (1, 2, 3) else []
            rows.append((k, s, "\n".join(lines), i % 5))
            k += 1
    article = "One republished article, whose line is long enough to be taken for prose by the operator.\nOdd furniture {}"
    rows += [(k + i, "a", article.format(i), i % 5) for i in range(6)]
    rows += [(900, None, "Share this", 0), (901, "b", None, 0), (902, "b", "", 0), (903, "d", "x" * 300_000, 0)]
    return rows


def _df(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in _posts()], "id bigint, site string, body string, day int, k string, src string")
    return df


def test_occurrences_against_brute_force(spark):
    df = _df(spark)
    digests = B.digest_lines(df, "id", "site", "body", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    got = sorted((r.doc_key, r.line_no) for r in B.occurrences(digests, B.frequent_lines(digests)).collect())
    counts, totals = defaultdict(Counter), Counter()
    for _, s, t, _ in _posts():
        if s is not None and t is not None:
            totals[s] += 1
            counts[s].update({_key(x) for x in t.split("\n")} - {""})
    want = sorted((k, n) for k, s, t, _ in _posts() if s and t for n, x in enumerate(t.split("\n")) if _key(x) and counts[s][_key(x)] >= max(4, 0.05 * totals[s]))
    assert got == want


def test_republished_article_is_no_boilerplate(spark):
    df = _df(spark)
    digests = B.digest_lines(df, "id", "site", "body", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    clean = {r.id: r for r in B.strip_lines(df, "id", "body", digests, B.boilerplate(digests)).collect()}
    by_id = {k: t for k, _, t, _ in _posts()}
    assert len(clean) == len(by_id)
    first = min(k for k, _, t, _ in _posts() if t and "republished" in t)
    assert "republished" in clean[first].body  # six copies are one cluster
    assert all("share" not in (folded(r.body) if r.body else "") for r in clean.values() if r.site in ("a", "b"))
    assert clean[900].body == "Share this" and clean[901].body is None and clean[902].body == "" and clean[903].body == by_id[903]
    untouched = [k for k, r in clean.items() if r.n_removed == 0]
    assert all(clean[k].body == by_id[k] for k in untouched) and clean[900].k == "clash"


def test_shares_are_over_clusters_and_furniture_makes_none(spark):
    """Reposts above a twentieth of the rows stay; a long notice on some copies does not part them."""
    own = [f"Article {chr(97 + i % 26)}{chr(97 + i // 26)} has a paragraph of its own that is long enough to be taken for prose." for i in range(80)]
    notice = "All rights reserved; no part of these pages may be copied without the consent of the publisher."
    story = "A story told again and again, by one site, in a paragraph that is long enough to be taken for prose."
    rows = [(i, "a", own[i] + ("\n" + notice if i % 3 else ""), i % 7) for i in range(80)]
    rows += [(100 + i, "a", story + ("\n" + notice if i % 2 else ""), i % 7) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, site string, body string, day int")
    digests = B.digest_lines(df, "id", "site", "body", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    stats = {r.n_rows: r for r in B.line_statistics(digests).collect()}
    told, legal = stats[20], stats[sum(notice in t for _, _, t, _ in rows)]
    assert (told.n_clusters, told.src_clusters, told.src_rows, told.n_days) == (1, 81, 100, 7)
    assert legal.n_clusters == sum(i % 3 > 0 for i in range(80)) + 1
    clean = {r.id: r.body for r in B.strip_lines(df, "id", "body", digests, B.boilerplate(digests)).collect()}
    assert all(notice not in t for t in clean.values()) and all(clean[100 + i] == story for i in range(20)) and clean[0] == own[0]


def test_empty(spark):
    df = _df(spark).limit(0)
    digests = B.digest_lines(df, "id", "site", "body", F.lit(None).cast("date"))
    assert B.occurrences(digests, B.frequent_lines(digests)).count() == 0
    assert B.strip_lines(df, "id", "body", digests, B.boilerplate(digests)).count() == 0
