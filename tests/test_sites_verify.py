import datetime

from pyspark.sql import functions as F

from factloom.operators import html, models
from factloom.plans.verify import predictions


def test_section_links_and_fallback(spark):
    good = "<section>" + "".join(f"<a href='/tin/2024/{i}.html'>Headline number {i}</a>" for i in range(16)) + "<a href='https://other.vn/tin/2024/x.html'>Headline elsewhere</a><a href='/tin/2024/1.html'>again again</a></section><a href='/news/2024/menu.html'>Menu headline</a>"
    few = "<a href='/x'>A title that is long enough</a><a href='/y'>short one</a><a href='/about'>A title that is blocked</a><a href='/a.pdf'>A title of a file here</a>"
    df = spark.createDataFrame([(good, "https://www.s.vn/muc"), (few, "https://s.vn"), (None, "https://s.vn"), ("", None)], "h string, b string")
    got = {}
    for r in html.articles_of_section(df, "h", "b").collect():
        got.setdefault(r.source_url, []).append(r.article_url)
    assert len(got["https://www.s.vn/muc"]) == 16 and got["https://s.vn"] == ["https://s.vn/x"]


def test_site_pages(spark):
    body = "Nội dung bài viết " * 10
    page = f"<html><head><meta property='og:title' content=' OG '></head><body><div class='post-meta'><span class='date'>05/06/2024</span></div><div class='post-content'><script>x</script>{body}<img src='/a.png'><img data-src='/a.png'><img src='data:x'></div></body></html>"
    timed = f"<title>T</title><time datetime='2024-01-02T03:04:05'>x</time><main>{body}</main>"
    alone = f"<h1>H</h1><article>{body}<p>25/06/2024</p></article>"
    df = spark.createDataFrame([(i, p, "https://s.vn/b") for i, p in enumerate([page, timed, alone, "<p>short</p>", None, f"<body>{body} 7 tháng 8 năm 2023</body>"])], "i int, h string, u string")
    a = [r.a for r in df.select("i", html.site(F.col("h"), F.col("u")).alias("a")).orderBy("i").collect()]
    assert (a[0].title, a[0].date, a[0].images) == ("OG", datetime.date(2024, 5, 6), ["https://s.vn/a.png"]) and a[0].content.startswith("Nội dung") and "x" not in a[0].content
    assert (a[1].title, a[1].date) == ("T", datetime.date(2024, 1, 2)) and (a[2].title, a[2].date) == ("H", datetime.date(2024, 6, 25))
    assert a[3].content is None and a[4].content is None and (a[5].title, a[5].date) == ("https://s.vn/b", datetime.date(2023, 8, 1))
    root = html.parse("<h2><a href='/1'>a</a></h2><div class='item'><a href='https://s.vn/2'>b</a><a href='https://www.s.vn/3'>c</a></div><h3><a href='#x'>d</a><a href='/1'>e</a></h3>")
    assert html.site_links(root, "https://s.vn/") == ["https://s.vn/2", "https://s.vn/1"]


def test_verdicts_match_by_key(spark):
    claims = spark.createDataFrame([(1, "the price rose"), (2, " "), (3, None), (4, "no evidence for this")], "k bigint, c string")
    ranked = spark.createDataFrame([(1, 10, 1, 0.9, 0.1, 0.5, 0.5), (1, 11, 2, 0.8, 0.1, 0.5, 0.5), (2, 10, 1, 0.9, 0.1, 0.5, 0.5)], "query_id bigint, doc_id bigint, final_rank int, score double, rrf_score double, recency_score double, cyclicity_score double")
    docs = spark.createDataFrame([(10, "the price rose today", "u"), (11, " ", "u")], "doc_id bigint, text string, link string")
    got = {r.k: r for r in predictions(claims, "k", "c", ranked, docs, models.lexical_scorer, models.SlotNetwork(2)).collect()}
    assert len(got) == 4 and got[1].verdict == "Đúng" and got[1].evidence == ["the price rose today"] and got[1].source_links == ["u"] and 0 < got[1].confidence <= 1
    assert got[2].verdict is None and got[3].verdict is None and got[3].confidence is None and got[4].verdict == "Chưa chắc chắn" and got[4].evidence == []
