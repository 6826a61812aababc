import re

from pyspark.sql import functions as F

from factloom.functions import clock, labels, text, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


def test_normalize_like_python(spark):
    for s in ["Xin  chào, Việt-Nam_1!", "ｅ́ Cà phê　½ 中文 😀", "", "A​B", "é"]:
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s.lower())).strip()
        if "½" not in s:
            assert one(spark, s, text.normalize) == want
    assert one(spark, None, text.normalize) is None


def test_text_scalars(spark):
    assert one(spark, "abcdef", lambda c: text.truncate(c, 4)) == "abc…"
    assert one(spark, "abcd", lambda c: text.truncate(c, 4)) == "abcd"
    assert one(spark, "Is this claim true", text.expand_query) == "Is this claim true statement assertion correct accurate"
    assert one(spark, "a 😀☀ b", text.strip_icons) == "a b"
    assert one(spark, "a/b: ?c!", text.safe_name) == "ab c"
    assert one(spark, "!!!", text.safe_name) == "unknown"
    assert one(spark, None, text.collapse_blank) == ""
    assert one(spark, "", lambda c: text.overlap_ratio(c, F.lit("x"))) == 0.0
    assert one(spark, "a b", lambda c: text.overlap_ratio(c, F.lit("b c"))) == 0.5
    assert one(spark, "x" * 1200, text.is_verbatim) is True
    assert one(spark, "<think>{1}</think> hi {\"claim\": {}} x", text.reply_json) == '{"claim": {}}'
    assert one(spark, "one two three four five", text.leak_free_claim) is True
    assert one(spark, "one two three four json", text.leak_free_claim) is False
    assert one(spark, "- one two three four five", text.leak_free_claim) is False
    assert one(spark, "Done..", text.strip_period) == "Done"
    assert one(spark, "Done", text.lower_first) == "done"
    assert text.field_boost("title^3") == ("title", 3.0) and text.field_boost("t^x") == ("t", 1.0)
    assert text.env_flag(" Yes ") and not text.env_flag("no") and text.env_flag(None, True)


def test_urls(spark):
    assert one(spark, "https://user@WWW.Site.vn:80/a/b.html?x#f", lambda c: urls.domain(urls.host(c))) == "site.vn"
    assert one(spark, "https://s.vn/a/b/", urls.slug) == "a_b"
    assert one(spark, "https://s.vn", urls.slug) == "post"
    assert one(spark, "https://s.vn/a#b", urls.without_fragment) == "https://s.vn/a"
    assert one(spark, "a.s.vn", lambda c: urls.same_domain(F.lit("www.s.vn"), c)) is True
    assert one(spark, "as.vn", lambda c: urls.same_domain(F.lit("s.vn"), c)) is False
    assert one(spark, "https://s.vn/tin/2024/abc.html", lambda c: urls.article_score(c, F.lit("t" * 20))) == 7
    assert one(spark, "https://s.vn/a.pdf", lambda c: urls.article_score(c, F.lit("t" * 20))) == 0
    assert one(spark, "https://s.vn/", lambda c: urls.article_score(c, F.lit(None).cast("string"))) == 0
    assert one(spark, "https://www.s.vn/a", urls.variants) == ["https://www.s.vn/a", "https://s.vn/a"]
    assert [one(spark, h, urls.skip_href) for h in ("", "mailto:a", "#x", "/a")] == [True, True, True, False]
    assert one(spark, "https://x/profile.php?id=12", urls.user_id) == "12"
    assert one(spark, "no url here", urls.display_host) == "no url here..."


def test_labels(spark):
    def ids(v):
        return [one(spark, v, lambda c, p=p: labels.label_id(c, p)) for p in ("loader", "fusion", "tuned")]

    assert ids(" đúng ") == [0, 0, 0] and ids("FAKE") == [2, 1, 2] and ids("0.7") == [2, 0, 0]
    assert ids("1.0") == [1, 1, 1] and ids("B") == [2, None, 1] and ids(None) == [2, None, 2]


def test_clock(spark):
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")

    def seconds(v):
        return one(spark, v, lambda c: F.unix_seconds(clock.lenient(c, as_of)))

    assert seconds("2024-01-02T03:04:05Z") == 1704164645
    assert seconds("20240102") == 1704153600
    assert seconds("1704164645") == 1704164645
    assert seconds("2024-01-02T03:04+07:00") == 1704139440
    for v in (None, "", "garbage", "2024-1-2", "2024-01"):
        assert seconds(v) == 1893456000
    assert str(one(spark, "đăng 25/06/2024", clock.element_date)) == "2024-06-25"
    assert str(one(spark, "05/06/2024", clock.element_date)) == "2024-05-06"
    assert str(one(spark, "5 tháng 6 năm 2024", clock.element_date)) == "2024-06-01"
    assert one(spark, "31/31/2024", clock.element_date) is None
