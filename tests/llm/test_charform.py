import unicodedata

import pytest
from pyspark.sql import functions as F

from factloom.llm import charform as C

SAME = [
    ("Việt Nam", unicodedata.normalize("NFD", "Việt Nam")), ("Viet Nam", "Ｖｉｅｔ　Ｎａｍ"), ("secure", "ѕесurе"), ("ab c", "a​b \n c "),
    ("office", "oﬃce"), ("Đà", "Ðà"), ("ó", "ό"), ("a-b", "a‑b"), ("cc", "ⅽⅽ"), ("soft", "so­ft"), ("ss", "ß"),
    ("house", "հօսѕе"), ("no", "ոօ"), ("vol", "ѵоӏ"), ("any", "αոү"), ("oy", "ᴏʏ"), ("AB", "ᎪᏴ"), ("ABLE", "ꓮꓐꓡꓰ"),
]
OTHER = [("a", "A"), ("hoà", "hòa"), ("đ", "d"), ("1", "l"), ("x2", "x²"), ("ab", "a b"), ("tiến", "tiền"), ("1/2", "½"), ("(1)", "①")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_look_alikes_become_equal(a, b):
    assert C.visual_form(a) == C.visual_form(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_different_texts_stay_different(a, b):
    assert C.visual_form(a) != C.visual_form(b)


def test_folding_is_one_for_columns_and_texts(spark):
    texts = ["ΟΔΟΣ", "οδος", "οδοσ", "Straße", "STRASSE", "İstanbul", "Ｔôi", "TÔI", "ĐÀ", "plain Text", "ﬃ", "Ꭺ", "ꭺ", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.t: r.f for r in df.select("t", C.folded_column(F.col("t")).alias("f")).collect()}
    assert all(f == (None if t is None else C.folded(t)) for t, f in got.items())
    assert got["ΟΔΟΣ"] == got["οδος"] == got["οδοσ"] and got["Straße"] == got["STRASSE"] and got["Ｔôi"] == got["TÔI"]


def test_form_is_stable():
    for pair in SAME + OTHER:
        for t in pair:
            assert C.visual_form(C.visual_form(t)) == C.visual_form(t)


def test_column_equals_function(spark):
    texts = [t for p in SAME + OTHER for t in p] + ["", " ", "a\n\n b\t c\r\n", "a\x0b\x1cb\x1f",  "x" * 200_000, "😀 中文", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", C.form_column(F.col("t")).alias("f"), C.form_column(F.col("t"), True).alias("k")).collect():
        assert r.f == (None if r.t is None else C.visual_form(r.t))
        assert r.t is None or r.k.count("\n") == r.t.count("\n")


def _brute(rows):
    out = set()
    for i, (ka, ta) in enumerate(rows):
        for kb, tb in rows[i + 1 :]:
            if None not in (ka, kb, ta, tb) and ta and tb and ka != kb and ta != tb and C.visual_form(ta) and C.visual_form(ta) == C.visual_form(tb):
                out.add((min(ka, kb), max(ka, kb)))
    return out


def test_pairs_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([t for p in SAME + OTHER for t in p] * 2 + [None, "", " ", "​"])] + [(500 + i, "hot") for i in range(60)] + [(900, "ｈｏｔ"), (901, "h​ot"), (None, "HOT"), (900, "ｈｏｔ")]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "k bigint, body string, form string, raw string")
    got = [(r.key_a, r.key_b) for r in C.look_alike_pairs(C.with_forms(df, "k", "body", "web_post")).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k bigint, body string")
    assert C.look_alike_pairs(C.with_forms(df, "k", "body", "x")).count() == 0
