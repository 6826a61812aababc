import random
import re
import unicodedata
from types import SimpleNamespace

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from factloom.llm import overlap as O

A = "Once the venture arm Lumrill renewed a smart contract module, it was little surprise that inflation expectations cooled by 3.5% in May."
V = "So với kỳ trước, đợt chia tách cổ phiếu đã tăng 15,4% và nhà đầu tư nhỏ lẻ chuyển sang quan sát, theo Ulmgast."
N = "The board noted that the bridge operator Zanvanta upgraded its pricing model to spread currency risk across the desks."


@pytest.mark.parametrize(
    ("a", "b"),
    [
        (A, A.upper()), (A, A.replace(",", "").replace(".5", ",5")), (A, "Breaking: " + A), (A, A + " (spreading)"), (A, A.replace("surprise", "surprsie").replace("renewed", "renwed")),
        (A, A.replace("the venture", "venture").replace("little", "no")), (V, "So voi ky truoc, dot chia tach co phieu da tang 15,4% va nha dau tu nho le chuyen sang quan sat, theo Ulmgast."),
        (V, V.replace("đã", "vừa").replace("chuyển", "chuyểnn")), (A + "\n" + N, N + "\n" + A), (N, N.replace("Zanvanta", "Zanavnta")), (N, N.lower()),
    ],
)
def test_same(a, b):
    assert O.same_statements(a, b)


@pytest.mark.parametrize(("a", "b"), [(A, A.replace("3.5", "4.5")), (A, A.replace("Lumrill", "Lumzell")), (V, V.replace("15,4", "15,5")), (N, N.replace("Zanvanta", "Kelmora")), (A + "\n" + N, A), (A, N), (A, V), (N, N.replace("Zanvanta", "Yanvanta"))])
def test_not_same(a, b):
    assert not O.same_statements(a, b)


def test_pairs(spark):
    filler = [f"Report {i} on firm Kor{chr(97 + i % 26)}{chr(97 + i // 26)}na: the exchange listed {i * 7 + 100} new coins and its users paid {i * 3}.5% in fees last week." for i in range(120)]
    rows = [(i, "train", t, t) for i, t in enumerate(filler)]
    rows += [(200, "train", A, f"{A}|||{N}"), (201, "train", A, f"['{A}', '{N}']"), (202, "train", N, None), (203, "other", A, A), (204, "train", None, ""), (205, "train", V, V)]
    rows += [(300, "dev", "Breaking: " + A.lower(), f"{N}\n{A}"), (301, "test", A.replace("3.5", "9.5"), f"{A}|||{N.replace('Zanvanta', 'Kelmora')}"), (302, "test", N.replace("noted", "said"), " "), (303, "dev", None, None), (304, "dev", filler[7], "x"), (304, "dev", filler[7], "x")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "id bigint, split string, text string, evidence string, cls int, side int")
    got = sorted((r.field_name, r.eval_key, r.train_key) for r in O.overlaps(df, "id", "split", ["text", "evidence"]).distinct().collect())
    assert got == [("evidence", 300, 200), ("evidence", 300, 201), ("text", 300, 200), ("text", 300, 201), ("text", 302, 202), ("text", 304, 7)]
    rep = O.report(*O.class_overlaps(df.distinct(), "id", "split", ["text"]), df.selectExpr("id", "split", "cast(null as string) src").distinct(), "id", "split", "src").collect()
    assert {(r.split_name, r.n_overlapping, r.n_pairs) for r in rep} == {("dev", 2, 3), ("test", 1, 1)}


def _edited(r, words, slips, exchanged, blanks=0):
    out = list(words)
    places = r.sample([i for i, w in enumerate(out) if not w[0].isdigit()], slips + exchanged)
    for i in places[:slips]:
        at = r.randrange(len(out[i]))
        out[i] = out[i][:at] + r.choice("bcdfg") + out[i][at:]
    for i in places[slips:]:
        out[i] = "x" + "".join(r.choice("aeioulmn") for _ in range(5))
    return out


@pytest.mark.parametrize("figures", [True, False])
@pytest.mark.parametrize("vocabulary", [200, 4000])
def test_recall_by_strength_of_edits(spark, figures, vocabulary):
    """Of the edited copies the comparison accepts, at least nine in ten are found at every strength of edits."""
    r = random.Random(5)
    voc = ["".join(r.choice("bdghklmnrstv") + r.choice("aeiou") for _ in range(r.choice([2, 3]))) for _ in range(vocabulary)]
    rows, planted, n = [], {}, 0
    for slips, exchanged in [(1, 0), (2, 0), (3, 0), (5, 0), (7, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (2, 2), (3, 3)]:
        for _ in range(60):
            words = [r.choice(voc) for _ in range(14)] + ([str(r.randint(1000, 99999)), "5"] if figures else [])
            copy = " ".join(_edited(r, words, slips, exchanged))
            if figures and r.random() < 0.5:
                copy = copy.replace(" 5", "5") if r.random() < 0.5 else copy.replace(words[-2], words[-2][:-3] + "," + words[-2][-3:])
            rows += [(n, "train", " ".join(words)), (n + 1, "test", copy)]
            planted[n + 1, n] = (slips, exchanged), O.same_statements(copy, " ".join(words))
            n += 2
    df = spark.createDataFrame(rows, "id bigint, split string, text string")
    got = {(x.eval_key, x.train_key) for x in O.overlaps(df, "id", "split", ["text"]).collect()}
    for strength in {s for s, _ in planted.values()}:
        accepted = [p for p, (s, ok) in planted.items() if s == strength and ok]
        assert len(accepted) >= 20 and len(got.intersection(accepted)) >= 0.9 * len(accepted), strength
    texts = {k: t for k, _, t in rows}
    assert all(O.same_statements(texts[e], texts[t]) for e, t in got)


def test_spelling_of_a_class_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "BUCKET_ROWS", 2)
    other = N.replace("Zanvanta", "Kelmora")
    rows = [(1, "train", N), (2, "train", N.upper()), (3, "train", N.lower()), (10, "test", other), (None, "test", N)]
    rows += [(100 + i, "train", N.replace("noted", f"note{chr(97 + i)}")) for i in range(20)] + [(50, "test", N.replace("noted", "said"))]
    df = spark.createDataFrame(rows, "id bigint, split string, text string")
    got = {(x.eval_key, x.train_key) for x in O.overlaps(df, "id", "split", ["text"]).collect()}
    assert got == {(50, k) for k in [1, 2, 3, *range(100, 120)]}
    e, t = (spark.createDataFrame([(7, i, 4, 1, 0, 0, 0) for i in ids], "bucket bigint, cid bigint, n int, m0 bigint, m1 bigint, m2 bigint, m3 bigint") for ids in ([1, 2], range(10, 40)))
    assert {(x.ec, x.tc) for x in O.candidates(e, t, 4).collect()} == {(a, b) for a in (1, 2) for b in range(10, 40)}


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, split string, text string")
    assert O.overlaps(df, "id", "split", ["text"]).count() == 0
    one = spark.createDataFrame([(1, "train", "word"), (2, "test", "word"), (3, "test", "x" * 50_000), (4, "train", "x" * 50_000)], "id bigint, split string, text string")
    assert {(r.eval_key, r.train_key) for r in O.overlaps(one, "id", "split", ["text"]).collect()} == {(2, 1), (3, 4)}


def test_moves_neither_keys_nor_texts(spark, monkeypatch):
    """What is written stays within the texts' own size, whatever the chance candidates; blocks and joins give the same links."""
    r = random.Random(9)
    voc = ["".join(r.choice("bdghklmnrstv") + r.choice("aeiou") for _ in range(3)) for _ in range(40)]
    texts = ["The " + " ".join(r.choice(voc) for _ in range(14)) for _ in range(600)]
    rows = [(i, "train", t) for i, t in enumerate(texts)] + [(1_000 + i, "test", t.replace(" ", " so ", 1)) for i, t in enumerate(texts[:200])]
    df = spark.createDataFrame(rows, "id bigint, split string, text string")
    names = []
    monkeypatch.setattr(O, "materialize", lambda one, name, own=O.materialize: (names.append(name), own(one, name))[1])
    got = lambda: {(x.eval_key, x.train_key) for x in O.overlaps(df, "id", "split", ["text"]).collect()}
    whole = got()
    assert {(1_000 + i, i) for i in range(200)} <= whole and not {"candidates", "train_keys", "classes"} & set(names)
    monkeypatch.setattr(O, "BLOCK_CHARS", 10_000)
    monkeypatch.setattr(O, "STEP_PAIRS", 50)
    monkeypatch.setattr(O, "BROADCAST_CLASSES", 10)
    assert got() == whole and names.count("near") > 5
    monkeypatch.setattr(O, "MAX_BLOCKS", 0)
    assert got() == whole and "candidates" in names
    assert all(O._has_parties(x, y) for x, y in [("On Zanvanta so it", "on zanvnata"), ("On Zanvanta so it", "on zanvantas"), ("On Zanvanta so it", "zan vanta"), ("On Zanvanta so it", "xzanvantax")])
    assert not any(O._has_parties(x, y) for x, y in [("On Zanvanta so it", "on zanvinta"), ("On Zed so it", "on zd")])


def test_copies_need_no_more_passes_and_few_texts_are_looked_at(spark, monkeypatch):
    """Evaluation classes go out by their own size, not by that of their copies; chance candidates end at the bitmaps before any text is read."""
    r = random.Random(11)
    voc = ["".join(r.choice("bdghklmnrstv") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    texts = ["The " + " ".join(r.choice(voc) for _ in range(60)) for _ in range(400)]
    rows = [(10_000 * c + i, "train", t) for c in range(3) for i, t in enumerate(texts)] + [(10_000 * c + 1_000 + i, "test", t + " so") for c in range(3) for i, t in enumerate(texts[:100])]
    df = spark.createDataFrame(rows, "id bigint, split string, text string")
    monkeypatch.setattr(O, "BLOCK_CHARS", 90_000)  # the 100 classes have about 60,000 characters, their copies three times as many
    names, looked = [], []
    monkeypatch.setattr(O, "materialize", lambda one, name, own=O.materialize: (names.append(name), own(one, name))[1])
    got = {(x.eval_key, x.train_key) for x in O.overlaps(df, "id", "split", ["text"]).collect()}
    assert {(10_000 * c + 1_000 + i, 10_000 * d + i) for c in range(3) for d in range(3) for i in range(100)} <= got and names.count("near") == 1
    table = O.signed(O.records(df.where("id < 10000"), "id", "split", "text", "train", ["test"])).withColumn("cid", F.xxhash64("cls")).toArrow()
    side = {s: table.filter(pc.equal(table.column("side"), s)).combine_chunks() for s in "et"}
    lists = side["e"].column("buckets").combine_chunks()
    every, row = lists.flatten().to_numpy(), np.repeat(np.arange(100), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(every, kind="stable")
    monkeypatch.setattr(O._Text, "like", lambda self, other, own=O._Text.like: (looked.append(1), own(self, other))[1])
    found = sum(len(b) for b in O._streamed(SimpleNamespace(value=(side["e"].drop_columns("buckets"), every[order], row[order])))(iter(side["t"].to_batches())))
    assert found == 100 and len(looked) < 1_500


def test_reading_of_many_texts_at_once():
    """Classes, words, figures and capitals of a step of texts are those of each text alone, worked out statement by statement."""
    r = random.Random(8)
    pool = ["The Cat sat", "the cät SAT", "x 4.5 %", "X 4,5", "Đường İx", "duong ix", "á _ b", "中文 12", "«»q", "B Ca", "b ca", "ñ"]
    texts = ["\n".join(r.choices(pool, k=r.randint(1, 5))) for _ in range(300)]

    def canonical(s):
        low = "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("đ", "d")) if not unicodedata.combining(c))
        return " ".join(re.findall(r"[^\W_]+", low))

    cls, n, capitals, telling, figures, plain, text, words = O._read(texts)
    want = [{canonical(s) for s in t.split("\n")} for t in texts]
    for key, of in ((lambda i: tuple(cls[i]), lambda i: frozenset(want[i])), (lambda i: figures[i], lambda i: "".join(sorted(c for c in "".join(want[i]) if c.isdecimal())))):
        seen, back = {}, {}
        assert all(seen.setdefault(key(i), of(i)) == of(i) and back.setdefault(of(i), key(i)) == key(i) for i in range(300))
    assert n.tolist() == [sum(len(s.split()) for s in w) for w in want] and np.bincount(text).tolist() == [len(set(" ".join(w).split())) for w in want]
    assert capitals.tolist() == [len(re.findall(r"[ \n][A-ZĐ]", t)) for t in texts] and plain.tolist() == [not any(c.isdecimal() for c in t) for t in texts]
    assert telling.tolist() == [c > 0 and 2 * c <= t.count(" ") + t.count("\n") for c, t in zip(capitals.tolist(), texts, strict=True)]
