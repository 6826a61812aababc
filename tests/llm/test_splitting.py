import random

import pytest

from factloom.llm import splitting as S


def _check(text, most, overlap):
    ends = S.cut_positions(text, most, overlap)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    starts = [0, *[e - overlap for e in ends[:-1]]]
    pieces = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    assert all(len(p) <= most for p in pieces)
    assert pieces[0] + "".join(p[overlap:] for p in pieces[1:]) == text
    assert all(a[-overlap:] == b[:overlap] for a, b in zip(pieces, pieces[1:], strict=False)) or not overlap
    return pieces


def test_round_trip():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["word ", "Sentence end. ", "x" * r.randint(1, 60), "\n", "\n\n", "|||", ", ", "é́", "😀"]) for _ in range(r.randint(1, 120)))
        most = r.randint(20, 200)
        _check(text, most, r.randint(0, most // 3))


def test_natural_boundaries():
    paras = [" ".join(["Some words of a sentence."] * 3) for _ in range(8)]
    pieces = _check("\n\n".join(paras), 200, 20)
    assert all(p.endswith("\n\n") for p in pieces[:-1])


def test_no_boundary_at_all():
    assert [len(p) for p in _check("x" * 1000, 100, 10)][:2] == [90, 100]
    with pytest.raises(ValueError):
        S.cut_positions("x" * 10, 5, 5)


def test_rows(spark):
    rows = [(1, "a" * 100), (2, "b" * 101), (3, None), (4, ""), (5, "c. " * 60_000), (2, "b" * 101)]
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], "k bigint, body string, t int, ends int")
    out = S.split_long(df, "k", "body", 100, 10, "x").collect()
    assert {r.record_key for r in out} == {2, 5} and all(len(r.piece) <= 100 for r in out)
    assert sum(r.record_key == 2 for r in out) == 4
    five = sorted((r for r in out if r.record_key == 5), key=lambda r: r.piece_no)
    assert five[0].piece + "".join(r.piece[10:] for r in five[1:]) == "c. " * 60_000
    assert S.split_long(df.limit(0), "k", "body", 100, 10, "x").count() == 0
