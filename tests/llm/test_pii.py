import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

from factloom.llm import pii, pii_train

sys.path.insert(0, str(Path(__file__).resolve().parent))
import pii_handmade  # noqa: E402

PLAIN = ["The price of Velmora moved by 3.5% and many orders stayed pending, block 904347248", "Cảm ơn ad nhiều, tổng 578.553.295 đồng, mã lệnh 860186136809", "theo dõi kênh @jormora_vn, ví 0x82e3330cf21d131ceb1e31f021310f1b8b70aa0a", "Sàn giao dịch Ostpex tại thành phố Lạc Giang sẽ nâng cấp máy chủ v8.15.7 ngày 20-10-2024"]


def test_held_out_accuracy():
    r = random.Random(7)
    tests = [pii_train.example(r.choice(PLAIN), r) for _ in range(300)]
    both = got_n = want_n = 0
    for (_, spans), found in zip(tests, pii.find([t for t, _ in tests]), strict=True):
        got, want = {k for *_, k in found}, {k for *_, k in spans}
        both, got_n, want_n = both + len(got & want), got_n + len(got), want_n + len(want)
    assert both / got_n > 0.95 and both / want_n > 0.95


def test_negatives_and_examples():
    assert pii.find(PLAIN) == [[], [], [], []]
    kinds = lambda t: sorted({k for *_, k in pii.find([t])[0]})
    assert kinds("liên hệ ａnh.tran@mail.example nhé, sđt 0912 345 678") == ["email", "phone"]
    assert kinds("số CCCD: 0463 7476 2843, tên mình là Nguyễn Văn Minh") == ["id_number", "person"]
    assert kinds("I live at 4B Old Mill Lane, Hartlow and work") == ["address"]


@pytest.mark.parametrize("name", ["SENTENCES", "FRESH"])
def test_handmade_sentences(name):
    """Exact spans in sentences no training has seen."""
    both = got_n = want_n = 0
    texts, spans = [], []
    for s in getattr(pii_handmade, name):
        text, own, at = "", set(), 0
        for m in re.finditer(r"\{(\w+)\|([^}]*)\}", s):
            text += s[at : m.start()]
            own.add((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        texts.append(text + s[at:])
        spans.append(own)
    for want, found in zip(spans, pii.find(texts), strict=True):
        both, got_n, want_n = both + len(want.intersection(found)), got_n + len(found), want_n + len(want)
    assert both >= 0.9 * got_n and both >= 0.9 * want_n


def test_numbers_by_their_shape():
    kinds = {"001302004567": "id_number", "508-22-7719": "id_number", "B1234567": "id_number", "123 456 789": "id_number", "0912345678": "phone", "+84 912 345 678": "phone", "0084912345678": "phone", "84912345678": "phone", "O912 345 678": "phone"}
    assert {t: pii.by_shape(t, "phone") for t in kinds} == {t: pii.by_shape(t, "id_number") for t in kinds} == kinds
    assert pii.by_shape("x@y.example", "email") == "email"


def test_redaction_leaves_the_rest_alone():
    raw = "Ｇọi\u00a0ngay  sđt\u200b 0912\u00a0345 678\u200b nhé!\r\ncafe\u0301 ½"
    assert list(pii._redact(pii.pd.Series([raw, None, ""]))) == ["Ｇọi\u00a0ngay  sđt\u200b [PHONE]\u200b nhé!\r\ncafe\u0301 ½", None, ""]
    for t in (raw, "e\u0301\u0323x  \t y", "ﬁ ß", "\u0301a", "", "\u1100\u1161"):
        at = pii.places(t)
        assert at is None or len(at) == len(pii.visual_form(t, True))


def test_windows_are_reconciled():
    long = " ".join(PLAIN * 30)
    at = len(long)
    text = f"{long} sđt 0912 345 678 {long}"
    assert [(text[a:b], k) for a, b, k in pii.find([text])[0]] == [("0912 345 678", "phone")] and at > 3 * pii.WINDOW


def test_viterbi_against_brute_force():
    import itertools

    g = np.random.default_rng(1)
    trans, start = g.standard_normal((pii.N_LABELS,) * 2).astype(np.float32), g.standard_normal(pii.N_LABELS).astype(np.float32)
    scores = [g.standard_normal((n, pii.N_LABELS)).astype(np.float32) for n in (3, 1, 0, 2)]
    for s, path in zip(scores, pii.viterbi(scores, trans, start), strict=True):
        cost = lambda p, s=s: start[p[0]] + sum(s[i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) if p else 0
        best = max((cost(p) for p in itertools.product(range(pii.N_LABELS), repeat=len(s))), default=0)
        assert abs(cost(tuple(path.tolist())) - best) < 1e-4


def test_gradient():
    texts = ["Has anyone tried it, block 904347248"]
    codes, y, mask = pii_train.dataset(texts, 4, 1)
    w = {k: v.astype(np.float64) for k, v in pii_train.initial(4).items()}
    _, grad = pii_train.loss_and_gradient(w, codes, y, mask)
    for k in w:
        at = tuple(np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape))
        losses = []
        for sign in (1, -1):
            moved = {a: b.copy() for a, b in w.items()}
            moved[k][at] += sign * 1e-5
            losses.append(pii_train.loss_and_gradient(moved, codes, y, mask)[0])
        assert abs((losses[0] - losses[1]) / 2e-5 - grad[k][at]) < 0.02 * max(1, abs(grad[k][at])), k


def test_training_learns():
    data = pii_train.dataset(PLAIN, 960, 1)
    losses: list[str] = []
    pii_train.fit(data, hidden=10, epochs=3, batch=48, rate=0.01, say=losses.append)
    first, last = (float(s.rsplit(" ", 1)[1]) for s in (losses[0], losses[-1]))
    assert last < 0.7 * first


def test_rows(spark):
    rows = [(1, "sđt 0912 345 678 nhé"), (2, None), (3, ""), (4, " "), (1, "sđt 0912 345 678 nhé"), (5, PLAIN[0]), (6, "x" * 30_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "k bigint, body string, t int")
    got = [(r.record_kind, r.record_key, r.pii_kind) for r in pii.with_kinds(df, "k", "body", "comment").collect()]
    assert got == [("comment", 1, "phone")] * 2
    red = {r.k: r.body for r in pii.redacted(df, "body").collect()}
    assert red[1] == "sđt [PHONE] nhé" and red[2] is None and red[3] == "" and red[5] == PLAIN[0]
    assert pii.with_kinds(df.limit(0), "k", "body", "c").count() == 0
