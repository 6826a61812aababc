import random

import numpy as np

from factloom.llm import leakage as L


def _brute(doc, item, min_words=40, spacing=5):
    """Longest stretch on any diagonal, by trying every start."""
    best = 0
    for shift in range(-len(doc), len(item)):
        lo, hi = max(0, -shift), min(len(doc), len(item) - shift)
        for a in range(lo, hi):
            if doc[a] != item[a + shift]:
                continue
            last = None
            for b in range(a, hi):
                if doc[b] == item[b + shift]:
                    best = max(best, b - a + 1)
                elif last is not None and b - last <= spacing:
                    break
                else:
                    last = b
    return best if best >= min_words else 0


def test_maximal_stretches_against_brute_force():
    r = random.Random(1)
    for _ in range(400):
        same = np.array([r.random() < r.choice([0.5, 0.8, 0.95]) for _ in range(r.randint(1, 40))])
        doc = [0 if x else 1 for x in same]
        want = 0
        for a in range(len(doc)):
            last = None
            for b in range(a, len(doc)):
                if doc[a]:
                    break
                if not doc[b]:
                    want = max(want, b - a + 1)
                elif last is not None and b - last <= 5:
                    break
                else:
                    last = b
        assert max((n for _, n in L.maximal_stretches(same, 5)), default=0) == want, same


def test_spans_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    items = [[r.choice(words) for _ in range(r.randint(45, 60))] for _ in range(8)]
    items.append(items[0][:50])
    docs = []
    for _ in range(120):
        item = r.choice(items)
        n = r.randint(30, len(item))
        a = r.randint(0, len(item) - n)
        part = list(item[a : a + n])
        for at in range(r.randint(0, 5), n, r.choice([6, 7, 4, 50])):
            part[at] = "exchanged"
        docs.append(r.choices(words, k=r.randint(0, 30)) + part + r.choices(words, k=r.randint(0, 30)))
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (902, "x " * 50_000)]
    d = spark.createDataFrame([(*x, 1) for x in rows], "id bigint, text string, w int").repartition(3)
    q = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, "")], "item bigint, body string")
    got = {}
    for x in L.leak_spans(d, "id", "text", q, "item", "body").collect():
        got[x.doc_id, x.item_id] = max(x.n_words, got.get((x.doc_id, x.item_id), 0))
    want = {(i, j): n for i, x in enumerate(docs) for j, y in enumerate(items) if (n := _brute(x, y))}
    assert got == want and want


def test_dress_does_not_matter(spark):
    item = " ".join(f"word{i}," for i in range(45))
    doc = "Intro\n<b>" + item.upper().replace(" ", "</b> <b>", 20).replace("WORD3,", "“ＷＯＲＤ３”").replace(" WORD30", "\n\nW​ORD30") + "</b> – outro"
    d = spark.createDataFrame([(1, doc), (1, doc)], "id bigint, text string")
    q = spark.createDataFrame([(7, item)], "item bigint, body string")
    spans = L.leak_spans(d, "id", "text", q, "item", "body").distinct()
    assert [(r.n_words, r.coverage) for r in spans.collect()] == [(45, 1.0)]
    assert {r.text for r in L.remove_spans(d, "id", "text", spans).collect()} == {"Intro\n<b></b> – outro"}


def _spans(spark, docs, items, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "id bigint, text string")
    q = spark.createDataFrame(list(enumerate(items)), "item bigint, body string")
    spans = L.leak_spans(d, "id", "text", q, "item", "body", **how)
    clean = {r.id: r.text for r in L.remove_spans(d, "id", "text", spans).collect()}
    return sorted(spans.collect()), [clean[i] for i in range(len(docs))]


def test_every_copy_and_short_items_are_cut_and_nothing_else(spark):
    item = " ".join(f"word{i}" for i in range(45))
    short = " ".join(f"brief{i}" for i in range(30))
    docs = [
        f"Head,\n\n{item}\nBetween  them.\n{item}\tTail…",  # twice
        f"x<B>y</B> … {item.title()} <I>z</I>\r\nrest",  # tags and other words' dress stay
        f"A B {short} C", f"A {' '.join(short.split()[:14])} C", f"A {' '.join(short.split()[:15])} C",  # half of a short item
        f"ＡＢ <P>{item}</P>\u200b Ｃ", "",
    ]
    spans, clean = _spans(spark, docs, [item, short], min_coverage=0.5)
    assert [(s.doc_id, s.item_id, s.n_words) for s in spans] == [(0, 0, 45), (0, 0, 45), (1, 0, 45), (2, 1, 30), (4, 1, 15), (5, 0, 45)]
    assert clean == ["Head,\n\n\nBetween  them.\n\tTail…", "x<B>y</B> …  <I>z</I>\r\nrest", "A B  C", docs[3], "A  C", "ＡＢ <P></P>\u200b Ｃ", ""]
    again, _ = _spans(spark, clean, [item, short], min_coverage=0.5)
    assert again == []
    assert [(s.doc_id, s.item_id) for s in _spans(spark, docs, [item, short])[0]] == [(0, 0), (0, 0), (1, 0), (5, 0)]


def test_places_are_those_of_the_words(spark):
    """The words at the places of a text have the digests of the text's words."""
    r = random.Random(4)
    parts = ["<b>", "</b>", "<p>", "</P >", "<br/>", " ", "\n", "\u00a0", "\u200b", "Ａｂ", "e\u0301", "İx", "½", "ﬁn", "«", "—", "!!", "a<b", "5.000", "<i class=x>", "ß", "đ", "\u0301", "字", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    whole = {x.id: list(x.w) for x in L.word_digests(df, "id", "text").collect()}
    bare = [(i, "".join(c for c in texts[i][a:b])) for i in range(len(texts)) for a, b in L.word_places(texts[i])]
    counts = {i: 0 for i in whole}
    for i, _ in bare:
        counts[i] += 1
    assert counts == {i: len(w) for i, w in whole.items()}


def test_empty(spark):
    d, q = spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([(1, "a b")], "item bigint, body string")
    assert L.leak_spans(d, "id", "text", q, "item", "body").count() == 0
    assert L.leak_spans(q.selectExpr("item id", "repeat('a b ', 50) text"), "id", "text", q.limit(0), "item", "body").count() == 0
