"""Evaluation passages inside corpus documents (problem 8).

The test items, a small fixed table, become one generalised suffix automaton over word digests, built
once per Python worker. Documents are streamed through it as arrays of digests: the longest matching
length at each word gives the maximal matches, and each match is placed on its diagonal (item word
number minus document word number). Along a diagonal single exchanged words are bridged if they
stand more than ``spacing`` words apart. A document contains an item's passage if a stretch of at
least ``min_words`` words results.

Words that belong to no run of ``spacing`` words of any item cannot be matched words of such a
stretch, and at most one of them may stand between two matched runs. Stretches that are too short
under that rule are left out before streaming, by array arithmetic on a whole batch; this loses nothing.

With ``min_coverage`` an item shorter than the length limit counts as well, by its share. Every maximal stretch comes
out, so an item that stands twice in a document gives two rows. Stretches carry the places of their first and last
character in the document as it is, and ``remove_spans`` cuts just these.

Words are split at blanks, after mark-up tags are removed, in the folded visual form without
punctuation; a word without letters and figures is none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.charform import folded_column, visual_pieces
from factloom.llm.patterns import WORD_CHARS

# Tags within words, and any tag.
INLINE_TAGS = "</?(?:b|i|u|em|strong|span|mark|a|code|sup|sub|small)(?: [^<>]*)?>"
TAGS = "</?[a-z][a-z0-9]*(?: [^<>]*)?/?>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_digests(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, w and the columns of ``keep``): digests of the words of a text; null for null, an empty array for a text without words."""
    form = df.select(key, *keep, folded_column(F.col(text)).alias("_f"))  # a column of its own, so that it is computed once
    bare = F.regexp_replace(F.regexp_replace("_f", INLINE_TAGS, ""), TAGS, " ")
    plain = F.regexp_replace(F.when(F.contains(F.col("_f"), F.lit("<")), bare).otherwise(F.col("_f")), f"[^ {WORD_CHARS}]+", "")
    return form.select(key, F.array_remove(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))).alias("w"), *keep)


_TAG = re.compile(f"(?P<inline>{INLINE_TAGS})|{TAGS}")


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word of ``word_digests`` in the text as it is, ``end`` exclusive.

    A word reaches to the blanks around it, with its punctuation and the tags within it.
    """
    pieces, source = [], []
    for at, piece in enumerate(visual_pieces(text)):
        folded = piece.casefold()
        pieces.append(folded)
        source.extend([at] * len(folded))
    form = "".join(pieces)
    gone = [(m.start(), m.end(), m["inline"] is not None) for m in _TAG.finditer(form)] if "<" in form else []
    out, first, last, real, tag = [], None, 0, False, 0
    at = 0
    while at <= len(form):
        inline = False
        if tag < len(gone) and at == gone[tag][0]:
            inline, step = gone[tag][2], gone[tag][1] - at
            tag += 1
            if inline:
                at += step
                continue
            blank = True
        else:
            step = 1
            blank = at == len(form) or form[at].isspace()
        if blank:
            if first is not None and real:
                out.append((source[first], source[last] + 1))
            first, real = None, False
        else:
            first = at if first is None else first
            last, real = at, real or unicodedata.category(form[at])[0] in "LNM"
        at += step
    return out


class Automaton:
    """Generalised suffix automaton over the words of several items."""

    def __init__(self, items: Iterable[tuple[int, np.ndarray]], spacing: int = 5):
        self.items = [(i, np.asarray(w, dtype=np.int64)) for i, w in items]
        self.spacing = spacing
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], [[]]
        for n, (_, words) in enumerate(self.items):
            last = 0
            for at, w in enumerate(words.tolist()):
                last = self._extend(last, w)
                if last == len(own):
                    own.append([])
                while len(own) < len(self.next):
                    own.append([])
                own[last].append((n, at))
        ends: list[list[tuple[int, int]]] = [list(x) for x in own] + [[] for _ in range(len(self.next) - len(own))]
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= spacing:
                ends[self.link[state]].extend(ends[state])
        self.ends = ends
        grams = [g for _, w in self.items for g in self.grams(w).tolist()]
        self.known = np.unique(np.array(grams, dtype=np.uint64))

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, q, word)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _state(self, follow: dict[int, int], length: int, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def grams(self, words: np.ndarray) -> np.ndarray:
        """A digest of each run of ``spacing`` words."""
        n = len(words) - self.spacing + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        w = words.astype(np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.spacing):
            out = (out + w[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches of at least ``spacing`` words, ``end`` exclusive."""
        follow, link, length, least = self.next, self.link, self.length, self.spacing
        state = size = 0
        for at, w in enumerate(words):
            if w in follow[state]:
                state = follow[state][w]
                size += 1
                continue
            if size >= least:
                yield at, size, state
            while state > 0 and w not in follow[state]:
                state = link[state]
            size = length[state]
            if w in follow[state]:
                state = follow[state][w]
                size += 1
        if size >= least:
            yield len(words), size, state

    def stretches(self, words: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, doc word, item word, words): the maximal stretches of each item with at least ``least`` words.

        A stretch within another one of the same item is left out.
        """
        diagonals: set[tuple[int, int]] = set()
        for end, size, state in self.matches(words.tolist()):
            while state > 0 and size >= self.spacing:
                diagonals.update((n, at + 1 - end) for n, at in self.ends[state])
                state = self.link[state]
                size = self.length[state]
        found: dict[int, set[tuple[int, int, int]]] = {}
        for n, shift in diagonals:
            item = self.items[n][1]
            lo, hi = max(0, -shift), min(len(words), len(item) - shift)
            if hi - lo < least[n]:
                continue
            for start, size in maximal_stretches(words[lo:hi] == item[lo + shift : hi + shift], self.spacing):
                if size >= least[n]:
                    found.setdefault(n, set()).add((lo + start, size, lo + start + shift))
        return [(n, at, i, size) for n in sorted(found) for at, size, i in _outermost(found[n])]


def _outermost(stretches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches (start, words, item word) that lie in no other one, in order."""
    out, reach = [], -1
    for s in sorted(stretches, key=lambda x: (x[0], -x[1], x[2])):
        if s[0] + s[1] > reach:
            out.append(s)
            reach = s[0] + s[1]
    return out


def maximal_stretches(same: np.ndarray, spacing: int) -> list[tuple[int, int]]:
    """(start, words) of the stretches that begin and end with an equal word, whose unequal words stand more than
    ``spacing`` words apart, and that cannot be widened.
    """
    bad = np.flatnonzero(~same)
    edges = [-1, *bad.tolist(), len(same)]
    out, first = [], 0
    for k in range(1, len(edges)):
        # a stretch that begins after the unequal word ``first`` ends before the unequal word k, if that one may not be bridged
        if k < len(edges) - 1 and (k == first + 1 or edges[k] - edges[k - 1] > spacing):
            continue
        # before the end of the text, the last bridge may be the edge itself
        start, end = edges[first] + 1, edges[k] - 1
        while start <= end and not same[start]:
            start += 1
        while end >= start and not same[end]:
            end -= 1
        if end >= start:
            out.append((start, end - start + 1))
        first = k - 1
    return out


def islands(covered: np.ndarray, firsts: np.ndarray, min_words: int, spacing: int) -> list[tuple[int, int]]:
    """Stretches of a batch in which uncovered words stand alone, cut at the documents' first words.

    At either end of a matching stretch an exchanged word and fewer than ``spacing`` words may be uncovered, so
    islands count from ``min_words`` less twice that and come out widened by it, within their document.
    """
    breaks = ~covered
    # an uncovered word next to another one, or at a document's edge, ends a stretch
    alone = breaks.copy()
    alone[1:] &= covered[:-1]
    alone[:-1] &= covered[1:]
    solid = covered | alone
    cut = np.zeros(len(covered) + 1, dtype=bool)
    cut[firsts] = True
    state = np.concatenate(([0], solid.astype(np.int8), [0]))
    change = np.diff(state)
    starts, ends = change[:-1] == 1, change[1:] == -1
    starts[cut[:-1] & solid] = True
    ends[np.concatenate((cut[1:-1], [True])) & solid] = True
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    keep = b - a >= max(spacing, min_words - 2 * spacing)
    a, b = a[keep], b[keep]
    edges = np.append(firsts, len(covered))
    doc = np.searchsorted(firsts, a, side="right") - 1
    a, b = np.maximum(a - spacing, edges[doc]), np.minimum(b + spacing, edges[doc + 1])
    wide = b - a >= min_words
    return list(zip(a[wide].tolist(), b[wide].tolist(), strict=True))


_built: dict[tuple, Automaton] = {}


def leak_spans(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
               min_words: int = 40, spacing: int = 5, min_coverage: float | None = None, max_item_words: int = 4_000_000,
               places: bool = True) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, coverage, first_char, end_char): the maximal stretches of each item in each document.

    A stretch has at least ``min_words`` words or, with ``min_coverage``, that share of its item's words; in either case at least
    ``spacing``. ``items`` is a fixed test set; it is read on the driver, where ``max_item_words`` bounds it, and broadcast. Null or
    short texts match nothing. Without ``places`` the texts are not read a second time, and the characters are null. ``coverage`` is the stretch's share of the item's words; ``end_char`` is exclusive.
    """
    lengths = items.where(F.col(item_text).isNotNull()).select(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    if lengths > 8 * max_item_words:
        raise ValueError(f"leak_spans takes test items of about {max_item_words} words; use several calls")
    passages = [(r[0], tuple(r[1])) for r in word_digests(items.where(F.col(item_text).isNotNull()), item_key, item_text).collect()]
    stamp = (hash(tuple(passages)), min_words, spacing, min_coverage)
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _built:
            _built.clear()
            _built[stamp] = Automaton([(i, np.array(w, dtype=np.int64)) for i, w in shared.value], spacing)
        auto = _built[stamp]
        filters = np.zeros(1 << 20, dtype=bool)
        filters[(auto.known >> np.uint64(44)).astype(np.int64)] = True
        sizes = np.array([len(w) for _, w in auto.items], dtype=np.int64)
        least = np.full(len(sizes), min_words)
        if min_coverage is not None:
            least = np.minimum(least, np.ceil(min_coverage * sizes).astype(np.int64))
        least = np.maximum(least, spacing)
        for batch in batches:
            ids, lists, texts = batch.column(0), batch.column(1), batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            words = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            offsets -= offsets[0]
            out: list[tuple] = []
            if len(words) >= spacing and len(auto.known):
                grams = auto.grams(words)
                hit = np.flatnonzero(filters[(grams >> np.uint64(44)).astype(np.int64)])
                at = np.searchsorted(auto.known, grams[hit])
                at[at == len(auto.known)] = 0
                hit = hit[auto.known[at] == grams[hit]]
                # a run that reaches into the next document is none
                doc = np.searchsorted(offsets, hit, side="right") - 1
                hit = hit[hit + spacing <= offsets[doc + 1]]
                mark = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(mark, hit, 1)
                np.add.at(mark, hit + spacing, -1)
                covered = np.cumsum(mark[:-1]) > 0
                found: dict[tuple[int, int], set] = {}
                for a, b in islands(covered, np.unique(offsets[:-1][np.diff(offsets) > 0]), int(least.min()), spacing):
                    d = int(np.searchsorted(offsets, a, side="right") - 1)
                    for n, dw, iw, size in auto.stretches(words[a:b], least):
                        found.setdefault((d, n), set()).add((int(a - offsets[d]) + dw, size, iw))
                spots = {d: word_places(texts[d].as_py()) for d in {d for d, _ in found} if texts[d].is_valid}
                for (d, n), stretches in found.items():
                    for dw, size, iw in _outermost(stretches):
                        chars = (spots[d][dw][0], spots[d][dw + size - 1][1]) if d in spots else (None, None)
                        out.append((ids[d].as_py(), auto.items[n][0], dw, iw, size, size / int(sizes[n]), *chars))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                names = ["doc_id", "item_id", "doc_word", "item_word", "n_words", "coverage", "first_char", "end_char"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    # no filter on the number of words: it would be pushed below the digests and compute them twice
    own = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.when(F.lit(places), F.col(text)).alias("raw"))
    return word_digests(own, "doc_id", "text", "raw").mapInArrow(
        scan, "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int, coverage double, first_char int, end_char int")


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, firsts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, a, b in zip(texts, firsts, ends, strict=True):
        reach, parts = 0, []
        for first, end in sorted(zip(a, b, strict=True)):
            if first > reach:
                parts.append(text[reach:first])
            reach = max(reach, end)
        out.append("".join([*parts, text[reach:]]))
    return pd.Series(out, dtype=object)


def remove_spans(documents: DataFrame, key: str, text: str, spans: DataFrame, max_words: int = 40, max_coverage: float = 0.5) -> DataFrame:
    """``documents`` without the leaked stretches that exceed a length or coverage limit.

    ``spans`` comes from ``leak_spans``. What stands outside the stretches stays as it is; documents without one are unchanged.
    """
    over = spans.where((F.col("n_words") >= max_words) | (F.col("coverage") >= max_coverage))
    # the cuts of one document number at most its words over the shortest stretch, for each item
    cuts = over.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct(F.col("first_char").alias("a"), F.col("end_char").alias("b"))).alias("_cuts"))
    hit = documents.join(cuts, key)
    hit = hit.withColumn(text, _cut(text, F.col("_cuts")["a"], F.col("_cuts")["b"])).drop("_cuts")
    return documents.join(cuts.select(key), key, "left_anti").unionByName(hit)
