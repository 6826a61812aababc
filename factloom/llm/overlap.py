"""Records of evaluation splits that also stand, exactly or nearly, in the training split (problem 6).

Records are canonicalised: one character form, no case, accents or punctuation; evidence becomes its
statements, so that order and joining play no part. Equal canonical hashes are one class, and only
one record of a class is compared; class pairs are expanded to their records at the end, where pairs are wanted.

A hash of the whole record finds exact copies only. Near copies are found by joining hashes of parts and then compared
word by word: slips of the pen and a few exchanged, dropped or added words are allowed, another figure or another
party is not. What the comparison accepts bounds the parts:

* all figures are equal up to blanks and joints, so the sorted digits of a record are part of every key;
* at most half of the words are touched, so at least a third of the two records' words is shared. Min-hashes of words,
  ``BANDS_FIGURES`` single ones or, for records without figures, ``BANDS_WORDS`` pairs of them, agree in at least one
  place with a probability of 0.98 and 0.96 at that limit, and of nearly 1 for lighter edits;
* each record has bitmaps of its words, a small one and one of ``WIDE`` bits. Bits of one record that the other lacks are words
  it lacks, so candidates with more of them than half the words end before any text is read, and none is lost.

Neither keys nor texts are moved: the evaluation classes go out in blocks of bounded size, and the training classes are
streamed past them where they lie, keys, bitmaps and comparison in one go. Evaluation sides of more than ``MAX_BLOCKS``
blocks are joined on the keys instead; there, keys of a large bucket are spread over as many salts as its size asks for.
No bucket is capped.

Null keys, null and empty fields take part in nothing; a field of one word has no near copies. Records of other splits
than the evaluation splits and train are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.charform import ASCII_BLANKS, PLAIN, visual_form
from factloom.operators.retrieval import document_blocks
from factloom.storage import compact, count_at_most, materialize

# Accented small letters of Vietnamese and Western European text, and their base letters.
ACCENTED = "àáâãäåăạảấầẩẫậắằẳẵặçèéêëẹẻẽếềểễệìíîïĩỉịñòóôõöơọỏốồổỗộớờởỡợùúûüũưụủứừửữựýÿỳỵỷỹđß"
BASE = "aaaaaaaaaaaaaaaaaaaceeeeeeeeeeeeiiiiiiinoooooooooooooooooouuuuuuuuuuuuuyyyyyyds"
BANDS_FIGURES, BANDS_WORDS, BUCKET_ROWS = 10, 28, 5_000
BROADCAST_CLASSES = 200_000
# Characters of a block of evaluation classes and the number of blocks; pairs that are looked at in one step.
BLOCK_CHARS, MAX_BLOCKS, STEP_PAIRS = 32_000_000, 256, 1_000_000
# Fixed value: bits of a record's wide bitmap. A small one is nearly full of the words of some sentences and tells little.
WIDE = 1_024
# Fixed value: where passages and statements are joined.
JOINTS = re.compile(r"""\s*\|\|\||\\n|\n|['"]\s*,\s*['"]|(?<=[.!?。])['"]?\s""", re.ASCII)
_STATES = re.compile(r"[^\W_]")
_DIRTY = re.compile(f"[^{PLAIN}\U0001f300-\U0001faff]")
_BLANKS, _BLANK_RUNS = re.compile(f"[{ASCII_BLANKS}]+"), re.compile(f"  |[{ASCII_BLANKS[1:]}]")
# Characters that are worked on in one step; what a character without a small letter or figure of its own is.
STEP_CHARS, BREAK, DROP = 500_000, 10, 1


def statements(text: str) -> list[str]:
    """The statements of a field's visual form, cut at joins of passages and ends of sentences."""
    if not text.isascii() and _DIRTY.search(text):
        text = visual_form(text, keep_lines=True)
    if _BLANK_RUNS.search(text):
        text = _BLANKS.sub(" ", text)
    return [s for s in JOINTS.split(text) if _STATES.search(s)]


class _Letters:
    """What each character is in the canonical form: a small base letter or a figure, 0 between words, ``DROP`` for marks."""

    def __init__(self):
        self.known, self.upper, self.figure = (np.zeros(0x110000, bool) for _ in range(3))
        self.canon = np.zeros(0x110000, np.uint32)
        self.base = dict(zip(ACCENTED, BASE, strict=True)) | {"ς": "σ"}

    def __call__(self, points: np.ndarray) -> np.ndarray:
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        for point in np.flatnonzero(seen & ~self.known):
            c = chr(point)
            low = [self.base.get(x, x) for x in c.lower()]
            low = [x for x in low if not unicodedata.category(x).startswith("M")]
            letter = bool(low) and unicodedata.category(low[0])[0] in "LN"
            self.canon[point] = BREAK if c == "\n" else DROP if not low else ord(low[0]) if letter else 0
            self.upper[point], self.figure[point] = unicodedata.category(c) == "Lu", letter and unicodedata.category(low[0]) == "Nd"
            self.known[point] = True
        return self.canon[points]


_letters = lru_cache(1)(_Letters)


def records(claims: DataFrame, key: str, split: str, field: str, train: str, evals: list[str]) -> DataFrame:
    """(record_key, side, field_name, text): a row per record whose key and field are not null."""
    own = claims.where(F.col(split).isin(train, *evals) & F.col(field).isNotNull() & F.col(key).isNotNull())
    return own.select(F.col(key).alias("record_key"), F.when(F.col(split) == train, "t").otherwise("e").alias("side"), F.lit(field).alias("field_name"), F.col(field).cast("string").alias("text"))


def representatives(rows: DataFrame) -> DataFrame:
    """(field_name, side, cls, record_key): of each class the record whose capitals tell names apart best.

    No text is shuffled for it. An all-capital or all-small copy stands for its class only if there is no other.
    """
    return rows.groupBy("field_name", "side", "cls").agg(F.max_by("record_key", F.struct("telling", "capitals", "record_key")).alias("record_key"))


_SIGNED = (
    "side string, field_name string, cls binary, cased string, n int, capitals int, telling boolean, buckets array<bigint>, m0 bigint, m1 bigint, m2 bigint, m3 bigint, wide binary"
)


def _mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _read(cased: list[str]) -> tuple[np.ndarray, ...]:
    """Of texts (statements on lines): each one's class in two numbers, its number of words, capitals and whether they tell names
    apart, its figures in one number and whether it has none, and the distinct words (text, hash), text by text.

    Repeated statements of a text count once. The class leaves the order of statements aside, the figures' number that of digits.
    """
    n_texts, one = len(cased), np.uint64(1)
    letters = _letters()
    points = np.frombuffer("\n".join(cased).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, cased), np.int64, n_texts) + 1)
    starts = ends - np.diff(ends, prepend=0)
    canon = letters(points)
    blank = (points == 32) | (points == 10)
    after = np.zeros(len(points), bool)
    after[1:] = blank[:-1] & letters.upper[points[1:]]
    after[starts] = False
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], np.minimum(ends, len(points))))])
    blank[ends[:-1] - 1] = False
    capitals, blanks = count(after), count(blank)
    # words: marks go first, they part nothing
    at = np.flatnonzero(canon != DROP)
    canon, figure = canon[at], letters.figure[points[at]]
    inside = canon > BREAK
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    chars = np.flatnonzero(inside)
    begins = np.flatnonzero(first[chars])
    word_of = np.cumsum(first[chars]) - 1
    place = np.arange(len(chars)) - begins[word_of]
    code = _mixed(canon[chars].astype(np.uint64), 1) * _powers(int(place.max()) + 1, 0xD6E8FEB86659FD93)[place]
    words = _mixed(np.add.reduceat(code, begins), 2)
    line = np.cumsum(canon == BREAK)[chars[begins]]
    text = np.searchsorted(ends, at[chars[begins]], "right")
    # statements, each of a text once
    opening = np.flatnonzero(np.diff(line, prepend=-1))
    of = np.cumsum(np.diff(line, prepend=-1) != 0) - 1
    nth = np.arange(len(words)) - opening[of]
    power = _powers(int(nth.max()) + 1, 0xA0761D6478BD642F)[nth]
    sums = [_mixed(np.add.reduceat(_mixed(words, k) * power, opening), k) for k in (3, 4)]
    order = np.lexsort((sums[1], sums[0], text[opening]))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (text[opening][order[1:]] == text[opening][order[:-1]]) & (sums[0][order[1:]] == sums[0][order[:-1]]) & (sums[1][order[1:]] == sums[1][order[:-1]])
    cls = np.zeros((n_texts, 2), np.uint64)
    for k in range(2):
        np.add.at(cls[:, k], text[opening][~again], sums[k][~again])
    counted = ~again[of]
    n = np.bincount(text[counted], minlength=n_texts)
    digit = np.flatnonzero(figure[chars] & counted[word_of])
    figures = np.zeros(n_texts, np.uint64)
    np.add.at(figures, text[word_of[digit]], _mixed(canon[chars[digit]].astype(np.uint64), 5))
    plain = np.bincount(text[word_of[digit]], minlength=n_texts) == 0
    text, words = text[counted], words[counted]
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (words[1:] != words[:-1])
    return cls, n, capitals, (capitals > 0) & (2 * capitals <= blanks), _mixed(figures, 6) | one, plain, text[fresh], words[fresh]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rand = np.random.default_rng(20)
    n_hash = max(BANDS_FIGURES, 2 * BANDS_WORDS)
    a, b = rand.integers(1, 1 << 62, n_hash, dtype=np.uint64) | np.uint64(1), rand.integers(1, 1 << 62, n_hash, dtype=np.uint64)
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
    for whole, cased in _steps(batches):
        names = whole.column("field_name").to_pylist()
        field = np.array([int.from_bytes(hashlib.md5(f.encode()).digest()[:8], "little") for f in dict.fromkeys(names)], np.uint64)
        which = {f: i for i, f in enumerate(dict.fromkeys(names))}
        cls, n, capitals, telling, figures, plain, text, words = _read(cased)
        figures = _mixed(figures ^ field[[which[f] for f in names]], 7)
        starts = np.searchsorted(text, np.arange(len(whole)))
        bit = np.uint64(1) << (words & np.uint64(63))
        part = (words >> np.uint64(6)) & np.uint64(3)
        maps = [np.bitwise_or.reduceat(np.where(part == np.uint64(k), bit, np.uint64(0)), starts) for k in range(4)]
        bits = np.zeros((len(whole), WIDE), bool)
        bits[text, (words >> np.uint64(8)) & np.uint64(WIDE - 1)] = True
        binary = lambda x: pa.Array.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())

        def least(k: int, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
            h = at * a[k] + b[k]
            return np.minimum.reduceat(h ^ (h >> turn), starts)

        buckets, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for rows_of, bands in ((np.flatnonzero(~plain), BANDS_FIGURES), (np.flatnonzero(plain), BANDS_WORDS)):
            if len(rows_of) == 0:
                continue
            own = np.zeros(len(whole), bool)
            own[rows_of] = True
            some = words[own[text]]
            begin = np.searchsorted(text[own[text]], rows_of)
            for band in range(bands):
                key = least(band, some, begin) if bands == BANDS_FIGURES else (least(2 * band, some, begin) * mix) ^ least(2 * band + 1, some, begin)
                buckets.append((key ^ (figures[rows_of] + np.uint64(band))) * mix)
                rows.append(rows_of)
        at, every = np.concatenate(rows), np.concatenate(buckets).view(np.int64)
        edges = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(whole))))).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(edges), pa.array(every[np.argsort(at, kind="stable")]))
        cols = [*(whole.column(c) for c in ("record_key", "side", "field_name")), binary(cls), pa.array(cased), pa.array(n, pa.int32()), pa.array(capitals, pa.int32()), pa.array(telling), listed]
        cols += [*(pa.array(m.view(np.int64)) for m in maps), binary(np.packbits(bits, axis=1))]
        yield pa.RecordBatch.from_arrays(cols, names=["record_key", "side", "field_name", "cls", "cased", "n", "capitals", "telling", "buckets", "m0", "m1", "m2", "m3", "wide"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows that state something with their statements on lines, about ``STEP_CHARS`` at a time."""
    for batch in batches:
        cased = ["\n".join(statements(t)) for t in batch.column("text").to_pylist()]
        keep = [i for i, t in enumerate(cased) if t]
        for lo, hi in document_blocks(np.array([len(cased[i]) for i in keep], np.int64), len(keep), STEP_CHARS):
            yield batch.take(pa.array(keep[lo:hi])), [cased[i] for i in keep[lo:hi]]


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``records`` that state something: their class, statements on lines, number of words, capitals, min-hash keys and bitmaps of the words.

    Records with the same distinct statements in canonical form (small base letters and figures, one space between words) are one class.
    """
    return rows.mapInArrow(_signed, f"record_key {rows.schema['record_key'].dataType.simpleString()}, {_SIGNED}")


def keys(classes: DataFrame) -> DataFrame:
    """(bucket, cid, n, m0..m3) of signed classes: a row per key."""
    return classes.select(F.explode("buckets").alias("bucket"), "cid", "n", "m0", "m1", "m2", "m3")


def candidates(evals: DataFrame, trains: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(ec, tc): pairs of cids with an equal key whose bitmaps allow half of the words to be equal."""
    sized = trains.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > bucket_rows)
    hot = materialize(sized.select("bucket", F.ceil(F.col("size") / bucket_rows).cast("int").alias("salts")), "hot_buckets")
    salts = F.coalesce("salts", F.lit(1))
    maps = [f"m{k}" for k in range(4)]
    named = lambda df, side: df.select("bucket", F.col("cid").alias(f"{side}c"), F.col("n").alias(f"{side}n"), *[F.col(m).alias(side + m) for m in maps])
    e = named(evals, "e").join(hot, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    t = named(trains, "t").join(hot, "bucket", "left").withColumn("salt", F.pmod("tc", salts).cast("int")).drop("salts")
    lacking = lambda x, y: sum((F.bit_count(F.col(x + m).bitwiseAND(F.bitwise_not(y + m))) for m in maps[1:]), F.bit_count(F.col(x + "m0").bitwiseAND(F.bitwise_not(y + "m0"))))
    possible = 2 * F.greatest(lacking("e", "t"), lacking("t", "e")) <= F.greatest("en", "tn")
    return e.join(t, ["bucket", "salt"]).where("ec <> tc").where(possible).select("ec", "tc").distinct()


_WORD = re.compile(r"[^\W_]+")


@lru_cache(100_000)
def _base(word: str) -> str:
    out = unicodedata.normalize("NFD", word.lower().replace("đ", "d").replace("ß", "ss"))
    return "".join(c for c in out if not unicodedata.combining(c))


def _figured(word: str) -> bool:
    return any(c.isdecimal() for c in word)


def _tokens(statement: str) -> list[tuple[str, bool]]:
    """(word, is capitalised inside the statement) of one statement."""
    words = _WORD.findall(statement)
    return [(_base(w), i > 0 and w[0].isupper()) for i, w in enumerate(words)]


def _telling(statements: list[list[tuple[str, bool]]]) -> bool:
    """Whether the capitals of a text tell names apart: it is neither all small nor mostly capitals."""
    flags = [c for s in statements for _, c in s[1:]]
    return bool(flags) and 0 < sum(flags) <= 0.5 * len(flags)


def slip(a: str, b: str, name: bool) -> bool:
    """Whether one word is the other with a slip: two neighbours swapped, one letter more, less or (not in names) another."""
    if a == b:
        return True
    if min(len(a), len(b)) < (4 if name else 2) or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        if i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]:
            return True
        return not name and len(a) > 2 and a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def difference(a: list[tuple[str, bool]], b: list[tuple[str, bool]], names_a: bool, names_b: bool) -> tuple[float, int]:
    """(cost, touched words) of the edits between two statements; infinite cost if a figure or a party differs."""
    x, y = [w for w, _ in a], [w for w, _ in b]
    if x == y:
        return 0.0, 0
    named = {w for w, c in a if c and names_a} | {w for w, c in b if c and names_b}
    cost, touched = 0.0, 0
    for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = x[i1:i2], y[j1:j2]
        touched += max(len(left), len(right))
        rest = []
        for w in left:  # slips first, wherever in the block
            hit = next((v for v in right if slip(w, v, w in named or v in named)), None)
            if hit is None or w != hit and (_figured(w) or _figured(hit)):
                rest.append(w)
            else:
                right.remove(hit)
                cost += 0.5
        if "".join(rest) == "".join(right):  # words joined or parted
            cost += 0.5 * bool(rest)
            continue
        if any(w in named or _figured(w) for w in rest + right):
            return float("inf"), touched
        cost += max(len(rest), len(right))
    return cost, touched


@lru_cache(4_096)
def _distinct(text: str) -> list[list[tuple[str, bool]]]:
    """The statements of a text's lines, equal ones once. A text is compared with many others."""
    own: dict[tuple, list[tuple[str, bool]]] = {}
    for s in text.split("\n"):
        tokens = _tokens(s)
        if tokens:
            own.setdefault(tuple(w for w, _ in tokens), tokens)
    return list(own.values())


@lru_cache(4_096)
def _parties(text: str) -> tuple[list[str], set[str]]:
    """The words that name parties, if the capitals tell, and all words."""
    own = _distinct(text)
    return sorted({w for s in own for w, c in s if c}) if _telling(own) else [], {w for s in own for w, _ in s}


@lru_cache(20_000)
def _variants(name: str) -> frozenset[str]:
    """The words that a name may stand as because they are shorter or have two neighbours swapped: its beginnings and ends, and its slips."""
    out = {name[:i] for i in range(1, len(name))} | {name[i:] for i in range(1, len(name))}
    if len(name) >= 4:
        out |= {name[:i] + name[i + 1] + name[i] + name[i + 2 :] for i in range(len(name) - 1)}
    if len(name) >= 5:
        out |= {name[:i] + name[i + 1 :] for i in range(len(name))}
    return frozenset(out)


def _stands(name: str, words: set[str], joined: str, longer: Iterable[str]) -> bool:
    """Whether a name may stand among ``words``: as it is, with a slip, or joined with or parted into other words.

    ``joined`` has the words with blanks between; a name has none. ``longer`` are those of one letter more.
    """
    if name in joined or not _variants(name).isdisjoint(words):
        return True
    return any(slip(name, v, True) for v in longer)


def _has_parties(a: str, b: str) -> bool:
    """Whether each party of ``a`` may stand in ``b``.

    The comparison refuses every pair that fails this; most chance candidates do.
    """
    words = _parties(b)[1]
    joined = " ".join(words)
    return all(_stands(w, words, joined, [v for v in words if len(v) == len(w) + 1]) for w in _parties(a)[0])


class _Text:
    """What is looked at before two texts are compared: the words, their number, and those that name parties."""

    __slots__ = ("by_length", "joined", "n", "names", "text", "words")

    def __init__(self, text: str):
        self.text, (self.names, self.words) = text, _parties(text)
        self.n, self.joined = sum(map(len, _distinct(text))), " ".join(self.words)
        self.by_length: dict[int, list[str]] = {}
        for word in self.words:
            self.by_length.setdefault(len(word), []).append(word)

    def like(self, other: _Text) -> bool:
        """``same_statements``; at most half of the words are touched there, so no more distinct words may be missing on either side."""
        missing = max(len(self.words), len(other.words)) - len(self.words & other.words)
        if 2 * missing > max(self.n, other.n):
            return False
        for one, two in ((self, other), (other, self)):
            for name in one.names:
                if not _stands(name, two.words, two.joined, two.by_length.get(len(name) + 1, ())):
                    return False
        return same_statements(self.text, other.text)


def same_statements(a: str, b: str, share: float = 0.3, free: float = 2.0) -> bool:
    """Whether two fields (statements on lines) state the same with slight edits.

    Edits cost one a word, slips and joined words half; together they may cost ``free`` and ``share`` of the words, and
    touch at most half of the words.
    """
    if not (_has_parties(a, b) and _has_parties(b, a)):
        return False
    left, right = _distinct(a), _distinct(b)
    names_a, names_b = _telling(left), _telling(right)
    lk, rk = ({tuple(w for w, _ in s) for s in x} for x in (left, right))
    pending = [s for s in left if tuple(w for w, _ in s) not in rk]
    rest = [s for s in right if tuple(w for w, _ in s) not in lk]
    if not pending and not rest:
        return True
    size = max(sum(map(len, left)), sum(map(len, right)))
    limit, most = min(free + share * size, size / 2), size / 2
    # a different cut into statements leaves the same words in the same order
    whole, touched = difference([t for s in pending for t in s], [t for s in rest for t in s], names_a, names_b)
    if whole <= limit and touched <= most:
        return True
    cost, touched = 0.0, 0
    for s in pending:
        words = {w for w, _ in s}
        best = max(range(len(rest)), key=lambda j: len(words & {w for w, _ in rest[j]}), default=None)
        more, n = (_alone(s, names_a), len(s)) if best is None else difference(s, rest.pop(best), names_a, names_b)
        cost, touched = cost + more, touched + n
        if cost > limit or touched > most:
            return False
    return cost + sum(_alone(s, names_b) for s in rest) <= limit and touched + sum(map(len, rest)) <= most


def _alone(statement: list[tuple[str, bool]], names: bool) -> float:
    if any((c and names) or _figured(w) for w, c in statement):
        return float("inf")
    return float(len(statement))


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_statements(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _wide(column: pa.Array) -> np.ndarray:
    """(rows, words of 64 bits) of the wide bitmaps."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), WIDE // 64)


def _streamed(shared) -> Callable:
    """The function that streams training classes past a block of evaluation classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, every, owner = shared.value
        cased, field, cls, own, size = (table.column(c).combine_chunks() for c in ("cased", "field_name", "cls", "cid", "n"))
        field, own, size = (np.asarray(x) for x in (field, own, size))
        maps = np.stack([np.asarray(table.column(f"m{k}")).view(np.uint64) for k in range(4)])
        wide = _wide(table.column("wide").combine_chunks())
        held = np.bitwise_count(wide).sum(1, dtype=np.int64)
        known: dict[int, _Text] = {}
        for batch in batches:
            lists = batch.column("buckets")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            bucket = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            first = np.searchsorted(every, bucket, "left")
            many = np.searchsorted(every, bucket, "right") - first
            bucket_at = np.flatnonzero(many)
            fields, cids, sizes = (np.asarray(batch.column(c)) for c in ("field_name", "cid", "n"))
            bits = np.stack([batch.column(f"m{k}").to_numpy().view(np.uint64) for k in range(4)])
            more_bits = _wide(batch.column("wide"))
            more_held = np.bitwise_count(more_bits).sum(1, dtype=np.int64)
            pairs = [np.zeros(0, np.int64)]
            for lo, hi in document_blocks(many[bucket_at], len(bucket_at), STEP_PAIRS):
                at = bucket_at[lo:hi]
                n = many[at]
                t = np.repeat(row[at], n)
                e = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(len(t))]
                more, less = (np.zeros(len(t), np.int64) for _ in range(2))
                for k in range(4):
                    x, y = maps[k][e], bits[k][t]
                    more += np.bitwise_count(x & ~y)
                    less += np.bitwise_count(y & ~x)
                keep = np.flatnonzero((2 * np.maximum(more, less) <= np.maximum(size[e], sizes[t])) & (own[e] != cids[t]))
                keep = keep[field[e[keep]] == fields[t[keep]]]
                t, e = np.divmod(np.unique(t[keep] * len(own) + e[keep]), max(1, len(own)))
                common = np.zeros(len(t), np.int64)
                for k in range(WIDE // 64):
                    common += np.bitwise_count(wide[e, k] & more_bits[t, k])
                missing = np.maximum(held[e], more_held[t]) - common
                fit = 2 * missing <= np.maximum(size[e], sizes[t])
                pairs.append(t[fit] * len(own) + e[fit])
            last, text, found = -1, None, []
            for t, e in zip(*np.divmod(np.unique(np.concatenate(pairs)), max(1, len(own))), strict=True):
                if t != last:
                    last, text = t, _Text(batch.column("cased")[t].as_py())
                other = known.get(e)
                if other is None:
                    other = known[e] = _Text(cased[e].as_py())
                if other.like(text):
                    found.append((field[e], cls[e].as_py(), batch.column("cls")[t].as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)], names=["field_name", "ec", "tc"])

    return run


def near_streamed(evals: DataFrame, trains: DataFrame, n_blocks: int) -> DataFrame:
    """(field_name, ec, tc): near copies, the evaluation classes broadcast block by block and the training classes streamed past each."""
    out = None
    for i in range(n_blocks):
        table = evals.where(F.pmod("cid", F.lit(n_blocks)) == i).select("field_name", "cls", "cid", "cased", "n", "buckets", *[f"m{k}" for k in range(4)], "wide").toArrow()
        lists = table.column("buckets").combine_chunks()
        every, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(every, kind="stable")
        shared = evals.sparkSession.sparkContext.broadcast((table.drop_columns("buckets"), every[order], row[order]))
        one = materialize(trains.select("field_name", "cls", "cid", "cased", "n", "buckets", *[f"m{k}" for k in range(4)], "wide").mapInArrow(_streamed(shared), "field_name string, ec binary, tc binary"), "near")
        shared.destroy()
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def near_joined(evals: DataFrame, trains: DataFrame) -> DataFrame:
    """(field_name, ec, tc): near copies, by joins on the keys and of the texts."""
    near = materialize(candidates(materialize(keys(evals), "eval_keys"), materialize(keys(trains), "train_keys")), "candidates")
    texts = lambda df, side: df.select("field_name", F.col("cid").alias(f"{side}c"), F.col("cls").alias(f"{side}_cls"), F.col("cased").alias(f"{side}_text"))
    near = near.join(texts(evals, "e"), "ec").join(texts(trains, "t"), ["field_name", "tc"]).where(_same("e_text", "t_text"))
    return near.select("field_name", F.col("e_cls").alias("ec"), F.col("t_cls").alias("tc")).distinct()


def class_overlaps(claims: DataFrame, key: str, split: str, fields: list[str], train: str = "train", evals: tuple[str, ...] = ("dev", "test")) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every record (field_name, side, cls, record_key), and every link between an
    evaluation class and a training class with the same field, exactly or nearly (field_name, ec, tc).
    """
    rows = None
    for field in fields:
        one = records(claims, key, split, field, train, list(evals))
        rows = one if rows is None else rows.unionByName(one)
    rows = compact(signed(rows), "records")
    chosen = materialize(representatives(rows), "representatives")
    same = ["field_name", "side", "cls", "record_key"]
    if count_at_most(chosen, BROADCAST_CLASSES) <= BROADCAST_CLASSES:
        classes = rows.join(F.broadcast(chosen), same, "left_semi")
    else:
        others = materialize(rows.select(*same).join(chosen, same, "left_anti"), "others")
        few = count_at_most(others, BROADCAST_CLASSES) <= BROADCAST_CLASSES
        classes = rows.join(F.broadcast(others), same, "left_anti") if few else materialize(rows.join(chosen, same, "left_semi"), "classes")
    classes = classes.withColumn("cid", F.xxhash64("field_name", "cls"))
    of = lambda side: classes.where(F.col("side") == side)
    # the classes' own size: of copies, one is compared
    chars = rows.where("side = 'e'").groupBy("field_name", "cls").agg(F.max(F.length("cased") + 200).alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    n_blocks = -(-chars // BLOCK_CHARS)
    if n_blocks > 1 and 2 * chosen.count() < rows.count():  # every pass would read the copies too
        classes = materialize(classes, "compared")
    near = near_streamed(of("e"), of("t"), max(1, n_blocks)) if n_blocks <= MAX_BLOCKS else near_joined(of("e"), of("t"))
    sides = [chosen.where(F.col("side") == s).select("field_name", F.col("cls").alias("ec")) for s in "et"]
    equal = sides[0].join(sides[1], ["field_name", "ec"]).distinct().withColumn("tc", F.col("ec"))
    return rows.select("field_name", "side", "cls", "record_key"), materialize(near.unionByName(equal), "class_pairs")


def expanded(members: DataFrame, links: DataFrame, salts: int = 8) -> DataFrame:
    """(field_name, eval_key, train_key): the links of classes as pairs of records, a class of many copies spread over ``salts`` tasks."""
    of = lambda side, cls, name: members.where(F.col("side") == side).select("field_name", F.col("cls").alias(cls), F.col("record_key").alias(name))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    own = lambda name: F.pmod(F.xxhash64(name), F.lit(salts)).cast("int")
    e = links.withColumn("salt", spread).join(of("e", "ec", "eval_key").withColumn("salt", own("eval_key")), ["field_name", "ec", "salt"])
    t = of("t", "tc", "train_key").withColumn("salt", own("train_key"))
    return e.withColumn("salt", spread).join(t, ["field_name", "tc", "salt"]).select("field_name", "eval_key", "train_key")


def overlaps(claims: DataFrame, key: str, split: str, fields: list[str], train: str = "train", evals: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(field_name, eval_key, train_key): every pair of an evaluation and a training record with the same field, exactly or nearly."""
    return expanded(*class_overlaps(claims, key, split, fields, train, evals))


def report(members: DataFrame, links: DataFrame, claims: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """Per field, split and source of the evaluation record: records with an overlap, their pairs, and all records.

    Pairs are counted from the sizes of the classes; none is formed.
    """
    sizes = members.where("side = 't'").groupBy("field_name", F.col("cls").alias("tc")).agg(F.count("*").alias("size"))
    per_class = links.join(sizes, ["field_name", "tc"]).groupBy("field_name", "ec").agg(F.sum("size").alias("n"))
    own = claims.select(F.col(key).alias("eval_key"), F.col(split).alias("split_name"), F.col(source).alias("source"))
    evals = members.where("side = 'e'").select("field_name", F.col("cls").alias("ec"), F.col("record_key").alias("eval_key"))
    hits = evals.join(per_class, ["field_name", "ec"]).select("field_name", "eval_key", "n")
    hits = hits.join(own, "eval_key").groupBy("field_name", "split_name", "source").agg(F.count("*").alias("n_overlapping"), F.sum("n").alias("n_pairs"))
    totals = own.groupBy("split_name", "source").agg(F.count("*").alias("n_records"))
    return hits.join(totals, (hits["split_name"] == totals["split_name"]) & hits["source"].eqNullSafe(totals["source"])).select(
        hits["field_name"], hits["split_name"], hits["source"], "n_overlapping", "n_pairs", "n_records"
    )
