"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions (problem 3).

The tagger reads texts in their visual form, character by character. A text is cut into overlapping
windows; the label scores of a character are blended over the windows that see it, weighted by its
distance to their edges, and one Viterbi path over the whole text reconciles them (BIO labels of
five kinds). Spans then pass an exact check of what their kind must hold (enough figures, a mail sign,
two name words).

Inference is numpy, many windows at a time; weights are a small file of this package, trained by
``factloom.llm.pii_train`` from labelled spans. Redaction replaces the characters an item takes in the text as it is. Null texts stay null; an empty text has no spans.
"""

from __future__ import annotations

import io
import pkgutil
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.charform import visual_form, visual_pieces

KINDS = ("email", "phone", "id_number", "address", "person")
N_LABELS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, OVERLAP = 96, 32
MARKS = "̛̣̀́̂̃̆̉"
_SYMBOLS = " abcdefghijklmnopqrstuvwxyzđ0123456789.,:;-_/\\@+()[]<>#'\"!?&%=*|\n"
N_BASE = len(_SYMBOLS) + 2
SHAPES = 4  # small, capital, figure, other
N_TONES = len(MARKS) + 1


@lru_cache(20_000)
def char_code(c: str) -> tuple[int, int, int]:
    """(base symbol, accent class, shape) of a character."""
    parts = unicodedata.normalize("NFD", c)
    base = "đ" if c in "đĐ" else parts[0]
    low = base.lower()
    symbol = _SYMBOLS.find(low[0]) + 1 if low[0] in _SYMBOLS else (N_BASE - 1 if c.isalpha() else 0)
    marks = [MARKS.find(m) for m in parts[1:] if m in MARKS]
    shape = 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 3
    return symbol, 1 + marks[-1] if marks else 0, shape


def encode(text: str) -> np.ndarray:
    """One integer per character, its three codes combined."""
    return np.array([(a * N_TONES + b) * SHAPES + s for a, b, s in map(char_code, text)], dtype=np.int32)


N_CODES = N_BASE * N_TONES * SHAPES


def split_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return codes // (N_TONES * SHAPES), codes // SHAPES % N_TONES, codes % SHAPES


class Tagger:
    """Weights and inference. Gates are in the order input, forget, output, candidate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        every = split_codes(np.arange(N_CODES))
        x = np.concatenate([self.w["e_base"][every[0]], self.w["e_tone"][every[1]], self.w["e_shape"][every[2]]], axis=1)
        # the input half of the gates of every possible character, computed once; gates i, f, o halved for tanh
        self.tables = [x @ self.w[f"{d}_x"] + self.w[f"{d}_b"] for d in ("f", "b")]
        self.hidden = self.w["f_h"].shape[0]
        half = np.concatenate([np.full(3 * self.hidden, 0.5), np.ones(self.hidden)]).astype(np.float32)
        self.tables = [np.ascontiguousarray(t * half) for t in self.tables]
        self.recur = [np.ascontiguousarray(self.w[f"{d}_h"] * half) for d in ("f", "b")]

    def _run(self, codes: np.ndarray, way: int) -> np.ndarray:
        steps, n = codes.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.empty((steps, n, k), np.float32)
        table, recur = self.tables[way], self.recur[way]
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g = np.tanh(table[codes[t]] + h @ recur)
            c = 0.5 * ((g[:, k : 2 * k] + 1) * c + (g[:, :k] + 1) * g[:, 3 * k :])
            h = 0.5 * (g[:, 2 * k : 3 * k] + 1) * np.tanh(c)
            out[t] = h
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Label scores (steps, windows, labels) of windows laid out as columns; code 0 pads."""
        return np.concatenate([self._run(codes, 0), self._run(codes, 1)], axis=2) @ self.w["out"] + self.w["out_b"]

    def label(self, texts: list[str], batch: int = 512) -> list[np.ndarray]:
        """Labels of each text's characters."""
        codes = [encode(t) for t in texts]
        spots = [(i, s) for i, c in enumerate(codes) for s in window_starts(len(c))]
        total = [np.zeros((len(c), N_LABELS), np.float32) for c in codes]
        seen = [np.zeros((len(c), 1), np.float32) for c in codes]
        spots.sort(key=lambda p: min(WINDOW, len(codes[p[0]]) - p[1]))
        for lo in range(0, len(spots), batch):
            part = spots[lo : lo + batch]
            sizes = [min(WINDOW, len(codes[i]) - s) for i, s in part]
            grid = np.zeros((max(sizes), len(part)), np.int32)
            for col, ((i, s), n) in enumerate(zip(part, sizes, strict=True)):
                grid[:n, col] = codes[i][s : s + n]
            scores = self.scores(grid)
            for col, ((i, s), n) in enumerate(zip(part, sizes, strict=True)):
                at = np.arange(n)
                trust = np.ones(n, np.float32)
                if s > 0:
                    trust = np.minimum(trust, (at + 1) / OVERLAP)
                if s + n < len(codes[i]):
                    trust = np.minimum(trust, (n - at) / OVERLAP)
                total[i][s : s + n] += scores[:n, col] * trust[:, None]
                seen[i][s : s + n] += trust[:, None]
        return viterbi([t / s for t, s in zip(total, seen, strict=True)], self.w["trans"], self.w["start"])


def window_starts(length: int) -> list[int]:
    if length <= WINDOW:
        return [0] if length else []
    step = WINDOW - OVERLAP
    return [*range(0, length - WINDOW, step), length - WINDOW]


def viterbi(scores: list[np.ndarray], trans: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Best label path of each text, all texts stepped together, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for lo in range(0, len(order), 256):
        part, sizes = order[lo : lo + 256], lengths[lo : lo + 256]
        if not len(part) or sizes[0] == 0:
            break
        grid = np.zeros((sizes[0], len(part), N_LABELS), np.float32)
        for col, i in enumerate(part):
            grid[: len(scores[i]), col] = scores[i]
        best = grid[0] + start
        back = np.zeros((sizes[0], len(part), N_LABELS), np.int8)
        for t in range(1, sizes[0]):
            live = int((sizes > t).sum())
            step = best[:live, :, None] + trans[None]
            back[t, :live] = step.argmax(1)
            best[:live] = step.max(1) + grid[t, :live]
        last = best.argmax(1)
        path = np.zeros((sizes[0], len(part)), np.int64)
        for t in range(sizes[0] - 1, -1, -1):
            live = int((sizes > t).sum())
            at = np.arange(live)
            last[:live] = np.where(sizes[:live] - 1 > t, back[min(t + 1, sizes[0] - 1), at, last[:live]] if t + 1 < sizes[0] else last[:live], last[:live])
            path[t, :live] = last[:live]
        for col, i in enumerate(part):
            out[i] = path[: len(scores[i]), col]
    return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the labelled spans."""
    out, at = [], 0
    while at < len(labels):
        if labels[at] == 0:
            at += 1
            continue
        kind, end = (labels[at] - 1) // 2, at + 1
        while end < len(labels) and labels[end] == 2 + 2 * kind:
            end += 1
        out.append((at, end, KINDS[kind]))
        at = end
    return out


_NAME_WORD = re.compile(r"[^\W\d_]{2,}")
_SOCIAL = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}")


def plausible(span: str, kind: str) -> bool:
    """What every item of a kind must hold; figures written as the letter O count in phone numbers."""
    n = sum(c.isdigit() for c in span)
    if kind == "email":
        return bool(re.search(r"[^\W_].*(?:@|\bat\b).*[^\W_]{2}", span, re.I)) and ("." in span or "dot" in span.lower())
    if kind == "phone":
        return 8 <= n + span.upper().count("O") <= 15
    if kind == "id_number":
        return 7 <= n <= 14
    if kind == "address":
        return n >= 1 and len(_NAME_WORD.findall(span)) >= 2
    return n == 0 and len(_NAME_WORD.findall(span)) >= 2


def by_shape(span: str, kind: str) -> str:
    """Phone or identity number, where the number of figures and their groups tell them apart; else the kind as tagged.

    Identity numbers have 9 or 12 figures, a letter with 7 or 8, or the groups of a social security number; phone
    numbers have 10 or 11, or begin with a plus or with 00.
    """
    if kind not in ("phone", "id_number"):
        return kind
    text = span.strip("()<>[]:,;. ")
    n = sum(c.isdigit() for c in text)
    if text[:1] == "+" or span.lstrip()[:2] == "(+" or text[:2] == "00" and n > 12:
        return "phone"
    if _SOCIAL.fullmatch(text) or text[:1].isalpha() and text[:1] not in "oO" and n in (7, 8) or n in (9, 12) and text[:1] not in "oO":
        return "id_number"
    return "phone" if n in (10, 11) or text[:1] in "oO" and n >= 8 else kind


def _reach(form: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """A mail address or number reaches as far as its characters do: the tagger may have lost its first or last ones."""
    more = r"[\w.+-]" if kind == "email" else r"\d" if kind in ("phone", "id_number") else None
    while more and start > 0 and re.match(more, form[start - 1]) and form[start - 1] not in "._-+":
        start -= 1
        while kind == "email" and start > 1 and form[start - 1] in "._-+" and re.match(r"\w", form[start - 2]):
            start -= 1
    while more and end < len(form) and re.match(r"\w" if kind == "email" else more, form[end]):
        end += 1
    return start, end


@lru_cache(1)
def tagger() -> Tagger:
    data = pkgutil.get_data("factloom.llm", "pii_weights.npz")
    with np.load(io.BytesIO(data)) as z:
        return Tagger(dict(z))


def find(texts: list[str | None], model: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans in the visual forms (line feeds kept) of the texts; equal texts are tagged once."""
    forms = [None if t is None else visual_form(t, True) for t in texts]
    distinct = sorted({f for f in forms if f}, key=len)
    model = model or tagger()
    found: dict[str, list] = {}
    for lo in range(0, len(distinct), 2048):
        part = distinct[lo : lo + 2048]
        for form, labels in zip(part, model.label(part), strict=True):
            found[form] = [checked for s in spans_of(labels) if (checked := _checked(form, *s))]
    return [found.get(f, []) if f else [] for f in forms]


def _checked(form: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """A span after the exact checks, or nothing."""
    while start < end and form[start].isspace():
        start += 1
    while start < end and form[end - 1].isspace():
        end -= 1
    if kind == "person" and (dot := re.search(r"[^\W\d_]{3,}[.!?]\s", form[start:end])):
        end = start + dot.end() - 2  # a name does not go on behind the end of a sentence
    start, end = _reach(form, start, end, kind)
    kind = by_shape(form[start:end], kind)
    return (start, end, kind) if plausible(form[start:end], kind) else None


def places(text: str) -> list[tuple[int, int]] | None:
    """For each character of the visual form (line feeds kept) where it stands in the text; None where that cannot be told."""
    clusters: list[list] = []
    for i, piece in enumerate(visual_pieces(text)):
        if piece and clusters and unicodedata.combining(piece[0]):
            clusters[-1][0] += piece
            clusters[-1][2] = i + 1
        elif piece:
            clusters.append([piece, i, i + 1])
    form, out = "", []
    for piece, a, b in clusters:
        for c in unicodedata.normalize("NFC", piece):
            c = " " if c.isspace() and c != "\n" else c
            if c == " " and form.endswith(" "):
                out[-1] = (out[-1][0], b)
            else:
                form += c
                out.append((a, b))
    return out if form == visual_form(text, True) else None


def _kinds(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({k for _, _, k in s}) for s in find(list(texts))], dtype=object)


def _redact(texts: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, find(list(texts)), strict=True):
        if spans:
            at = places(text)
            if at is None:
                text = visual_form(text, True)
                at = [(i, i + 1) for i in range(len(text))]
            for a, b, kind in reversed(spans):
                text = f"{text[: at[a][0]]}[{kind.upper()}]{text[at[b - 1][1] :]}"
        out.append(text)
    return pd.Series(out, dtype=object)


def with_kinds(records: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(record_kind, record_key, pii_kind): the kinds of item each record's text holds."""
    udf = F.pandas_udf(_kinds, T.ArrayType(T.StringType()))
    own = records.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_key"), F.col(text).alias("t"))
    return own.select("record_kind", "record_key", F.explode(udf("t")).alias("pii_kind"))


def redacted(records: DataFrame, text: str) -> DataFrame:
    """``records`` with the items in ``text`` replaced by placeholders such as [PHONE]; all else stays as it is.

    Only a text whose characters do not fall into single letters with their accents (as parted Korean syllables) comes out in
    its visual form.
    """
    udf = F.pandas_udf(_redact, T.StringType())
    return records.withColumn(text, udf(text))
