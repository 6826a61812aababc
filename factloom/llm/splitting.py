"""Oversized texts cut into pieces at natural boundaries (problem 7).

Agglomerative merging: a text begins as atomic segments; the boundaries between neighbours wait in a
heap, weakest first, and are merged away while the joined segment and the overlap fit the limit. What
survives are the strongest boundaries that had to stay. Atoms are sentences, lines and passages; only
an atom that is itself too long is broken further at clauses, then blanks, then between characters.

Each piece after the first begins with the last ``overlap`` characters of the text before it, so
the text can be put together again exactly. Lengths are Unicode code points.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of boundary, strongest first, and the strength of each; a boundary lies behind the match.
_LEVELS = [
    (re.compile(r"\n[^\S\n]*\n\s*|\|\|\|"), 6),
    (re.compile(r"\r?\n"), 5),
    (re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]"), 4),
    (re.compile(r"[;:]\s+"), 3),
    (re.compile(r",\s+|\s[–—-]\s"), 2),
    (re.compile(r"\s+"), 1),
]
_COARSE = 3


def _boundaries(text: str, lo: int, hi: int, levels: list, least: int) -> dict[int, int]:
    found: dict[int, int] = {}
    for pattern, strength in levels:
        for m in pattern.finditer(text, lo, hi):
            if least <= m.end() and lo < m.end() < hi:
                found.setdefault(m.end(), strength)
    return found


def _hard_cuts(text: str, lo: int, hi: int, size: int) -> dict[int, int]:
    cuts, at = {}, lo + size
    while at < hi:
        cut = at
        while cut > at - 8 and cut > lo + 1 and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f"):
            cut -= 1
        cuts[cut] = 0
        at = cut + size
    return cuts


def _atoms(text: str, room: int, least: int) -> dict[int, int]:
    """Boundary positions and strengths such that no segment is longer than ``room``."""
    bounds = _boundaries(text, 0, len(text), _LEVELS[:_COARSE], least)
    for level in range(_COARSE, len(_LEVELS) + 1):
        edges = [0, *sorted(bounds), len(text)]
        long_ones = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > room]
        if not long_ones:
            break
        for a, b in long_ones:
            if level < len(_LEVELS):
                bounds |= _boundaries(text, a, b, _LEVELS[level : level + 1], least)
            else:
                bounds |= _hard_cuts(text, a, b, room)
    return bounds


def cut_positions(text: str, max_chars: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``text``, the last being its length; a text within the limit is one piece."""
    if len(text) <= max_chars:
        return [len(text)]
    room = max_chars - overlap
    if room <= 0 or overlap < 0:
        raise ValueError("the overlap must be smaller than the limit")
    least = min(overlap, room)
    bounds = _atoms(text, room, least)
    edges = [0, *sorted(bounds), len(text)]
    n = len(edges) - 1
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    start, end, alive, stamp = edges[:-1], edges[1:], [True] * n, [0] * n
    heap = [(bounds[end[i]], end[right[i]] - start[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, si, sj = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or si != stamp[i] or sj != stamp[j] or size > room:
            continue
        end[i], right[i], alive[j] = end[j], right[j], False
        stamp[i] += 1
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (bounds[end[i]], end[right[i]] - start[i], i, stamp[i], stamp[right[i]]))
        if left[i] >= 0:
            p = left[i]
            heapq.heappush(heap, (bounds[end[p]], end[i] - start[p], p, stamp[p], stamp[i]))
    return [end[i] for i in range(n) if alive[i]]


def split_long(records: DataFrame, key: str, text: str, max_chars: int, overlap: int, kind: str) -> DataFrame:
    """(record_kind, record_key, piece_no, n_pieces, start_char, piece) for the records over the limit.

    Records whose text is null, empty or within the limit give no row: they stay as they are.
    """
    @F.pandas_udf("array<int>")
    def ends(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_positions(t, max_chars, overlap) for t in texts], dtype=object)

    own = records.select(F.col(key).alias("record_key"), F.col(text).alias("t")).where(F.length("t") > max_chars)
    # called non-deterministic so that no filter on its result is pushed below it, which would cut every text twice
    cut = own.withColumn("ends", ends.asNondeterministic()("t"))
    pieces = cut.select("record_key", "t", "ends", F.posexplode("ends").alias("piece_no", "stop"))
    start = F.when(F.col("piece_no") == 0, 0).otherwise(F.get("ends", F.col("piece_no") - 1) - overlap)
    return pieces.select(
        F.lit(kind).alias("record_kind"), "record_key", "piece_no", F.size("ends").alias("n_pieces"), start.alias("start_char"),
        F.substring(F.col("t"), start + 1, F.col("stop") - start).alias("piece"),
    )
