"""Token counts under a public tokenizer.

The tokenizer's vocabulary file is a parameter; nothing of it is kept in the repository. The file is read from the
driver's disk and sent to the executors. A text is cut
in front of each blank that follows a non-blank character. The tokenizer's own pattern never joins
characters across such a place, so the counts of the chunks add up to the count of the text. Chunks
repeat very often: a batch's distinct chunks are found by Arrow's dictionary encoding and only those
not yet known to the worker are tokenized.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FILE = os.environ.get("FACTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the splitting pattern published with this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KNOWN_MAX = 500_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _known(path: str) -> dict[str, int]:
    return {}


def chunk_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Byte positions at which chunks begin: each text's first byte, each blank behind a non-blank."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    before = np.concatenate(([True], blank[:-1]))
    cut = blank & ~before
    at = np.flatnonzero(cut)
    wide = at[(data[at - 1] >= 0x80) & (at >= 3)]
    b3, b2, b1 = data[wide - 3], data[wide - 2], data[wide - 1]
    space = (b2 == 0xC2) & ((b1 == 0xA0) | (b1 == 0x85))
    space |= (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81)) | (b3 == 0xE3) & (b2 == 0x80) | (b3 == 0xE1) & (b2 == 0x9A)
    cut[wide[space]] = False
    cut[at[at < 3]] = False
    cut[firsts] = True
    return np.flatnonzero(cut)


def count_batch(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text; 0 for null and for the empty text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    if not sizes.sum():
        return np.zeros(len(texts), dtype=np.int64)
    base = offsets[0]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[base : offsets[-1]]
    starts = chunk_starts(data, (offsets[:-1] - base)[sizes > 0])
    bounds = np.append(starts, len(data)).astype(np.int64) + base
    chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), raw]).dictionary_encode()
    known, enc = _known(path), _encoding(path)
    if len(known) > _KNOWN_MAX:
        known.clear()
    words = chunks.dictionary.to_pylist()
    for w in words:
        if w not in known:
            known[w] = len(enc.encode_ordinary(w))
    counts = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))[chunks.indices.to_numpy()]
    total = np.concatenate(([0], np.cumsum(counts)))
    edge = np.searchsorted(starts, offsets - base)
    return total[edge[1:]] - total[edge[:-1]]


def with_token_counts(df: DataFrame, key: str, text: str, keep: list[str], path: str = TOKENIZER_FILE) -> DataFrame:
    """(key, *keep, n_tokens): ``n_tokens`` of ``text``, 0 where it is null or empty."""
    from pyspark.sql import types as T

    own = df.select(key, *keep, F.col(text).alias("_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    df.sparkSession.sparkContext.addFile(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(path))
        for b in batches:
            n = pa.array(count_batch(b.column(b.num_columns - 1), sent), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return own.mapInArrow(count, schema)
