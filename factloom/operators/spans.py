"""Token spans: pooling over overlapping chunks, late chunking, supervised sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = -100


def token_spans(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token_no, token, start, stop): words of a text parted by single blanks, with character positions."""
    rows = df.select(key, F.posexplode(F.split(text, " ")).alias("token_no", "token"))
    before = F.coalesce(F.sum(F.length("token") + 1).over(W.partitionBy(key).orderBy("token_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before)
    return rows.withColumn("stop", F.col("start") + F.length("token")).where(F.length("token") > 0)


def fixed_chunks(df: DataFrame, key: str, text: Column, size: int) -> DataFrame:
    """(key, chunk_no, c_start, c_stop): consecutive pieces of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    rows = df.select(key, F.length(text).alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(key, "chunk_no", (F.col("chunk_no") * size).alias("c_start"), F.least(F.col("_n"), (F.col("chunk_no") + 1) * size).alias("c_stop"))


def pooled(tokens: DataFrame, chunks: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, chunk_no, n_tokens, mean): mean of a token value over the tokens that overlap a chunk. The join is on the document first."""
    both = chunks.join(tokens.select(key, "start", "stop", value.alias("_v")), key).where((F.col("start") < F.col("c_stop")) & (F.col("stop") > F.col("c_start")))
    return both.groupBy(key, "chunk_no").agg(F.count("*").alias("n_tokens"), F.avg("_v").alias("mean"))


def late_chunks(df: DataFrame, key: str, text: str, pieces: str, encode: Callable[[list[str]], np.ndarray], dim: int, most_tokens: int = 8192) -> DataFrame:
    """(key, chunk_no, embedding): each chunk's mean of the token vectors of the whole document that overlap it.

    A document over ``most_tokens`` tokens is encoded chunk by chunk; a chunk that does not stand in the text, or has no token,
    gets the zero vector. ``pieces`` is an array of texts.
    """
    schema = T.StructType([df.schema[key], T.StructField("chunk_no", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, whole, parts in zip(b[key], b[text], b[pieces], strict=True):
                if whole is None or parts is None:
                    continue
                tokens = whole.split()
                at, spans = 0, []
                for t in tokens:
                    at = whole.index(t, at)
                    spans.append((at, at + len(t)))
                    at += len(t)
                long = len(tokens) > most_tokens
                vectors = None if long else encode(tokens)
                found = 0
                for n, part in enumerate(parts):
                    mean = np.zeros(dim)
                    start = whole.find(part, found)
                    if long:
                        own = encode(part.split())
                        mean = own.mean(0) if len(own) else mean
                    elif start >= 0:
                        found = start
                        hit = [i for i, (s, e) in enumerate(spans) if s < start + len(part) and e > start]
                        mean = vectors[hit].mean(0) if hit else mean
                    out.append((k, n, mean.tolist()))
            yield pd.DataFrame(out, columns=[key, "chunk_no", "embedding"])

    return df.select(key, text, pieces).mapInPandas(run, schema)


def supervised(prompt_ids: Column, label_id: Column, end_id: int, most: int, pad_id: int = 0) -> Column:
    """struct(input_ids, labels, attention): prompt, label and end token, padded; only the label is trained on.

    A prompt that leaves no room for label and end is an error.
    """
    n = F.size(prompt_ids)
    checked = F.when(n + 2 <= most, prompt_ids).otherwise(F.raise_error(F.lit("the prompt is longer than the sequence")).cast("array<int>"))
    pad = F.lit(most) - n - 2
    return F.struct(
        F.concat(checked, F.array(label_id, F.lit(end_id)), F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(IGNORED), n), F.array(label_id), F.array_repeat(F.lit(IGNORED), pad + 1)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), n + 2), F.array_repeat(F.lit(0), pad)).alias("attention"))


def truncated(prefix_ids: Column, claim_ids: Column, middle_ids: Column, items: Column, end_ids: Column, most: int, label_ids: int = 2) -> Column:
    """The prompt's ids, cut to leave room for ``label_ids``: the claim gives way first, then whole evidence items from the first that does not fit.

    ``items`` is an array of the items' ids. A template that alone leaves no room is an error.
    """
    fixed = F.size(prefix_ids) + F.size(middle_ids) + F.size(end_ids) + label_ids
    room = F.when(fixed <= most, F.lit(most) - fixed).otherwise(F.raise_error(F.lit("the template is too long for the sequence")).cast("int"))
    claim = F.slice(claim_ids, F.lit(1), F.least(F.size(claim_ids), room))
    left = room - F.size(claim)
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(True).alias("open"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["open"] & (F.size(acc["ids"]) + F.size(item) <= left)
        return F.struct(F.when(fits, F.concat(acc["ids"], item)).otherwise(acc["ids"]).alias("ids"), fits.alias("open"))

    return F.concat(prefix_ids, claim, middle_ids, F.aggregate(items, start, step)["ids"], end_ids)
