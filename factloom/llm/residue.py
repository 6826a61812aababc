"""Posts with template residue, filler or an error page in place of the article (problem 5).

A regularised linear classifier over hashed byte n-grams of the body, its length and shape, and the
title. The body is the post in its folded visual form, figures masked, without the lines its site repeats.
Weak labels come from response statuses and phrases: a short body made of such phrases, without
lines of prose, is a positive; a body of prose is a negative, also if it mentions such a thing in passing.
Everything between is left unlabelled and is for the classifier to decide.

Training takes its weak labels from a bounded, documented sample of ``max_sample`` documents, of which it reads at
most ``max_train`` rows of each label, chosen by hash; the validation labels every post.
Hosts are divided by hash as well: a quarter of them is kept out of training and used to validate.
Scoring covers every post and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import boilerplate
from factloom.llm.patterns import alternatives
from factloom.storage import materialize

BITS, GRAM = 18, 6
# Statuses and phrases of pages without content, in small letters; figures appear as #.
PHRASES = (
    "# not found", "# bad gateway", "# service unavailable", "# forbidden", "# internal server error", "# gateway timeout", "# gateway time-out",
    "access denied", "request was blocked", "fatal error", "stack trace", "uncaught exception", "error code", "mã sự cố", "mã lỗi", "reference:",
    "không tìm thấy trang", "page not found", "page was not found", "không tồn tại hoặc đã bị gỡ", "bảo trì", "maintenance", "temporarily unavailable",
    "javascript", "scripts to run", "turn scripts on", "loading...", "đăng nhập để", "log in first", "log in to", "login to", "sign in to",
    "phiên làm việc", "session expired", "session has expired", "cookie", "not available in your region", "lorem ipsum", "dolor", "consectetur",
    "did not answer in time", "nginx", "trình duyệt của bạn", "your browser", "are you a robot", "not a robot", "captcha", "subscribe to read",
    "subscribe to continue", "đang cập nhật", "đang được cập nhật", "coming soon", "placeholder", "sample text", "văn bản mẫu", "tiêu đề mẫu",
    "nội dung mẫu", "chèn nội dung", "headline goes here", "text goes here", "replace this text", "thay đoạn này", "quá nhiều yêu cầu",
    "too many requests", "không phải người máy", "không phải robot", "không phải là robot", "asdf", "qwerty", "xx/xx/xxxx",
)
SLOTS = r"\{\{[^{}]*\}\}|\$\{[^{}]*\}|<%[^%]*%>|\[\[[^\[\]]*\]\]|\{#\}|%[a-z_]+%|__[a-z_]+__|\[[\p{L}_ #]+\]|_{3,}|#ref!|#n/a|#value!|\[object object\]|\bundefined\b|\bnan\b"
MARKS = r"[{$<\[_%#](?=[{%\[_a-z(])"
DENSE = ("chars", "lines", "prose", "marks", "no_title", "title_in_body", "repeated_lines", "distinct_words")


def bodies(digests: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_key, source, left, body and the columns of DENSE).

    ``digests`` comes from ``boilerplate.digest_lines`` with the title kept and the lines; ``left`` are the
    lines that are neither blank nor repeated. A source without repeated lines keeps all its lines.
    """
    by_source = materialize(boilerplate.per_source(repeated), "repeated")
    if boilerplate.count_at_most(by_source, boilerplate.BROADCAST_SOURCES) <= boilerplate.BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    own = digests.select("doc_key", "source", "src", "title", "k", "lines").join(by_source, "src", "left")
    known = F.coalesce("repeated", F.array().cast("array<bigint>"))
    left = F.filter("k", lambda x, i: (x != "") & ~F.array_contains(known, F.get("lines", i)))
    own = own.select("doc_key", "source", F.lower(F.trim("title")).alias("title"), left.alias("left")).withColumn("body", F.array_join("left", "\n"))
    words = F.split("body", "[ \\n]")
    head = F.regexp_replace(F.substring("title", 1, 30), "[0-9]+(?:[.,][0-9]+)*", "#")
    return own.select(
        "doc_key", "source", "left", "body",
        F.log1p(F.length("body").cast("double")).alias("chars"), F.log1p(F.size("left").cast("double")).alias("lines"),
        F.size(F.filter("left", lambda x: F.length(x) >= 60)).cast("double").alias("prose"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.regexp_count("body", F.lit(MARKS)), F.length("body")), F.lit(0.0)).alias("marks"),
        F.when(F.col("title").isNull() | (F.col("title") == ""), 1.0).otherwise(0.0).alias("no_title"),
        F.coalesce(F.contains(F.col("body"), head).cast("double"), F.lit(0.0)).alias("title_in_body"),
        (1 - F.coalesce(F.try_divide(F.size(F.array_distinct("left")).cast("double"), F.size("left")), F.lit(1.0))).alias("repeated_lines"),
        F.coalesce(F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words)), F.lit(1.0)).alias("distinct_words"),
    )


def sample(digests: DataFrame, max_sample: int = 8_000) -> DataFrame:
    """At most about ``max_sample`` documents, those with the smallest hashes; all of a smaller table."""
    n = digests.count()
    if n <= max_sample:
        return digests
    return digests.where(F.shiftrightunsigned(F.xxhash64("doc_key", F.lit(5)), 1) < int(max_sample / n * (1 << 63)))


def weak_label(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weak``: 1, 0 or null. Lines of 60 characters or more without phrase or slot are taken for prose."""
    phrase = alternatives(PHRASES)
    sort = F.transform("left", lambda x: F.when(x.rlike(phrase) | x.rlike(SLOTS), 0).when(F.length(x) >= 60, 1).otherwise(2))
    rows = rows.withColumn("slots", F.regexp_count("body", F.lit(SLOTS))).withColumn("_sort", sort)
    rows = rows.withColumn("phrases", F.size(F.filter("_sort", lambda k: k == 0))).withColumn("plain", F.size(F.filter("_sort", lambda k: k == 1))).drop("_sort")
    slot_share = F.coalesce(F.try_divide(F.lit(100.0) * F.col("slots"), F.length("body")), F.lit(0.0))
    short = (F.col("plain") == 0) & (F.col("chars") < np.log1p(700.0))
    signs = F.greatest("phrases", "slots")
    positive = (short & ((F.col("phrases") > 0) | (F.col("slots") >= 2))) | ((F.col("plain") == 0) & (F.col("slots") >= 3) & (slot_share >= 0.5))
    negative = (F.col("plain") >= 2) & (signs <= 2)
    return rows.withColumn("weak", F.when(positive, 1).when(negative, 0))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def scaled(dense: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Dense features in standard units, cut at 3, so that a rare feature cannot outweigh the text."""
    return np.clip((dense - mean) / scale, -3.0, 3.0)


@dataclass
class Model:
    """Weights of the n-gram buckets, of the dense features, and the bias."""

    grams: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def score(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        total = np.concatenate(([0.0], np.cumsum(self.grams[_gram_hashes(data)], dtype=np.float64)))
        n = np.maximum(0, ends - starts - GRAM + 1)
        first = np.minimum(starts, len(total) - 1)
        sums = np.where(n > 0, total[np.minimum(first + n, len(total) - 1)] - total[first], 0.0)
        return sums / np.sqrt(np.maximum(1, n)) + scaled(dense, self.mean, self.scale) @ self.dense + self.bias


def train(texts: list[str], dense: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.08, ridge: float = 1e-4, seed: int = 1) -> Model:
    """Logistic regression with a ridge penalty, by stochastic gradient steps with per-weight rates."""
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    z = scaled(dense, mean, scale)
    docs = []
    for t in texts:
        h, c = np.unique(_gram_hashes(np.frombuffer(t.encode(), dtype=np.uint8)), return_counts=True)
        docs.append((h, c / np.sqrt(max(1, c.sum()))))
    w, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    v, bias, gv = np.zeros(z.shape[1]), 0.0, np.full(z.shape[1] + 1, 1e-3)
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    rand = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rand.permutation(len(y)):
            h, c = docs[i]
            e = (1 / (1 + np.exp(-np.clip(w[h] @ c + v @ z[i] + bias, -30, 30))) - y[i]) * weight[i]
            step = e * c + ridge * w[h]
            g[h] += step * step
            w[h] -= rate * step / np.sqrt(g[h])
            dv = e * z[i] + ridge * v
            gv[:-1] += dv * dv
            gv[-1] += e * e
            v -= rate * dv / np.sqrt(gv[:-1])
            bias -= rate * e / np.sqrt(gv[-1])
    return Model(w, v, mean, scale, float(bias))


def held_out(source: F.Column) -> F.Column:
    """Whether a host is one of the quarter kept for validation."""
    return F.pmod(F.xxhash64(source, F.lit(11)), F.lit(4)) == 0


def fit(weakly: DataFrame, max_train: int = 2_000) -> Model | None:
    """``weakly`` comes from ``weak_label``. The model from at most ``max_train`` weak labels of each value on the training hosts; None without positives."""
    labelled = weakly.where(F.col("weak").isNotNull() & ~F.coalesce(held_out(F.col("source")), F.lit(False)))
    few = lambda k, *order, n=max_train: labelled.where(F.col("weak") == k).orderBy(*order, F.xxhash64("doc_key")).limit(n)
    # half of the negatives are the shortest articles: the hard ones
    picked = few(1).unionByName(few(0, n=max_train // 2)).unionByName(few(0, "chars", n=max_train // 2))
    rows = picked.select("doc_key", "body", *DENSE, "weak").toPandas().drop_duplicates("doc_key").sort_values("doc_key", kind="stable")
    if rows.empty or rows["weak"].nunique() < 2:
        return None
    return train(rows["body"].tolist(), rows[list(DENSE)].to_numpy(dtype=float), rows["weak"].to_numpy(dtype=int))


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_key, source, score): above 0 means no article. Without a model the score is null."""
    if model is None:
        return rows.select("doc_key", "source", F.lit(None).cast("double").alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 512):  # n-gram arrays are eight times the text: keep them small
                part = b.slice(lo, 512)
                dense = np.column_stack([part.column(f).to_numpy() for f in DENSE])
                s = shared.value.score(part.column("body"), dense)
                yield pa.RecordBatch.from_arrays([part.column("doc_key"), part.column("source"), pa.array(s, pa.float64())], names=["doc_key", "source", "score"])

    return rows.select("doc_key", "source", "body", *DENSE).mapInArrow(run, "doc_key bigint, source string, score double")


def validation(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """``rows`` comes from ``weak_label``. Per group of hosts (trained on or unseen): weak labels, and how many of them the classifier confirms."""
    both = rows.where("weak is not null").select("doc_key", "weak").join(scored, "doc_key")
    group = F.when(F.coalesce(held_out(F.col("source")), F.lit(False)), "unseen").otherwise("trained")
    hit = F.col("score") > 0
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy(group.alias("hosts")).agg(
        count(F.col("weak") == 1).alias("positives"), count(F.col("weak") == 0).alias("negatives"),
        count((F.col("weak") == 1) & hit).alias("positives_found"), count((F.col("weak") == 0) & hit).alias("negatives_found"),
    )
