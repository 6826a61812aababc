"""Inference math of the gated fusion and of embeddings, as array expressions; numpy only for the small networks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.storage import materialize


def softmax(x: Column) -> Column:
    """Softmax of an array of doubles; the largest value is taken off first."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(x: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(p: Column) -> Column:
    """ln(p / (1 - p)) with p kept 1e-6 away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def gated(lm: Column, retrieval: Column, beta: Column) -> Column:
    """Fused logits: beta times the language model's plus the rest times retrieval's. One retrieval logit counts for and against."""
    wide = F.when(F.size(retrieval) == 1, F.array(retrieval[0], -retrieval[0])).otherwise(retrieval)
    return F.zip_with(lm, wide, lambda a, b: beta * a + (1 - beta) * b)


def info_nce(positive: Column, negatives: Column, temperature: float, penalty: Column | float = 0.0) -> Column:
    """-ln of the positive's share among the exponentials of all similarities, and a penalty such as ``ridge`` gives."""
    p = F.exp(positive / temperature)
    return -F.log(p / (p + F.aggregate(negatives, F.lit(0.0), lambda a, v: a + F.exp(v / temperature)) + 1e-8) + 1e-8) + penalty


def ridge(strength: float, *weights: Column) -> Column:
    """``strength`` times the sum of the squared weights."""
    return F.lit(strength) * sum((w * w for w in weights[1:]), weights[0] * weights[0])


def cross_entropy(probabilities: Column, label: Column, weights: list[float], penalty: Column | float = 0.0) -> Column:
    """Weighted negative log-probability of the label, and a penalty such as ``ridge`` gives."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), label + 1)
    return -w * F.log(F.element_at(probabilities, label + 1) + 1e-12) + penalty


def unit(x: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return F.transform(x, lambda v: v / F.when(norm == 0, 1.0).otherwise(norm))


def centroids(df: DataFrame, cluster: str, vector: str, normalized: bool = False) -> DataFrame:
    """(cluster, centroid): mean vectors, of length 1 with ``normalized``; one aggregation per dimension value, no vectors collected."""
    parts = df.select(cluster, F.posexplode(vector).alias("d", "x")).groupBy(cluster, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centroid"))
    return out.withColumn("centroid", unit(F.col("centroid"))) if normalized else out


def medoids(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(cluster, medoid, size): the member most similar to its centroid; ties and zero centroids give the smallest key."""
    from factloom.operators.retrieval import cosine, small

    both = df.join(small(centroids(df, cluster, vector)), cluster)
    sim = F.coalesce(F.round(cosine(F.col(vector), F.col("centroid")), 9), F.lit(-2.0))
    return both.groupBy(cluster).agg(F.max_by(key, F.struct(sim, -F.col(key))).alias("medoid"), F.count("*").alias("size"))


def tf_idf(docs: DataFrame, key: str, tokens: Column, n_docs: int) -> DataFrame:
    """(key, term, weight): counts times ln((1 + n) / (1 + df)) + 1, each document's vector of length 1. Terms of one and two words."""
    t = docs.select(key, tokens.alias("t"))
    pairs = F.zip_with("t", F.slice("t", 2, 1_000_000_000), lambda a, b: F.concat_ws(" ", a, b))
    grams = t.select(key, F.explode(F.concat("t", F.filter(pairs, lambda p: p.contains(" ")))).alias("term"))
    tf = grams.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).select(key, "term", "weight")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=object)


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two texts (longest matching blocks). Its time grows with the product of their lengths."""
    return F.pandas_udf(_ratio, T.DoubleType())(a, b)


class SlotNetwork:
    """Attention over retrieval slots, then a two-layer network; weights from a seed or given."""

    def __init__(self, slots: int, classes: int = 3, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        g = np.random.default_rng(seed)
        n = lambda *s: (g.standard_normal(s) * 0.1)
        self.slots = slots
        self.w = weights or {"a1": n(4, 16), "b1": n(16), "a2": n(16, 1), "c1": n(4 * slots, 64), "d1": n(64), "c2": n(64, 64), "d2": n(64), "m1": n(64, 128), "e1": n(128), "m2": n(128, classes), "e2": n(classes)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, slots, 4) features to (n, 64)."""
        w = self.w
        a = np.tanh(x @ w["a1"] + w["b1"]) @ w["a2"]
        a = np.exp(a - a.max(1, keepdims=True))
        flat = (x * (a / a.sum(1, keepdims=True))).reshape(len(x), -1)
        return np.maximum(flat @ w["c1"] + w["d1"], 0) @ w["c2"] + w["d2"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return np.maximum(self.encode(x) @ w["m1"] + w["e1"], 0) @ w["m2"] + w["e2"]


def with_slot_logits(df: DataFrame, features: str, network: SlotNetwork) -> DataFrame:
    """``df`` with ``retrieval_logits``: the network over padded feature matrices, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField("retrieval_logits", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.zeros((len(b), network.slots, 4))
            for i, rows in enumerate(b[features]):
                for j, r in enumerate(list(rows if rows is not None else [])[: network.slots]):
                    x[i, j] = r
            yield b.assign(retrieval_logits=list(network.logits(x)))

    return df.mapInPandas(run, schema)


def with_scores(df: DataFrame, prompt: str, scorer: Callable[[list[str]], np.ndarray], name: str = "lm_logits") -> DataFrame:
    """``df`` with label logits of a pluggable scorer, which gets prompts and returns one row of logits each."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [list(map(float, r)) for r in scorer(b[prompt].tolist())]})

    return df.mapInPandas(run, schema)


def lexical_scorer(prompts: list[str]) -> np.ndarray:
    """A stand-in scorer for tests: word overlap of the claim with the evidence decides between support and no information."""
    out = []
    for p in prompts:
        claim, _, evidence = p.partition("Evidence:")
        c, e = set(claim.partition("Claim:")[2].lower().split()), set(evidence.lower().split())
        share = len(c & e) / len(c) if c else 0.0
        negated = any(w in e for w in ("không", "not", "phủ", "denied"))
        out.append([2 * share - negated, share + negated - 0.5, 1 - share])
    return np.array(out).reshape(len(prompts), 3)


def triplets(claims: DataFrame, key: str, claim: str, evidence: str, negatives: int = 3, bucket_rows: int = 1_000) -> DataFrame:
    """(key, anchor, positive, negatives): evidence of other claims drawn by hash within buckets; fewer than wanted are repeated.

    Claims meet only those next in order in their hash bucket of about ``bucket_rows`` rows, so no task gets more, and the work
    grows with the rows, not with their square. A claim whose neighbours all carry its own evidence draws from a few distinct
    texts of the whole table instead; where the table has no other text, its own pads, so that every claim with evidence has a row.
    """
    rows = claims.where(F.col(evidence).isNotNull() & (F.trim(evidence) != "")).select(key, F.col(claim).alias("anchor"), F.col(evidence).alias("positive"))
    # one more than wanted: one of them may be the claim's own
    spare = rows.select("positive").distinct().orderBy(F.xxhash64("positive", F.lit(2)), "positive").limit(negatives + 1).agg(F.collect_list("positive").alias("spare"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(max(1, rows.count() // bucket_rows))))
    w = W.partitionBy("bucket").orderBy(F.xxhash64(key, F.lit(1)), key)
    near = F.filter(F.array(*[F.lead("positive", i).over(w) for i in range(1, negatives + 1)], *[F.lag("positive", i).over(w) for i in range(1, negatives + 1)]), lambda x: x.isNotNull())
    rows = rows.withColumn("near", near).crossJoin(F.broadcast(spare))
    differing = lambda c: F.filter(c, lambda x: x != F.col("positive"))
    rows = rows.withColumn("others", differing("near"))
    rows = rows.withColumn("others", F.when(F.size("others") > 0, F.col("others")).otherwise(differing("spare")))
    others = F.when(F.size("others") > 0, F.col("others")).otherwise(F.array("positive"))
    padded = F.slice(F.flatten(F.array_repeat(others, negatives)), 1, negatives)
    return rows.select(key, "anchor", "positive", padded.alias("negatives"))


def choose_clusters(df: DataFrame, vector: str, least: int = 2, most: int = 6, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``: k-means with the number of clusters of the best cosine silhouette, the smallest of equals.

    Two rows or fewer are one cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if n <= 2:
        return df.withColumn("cluster", F.lit(0))
    # written once: every number of clusters and every iteration reads the unit vectors again
    ready = materialize(df.withColumn("_u", unit(F.col(vector))), "unit_vectors").withColumn("_v", array_to_vector("_u")).drop("_u")
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine")
    best, score = None, -2.0
    for k in range(max(2, least), min(most, n - 1) + 1):
        out = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready).transform(ready)
        if out.select("cluster").distinct().count() < 2:
            continue
        s = judge.evaluate(out)
        if s > score:
            best, score = out, s
    return (best if best is not None else ready.withColumn("cluster", F.lit(0))).drop("_v")
