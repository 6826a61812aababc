"""Claims to verdicts in one plan: search, fusion with temporal scores, label scores, gated fusion, explanation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import labels, text
from factloom.operators import models


def predictions(claims: DataFrame, key: str, claim: str, ranked: DataFrame, docs: DataFrame, scorer: Callable[[list[str]], np.ndarray], network: models.SlotNetwork,
                evidence_items: int = 3, gate: float = 0.5) -> DataFrame:
    """(key, claim, verdict, label_id, confidence, evidence, source_links) for every claim, in any order.

    ``ranked`` has query_id, doc_id, final_rank, score, rrf_score, recency_score, cyclicity_score; ``docs`` doc_id, text, link.
    A blank claim keeps its row, with null verdict: rows are matched by key, never by position. A claim
    without evidence is judged on an empty evidence text.
    """
    hits = ranked.join(docs.select("doc_id", F.col("text").alias("_text"), F.col("link").alias("_link")), "doc_id")
    row = F.struct("final_rank", F.trim("_text").alias("text"), F.col("_link").alias("link"), F.array(*[F.col(c).cast("double") for c in ("score", "rrf_score", "recency_score", "cyclicity_score")]).alias("x"))
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("h"))  # at most the few ranks kept of each claim
    both = claims.select(key, F.col(claim).alias("claim")).join(found, F.col(key) == F.col("query_id"), "left")
    first = F.slice(F.coalesce("h", F.array().cast(found.schema["h"].dataType)), 1, evidence_items)
    ready = both.select(
        key, "claim", F.filter(F.transform(first, lambda r: r["text"]), lambda t: t != "").alias("evidence"),
        F.array_distinct(F.filter(F.transform(first, lambda r: r["link"]), lambda u: u != "")).alias("source_links"),
        F.transform(F.coalesce("h", F.array().cast(found.schema["h"].dataType)), lambda r: r["x"]).alias("features"))
    asked = ready.withColumn("prompt", text.prompt(F.trim("claim"), F.array_join("evidence", "\n")))
    scored = models.with_slot_logits(models.with_scores(asked, "prompt", scorer), "features", network)
    p = models.softmax(models.gated(F.col("lm_logits"), F.col("retrieval_logits"), F.lit(gate)))
    judged = scored.withColumn("p", p).withColumn("label_id", F.when(F.coalesce(F.trim("claim"), F.lit("")) != "", models.argmax(F.col("p"))))
    return judged.select(
        key, "claim", F.when(F.col("label_id").isNotNull(), labels.verdict(F.col("label_id"))).alias("verdict"), "label_id",
        F.when(F.col("label_id").isNotNull(), F.array_max("p")).alias("confidence"), "evidence", "source_links")
