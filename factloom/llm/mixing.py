"""Mixing sources to target shares by balanced sampling (problem 9).

Each source gets a number of tokens: its share of the whole, no more than its cap of repeats allows.
What capped sources cannot give goes to the others in proportion to their shares, so that the total
is met as far as the caps allow. A source's rate (wanted tokens over own tokens) splits into whole
repeats for every document and a fractional inclusion probability.

Which documents get one repeat more is drawn by the cube method. The probabilities move along the
null space of two constraints, the source's expected tokens and its expected number of documents,
until all but two at most are 0 or 1 (flight). Blocks of documents fly on their own in parallel; their few
undecided documents meet in the next, smaller round. The last two of a source are the landing problem,
settled at random with the remaining probability.

Random numbers come from a hash of the document key and a seed: the same input gives the same mix.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import materialize

EPS = 1e-9


def water_fill(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens wanted of each source. Sources without tokens, share or positive cap get 0."""
    able = {s for s in shares if tokens.get(s, 0) > 0 and shares[s] > 0 and caps.get(s, 0) > 0}
    want, full = {s: 0.0 for s in shares}, set()
    while able - full:
        left = total - sum(caps[s] * tokens[s] for s in full)
        open_share = sum(shares[s] for s in able - full)
        over = {s for s in able - full if left * shares[s] / open_share >= caps[s] * tokens[s]}
        if not over:
            return want | {s: float(caps[s] * tokens[s]) for s in full} | {s: left * shares[s] / open_share for s in able - full}
        full |= over
    return want | {s: float(caps[s] * tokens[s]) for s in full}


def fly(probs: np.ndarray, sizes: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Flight phase: move ``probs`` until at most two are fractional, keeping sum(probs) and sum(probs * sizes).

    Documents are taken three at a time; for three sizes the null space has one direction, in closed form.
    """
    p, x = probs.tolist(), sizes.tolist()
    todo = [i for i, q in enumerate(p) if EPS < q < 1 - EPS]
    todo.reverse()
    held: list[int] = []
    r = 0
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            return np.array(p)
        a, b, c = held
        u = (float(x[b] - x[c]), float(x[c] - x[a]), float(x[a] - x[b]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u, strict=True) if v)
        step = up if rand[r % len(rand)] * (up + down) < down else -down
        r += 1
        for i, v in zip(held, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        held = [i for i in held if 0.0 < p[i] < 1.0]


def land(probs: np.ndarray, sizes: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Landing: settle the fractional documents one after the other, each at random with its probability
    moved by what the ones before it gave too much or too little, in tokens."""
    p, debt = probs.tolist(), 0.0
    for i in np.flatnonzero((probs > EPS) & (probs < 1 - EPS)).tolist():
        aim = min(1.0, max(0.0, p[i] + debt / sizes[i]))
        took = 1.0 if rand[i] < aim else 0.0
        debt += (p[i] - took) * sizes[i]
        p[i] = took
    return np.round(np.array(p))


def _round(rows: DataFrame, last: bool) -> DataFrame:
    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "doc_key"], kind="stable")
        sizes = pdf["n_tokens"].to_numpy()
        rand = np.modf(pdf["u"].to_numpy() * 1_048_573.0)[0]  # the order uses the high bits, the draws the low ones
        p = fly(pdf["p"].to_numpy(dtype=float), sizes, rand)
        if last:
            p = land(p, sizes, rand)
        return pd.DataFrame({"doc_key": pdf["doc_key"], "source": pdf["source"], "n_tokens": pdf["n_tokens"], "u": pdf["u"], "p": p})

    return rows.groupBy("source", "block").applyInPandas(move, "doc_key bigint, source string, n_tokens bigint, u double, p double")


def draw(rows: DataFrame, counts: dict[str, int], block_rows: int = 20_000) -> DataFrame:
    """(doc_key, source, n_tokens, extra): 1 for the documents drawn by the cube method, else 0.

    ``rows`` has doc_key, source, n_tokens, u (random in [0, 1)) and p; ``counts`` the fractional
    documents per source. A block holds about ``block_rows`` documents whatever a source's size.
    """
    done: list[DataFrame] = []
    most = max(counts.values(), default=0)
    while True:
        last = most <= block_rows
        n_blocks = {s: max(1, -(-n // block_rows)) for s, n in counts.items()}
        table = F.create_map(*[F.lit(v) for kv in n_blocks.items() for v in kv]) if n_blocks else None
        blocks = table[F.col("source")] if table is not None else F.lit(1)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_key", F.lit(most)), blocks.cast("long")))
        moved = materialize(_round(rows, last), "flight")
        if last:
            done.append(moved)
            break
        done.append(moved.where(f"p <= {EPS} or p >= {1 - EPS}"))
        rows = moved.where(f"p > {EPS} and p < {1 - EPS}")
        counts = {s: 2 * n for s, n in n_blocks.items()}
        most = max(counts.values())
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_key", "source", "n_tokens", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("extra"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, block_rows: int = 20_000) -> tuple[DataFrame, dict[str, dict]]:
    """Copies per document and the plan per source.

    ``sized`` has doc_key, source, n_tokens; ``targets`` source, target_share, max_repeats (a small fixed
    table; of repeated sources the first by share counts). Documents without source take no part; documents
    of a source without target, and documents without tokens, get 0 copies. Returns (doc_key, source,
    n_tokens, copies) for every document that has a source, and {source: wanted, rate, ...}.
    """
    sized = sized.where("source is not null")
    sums = {r["source"]: (r["t"] or 0, r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.sum((F.col("n_tokens") > 0).cast("long")).alias("n")).join(F.broadcast(targets.select("source").distinct()), "source").collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    goal: dict[str, tuple[float, int]] = {}
    for r in targets.where("source is not null").orderBy(F.desc("target_share")).collect():
        goal.setdefault(r["source"], (r["target_share"] or 0.0, r["max_repeats"] or 0))
    tokens = {s: t for s, (t, _) in sums.items()}
    want = water_fill(tokens, {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()}, float(total))
    plan = {s: {"wanted": w, "rate": w / tokens[s] if tokens.get(s) else 0.0, "tokens": tokens.get(s, 0)} for s, w in want.items()}
    rate = F.lit(0.0)
    if plan:
        rate = F.coalesce(F.create_map(*[F.lit(v) for s, x in plan.items() for v in (s, round(x["rate"], 12))])[F.col("source")], F.lit(0.0))
    rows = sized.withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    open_ones = f"p > {EPS} and p < {1 - EPS}"
    counts = {s: sums[s][1] for s in sums if EPS < plan[s]["rate"] % 1 < 1 - EPS}
    fixed = rows.where(f"not ({open_ones})").select("doc_key", "source", "n_tokens", (F.col("whole") + F.when(F.col("p") > 0.5, 1).otherwise(0)).alias("copies"))
    if not counts:
        return fixed, plan
    drawn = draw(rows.where(open_ones).select("doc_key", "source", "n_tokens", "u", "p"), counts, block_rows)
    whole = F.create_map(*[F.lit(v) for s in counts for v in (s, int(plan[s]["rate"]))])[F.col("source")]
    return fixed.unionByName(drawn.select("doc_key", "source", "n_tokens", (whole + F.col("extra")).cast("long").alias("copies"))), plan


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, tokens before and after, target and actual share, largest repeat."""
    sums = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("own_tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"),
        F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"),
    )
    out = targets.join(sums, "source", "left").fillna(0, ["n_docs", "own_tokens", "mixed_tokens", "n_copies", "most_repeats"])
    whole = out.agg(F.sum("mixed_tokens").alias("_all"))
    return out.join(F.broadcast(whole)).withColumn("actual_share", F.coalesce(F.try_divide("mixed_tokens", "_all"), F.lit(0.0))).drop("_all")


def sized_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_key, source, n_tokens), written once; documents without source are left out before tokenizing."""
    from factloom.llm.tokens import TOKENIZER_FILE, with_token_counts

    own = documents.where("source is not null").select(F.col("doc_id").alias("doc_key"), "source", "text")
    return materialize(with_token_counts(own, "doc_key", "text", ["source"], tokenizer or TOKENIZER_FILE), "sized")
