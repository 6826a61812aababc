"""Text statistics per document and rules that tell prose from lists, tables and junk (problem 10).

The statistics are native column expressions over the whole text. An ordered rule list is induced by
incremental reduced-error pruning from rated documents: for each unusual kind, rules are grown condition
by condition on two thirds of the ratings, pruned on the rest and kept while they are right more often
than wrong there. The learned thresholds are exported as one SQL CASE expression, which then classifies
every document inside the plan. Mistaken ratings are tolerated: a rule needs several of them to appear.

The ratings used are bounded by ``max_ratings`` (a documented parameter, chosen by a hash of the key);
statistics and classification cover all documents. Null texts count as empty; an empty text has the
statistics 0 and is junk, as it has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.charform import form_column
from factloom.llm.patterns import WORD_CHARS

# Frequent function words of Vietnamese and English prose.
COMMON_WORDS = (
    "và của là các có cho trong được với không một đã để khi này từ về đến ở tại theo những người sẽ bị cũng như vì do mà nên thì "
    "rằng nếu còn phải vào ra lên lại sau trước rất chỉ cùng hay hoặc nhưng giúp nhằm khoảng rồi hơn nhiều "
    "the of and to in a is that for on was with as it by at from an be are this which or have its has had they were but not "
    "what when why while once after before than more only so if their been would will"
).split()
FEATURES = (
    "n_words mean_word_length symbol_ratio digit_ratio n_lines words_per_line end_punctuation_share common_word_share "
    "distinct_word_share broken_word_share mixed_word_share bullet_share cell_ratio sentence_words"
).split()


def statistics(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the columns of ``FEATURES`` for each row; shares of nothing are 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = documents.select(*keep, t.alias("t"), F.split(F.lower(form_column(t)), " ").alias("w"))
    n_words = F.when(F.get("w", F.lit(0)) == "", 0).otherwise(F.size("w"))
    n = lambda pattern: F.regexp_count("t", F.lit(pattern))  # noqa: E731; each pattern first tests the one character that most places fail
    some = base.withColumns({
        "n_words": n_words, "n_chars": F.length("t"),
        "n_lines": n("(?:^|\\n)[^\\S\\n]*\\S"), "ends": n("(?m)[.!?…。:;][\"'”’)\\]]*\\s*$"),
        "symbols": n(f"[^a-zA-Z0-9\\s{WORD_CHARS}]"), "digits": n("[0-9]"),
        "broken": n(f"(?=[^a-zA-Z0-9\\s'’.\\u00AD{WORD_CHARS}-])(?<=\\p{{L}})[^\\n](?=\\p{{L}})"), "mixed": n("(?=[0-9])(?:(?<=\\p{L})[0-9]|[0-9](?=\\p{L}))"),
        "bullets": n("(?m)^\\s*(?:[-–•*+]|\\d+[.)]|https?://|#)"), "cells": n("(?=[|\\t ,])(?:[|\\t]| {3,}|(?<=[0-9]),(?=[0-9]))"),
        "sentences": n("[.!?。](?=\\s|$)"),
        "common": F.size(F.filter("w", lambda w: w.isin(*COMMON_WORDS))),
        "kinds": F.size(F.array_distinct("w")),
    })
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return some.select(
        *keep, F.col("n_words").cast("double").alias("n_words"),
        F.coalesce(F.try_divide((F.col("n_chars") - F.col("n_words") + 1).cast("double"), F.col("n_words")), F.lit(0.0)).alias("mean_word_length"),
        share("symbols", "n_chars").alias("symbol_ratio"), share("digits", "n_chars").alias("digit_ratio"), F.col("n_lines").cast("double").alias("n_lines"),
        share("n_words", "n_lines").alias("words_per_line"), share("ends", "n_lines").alias("end_punctuation_share"), share("common", "n_words").alias("common_word_share"),
        share("kinds", "n_words").alias("distinct_word_share"), share("broken", "n_words").alias("broken_word_share"), share("mixed", "n_words").alias("mixed_word_share"),
        share("bullets", "n_lines").alias("bullet_share"), share("cells", "n_words").alias("cell_ratio"), share("n_words", "sentences").alias("sentence_words"),
    )


@dataclass(frozen=True)
class Rule:
    """A kind and the conditions (feature, sign, threshold) that all must hold; sign 1 means at least, -1 at most."""

    kind: str
    conditions: tuple[tuple[str, int, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for name, sign, limit in self.conditions:
            out &= x[name] >= limit if sign > 0 else x[name] <= limit
        return out

    def sql(self) -> str:
        return " AND ".join(f"{n} {'>=' if s > 0 else '<='} {v!r}D" for n, s, v in self.conditions)


def _gain(p: np.ndarray, q: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, kind: str, most: int = 6) -> Rule:
    rows, conditions = np.ones(len(y), dtype=bool), []
    while len(conditions) < most and (~y[rows]).any():
        best = (1e-9, None)
        p0, n0 = float(y[rows].sum()), float((~y[rows]).sum())
        for name in FEATURES:
            v, good = x[name][rows], y[rows]
            order = np.argsort(v, kind="stable")
            v, good = v[order], good[order]
            last = np.append(v[1:] != v[:-1], True)  # only cut between different values
            below_p, below_n = np.cumsum(good).astype(float), np.cumsum(~good).astype(float)
            for sign, p, n in ((-1, below_p, below_n), (1, p0 - below_p, n0 - below_n)):
                gain = np.where(last, _gain(p, n, p0, n0), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0] and (sign < 0 or k + 1 < len(v)):
                    nxt = v[min(k + 1, len(v) - 1)]
                    best = (gain[k], (name, sign, float(f"{(v[k] + nxt) / 2:.6g}")))
        if best[1] is None:
            break
        name, sign, limit = best[1]
        keep = x[name] >= limit if sign > 0 else x[name] <= limit
        if (rows & keep).sum() == rows.sum():
            break
        rows &= keep
        conditions.append(best[1])
    return Rule(kind, tuple(conditions))


def _worth(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> float:
    hit = rule.holds(x)
    p, n = y[hit].sum(), (~y[hit]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: dict[str, np.ndarray], labels: np.ndarray, default: str = "prose", seeds: int = 6) -> list[Rule]:
    """The ordered rule list; rarer kinds first, ``default`` where no rule holds.

    Of lists grown from several random divisions the one with the fewest errors and rules is kept.
    """
    best: tuple[float, list[Rule]] | None = None
    for seed in range(seeds):
        rules = _induce_once(x, labels, default, seed)
        said = np.full(len(labels), default, dtype=object)
        for rule in reversed(rules):
            said[rule.holds(x)] = rule.kind
        cost = float((said != labels).sum()) + len(rules)
        if best is None or cost < best[0]:
            best = (cost, rules)
    return best[1] if best else []


def _induce_once(x: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int, min_worth: float = 0.3) -> list[Rule]:
    kinds, n = np.unique(labels, return_counts=True)
    rules: list[Rule] = []
    left = np.ones(len(labels), dtype=bool)
    rand = np.random.default_rng(seed)
    for kind in [k for _, k in sorted(zip(n.tolist(), kinds.tolist(), strict=True)) if k != default]:
        failures = 0
        while (left & (labels == kind)).sum() >= 3 and failures < 8:
            at = rand.permutation(np.flatnonzero(left))
            grow, prune = at[: len(at) * 2 // 3], at[len(at) * 2 // 3 :]
            part = lambda rows: ({f: x[f][rows] for f in FEATURES}, labels[rows] == kind)  # noqa: B023,E731
            if not (labels[grow] == kind).any():
                break
            rule = _grow(*part(grow), kind)
            while len(rule.conditions) > 1:
                shorter = Rule(kind, rule.conditions[:-1])
                if _worth(shorter, *part(prune)) < _worth(rule, *part(prune)):
                    break
                rule = shorter
            own, good = part(np.flatnonzero(left))
            if not rule.conditions or _worth(rule, *part(prune)) < min_worth or good[rule.holds(own)].sum() < 3:
                failures += 1
                continue
            rules.append(rule)
            left &= ~rule.holds(x)
    return rules


def case_sql(rules: list[Rule], default: str = "prose") -> str:
    """The rule list as one SQL CASE expression; a document without words is junk before any rule."""
    whens = "".join(f" WHEN {r.sql()} THEN '{r.kind}'" for r in rules)
    return f"CASE WHEN n_words = 0 THEN 'junk'{whens} ELSE '{default}' END"


def learn(stats: DataFrame, key: str, labels: DataFrame, label: str, max_ratings: int = 20_000) -> list[Rule]:
    """Rules from the rated documents, the ones with the smallest hashes if there are more than ``max_ratings``.

    A document rated twice counts twice; ratings without label or document don't count.
    """
    rated = labels.where(F.col(label).isNotNull()).orderBy(F.xxhash64(key), label).limit(max_ratings)
    rows = stats.join(F.broadcast(rated.select(key, F.col(label).alias("_label"))), key).select(*FEATURES, "_label").toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values([*FEATURES, "_label"], kind="stable")
    return induce({f: rows[f].to_numpy(dtype=float) for f in FEATURES}, rows["_label"].to_numpy(dtype=str))


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``kind``."""
    return stats.withColumn("kind", F.expr(case_sql(rules)))
