"""Evidence fields, chunks and budgets."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import collapse_blank


def _literal(values: pd.Series) -> pd.Series:
    out = []
    for v in values:
        got = None
        if v is not None and v.strip().startswith("[") and v.strip().endswith("]"):
            try:
                parsed = ast.literal_eval(v.strip())
                got = [str(x) for x in parsed] if isinstance(parsed, list) else None
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                got = None
        out.append(got)
    return pd.Series(out, dtype=object)


def literal_list(text: Column) -> Column:
    """The items of a text that is a list literal; null for any other. Only texts in brackets visit Python."""
    udf = F.pandas_udf(_literal, T.ArrayType(T.StringType()))
    return udf(F.when(F.trim(text).startswith("[") & F.trim(text).endswith("]"), text))


def joined_evidence(text: Column) -> Column:
    """Null to the empty text, a list literal to its items joined by ``|||``, else trimmed."""
    return F.coalesce(F.array_join(literal_list(text), "|||"), F.trim(text), F.lit(""))


def evidence_items(text: Column) -> Column:
    """Items parted by ``|||`` if it occurs, else by line feeds."""
    return F.when(text.contains("|||"), F.split(text, "\\|\\|\\|")).otherwise(F.split(text, "\n"))


def distinct_statements(items: Column) -> Column:
    """Items of 10 characters and more, trimmed, each once whatever its case."""
    parts = F.filter(F.transform(items, F.trim), lambda x: F.length(x) >= 10)
    low = F.transform(parts, F.lower)
    return F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == (i + 1).cast("long"))


def evidence_list(text: Column) -> Column:
    """The distinct statements of a text parted at line feeds or a period with two blanks."""
    return distinct_statements(F.split(text, "\\n+|\\.  "))


def with_evidence_list(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the distinct items of a list literal, else those of ``evidence_list``, in a column."""
    own = df.withColumn("_literal", literal_list(F.col(text)))  # a column of its own: a function over arrays may not call Python
    return own.withColumn(name, F.coalesce(distinct_statements(F.col("_literal")), evidence_list(F.col(text)))).drop("_literal")


def budgeted(df: DataFrame, key: str, items: Column, budget: int, cost: Column | None = None) -> DataFrame:
    """(key, evidence, n_items): numbered items until the first that would exceed the budget.

    Blank items are skipped but keep their number. ``cost`` is a function of column ``item``, by default its words.
    """
    rows = df.select(key, F.posexplode_outer(items).alias("pos", "raw"))
    rows = rows.withColumn("item", F.trim("raw")).withColumn("kept", F.coalesce(F.col("item") != "", F.lit(False)))
    words = F.size(F.split(F.col("item"), "\\s+"))
    rows = rows.withColumn("cost", F.when(F.col("kept"), cost if cost is not None else words).otherwise(0))
    used = F.sum("cost").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).withColumn("kept", F.col("kept") & (F.col("used") <= budget))
    line = F.when(F.col("kept"), F.struct("pos", F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "item", F.lit("\n")).alias("s")))
    lines = F.array_sort(F.collect_list(line))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["s"]), "").alias("evidence"), F.count(line).alias("n_items"))


def sentences(text: Column) -> Column:
    """Sentences of a text, not parted behind a single capital with a period."""
    return F.filter(F.split(text, r"(?<!\b\p{Lu}\.)(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def packed(text: Column, most: int = 1500) -> Column:
    """Sentences packed greedily into chunks of at most ``most`` characters; a longer sentence is its own chunk.

    A text within the limit is one chunk; a blank text has none.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) + 1 <= most
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], s).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))

    many = F.aggregate(sentences(text), start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.length(text) > most, many).otherwise(F.filter(F.array(text), lambda t: F.trim(t) != ""))


def chunks(df: DataFrame, key: str, url: Column, title: Column, text: Column, most: int = 1500) -> DataFrame:
    """(key, chunk_no, chunk_id, content): chunks with the title in front, ids from address and number."""
    rows = df.select(key, url.alias("_u"), title.alias("_t"), F.posexplode(packed(text, most)).alias("chunk_no", "_c"))
    return rows.select(
        key, "chunk_no", F.md5(F.concat_ws("_", F.coalesce("_u", F.lit("")), F.col("chunk_no").cast("string"))).alias("chunk_id"),
        F.concat_ws(" ", F.nullif(F.col("_t"), F.lit("")), "_c").alias("content"))


def timed(text: Column, time: Column) -> Column:
    """An evidence text with the time of its information in front; the text alone without a time."""
    return F.coalesce(F.concat(F.lit("[Thời gian của thông tin: "), F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC] "), text), text)
