"""Mixed timestamp texts to one UTC instant per record (problem 4).

Every value becomes the array of its valid readings (``factloom.functions.timestamps``): either order of day and month,
the zones that share an abbreviation, both instants of a local time that occurs twice. Where there are several, a
Viterbi path over the records of one source in their order chooses. It pays for switching the format (readings of one
value differ in the order of day and month only, so that order is the state), for jumps back in time, for a reading
later than the record's arrival, for an unlikely reading, and for one against the source's declared order. The
declaration is a prior: a few records that arrived before the time it gives them outweigh it.

Sources may be of any size: records are range-partitioned by source and order, sorted, and cut into
blocks. A block's cost for each way to enter and leave it is a small min-plus table; the tables of a
source are composed in order, which fixes how each block is entered and left; the blocks then decode
on their own. The result is the same as one pass over the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.timestamps import DAY_FIRST, FREE, MONTH_FIRST, interpretations
from factloom.storage import materialize

INF = float("inf")
ORDERS = (FREE, DAY_FIRST, MONTH_FIRST)
SWITCH, BACK, AGAINST_DECLARED, MONTH_FIRST_UNDECLARED, AFTER_ARRIVAL = 1.0, 0.4, 1.5, 0.5, 4.0
ARRIVAL_SLACK = 2 * 86_400


_READINGS = T.StructType([T.StructField("orders", T.ArrayType(T.IntegerType())), T.StructField("instants", T.ArrayType(T.LongType())), T.StructField("costs", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_READINGS)
def _readings(raw: pd.Series, zone: pd.Series) -> pd.DataFrame:
    known: dict[tuple, list] = {}
    pairs = [(None if pd.isna(r) else r, None if pd.isna(z) else z) for r, z in zip(raw, zone, strict=True)]
    for p in set(pairs):
        known[p] = interpretations(*p)
    found = [known[p] for p in pairs]
    return pd.DataFrame({name: [[x[i] for x in f] for f in found] for i, name in enumerate(("orders", "instants", "costs"))})


def with_readings(records: DataFrame, raw: Column, feeds: DataFrame) -> DataFrame:
    """``records`` (which has ``source``) with orders, instants, costs and day_first.

    ``feeds`` has a row per source (source, zone_name, day_first); of repeated sources the first by zone
    counts. A value without zone of an unknown source has no reading.
    """
    feeds = feeds.where("source is not null").groupBy("source").agg(F.min_by("zone_name", "zone_name").alias("_zone"), F.min_by("day_first", "zone_name").alias("day_first"))
    joined = records.join(feeds, "source", "left").withColumn("_r", _readings(raw, F.col("_zone")))
    return joined.withColumns({"orders": F.col("_r.orders"), "instants": F.col("_r.instants"), "costs": F.col("_r.costs")}).drop("_r", "_zone")


def _with_priors(rows: DataFrame) -> Column:
    """The costs of a record's readings: their own, against the declared order, after the arrival."""
    against = F.when(F.col("day_first").isNull(), MONTH_FIRST_UNDECLARED).otherwise(AGAINST_DECLARED)
    prior = lambda o: F.when((o == MONTH_FIRST) & ~F.coalesce(~F.col("day_first"), F.lit(False)), against).when((o == DAY_FIRST) & ~F.coalesce("day_first", F.lit(True)), AGAINST_DECLARED).otherwise(0.0)
    kind = dict(rows.dtypes)["arrived"]
    arrived = F.col("arrived").cast("timestamp").cast("long") if kind.startswith("timestamp") else F.lit(None).cast("long")
    late = lambda t: F.when(t > arrived + ARRIVAL_SLACK, AFTER_ARRIVAL).otherwise(0.0)
    return F.zip_with("costs", F.zip_with("orders", "instants", lambda o, t: prior(o) + late(t)), lambda a, b: a + b)


_State = tuple[int, int]  # the order of day and month seen last, and the last instant


def _step(states: dict[_State, float], orders: list[int], instants: list[int], costs: list[float]) -> tuple[dict, dict]:
    """Advance {state: cost} by a record; returns states and {state: (state before, choice)}."""
    new: dict[_State, float] = {}
    back: dict[_State, tuple[_State, int]] = {}
    for k, (order, at, own) in enumerate(zip(orders, instants, costs, strict=True)):
        for (seen, last), cost in states.items():
            total = cost + own + (SWITCH if order and seen and order != seen else 0.0) + (BACK if at < last else 0.0)
            to = (order or seen, at)
            if total < new.get(to, INF):
                new[to] = total
                back[to] = ((seen, last), k)
    return new, back


def _first(seen: int, k: int, orders: list[int], instants: list[int], costs: list[float]) -> dict[_State, float]:
    return {(orders[k] or seen, instants[k]): costs[k] + (SWITCH if orders[k] and seen and orders[k] != seen else 0.0)}


def _rows(pdf: pd.DataFrame) -> list[tuple[list[int], list[int], list[float]]]:
    pdf.sort_values("pos", inplace=True)
    return [(list(o), list(t), list(c)) for o, t, c in zip(pdf["orders"], pdf["instants"], pdf["costs"], strict=True)]


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """The block's cost table: entered with an order seen, first choice, left with an order and an instant."""
    rows, out = _rows(pdf), []
    for seen in ORDERS:
        for k in range(len(rows[0][0])):
            states = _first(seen, k, *rows[0])
            for r in rows[1:]:
                states, _ = _step(states, *r)
            out += [(seen, k, rows[0][1][k], to, cost, last) for (to, last), cost in states.items()]
    head = (pdf["block"].iloc[0], pdf["seq"].iloc[0])
    return pd.DataFrame([(*head, *r) for r in out], columns=["block", "seq", "seen", "first", "first_at", "leave", "cost", "last_at"])


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Along one source's blocks: how each is entered (order seen, first choice) and left (order seen, last instant)."""
    states: dict[_State, float] = {(FREE, -(1 << 62)): 0.0}
    trail = []
    for block, part in pdf.groupby("block", sort=True):
        new: dict[_State, float] = {}
        back: dict[_State, tuple[_State, int]] = {}
        for r in part.itertuples():
            for (seen, last), cost in states.items():
                if r.seen != seen:
                    continue
                total, to = cost + r.cost + (BACK if r.first_at < last else 0.0), (r.leave, r.last_at)
                if total < new.get(to, INF):
                    new[to], back[to] = total, ((seen, last), r.first)
        trail.append((block, back))
        states = new
    leave = min(states, key=lambda s: (states[s], s))
    out = []
    for block, back in reversed(trail):
        before, first = back[leave]
        out.append((block, before[0], first, *leave))
        leave = before
    return pd.DataFrame(out, columns=["block", "seen", "first", "leave", "last_at"])


def _decode(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = _rows(pdf)
    states = _first(int(pdf["seen"].iloc[0]), int(pdf["first"].iloc[0]), *rows[0])
    trail = []
    for r in rows[1:]:
        states, back = _step(states, *r)
        trail.append(back)
    leave, picks = (int(pdf["leave"].iloc[0]), int(pdf["last_at"].iloc[0])), []
    for back in reversed(trail):
        leave, k = back[leave]
        picks.append(k)
    picks = [int(pdf["first"].iloc[0]), *reversed(picks)]
    chosen = [r[1][k] for r, k in zip(rows, picks, strict=True)]
    return pd.DataFrame({"record_kind": pdf["record_kind"], "record_key": pdf["record_key"], "instant": chosen})


def choose_instants(read: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """(record_kind, record_key, instant) for every record with a reading.

    ``read`` has record_kind, record_key, source, arrived, orders, instants, costs, day_first. Records of one kind
    and source form a sequence by ``arrived`` (missing first) and key; records without source form one of their own.
    ``arrived`` tells of readings that are too late only if it is a timestamp.
    """
    seq = F.xxhash64("record_kind", "source")
    rows = read.select("record_kind", "record_key", seq.alias("seq"), "arrived", "orders", "instants", _with_priors(read).alias("costs"))
    # written once: the range partitioning samples it first, and a filter would otherwise read every value twice
    rows = materialize(rows, "readings").where(F.size("instants") > 0)
    cut = rows.repartitionByRange("seq", "arrived", "record_key").sortWithinPartitions("seq", "arrived", "record_key")
    cut = cut.withColumn("pid", F.spark_partition_id().cast("long")).drop("arrived")
    schema = "record_kind string, record_key bigint, seq bigint, orders array<int>, instants array<bigint>, costs array<double>, block bigint, pos bigint"

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, used, last = 0, 0, None
        for b in batches:
            blocks, places = [], []
            for s in b["seq"].tolist():
                if s != last or used >= block_rows:
                    block, used, last = block + 1, 0, s
                blocks.append(block)
                places.append(used)
                used += 1
            yield b.assign(block=b["pid"] * (1 << 32) + blocks, pos=places).drop(columns="pid")

    blocks = materialize(cut.mapInPandas(number, schema), "blocks")
    tables = blocks.groupBy("block").applyInPandas(_summary, "block bigint, seq bigint, seen int, first int, first_at bigint, leave int, cost double, last_at bigint")
    ways = tables.groupBy("seq").applyInPandas(_compose, "block bigint, seen int, first int, leave int, last_at bigint")
    return blocks.join(ways, "block").groupBy("block").applyInPandas(_decode, "record_kind string, record_key bigint, instant bigint")


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of Unix seconds; the session's time zone plays no part."""
    return F.date_format(F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
