import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions.timestamps import DAY_FIRST, FREE, MONTH_FIRST, as_text, interpretations, readings
from factloom.operators import timelines

HCM, NY = "Asia/Ho_Chi_Minh", "America/New_York"


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("2024-05-01T10:00:00Z", None, "2024-05-01T10:00:00Z"),
        ("2024-05-01 10:00:00+07", None, "2024-05-01T03:00:00Z"),
        ("2023-03-10T00:12:26.5+05:30", None, "2023-03-09T18:42:26Z"),
        ("2024-05-01", HCM, "2024-04-30T17:00:00Z"),
        ("20250826T053125Z", None, "2025-08-26T05:31:25Z"),
        ("20240131", NY, "2024-01-31T05:00:00Z"),
        ("1688484130.9", None, "2023-07-04T15:22:10Z"),
        ("1738238883884", None, "2025-01-30T12:08:03Z"),
        ("06:32 ngày 8 tháng 6 năm 2023 (UTC+07:00)", None, "2023-06-07T23:32:00Z"),
        ("Thứ Bảy, 15/11/2025 - 13:52 (GMT+7)", None, "2025-11-15T06:52:00Z"),
        ("24/5/2021 12:13 SA", HCM, "2021-05-23T17:13:00Z"),
        ("25/6/2021 12:30 CH", HCM, "2021-06-25T05:30:00Z"),
        ("March 21, 2023 at 3:13 AM", NY, "2023-03-21T07:13:00Z"),
        ("27 November 2022, 4:27pm", "Europe/London", "2022-11-27T16:27:00Z"),
        ("2 January 2023 19:22:47 AEDT", None, "2023-01-02T08:22:47Z"),
        ("Sat, 10 Jul 2021 04:53:23 +0700", None, "2021-07-09T21:53:23Z"),
        ("16/02/23 05:00", HCM, "2023-02-15T22:00:00Z"),
        ("2022-03-13 02:30", NY, "2022-03-13T07:30:00Z"),  # skipped: the offset before holds
        ("2025-11-02 01:30:00", NY, "2025-11-02T05:30:00Z"),  # twice: the earlier
    ],
)
def test_readings(raw, zone, want):
    assert as_text(readings(raw, zone)[0][1]) == want


@pytest.mark.parametrize("raw", [None, "", " ", "just now", "2 giờ trước", "06/2023", "2024", "2021-06-", "31/02/2024", "2022-02-30", "0000-00-00", "lúc 14:05", "quý 2", "N/A", "2023-13-05 10:00:00", "x" * 100_000])
def test_no_reading(raw):
    assert readings(raw, HCM) == []


def test_no_zone_no_instant():
    assert readings("2024-05-01 10:00", None) == []
    assert readings("2024-05-01 10:00", "No/Where") == []


def test_orders():
    assert [o for o, _ in readings("05/06/2024", HCM)] == [DAY_FIRST, MONTH_FIRST]
    assert [o for o, _ in readings("25/06/2024", HCM)] == [DAY_FIRST]
    assert [o for o, _ in readings("06/06/2024", HCM)] == [FREE]


def _prior(order, day_first):
    if order == FREE or order == DAY_FIRST and day_first is None:
        return 0.0
    return timelines.MONTH_FIRST_UNDECLARED if day_first is None else 0.0 if (order == DAY_FIRST) == day_first else timelines.AGAINST_DECLARED


def _brute(rows, day_first):
    best = None
    for picks in itertools.product(*[range(len(o)) for o, _, _ in rows]):
        cost, seen, last = 0.0, 0, -(1 << 62)
        for (orders, times, own), k in zip(rows, picks, strict=True):
            cost += own[k] + _prior(orders[k], day_first) + (timelines.BACK if times[k] < last else 0)
            if orders[k]:
                cost += timelines.SWITCH if seen and seen != orders[k] else 0
                seen = orders[k]
            last = times[k]
        if best is None or cost < best - 1e-12:
            best = cost
    return best


def _cost(rows, chosen, day_first):
    one = [([o[t.index(c)]], [c], [w[t.index(c)]]) for (o, t, w), c in zip(rows, chosen, strict=True)]
    return _brute(one, day_first)


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_viterbi_is_optimal(spark, block_rows):
    r = random.Random(5)
    data, want = [], {}
    for source, day_first in (("a", None), ("b", True), ("c", False), (None, None), ("d", True)):
        rows = []
        for i in range(8):
            at = 1000 * i + r.randint(-1500, 1500)
            orders, times = ([1, 2], [at, at + r.choice([-3000, 3000])]) if r.random() < 0.6 else ([r.choice([0, 1, 2])], [at])
            costs = [0.0] * len(orders)
            if r.random() < 0.4:  # a local time that occurs twice
                orders, times, costs = orders * 2, times + [t + 700 for t in times], costs + [r.choice([0.1, 1.5])] * len(orders)
            rows.append((orders, times, costs))
            data.append(("k", len(data), source, i, orders, times, costs, day_first))
        want[source] = (rows, day_first)
    df = spark.createDataFrame(data, "record_kind string, record_key bigint, source string, arrived int, orders array<int>, instants array<bigint>, costs array<double>, day_first boolean")
    got = {x.record_key: x.instant for x in timelines.choose_instants(df, block_rows).collect()}
    for n, (rows, day_first) in enumerate(want.values()):
        chosen = [got[8 * n + i] for i in range(8)]
        assert _cost(rows, chosen, day_first) == pytest.approx(_brute(rows, day_first))


def test_interpretations():
    at = lambda raw, zone: [(as_text(t), c) for _, t, c in interpretations(raw, zone)]
    assert at("2025-11-02 01:30:00", NY) == [("2025-11-02T05:30:00Z", 0.0), ("2025-11-02T06:30:00Z", 1.5)]
    assert at("2024-01-10 12:00 CST", NY) == [("2024-01-10T18:00:00Z", 0.0), ("2024-01-10T04:00:00Z", 1.5), ("2024-01-10T17:00:00Z", 1.5)]
    assert at("2024-01-10 12:00 CST", "Asia/Shanghai")[0] == ("2024-01-10T04:00:00Z", 0.0)
    assert at("2024-07-10 12:00 IST", "Europe/Dublin")[0] == ("2024-07-10T11:00:00Z", 0.0)
    assert len(interpretations("05/06/2024 10:00 BST", HCM)) == 4 and len(readings("05/06/2024 10:00 BST", HCM)) == 2


def test_record_order_corrects_a_wrong_declaration(spark):
    """A source declared to write the day first that writes the month first, as the times of arrival show."""
    days = [datetime(2024, 1, 3) + timedelta(days=i) for i in range(0, 150, 3)]
    rows = [("w", i, "s", d + timedelta(hours=5), d.strftime("%m/%d/%Y")) for i, d in enumerate(days)]
    rows += [("w", 1000 + i, "right", d + timedelta(hours=5), d.strftime("%d/%m/%Y")) for i, d in enumerate(days)]
    feeds = spark.createDataFrame([("s", "UTC", True), ("right", "UTC", True)], "source string, zone_name string, day_first boolean")
    read = timelines.with_readings(spark.createDataFrame(rows, "record_kind string, record_key bigint, source string, arrived timestamp, raw string"), F.col("raw"), feeds)
    got = {r.record_key: as_text(r.instant)[:10] for r in timelines.choose_instants(read).collect()}
    assert got == {k: (days[k % 1000]).strftime("%Y-%m-%d") for _, k, *_ in rows}


def test_choose_instants_edge_cases(spark):
    feeds = spark.createDataFrame([("s", HCM, True), ("s", NY, False), (None, HCM, True)], "source string, zone_name string, day_first boolean")
    rows = spark.createDataFrame([("w", 1, "s", None, "05/06/2024"), ("w", 1, "s", None, "05/06/2024"), ("w", 2, None, None, "2024-05-01"), ("w", 3, "s", None, None), ("w", 4, None, None, "2024-05-01T00:00:00Z")],
                                 "record_kind string, record_key bigint, source string, arrived timestamp, raw string")
    read = timelines.with_readings(rows, F.col("raw"), feeds)
    got = sorted((r.record_key, r.u) for r in timelines.choose_instants(read).withColumn("u", timelines.utc_text(F.col("instant"))).collect())
    assert [k for k, _ in got] == [1, 1, 4] and got[2][1] == "2024-05-01T00:00:00Z"
    assert timelines.choose_instants(read.limit(0)).count() == 0
