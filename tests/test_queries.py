import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


def test_core_does_not_import_llm():
    for path in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "factloom.llm" not in path.read_text(encoding="utf-8"), path


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_core_queries_against_their_sql(spark):
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry
    from factloom.plans.registry import QUERIES, SQL

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")

    def rows(df: pd.DataFrame) -> list:
        cell = lambda v: "" if not hasattr(v, "__len__") and pd.isna(v) else f"{v:.5g}" if isinstance(v, float) else str(v)
        return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))

    for name, sql in SQL.items():
        assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(sql).df()), name
    assert entry.entry(spark).count() > 0
