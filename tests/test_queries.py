"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from glyphstream.plans import artifacts, audits  # noqa: F401  add their queries
from glyphstream.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return "-"
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return "0" if v == 0 else f"{v:.{max(0, 8 - int(math.log10(abs(v)) // 1))}f}" if abs(v) < 1e15 else str(v)
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    got = QUERIES[name](spark, tiny).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def against_sql(spark, folder, name):
    """Rows of the query and of its SQL over the tables in a folder."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return rows(QUERIES[name](spark, str(folder)).toPandas()), rows(con.sql(ORACLE_SQL[name]).df())


def put_events(folder, events):
    """events.parquet of (event_id, user_id, value), an hour apart."""
    t = pd.DataFrame(events, columns=["event_id", "user_id", "value"])
    t["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(t)), unit="h")
    t["event_type"] = "view"
    t.astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet", index=False)


def test_fuse_estimates_with_ids_millions_apart(spark, tmp_path):
    """The larger group has ids so high that the SQL's score of the smaller one is greater."""
    put_events(tmp_path, [(1, 1, 10.0), (2, 1, 10.0), (5_000_001, 1, 90.0), (5_000_002, 1, 91.0), (5_000_003, 1, 92.0)])
    got, want = against_sql(spark, tmp_path, "fuse_estimates")
    assert got == want
