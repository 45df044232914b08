"""Holds a query's rows against its SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(map(clean, row)) for row in frame.itertuples(index=False)), key=repr)


def differences(df, sql, con):
    """Rows that only one side has."""
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = _rows(got.astype(object).where(got.notna(), None)), _rows(want.astype(object).where(want.notna(), None))
    assert len(a) == len(b), (len(a), len(b))
    return [(x, y) for x, y in zip(a, b) if x != y]
