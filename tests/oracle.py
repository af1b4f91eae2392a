"""Runs a registered query and its SQL twin over the same tables and compares them as multisets."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return v


def _rows(rows):
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=repr)


def check(spark, query, sql: str) -> None:
    if not Path(SF).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    have = _rows(tuple(r) for r in df.select(*cols).collect())
    assert have == _rows(con.sql(f"SELECT {names} FROM ({sql})").fetchall())
