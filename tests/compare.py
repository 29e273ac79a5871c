"""Rows of a registered query against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

DATA = os.environ.get("HITLOOM_TESTDATA", "/root/testdata/sf0.001")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v if v is None or isinstance(v, (int, str)) else str(v)


def both(spark, query, sql: str):
    """Sorted rows of either side, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in sorted(Path(DATA).iterdir()):
        con.sql(f"create view {f.name.split('.')[0]} as select * from '{f}'")
    df = query(spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    mine = sorted(repr(tuple(normal(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = sorted(repr(tuple(normal(r[i]) for i in at)) for r in rel.fetchall())
    return mine, theirs
