import os

import pytest

from hitloom.plans import general, reference
from tests.compare import DATA, both

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = {**general.QUERIES, **reference.QUERIES}
SQL = {**general.SQL, **reference.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, name):
    mine, theirs = both(spark, QUERIES[name], SQL[name])
    assert mine == theirs


#: Columns that hold nothing on the smallest tables.
MAY_BE_EMPTY = {"complete"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"rank_model", "tried_orders", "training_orders", "track_features_all"}))
def test_rows_are_whole(spark, name):
    """Queries without SQL: rows are read in full, there are some, no column is empty, and no row occurs twice."""
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns if c not in MAY_BE_EMPTY)
    assert len({repr(r) for r in rows}) == len(rows)


def test_entry_gives_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
