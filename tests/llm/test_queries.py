import os

import pytest

from hitloom.llm import queries as Q
from tests.compare import DATA, both

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_its_sql(spark, name):
    mine, theirs = both(spark, Q.QUERIES[name], Q.SQL[name])
    assert mine == theirs


def test_all_others_are_looked_at_row_by_row():
    """Queries without SQL have their own tests in test_tables."""
    assert set(Q.QUERIES) - set(Q.SQL) == {"p4_found", "p4_groups", "p5_splits", "p5_split_shares", "p6_containers", "p6_fill", "p7_mix", "p7_shares", "p8_found", "p8_rates"}
