import random

import pytest

from hitloom.operators.sessions import session_starts, sessionize

SCHEMA = "crystal_no int, ts long, event_id long, _s string"


def brute(rows, gap):
    by = {}
    for c, t, e in rows:
        if c is not None and t is not None:
            by.setdefault(c, []).append((t, e))
    out = set()
    for c, hits in by.items():
        hits.sort(key=lambda h: h[0])
        cur = [hits[0]]
        for h in hits[1:] + [None]:
            if h is None or h[0] - cur[-1][0] > gap:
                out.add((c, cur[0][0], cur[-1][0], len({e for _, e in cur if e is not None}), len(cur)))
                cur = []
            cur.append(h)
    return out


def rows_of(df):
    return {(r["crystal_no"], r["start_ts"], r["end_ts"], r["n_events"], r["n_hits"]) for r in df.collect()}


@pytest.mark.parametrize("bits", [3, 26])
def test_against_brute_force(spark, bits):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-60, 200)]), rng.choice([None, *range(20)])) for _ in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sessionize(df, gap=5, cell_bits=bits)
    assert got.columns == ["crystal_no", "start_ts", "end_ts", "duration", "n_events", "n_hits"]
    assert rows_of(got) == brute(rows, 5)


def test_exact_gap_belongs_and_repeats_count_once(spark):
    df = spark.createDataFrame([(1, 0, 7, ""), (1, 5, 7, ""), (1, 5, 7, ""), (1, 11, 8, "")], SCHEMA)
    assert rows_of(sessionize(df, gap=5)) == {(1, 0, 5, 1, 3), (1, 11, 11, 1, 1)}


def test_empty_and_extreme_times(spark):
    assert sessionize(spark.createDataFrame([], SCHEMA)).count() == 0
    big = 2**63 - 1
    df = spark.createDataFrame([(1, big, 1, ""), (1, big - 1, 2, ""), (1, -(2**63), 3, "")], SCHEMA)
    assert rows_of(sessionize(df, gap=200_000)) == {(1, big - 1, big, 2, 2), (1, -(2**63), -(2**63), 1, 1)}


def test_starts_for_every_time(spark):
    df = spark.createDataFrame([(1, 0, 1, ""), (1, 3, 1, ""), (1, 9, 1, "")], SCHEMA)
    assert {(r[1], r[2]) for r in session_starts(df, "crystal_no", "ts", 3).collect()} == {(0, 0), (3, 0), (9, 9)}
