import random

import numpy as np

from hitloom.operators.spikes import fit_forest, implausible_readings, score_bars, score_forest, scored_readings

HITS = "event_id long, point_idx int, x double, y double, z double, e double, ts long, crystal_no int, flag string, level double"
CRYSTALS = "crystal_no int, cx double, cy double, cz double, blk int"


def crystals(spark):
    return spark.createDataFrame([(1, 20.0, 0.0, 0.0, 0), (2, 0.0, 20.0, 0.0, 0), (3, 0.0, 0.0, 20.0, 0)], CRYSTALS)


def normal(n, seed=0):
    rng = random.Random(seed)
    centre = {1: (20, 0, 0), 2: (0, 20, 0), 3: (0, 0, 20)}
    out = []
    for i in range(n):
        c = 1 if i % 3 else rng.choice([2, 3])
        p = [v + rng.uniform(-1.5, 1.5) for v in centre[c]]
        level = max(-1.1, min(1.1, rng.gauss(0, 0.35)))
        out.append([i, 1, *[round(v, 4) for v in p], round(0.3 * c * float(np.exp(level)), 6), 1000 * i, c, "a", 1.0])
    return out


def found(spark, rows, **kw):
    got = implausible_readings(spark.createDataFrame([tuple(r) for r in rows], HITS), crystals(spark), **kw)
    return {(r["event_id"], r["point_idx"], r["field"]) for r in got.collect()}


def test_each_kind_of_case(spark):
    rows = normal(3000)
    assert found(spark, rows) == set()
    rows[100][5] = 9.0  # far up
    rows[101][5] = 0.004  # far down
    rows[102][5] = -0.1
    rows[103][5] = 0.0
    rows[104][5] = 123456789.0
    rows[105][7] = 77  # unknown crystal
    rows[106][2:5] = [0.0, 0.0, 0.0]  # nowhere
    c = rows[107][7]
    rows[107][2:5] = [0.0, 20.0, 0.5] if c != 2 else [20.0, 0.0, 0.5]  # inside another crystal
    rows[107][5] = 50.0  # then e isn't judged
    want = {(i, 1, "e") for i in (100, 101, 102, 103, 104)} | {(105, 1, "crystal_no"), (106, 1, "x"), (107, 1, "crystal_no")}
    rows[108][5], rows[109][7], rows[110][2] = None, None, None  # nulls are no cases
    assert found(spark, rows) == want
    assert found(spark, rows + rows[90:120]) == want  # repeated rows count once
    assert found(spark, [*rows, [None, *rows[0][1:]], [5, None, *rows[0][2:7], 77, "a", 1.0]]) == want  # no hit is named


def test_stuck_runs_over_partitions(spark):
    rows = normal(3000, 1)
    one = [r for r in rows if r[7] == 1]
    for k, r in enumerate(one[200:800]):  # longer than a partition
        r[5] = round(0.31 + (k % 3) * 1e-6, 6)
    for r in one[1000:1004]:  # four are no case
        r[5] = 0.35
    for r in one[1100:1105]:
        r[2:5] = [20.5, 0.5, 0.5]
    one[1102][5] = None
    one[300][5] = None  # a null doesn't interrupt
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {(r[0], 1, "e") for k, r in enumerate(one[200:800]) if k != 100} | {(r[0], 1, "x") for r in one[1100:1105]}


def test_no_time_no_run_and_empty(spark):
    rows = normal(600, 2)
    for r in [r for r in rows if r[7] == 1][100:110]:
        r[5], r[6] = 0.3, None
    assert found(spark, rows) == set()
    empty = spark.createDataFrame([], HITS)
    assert implausible_readings(empty, crystals(spark)).count() == 0
    assert scored_readings(empty, crystals(spark)).count() == 0


def test_all_equal_and_tiny_sources(spark):
    rows = [[i, 1, 20.0 + i * 0.01, 0.0, 0.0, 0.5, i, 1, "", 0.0] for i in range(4)]
    assert found(spark, rows) == set()


def test_forest_parts_off_what_leaves_a_constant():
    rng = np.random.default_rng(0)
    data = np.c_[rng.normal(0, 1, 2000), np.zeros(2000)].astype(np.float32)
    f = fit_forest(data, np.array([-6, 0], np.float32), np.array([6, 2.8], np.float32), 20, 256, rng)
    s = score_forest(np.array([[0, 0], [0, 2.0], [9, 0]], np.float32), *f, 256)
    assert s[1] > s[0] + 0.1 and s[2] > s[0] + 0.1


def test_many_spikes_and_none(spark):
    """Whether a reading is a spike doesn't depend on the share of spikes, and it is the forest's score that tells."""
    rows = normal(3000, 4)
    rng = random.Random(9)
    bad = set()
    for r in rows:
        if r[7] == 1 and rng.random() < 0.06:
            r[5] = round(0.3 * float(np.exp(rng.choice([-1, 1]) * rng.uniform(3, 6))), 7)
            bad.add((r[0], 1, "e"))
    got = found(spark, rows)
    assert len(got & bad) >= 0.97 * len(bad) and not {k for k in got - bad}
    scored = scored_readings(spark.createDataFrame([tuple(r) for r in rows], HITS), crystals(spark)).where("judged").toPandas()
    spikes = scored["event_id"].isin([i for i, _, _ in got])
    assert scored[spikes]["plain"].min() >= scored["bar"].min() and (scored[~spikes]["plain"] < scored[~spikes]["bar"]).all()


def test_bar_lies_in_the_widest_empty_stretch(spark):
    rows = [(1, 0.3 + (i % 40) * 0.005, 0.8, True) for i in range(400)] + [(1, 0.7, 0.8, True), (1, 0.75, 0.8, True), (2, 0.3, 0.8, True), (2, 0.9, 0.8, False), (3, 0.4, 0.8, True), (3, 0.41, 0.8, True)]
    got = {r["crystal_no"]: r["bar"] for r in score_bars(spark.createDataFrame(rows, "crystal_no int, plain double, top double, judged boolean")).collect()}
    assert 0.5 < got[1] < 0.7 and got[2] > 0.45 and got[3] > 0.45


def test_test_tables(spark):
    """On the smallest test tables every impossible energy, unknown crystal and lost position is found by plain SQL too."""
    import os

    import duckdb
    import pytest

    from tests.compare import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = {tuple(r) for r in implausible_readings(spark.read.parquet(f"{DATA}/interactions.parquet"), spark.read.parquet(f"{DATA}/crystals.parquet")).select("event_id", "point_idx", "field").distinct().collect()}
    i, c = f"'{DATA}/interactions.parquet'", f"'{DATA}/crystals.parquet'"
    near = f"exists (select 1 from {c} o where (i.x-o.cx)**2 + (i.y-o.cy)**2 + (i.z-o.cz)**2 <= 4.2**2{{}})"
    own = near.format(" and o.crystal_no = i.crystal_no")
    sql = {
        "crystal_no": f"crystal_no is not null and (not exists (select 1 from {c} k where k.crystal_no = i.crystal_no) or (not isnan(x + y + z) and not {own} and {near.format('')}))",
        "x": f"exists (select 1 from {c} k where k.crystal_no = i.crystal_no) and not isnan(x + y + z) and not {near.format('')}",
        "e": f"exists (select 1 from {c} k where k.crystal_no = i.crystal_no) and (e <= 0 or (e >= 1000 and not isnan(e))) and ({own} or not {near.format('')} or x is null or y is null or z is null or isnan(x + y + z))",
    }
    for field, where in sql.items():
        want = {(*r, field) for r in duckdb.sql(f"select distinct event_id, point_idx from {i} i where {where}").fetchall()}
        mine = {k for k in got if k[2] == field}
        assert want and want <= mine if field != "crystal_no" else want == mine
