import math
import random

import pytest

from hitloom.llm import percentiles as P

SCHEMA = "g int, v double, day string, lo double, n long"


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


def table(spark, rows):
    return spark.createDataFrame([(g, v, d, 0.0, 0) for g, v, d in rows], SCHEMA)


@pytest.mark.parametrize("sections", [2, 16, 256])
def test_exact_with_ties_outliers_and_nulls(spark, sections):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 2, None]), rng.choice([rng.gauss(0, 1), 0.25, 0.25, 1.2e8, -5.0, None, float("nan")]), "a") for _ in range(800)]
    rows += [(7, 2.0, "a"), (8, None, "a")]
    got = {(r["g"], r["p"]): (r["lo"], r["hi"], r["n"]) for r in P.bisect_percentiles(table(spark, rows), ["g"], "v", (0.01, 0.5, 0.9, 1.0), sections).collect()}
    groups = {}
    for g, v, _ in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == {(g, p) for g in groups for p in (0.01, 0.5, 0.9, 1.0)}
    for (g, p), (lo, hi, n) in got.items():
        assert lo == hi == exact(groups[g], p) and n == len(groups[g])


def test_tolerance_bounds_the_error(spark):
    rows = [(1, float(i) / 7, "a") for i in range(1000)]
    for r in P.bisect_percentiles(table(spark, rows), ["g"], "v", (0.3, 0.7), 4, tolerance=2.0).collect():
        assert r["lo"] <= exact([v for _, v, _ in rows], r["p"]) <= r["hi"] and r["hi"] - r["lo"] <= 2.0


def test_infinities_and_empty(spark):
    rows = [(1, float("inf"), "a"), (1, float("-inf"), "a"), (1, 1.0, "a"), (1, -1.7e308, "a"), (1, 1.7e308, "a")]
    got = {r["p"]: r["lo"] for r in P.bisect_percentiles(table(spark, rows), ["g"], "v", (0.2, 0.6, 1.0)).collect()}
    assert got == {0.2: float("-inf"), 0.6: 1.0, 1.0: float("inf")}
    assert P.bisect_percentiles(table(spark, []), ["g"], "v").count() == 0
    assert P.summary_percentiles(P.merge(P.summarise(table(spark, []), ["g"], "day", "v"), ["g"]), ["g"]).count() == 0


def test_days_made_apart_combine(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2]), rng.lognormvariate(0, 1), rng.choice(["a", "b", "c"])) for _ in range(600)]
    days = [P.summarise(table(spark, [r for r in rows if r[2] == d]), ["g"], "day", "v", 0.01) for d in "abc"]
    merged = P.merge(days[0].union(days[1]).union(days[2]), ["g"])
    for r in P.summary_percentiles(merged, ["g"]).collect():
        v = exact([v for g, v, _ in rows if g == r["g"]], r["p"])
        assert r["lo"] <= v <= r["hi"] and r["hi"] - r["lo"] < 0.01


def test_weights_stand_for_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2]), float(rng.randint(-5, 40)), rng.randint(1, 6)) for _ in range(200)]
    df = spark.createDataFrame([*rows, (1, 0.0, 0), (1, 1.0, None)], "g int, v double, w int")
    got = {(r["g"], r["p"]): (r["lo"], r["n"]) for r in P.bisect_percentiles(df, ["g"], "v", (0.1, 0.5, 0.95), sections=4, weight="w").collect()}
    for g in (1, 2):
        every = [v for h, v, w in rows if h == g for _ in range(w)]
        assert all(got[g, p] == (exact(every, p), len(every)) for p in (0.1, 0.5, 0.95))
