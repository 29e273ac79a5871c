import random

import pytest

from hitloom.llm import splits as S

ROWS = "row_id long, ray_event_id long, ray_cluster_id long, u long, key string"


def brute(rows):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, e, c in rows:
        if e is not None and c is not None and c != -1:
            parent[top(("c", c))] = top(("e", e))
    sets = {}
    for x in parent:
        if x[0] == "e":
            sets.setdefault(top(x), set()).add(x[1])
    return {(min(s), e) for s in sets.values() for e in s if e != min(s)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "") for r in rows], ROWS)


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(i % (n - 5), rng.choice([None, *range(1, 150)]), rng.choice([None, -1, -1, *range(1, 120)])) for i in range(n)]


@pytest.mark.parametrize("limit", [2_000_000, 15])
def test_ties_against_brute_force(spark, limit):
    rows = random_rows(140, 2) + [(1000 + i, 500 + i, 900 + i) for i in range(60)] + [(2000 + i, 501 + i, 900 + i) for i in range(60)]  # and a long chain
    t = S.ties(frame(spark, rows).repartition(7), "ray_event_id", "ray_cluster_id", rows_per_task=limit, fan_in=2)
    assert {(r["root"], r["id"]) for r in t.where("kind = 'e'").collect()} == brute(rows)


def test_splits_keep_ties_together_at_target_shares(spark):
    rows = random_rows(400, 4) + [(5000 + i, 10_000 + i, None) for i in range(3000)]
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), ("none", 0.0), (None, 0.5)], "split_name string, target_share double")
    got = S.grouped_splits(frame(spark, rows + rows[:50]), targets).collect()
    assert len(got) == len(set(rows))
    for key in ("ray_event_id", "ray_cluster_id"):
        seen = {}
        for r in got:
            if r[key] is not None and r[key] != -1:
                assert seen.setdefault(r[key], r["split_name"]) == r["split_name"]
    n = {s: sum(r["split_name"] == s for r in got) / len(got) for s in ("train", "test", "validation")}
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["test"] - 0.1) < 0.01 and sum(n.values()) == pytest.approx(1)


def test_plan_is_the_one_by_one_greedy():
    rng = random.Random(0)
    targets = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
    for _ in range(50):
        sizes = sorted({rng.randint(1, 60): rng.randint(1, 40) for _ in range(8)}.items(), reverse=True)
        total = sum(s * c for s, c in sizes)
        short = [total * t for _, t in targets]
        for s, c in sizes:
            for _ in range(c):
                short[max(range(3), key=lambda j: short[j])] -= s
        got = [total * t for _, t in targets]
        for s, split, lo, hi in S._plan(sizes, targets):
            got["abc".index(split)] -= s * (hi - lo)
        assert sorted(got) == pytest.approx(sorted(short), abs=max(s for s, _ in sizes))
        assert sum(s * (hi - lo) for s, _, lo, hi in S._plan(sizes, targets)) == total


def test_empty(spark):
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert S.ties(frame(spark, []), "ray_event_id", "ray_cluster_id").count() == 0
    assert S.grouped_splits(frame(spark, []), targets).count() == 0
    with pytest.raises(ValueError):
        S.assign_splits(frame(spark, []).select("key", "row_id"), targets.where("target_share > 1"))
