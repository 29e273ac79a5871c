import random

import numpy as np

from hitloom.llm import similarity as D

SCHEMA = "event_id long, points array<struct<x:double,y:double,z:double,e:double>>, leaf string, cluster string"


def sphere(rng, n):
    out = []
    for _ in range(n):
        v = [rng.gauss(0, 1) for _ in range(3)]
        r = rng.uniform(19, 26) / sum(a * a for a in v) ** 0.5
        out.append([a * r for a in v])
    return out


def copy(rng, pattern):
    p = [[a + rng.gauss(0, 0.1) for a in q] for q in pattern]
    rng.shuffle(p)
    kind = rng.random()
    if kind < 0.2:
        p.pop()
    elif kind < 0.3:
        p += sphere(rng, 1)
    return [(*q, rng.choice([None, 0.5])) for q in p]


def test_groups_decoys_and_singles(spark):
    rng = random.Random(7)
    rows, want, i = [], set(), 1
    for g in range(40):
        base = sphere(rng, rng.randint(5, 10))
        n = 300 if g == 0 else rng.choice([1, 2, 3, 8])
        ids = list(range(i, i + n))
        i += n
        rows += [(k, copy(rng, base), "", "") for k in ids]
        want |= {(ids[0], k) for k in ids[1:]}
        rows.append((i, [(*q, 1.0) for q in base[: len(base) // 2] + sphere(rng, len(base) - len(base) // 2)], "", ""))  # shares half
        i += 1
    rows += rows[:20] + [(9001, [], "", ""), (9002, None, "", ""), (9003, [(None, 1.0, 1.0, 1.0)], "", ""), (None, rows[0][1], "", "")]
    rng.shuffle(rows)
    members = D.similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()
    assert {(r["cluster"], r["id"]) for r in members.where("id <> cluster").collect()} == want
    big = [r for r in D.describe(members).collect() if r["size"] == 300]
    assert len(big) == 1 and len(big[0]["typical_members"]) == 3


def test_empty(spark):
    assert D.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_merges_and_ward():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(50, D.DIMS)).astype(np.float32) * 2
    x = (centres[rng.integers(0, 50, 2000)] + rng.normal(size=(2000, D.DIMS)) * 0.05).astype(np.float32)
    a, b = D.CFTree(), D.CFTree()
    ones = np.ones(1000)
    at = np.concatenate([a.insert(x[:700], ones[:700]), a.insert(x[700:1000], ones[:300])])
    assert (np.bincount(at, minlength=a.count) == a.n).all()
    b.insert(x[1000:], ones)
    assert b.count < 200
    a.insert(b.ls, b.n)
    assert a.n.sum() == 2000 and np.allclose(a.ls.sum(0), x.sum(0), atol=0.05)
    groups = D.ward(a.n, a.ls)
    assert len(set(groups.tolist())) == 50


def test_matched_is_one_to_one():
    a = np.array([[0.0, 0, 0], [0.5, 0, 0]])
    assert D.matched(a, a[:1]) == 1 and D.matched(a, a + 0.1) == 2 and D.matched(a, a + 5) == 0


def test_crowded_keys_and_small_trees_lose_nothing(spark):
    """Blocks of crowded keys, more hashes with more turns, and trees that overflow give the groups of one tree."""
    rng = random.Random(11)
    rows, want, i = [], set(), 1
    for _ in range(60):
        base, n = sphere(rng, rng.randint(4, 9)), rng.choice([1, 2, 5, 9])
        rows += [(k, copy(rng, base), "", "") for k in range(i, i + n)]
        want |= {(i, k) for k in range(i + 1, i + n)}
        i += n
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for kw in ({"block": 10, "sharing": 1e9}, {"sharing": 2}, {"most": 7}):
        assert {(r["cluster"], r["id"]) for r in D.similar_sets(df, **kw).where("id <> cluster").collect()} == want


def test_lattice_keys_agree_on_equal_patterns():
    rng = random.Random(5)
    agree = []
    for _ in range(200):
        base = sphere(rng, 6)
        a, b = ([np.array([q[:3] for q in copy(rng, base)])] for _ in range(2))
        agree.append((D.lattice_keys(a, range(30), 1) == D.lattice_keys(b, range(30), 1)).mean())
    assert np.mean(agree) > 0.65
