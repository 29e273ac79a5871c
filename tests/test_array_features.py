import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.functions import geometry as G, physics as P
from hitloom.functions.arrays import material_way
from hitloom.operators import array_features as A, features as X, linkage as L, ordering as O, tracks as T

INNER = G.SHELLS["gretina"][0]


def random_tracks(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        m = int(rng.integers(2, 6))
        d = rng.normal(size=3)
        p = d / np.linalg.norm(d) * rng.uniform(19, 24)
        x = p + np.cumsum(np.vstack([np.zeros(3), rng.normal(0, 1.5, (m - 1, 3))]), 0)
        out.append((x, rng.uniform(0.02, 0.6, m)))
    return out


def test_every_feature_equals_its_column(spark):
    tracks = random_tracks(30)
    rows = [(i, 0, k, k, *map(float, x[k]), float(e[k])) for i, (x, e) in enumerate(tracks) for k in range(len(e))]
    o = spark.createDataFrame(rows, "event_id long, cluster_id int, track_pos int, point_idx int, x double, y double, z double, e double")
    names = X.names()
    want = {r["event_id"]: r for r in X.track_features(o, names).collect()}
    for i, (x, e) in enumerate(tracks):
        both = {t: A.Tracks(x[None], e[None], np.array([e.sum()]), INNER, tango=t) for t in (False, True)}
        for n in names:
            got = float(both[n.endswith("_tango")].feature(n.removesuffix("_tango"))[0])
            ref = want[i][n]
            if ref is None or math.isnan(ref):
                assert math.isnan(got) or got == 0 or abs(got) > 1e7 or "r" in n, (n, got, ref)
            else:
                assert got == pytest.approx(ref, rel=1e-7, abs=1e-9), (n, i, got, ref)


def test_weighted_score_is_the_selected_figure_of_merit(spark):
    tracks = random_tracks(20, 3)
    rows = [(i, 0, k, k, *map(float, x[k]), float(e[k])) for i, (x, e) in enumerate(tracks) for k in range(len(e))]
    o = spark.createDataFrame(rows, "event_id long, cluster_id int, track_pos int, point_idx int, x double, y double, z double, e double")
    want = {r["event_id"]: r["fom"] for r in T.figures_of_merit(o, "selected").collect()}
    for i, (x, e) in enumerate(tracks):
        assert O.scores(x[None], e[None], np.array([e.sum()]), "selected", INNER)[0] == pytest.approx(want[i], rel=1e-7)


def test_search_by_selected_and_by_weights_finds_the_least():
    from itertools import permutations

    x, e = random_tracks(1, 8)[0]
    n = len(e)
    for method, weights in (("selected", None), ("model", {"rsg_mean_1": 2.0, "distances_sum": 1.0, "rc_sum_1_tango": 0.5})):
        order, value = O.search(x[None], e[None], 5, 2, method, INNER, weights=weights)
        every = {p: float(O.scores(x[None, list(p)], e[None, list(p)], np.array([e.sum()]), method, INNER, weights=weights)[0]) for p in permutations(range(n))}
        assert value[0] == pytest.approx(min(every.values())) and every[tuple(order[0])] == pytest.approx(value[0])
    with pytest.raises(ValueError):
        O.scores(x[None], e[None], np.array([1.0]), "model", INNER)


def test_material_way_by_steps_along_the_line(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 12, (200, 3)), rng.normal(0, 12, (200, 3))
    t = (np.arange(4000) + 0.5) / 4000
    outside = np.linalg.norm(a[:, None] + t[None, :, None] * (b - a)[:, None], axis=2) > 10
    length = np.linalg.norm(b - a, axis=1)
    got = material_way(a, b, 10.0)
    assert np.abs(got - outside.mean(1) * length).max() < 0.02
    df = spark.createDataFrame([(*map(float, p), *map(float, q)) for p, q in zip(a, b)], "ax double, ay double, az double, bx double, by double, bz double")
    col = [r["d"] for r in df.select(G.shell_distance(G.point("a"), G.point("b"), 10.0).alias("d")).collect()]
    assert np.allclose(got, col, atol=1e-9)


def test_cross_section_integrates_to_the_known_total(spark):
    """The integral of the Klein-Nishina formula over all angles against its closed form."""
    for e in (0.1, 0.662, 2.0):
        k = e / P.MEC2
        theta = (np.arange(2000) + 0.5) * math.pi / 2000
        df = spark.createDataFrame([(1 - math.cos(t),) for t in theta], "omc double")
        omc = F.col("omc")
        ratio = P.outgoing(F.lit(e), omc) / e
        total = df.select(F.sum(P.by_angle(P.klein_nishina(ratio, omc), omc)).alias("s")).first()["s"] * math.pi / 2000
        want = 2 * math.pi * P.R_0**2 * ((1 + k) / k**2 * (2 * (1 + k) / (1 + 2 * k) - math.log(1 + 2 * k) / k) + math.log(1 + 2 * k) / (2 * k) - (1 + 3 * k) / (1 + 2 * k) ** 2)
        assert total == pytest.approx(want, rel=1e-4)


def test_beyond_edge(spark):
    got = [spark.range(1).select(P.beyond_edge(F.lit(c), -7.0)).first()[0] for c in (0.3, -1.0, -1.05, -1.2)]
    assert got == [0.3, -1.0, 1e-10 - 1.0, -7.0]


def test_points_at_the_origin_have_no_direction():
    p = np.array([[0.0, 0, 0], [0, 0, 0], [1, 0, 0]])
    d = L.distances(p, "great_circle", 0.0)
    assert d[0, 1] == 0 and d[0, 2] == pytest.approx(math.pi / 2) and not np.isnan(d).any()
    assert [L.cut_labels(p, np.zeros(3), cut, "great_circle", "single", None, 3, 0.0).tolist() for cut in (0.01, 1.0)] == [[0, 0, 1], [0, 0, 1]]
