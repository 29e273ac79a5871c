import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.functions import geometry as G, physics as P
from hitloom.operators import coincidences as C, events as E, features as X, linkage as L, metrics as M, ordering as O, ranking as R, tracks as T
from hitloom.streaming.coincidences import folded

BUILT_IN = [(25, 0, 0, 0.1), (25, 4, 0, 0.2), (25, 4, 3, 0.3), (0, 24, 12, 0.4), (5, 24, 0, 0.5), (0, 24, 0, 0.6), (16, 16, 16, 0.7), (0, 0, 25, 0.8), (-16, -16, -16, 0.9)]
HITS = "event_id long, point_idx int, x double, y double, z double, e double, ts long, crystal_no int, seg_no int, interaction_type int"
CLUSTERS = "event_id long, cluster_id int, track_pos int, point_idx int"


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def pt(*v):
    return tuple(F.lit(float(a)) for a in v)


@pytest.fixture(scope="module")
def event(spark):
    hits = spark.createDataFrame([(1, i + 1, float(x), float(y), float(z), e, 10 * i, i, 0, 1) for i, (x, y, z, e) in enumerate(BUILT_IN)], HITS)
    clusters = spark.createDataFrame([(1, c, k, p) for c, ps in {1: [1, 2, 3], 2: [4, 5, 6], 3: [7], 4: [8, 9]}.items() for k, p in enumerate(ps)], CLUSTERS)
    return hits, clusters


def test_triangles(spark):
    a, b, c = pt(0, 0, 0), pt(3, 0, 0), pt(0, 4, 0)
    assert value(spark, G.cos_turn(a, b, c)) == pytest.approx(-0.6)
    assert value(spark, G.cos_turn(c, a, b)) == pytest.approx(0, abs=1e-9)
    assert value(spark, G.cos_turn(b, c, a)) == pytest.approx(-0.8)
    q = pt(0.5, math.sqrt(3) / 2, 0)
    assert value(spark, G.cos_turn(a, pt(1, 0, 0), q)) == pytest.approx(-0.5)
    assert value(spark, G.cos_between(G.minus(b, a), G.minus(c, a))) == pytest.approx(0, abs=1e-9)
    assert value(spark, G.cos_between(G.minus(a, b), G.minus(c, b))) == pytest.approx(0.6)
    assert value(spark, G.cos_turn(a, a, c)) == -1.0


def test_angles_from_energies(spark):
    want = [0.19134129, 0.26177011, 0.41570088, 1.05985215, -12]
    got = [value(spark, P.theta_theory(F.lit(float(a)), F.lit(b), -12)) for a, b in zip([4, 3, 2, 1, 4], [3.5, 2.5, 1.5, 0.5, 0.1])]
    assert got == pytest.approx(want, abs=1e-7)
    assert value(spark, P.theta_theory(F.lit(1.0), F.lit(1.0))) == 0.0


def test_shell_distance(spark):
    d = lambda a, b: value(spark, G.shell_distance(pt(*a), pt(*b), 10.0))
    assert d((-15, 0, 0), (15, 0, 0)) == pytest.approx(10)
    assert d((0, 0, 0), (15, 0, 0)) == pytest.approx(5)
    assert d((15, 0, 0), (2, 0, 0)) == pytest.approx(5)
    assert d((1, 0, 0), (2, 0, 0)) == 0
    assert d((15, 0, 0), (15, 5, 0)) == pytest.approx(5)
    m = L.material_matrix(np.array([[-15.0, 0, 0], [15, 0, 0], [0, 0, 0]]), 10.0)
    assert m[0, 1] == pytest.approx(10) and m[1, 2] == pytest.approx(5)


def test_energy_relations(spark):
    e, omc = F.lit(0.8), F.lit(0.7)
    out = value(spark, P.outgoing(e, omc))
    assert value(spark, P.incoming(F.lit(out), omc)) == pytest.approx(0.8)
    assert value(spark, P.local_incoming(F.lit(0.8 - out), omc)) == pytest.approx(0.8)
    assert value(spark, P.cos_theory(e, F.lit(out))) == pytest.approx(0.3)
    assert value(spark, P.edge_incoming(F.lit(value(spark, P.edge_outgoing(F.lit(0.1)))))) == pytest.approx(0.1)
    assert value(spark, P.local_incoming(F.lit(0.3), F.lit(0.0))) == P.FILL
    h = 1e-6
    num = (value(spark, P.local_incoming(F.lit(0.3 + h), omc)) - value(spark, P.local_incoming(F.lit(0.3 - h), omc))) / (2 * h)
    assert value(spark, P.local_d_energy(F.lit(0.3), omc)) == pytest.approx(num, rel=1e-6)
    assert value(spark, P.piecewise(F.lit(0.35))) == pytest.approx(3.37) and value(spark, P.piecewise(F.lit(99.0))) == 27.41
    assert value(spark, P.sigma_pair(F.lit(1.0))) == 0 and value(spark, P.sigma_pair(F.lit(3.0))) > 0
    assert value(spark, P.log_interpolated(F.lit(2.0), [(1.0, 1.0), (4.0, 16.0)])) == pytest.approx(4.0)


def test_built_in_event(spark, event):
    hits, clusters = event
    t = {r["cluster_id"]: r for r in T.track_energies(T.ordered_hits(hits, clusters)).collect()}
    assert [round(t[c]["esum"], 9) for c in (1, 2, 3, 4)] == [0.6, 1.5, 0.7, 1.7]
    assert t[1]["first_hit"]["e"] == 0.1 and t[3]["second_hit"] is None


@pytest.mark.parametrize("method", ["angle", "cosine", "oft", "agata", "local"])
def test_kernel_equals_columns(spark, event, method):
    hits, clusters = event
    got = {r["cluster_id"]: r["fom"] for r in T.figures_of_merit(T.ordered_hits(hits, clusters), method).collect()}
    p = np.array(BUILT_IN, float)
    for c, idx in {1: [0, 1, 2], 2: [3, 4, 5], 4: [7, 8]}.items():
        want = O.scores(p[idx, :3][None], p[idx, 3][None], np.array([p[idx, 3].sum()]), method, 18.5)[0]
        assert got[c] == pytest.approx(want, rel=1e-9, abs=1e-300)
    assert got[3] == 1.85  # deeper than 0.7 MeV allows


def test_agata_by_hand(spark):
    """One turn, every term written out."""
    x, y, ex, ey = (20.0, 0.0, 0.0), (20.0, 3.0, 0.0), 0.25, 0.35
    hits = spark.createDataFrame([(1, 1, *x, ex, 0, 0, 0, 1), (1, 2, *y, ey, 0, 0, 0, 1)], HITS)
    clusters = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 2)], CLUSTERS)
    got = T.figures_of_merit(T.ordered_hits(hits, clusters), "agata").first()["fom"]
    e0, cos = 0.6, 0.0
    g = e0 / (1 + e0 / P.MEC2)
    s = lambda e: 0.463 + 0.551 * math.sqrt(0.1 / e)
    cerr = math.sqrt((0.463**2 + s(ex) ** 2) / 20**2 + (s(ex) ** 2 + s(ey) ** 2) / 9)
    sig = 1e-6 * ((g / e0) ** 4 + 3 * (1 - (g / e0) ** 2) ** 2) + (cerr * g**2 / P.MEC2) ** 2
    mu = {e: [value(spark, f(F.lit(e))) for f in (P.mu_absorption, P.mu_compton, P.mu_total)] for e in (e0, ey)}
    want = (2 * (ey - g) ** 2 / sig + mu[e0][1] * 1.5 - math.log(mu[e0][1] / mu[e0][2]) + mu[ey][0] * 3 - math.log(mu[ey][0] / mu[ey][2])) / 3
    assert got == pytest.approx(want, rel=1e-9) and cos == 0


@pytest.mark.parametrize("method", ["angle", "oft"])
def test_search_finds_the_best_of_all(method):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4, 3))
    x *= (rng.uniform(19, 27, (20, 4)) / np.linalg.norm(x, axis=2))[..., None]
    e = rng.uniform(0.05, 0.6, (20, 4))
    order, sc = O.search(x, e, 5, 2, method)
    for k in range(20):
        tried = {p: O.scores(x[k, list(p)][None], e[k, list(p)][None], e[k].sum()[None], "agata" if method == "oft" else method, 18.5)[0] for p in permutations(range(4))}
        assert tuple(order[k]) == min(tried, key=lambda p: (tried[p], p))
    many, _ = O.search(rng.normal(size=(3, 8, 3)) * 20, rng.uniform(0.05, 0.6, (3, 8)))
    assert all(sorted(m) == list(range(8)) for m in many.tolist())


def test_order_rays_sizes(spark, event):
    hits, _ = event
    clusters = spark.createDataFrame([(1, 1, None, p) for p in range(1, 10)] + [(1, 2, None, 1), (1, 2, None, 1)], CLUSTERS)
    got = O.order_rays(hits, clusters, max_size=8).collect()
    assert [r["point_idx"] for r in got if r["cluster_id"] == 1] == list(range(1, 10)) and all(r["score"] is None for r in got if r["cluster_id"] == 1)
    assert [(r["point_idx"], r["score"]) for r in got if r["cluster_id"] == 2] == [(1, 0.0)]
    assert O.order_rays(hits.limit(0), clusters).count() == 0


def test_features_by_hand(spark, event):
    hits, clusters = event
    o = T.ordered_hits(hits, clusters)
    steps = {(r["cluster_id"], r["k"]): r for r in T.residuals(T.steps(o)).collect()}
    f = {r["cluster_id"]: r for r in X.track_features(o, ["rsg_sum_1", "rsg_mean_2", "rsg_norm_2v", "rc_wmean_1v", "rc_sum_1_penalty_removed", "cross_abs_ge_dist_final", "-log_p_compt_sum_nonfinal", "rth_cap_mean_1_tango", "tango_sigma"]).collect()}
    a, b = steps[1, 1], steps[1, 2]
    assert f[1]["rsg_sum_1"] == pytest.approx(a["rsg"] + b["rsg"])
    assert f[1]["rsg_mean_2"] == pytest.approx((a["rsg"] ** 2 + b["rsg"] ** 2) / 2)
    assert f[1]["rsg_norm_2v"] == pytest.approx(math.hypot(a["rsg"] / a["rsg_sigma"], b["rsg"] / b["rsg_sigma"]) / 3)
    assert f[1]["rc_wmean_1v"] == pytest.approx((a["rc"] / a["rc_sigma"] + b["rc"] / b["rc_sigma"]) / (1 / a["rc_sigma"] + 1 / b["rc_sigma"]))
    assert f[1]["rc_sum_1_penalty_removed"] == pytest.approx(sum(r["rc"] * (1 - r["penalty"]) for r in (a, b)))
    last = steps[1, 3]
    assert f[1]["cross_abs_ge_dist_final"] == pytest.approx(last["mu_abs"] * last["shell_way"])
    assert f[1]["tango_sigma"] == pytest.approx(np.std([a["local"], b["local"]]))
    assert set(f) == {1, 2, 4} and len(X.names()) == 516
    with pytest.raises(ValueError):
        X.track_features(o, ["nothing"])


def test_shapes_against_numpy(spark, event):
    hits, clusters = event
    got = {r["cluster_id"]: r for r in X.cluster_features(T.ordered_hits(hits, clusters)).collect()}
    p = np.array(BUILT_IN, float)[:, :3]
    for c, idx in {1: [0, 1, 2], 2: [3, 4, 5], 4: [7, 8]}.items():
        ev = np.sqrt(np.clip(np.linalg.eigvalsh(np.cov(p[idx], rowvar=False)), 0, None))
        assert got[c]["length"] == pytest.approx(ev[-1], rel=1e-6) and got[c]["width"] == pytest.approx(math.sqrt(ev[0] * ev[1]), abs=1e-3)
    assert got[3]["length"] == got[3]["width"] == 1e-3


def test_escape_of_the_centre():
    v = X.escape_integral(np.array([[-1.0, 0, 0]]), np.zeros((1, 3)), np.array([0.2]), np.array([0.5]), np.array([0.1]), 20.0)
    assert v[0] == pytest.approx(math.exp(-2))
    assert X.escape_integral(np.zeros((1, 3)), np.ones((1, 3)), np.array([0.2]), np.array([0.0]), np.array([0.1]), 20.0)[0] == 0


@pytest.mark.parametrize("anchored", ["first", "last"])
def test_coincidences(spark, anchored):
    ts = [0, 39, 41, 60, 79, 120, 500, None, 500, 530, 545]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ts)], "i int, ts long, start_ts double")
    got = {r["i"]: r["coincidence_ts"] for r in C.coincidences(df, gap=40, anchored=anchored).collect()}
    for first, last, n, _ in folded([t for t in ts if t is not None], [1.0] * 10, 40, anchored):
        assert sum(v == first for v in got.values()) == n and all(first <= ts[i] <= last for i, v in got.items() if v == first)
    assert 7 not in got


def test_linkage_against_components():
    rng = np.random.default_rng(0)
    for _ in range(30):
        p = rng.normal(size=(rng.integers(2, 25), 3)) * 10
        d = L.distances(p, "euclidean", 18.5)
        want = L.single_labels(d <= 8)
        assert (L.labels_at(L.agglomerate(d, "single"), len(p), 8) == want).all()
        for m in ("complete", "average", "ward"):
            lab = L.labels_at(L.agglomerate(d, m), len(p), 8)
            assert all(lab[i] != lab[j] or want[i] == want[j] for i, j in combinations(range(len(p)), 2)) or m == "ward"
        path = L.directional(d, 3)
        assert len(path) == len(p) - 1 and path[0][2] == d[~np.eye(len(p), dtype=bool)].min()
    assert len(set(L.cut_labels(np.eye(3) * 20, np.array([0.0, 5, 1000]), 30.0, "euclidean", "single", 40, 30, 18.5))) == 2
    assert L.labels_at(L.agglomerate(d, "single"), len(p), -1, 2).max() == 1


def test_packing_and_cleaning(spark):
    hits = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 0.1, 5, 1, 1, 1), (1, 2, 0.0, 0.3, 20.0, 0.3, 6, 1, 2, 3), (1, 3, 9.0, 0.0, 20.0, 0.2, 7, 1, 3, 1), (1, 4, None, None, None, 0.2, 7, 1, 3, 1), (1, 5, 1.0, 1.0, 1.0, 0.0, 7, 1, 3, 1)], HITS)
    r = {p["point_idx"]: p for p in E.packed(hits, 0.5).collect()}
    assert r[1]["e"] == pytest.approx(0.4) and r[1]["y"] == pytest.approx(0.225) and r[1]["interaction_type"] == 3 and r[1]["ts"] == 5 and 3 in r and 2 not in r
    assert [p["new_idx"] for p in E.without_low_energy(hits, 0.15).orderBy("point_idx").collect()] == [1, 2, 3]
    assert E.cone_clusters(hits, 5.0).select("cluster_id").distinct().count() == 3
    assert E.cone_clusters(hits, 5.0, max_hits=2).count() == 0
    rot = E.rotated(hits, ["event_id"]).where("x is not null")
    assert rot.where(F.abs(G.norm(G.point()) - 20) < 1e-9).count() == 1
    sm = E.smeared(hits).collect()
    assert [tuple(x) for x in sm] == [tuple(x) for x in E.smeared(hits.repartition(3)).orderBy("point_idx").collect()]


def test_pair_counts_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(ev, i, int(rng.integers(0, 4)), int(rng.integers(0, 3))) for ev in range(5) for i in range(12)]
    p = spark.createDataFrame([(e, i, a) for e, i, a, _ in rows], "event_id long, point_idx int, cluster_id int")
    t = spark.createDataFrame([(e, i, b) for e, i, _, b in rows], "event_id long, point_idx int, cluster_id int")
    for r in M.pair_counts(M.overlaps(p, t)).collect():
        own = [(a, b) for e, _, a, b in rows if e == r["event_id"]]
        both = [(x[0] == y[0], x[1] == y[1]) for x, y in combinations(own, 2)]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (both.count((True, True)), both.count((True, False)), both.count((False, True)), both.count((False, False)))


def test_linear_model_by_name(spark, tmp_path):
    m = R.LinearModel({"b": 2.0, "a": -1.0, "c": 1e-12}, {"a": 0.5}, 3.0)
    m.save(str(tmp_path / "m.json"))
    k = R.LinearModel.load(str(tmp_path / "m.json"))
    df = spark.createDataFrame([(1.0, 10.0, None)], "a double, b double, c double")
    assert df.select(k.column().alias("s")).first()["s"] == pytest.approx(21.0) and k.columns == ["b", "a"]


def test_backward_tracks_are_disjoint():
    p = np.array(BUILT_IN, float)
    tracks, left = O.backward_tracks(p[:, :3], p[:, 3])
    flat = [i for t in tracks for i in t]
    assert len(flat) == len(set(flat)) and sorted(flat + left) == list(range(9))


def test_column_generation_ends_with_no_new_row(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(20 * q + k, q, 1, *map(float, rng.normal(size=4) + [0.4, 0.2, 0.1, 0.3])) for q in range(30) for k in range(20)]
    rel = spark.createDataFrame(rows, "row_id long, ray_event_id long, ray_cluster_id int, a double, b double, c double, d double")
    fits, fit = [], R.fit_linear

    def seen(relative, *args, **kw):
        fits.append({r["row_id"] for r in relative.select("row_id").collect()})
        return fit(relative, *args, **kw)

    monkeypatch.setattr(R, "fit_linear", seen)
    w = R.column_generation(rel, list("abcd"), iterations=20)
    last = {r["row_id"] for r in R.selected_rows(rel.withColumn("s", R.score(w)), "neg").collect()}
    assert last <= fits[-1] and len(fits) > 2 and all(x < y for x, y in zip(fits, fits[1:]))


def test_margin_weights_separate_and_prefer_what_tells(spark):
    rng = np.random.default_rng(1)
    rows = [(float(abs(rng.normal()) + 1), float(rng.normal()), float(rng.normal() * 5)) for _ in range(400)]
    w = R.margin_weights(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], iterations=40)
    assert w["a"] > 0.5 and w["a"] > 5 * w["b"] and min(w.values()) >= 0
    assert R.margin_weights(spark.createDataFrame([], "a double"), ["a"]) == {"a": 0.0}


def test_tables_of_cross_sections(spark):
    e = F.lit(0.5)
    assert value(spark, P.edge_interpolated(e, [(0.1, 1.0), (1.0, 10.0)], [(0.1, 2.0), (1.0, 20.0)], 0.4)) == pytest.approx(10.0)
    assert value(spark, P.edge_interpolated(F.lit(0.2), [(0.1, 1.0), (1.0, 10.0)], [(0.1, 2.0), (1.0, 20.0)], 0.4)) == pytest.approx(2.0)
    pair = [(x, (1 - 1.022007 / x) ** 3 * x) for x in (1.5, 2.0, 4.0)]
    assert value(spark, P.pair_interpolated(F.lit(1.0), pair)) == 0 and value(spark, P.pair_interpolated(F.lit(3.0), pair)) == pytest.approx((1 - 1.022007 / 3) ** 3 * 3, rel=1e-6)
    d = G.Detector.of("AGATA", "soederstroem")
    assert (d.inner, d.outer) == (23.5, 32.5) and value(spark, d.position_error(F.lit(0.1))) == pytest.approx(0.89)
    with pytest.raises(ValueError):
        G.Detector.of("none")
