from itertools import combinations

import numpy as np
import pytest

from hitloom.operators import ordering as O, programs as S, training as N

HITS = "event_id long, point_idx int, x double, y double, z double, e double, ts long, crystal_no int, seg_no int, interaction_type int"
CLUSTERS = "event_id long, cluster_id int, track_pos int, point_idx int"


def test_subset_sums_find_known_energies():
    e = np.array([0.1, 0.25, 0.4, 0.7, 0.05, 0.33])
    assert np.allclose(S.subset_sums(e)[0b101], 0.5)
    got = S.subset_sum_stack(e, [0.5, 1.08], 0.01)
    assert [round(float(e[c].sum()), 6) for c in got[:2]] in ([0.5, 1.08], [1.08, 0.5]) and sorted(i for c in got for i in c) == list(range(6))
    assert S.subset_sum_stack(e, [9.0]) == [list(range(6))]


def test_set_packing_is_optimal():
    rng = np.random.default_rng(0)
    n = 6
    cand = {c: float(rng.uniform(0, 2)) for k in (1, 2, 3) for c in combinations(range(n), k)}
    got = S.set_packing(n, cand)
    assert sorted(i for c in got for i in c) == list(range(n))
    weigh = lambda cs: sum(0.5 if len(c) == 1 else cand[c] for c in cs)

    def parts(left):
        if not left:
            yield []
            return
        for c in cand:
            if left[0] in c and set(c) <= set(left):
                for rest in parts([i for i in left if i not in c]):
                    yield [c, *rest]

    assert weigh(got) == pytest.approx(min(map(weigh, parts(list(range(n))))))
    assert S.set_packing(2, {(0,): 1.0}) == []


def test_dendrogram_and_trajectories():
    p = np.array([[20.0, 0, 0], [20, 1, 0], [0, 20, 0], [0, 21, 1], [0, 0, 20]])
    e = np.array([0.2, 0.3, 0.4, 0.1, 0.9])
    lab = S.dendrogram_peaks(p, e, [0.5])
    assert lab[0] == lab[1] and lab[2] == lab[3] and len(set(lab.tolist())) == 3
    # A path built from the Compton formula is found.
    e0, e1 = 0.8, 0.35
    cos = 1 - 0.51099895 * (1 / (e0 - e1) - 1 / e0)
    a = np.array([20.0, 0, 0])
    b = a + 2 * np.array([cos, np.sqrt(1 - cos**2), 0])
    assert S.trajectories(np.array([a, b, [0, 0, 25.0]]), np.array([e1, e0 - e1, 0.1]), 0, e0, 0.01, 10.0) == [[0, 1]]
    assert S.trajectories(np.array([a]), np.array([2.0]), 0, 0.5, 0.1, 10.0) == []


def test_predicted_clusters_follow_an_oracle():
    true = [0, 0, 1, 1, 1, 2]
    feat = lambda a, b: np.array([float(len({true[i] for i in a + b}) == 1)])
    got = S.predicted_clusters(6, feat, lambda x: x[:, 0], 0.5)
    assert sorted(map(sorted, got)) == [[0, 1], [2, 3, 4], [5]]


def test_tensor_along_an_order():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(3, 3))
    p *= (22 / np.linalg.norm(p, axis=1))[:, None]
    t = S.transition_tensor(p, np.array([0.2, 0.3, 0.1]))
    assert t.shape == (4, 4, 4, len(S.TRANSITIONS)) and (t[1, 1] == 0).all() and (t[:, 0] == 0).all()
    assert np.allclose(S.along(t, [1, 0, 2]), t[0, 2, 1] + t[2, 1, 3])


def test_event_operators_and_training(spark):
    rng = np.random.default_rng(3)
    hits, clusters, energies = [], [], []
    for ev in range(1, 41):
        i = 0
        for c in (1, 2, 3):
            n = [1, 2, 3][(ev + c) % 3]
            base = rng.normal(size=3)
            base *= 21 / np.linalg.norm(base)
            total = 0.0
            for k in range(n):
                i += 1
                e = float(rng.uniform(0.1, 0.6))
                total += e
                hits.append((ev, i, *map(float, base + rng.normal(size=3)), e, 0, 1, 1, 1))
                clusters.append((ev, c, k, i))
            energies.append((ev, c, total if (ev + c) % 2 else total + 0.3))
    h, cl = spark.createDataFrame(hits, HITS), spark.createDataFrame(clusters, CLUSTERS)
    en = spark.createDataFrame(energies, "event_id long, cluster_id int, energy double")
    assert S.energy_clusters(h, [0.5], 0.01).count() == len(hits) == S.peak_clusters(h, [0.5]).count()
    assert S.energy_clusters(h.limit(0), [0.5]).count() == 0
    rows = N.order_rows(h, cl, ["rsg_mean_1", "rc_sum_1"], en, width=3).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["event_id"], r["cluster_id"]), []).append(r)
    assert all(len(v) == (2 if v[0]["n"] == 2 else 6) and sum(r["ordered"] for r in v) == 1 for v in sizes.values())
    tracks, singles = N.suppression_rows(h, cl, ["rsg_mean_1", "first_r"], en)
    m = N.TwoBranchModel(10).fit(tracks, singles, ["rsg_mean_1", "first_r"], ["energy", "penetration_cm"])
    p = m.predict(tracks, singles).collect()
    assert len(p) == 120 and all(0 <= r["score"] <= 1 for r in p)


def test_rays_above_the_width_are_tried(spark):
    rng = np.random.default_rng(8)
    hits, clusters, sizes = [], [], {1: 2, 2: 5, 3: 6, 4: 7, 5: 8, 6: 1}
    for c, n in sizes.items():
        for k in range(n):
            hits.append((1, 10 * c + k, *map(float, rng.normal(size=3) + [20, 0, 0]), float(rng.uniform(0.1, 0.6)), 0, 1, 1, 1))
            clusters.append((1, c, k, 10 * c + k))
    h, cl = spark.createDataFrame(hits, HITS), spark.createDataFrame(clusters, CLUSTERS)
    count = lambda df: {r["cluster_id"]: r["count"] for r in df.select("cluster_id", "order_no").distinct().groupBy("cluster_id").count().collect()}
    assert count(O.tried_orders(h, cl)) == {1: 2, 2: 120, 3: 720}
    part = O.tried_orders(h, cl, 3, 8)
    assert count(part) == {1: 2, 2: 60, 3: 120, 4: 210, 5: 336}  # 3 places of 5, 6, 7 and 8
    assert count(O.tried_orders(h, cl, 4, 5)) == {1: 2, 2: 120}  # whole at width + 1
    first = sorted((r["track_pos"], r["point_idx"]) for r in part.where("cluster_id = 5 and ordered = 1").collect())
    assert first == [(0, 50), (1, 51), (2, 52)]
    rows = N.order_rows(h, cl, ["rsg_mean_1", "rth_cap_mean_1_tango"]).groupBy("cluster_id", "n").count().collect()
    assert {(r["cluster_id"], r["n"], r["count"]) for r in rows} == {(1, 2, 2), (2, 5, 120), (3, 6, 720)}
    whole = N.order_rows(h, cl, ["rsg_mean_1"], width=3, max_size=8).where("cluster_id = 4").select("n", "esum").distinct().collect()
    assert [r["n"] for r in whole] == [7] and all(abs(r["esum"] - sum(x[5] for x in hits if x[1] // 10 == 4)) < 1e-9 for r in whole)


def test_closest_subset_equals_all_masks():
    rng = np.random.default_rng(5)
    for n in range(1, 13):
        for digits in (1, 2, 12):
            e = np.round(rng.uniform(0.05, 0.9, n), digits) + 0.05
            for largest, energies in ((8, [0.5, 0.662]), (3, [1.173, 0.5, 9.0])):
                got, all_of_it = S.closest_subset(e, energies, 0.05, largest), S._masked_stack(e, energies, 0.05, largest)
                fits = min((abs(e[[i for i in range(n) if m >> i & 1]].sum() - v) for m in range(1, 1 << n) if m.bit_count() <= largest for v in energies)) < 0.05
                assert got == (all_of_it[0] if fits else None)


def test_large_events_are_clustered(spark):
    rng = np.random.default_rng(6)
    rows = [(ev, i, *map(float, rng.normal(size=3) * 20), float(np.round(rng.uniform(0.05, 0.6), 6)), 0, 1, 1, 1) for ev, n in ((1, 10), (2, 17), (3, 55)) for i in range(n)]
    h = spark.createDataFrame(rows, HITS)
    for df in (S.energy_clusters(h, [0.5, 1.332]), S.peak_clusters(h, [0.5, 1.332])):
        assert {r["event_id"]: r["count"] for r in df.groupBy("event_id").count().collect()} == {1: 10, 2: 17, 3: 55}


def test_ordered_partitions_are_all_there():
    for n, count in ((0, 1), (1, 1), (2, 3), (3, 13), (4, 73), (5, 501), (6, 4051)):
        every = [tuple(sorted(map(tuple, p))) for p in O.ordered_partitions(list(range(n)))]
        assert len(every) == len(set(every)) == count and all(sorted(i for c in p for i in c) == list(range(n)) for p in every)


def test_best_partition_against_all_and_large_events_are_told(spark):
    rng = np.random.default_rng(3)
    rows = [(ev, i, *(rng.normal(size=3) * 2 + [20, 0, 0]).tolist(), float(rng.uniform(0.1, 0.5)), 0, 1, 1, 1) for ev, n in ((1, 4), (2, 7)) for i in range(1, n + 1)]
    got = O.best_partition(spark.createDataFrame(rows, HITS)).collect()
    assert [(r["cluster_id"], r["point_idx"]) for r in got if r["event_id"] == 2] == [(None, None)]
    x, e = np.array([r[2:5] for r in rows[:4]]), np.array([r[5] for r in rows[:4]])
    fom = lambda c: 0.5 if len(c) == 1 else float(O.scores(x[None, c], e[None, c], np.array([e[c].sum()]), "angle", 18.5)[0])
    mine = {}
    for r in sorted((r for r in got if r["event_id"] == 1), key=lambda r: r["track_pos"]):
        mine.setdefault(r["cluster_id"], []).append(r["point_idx"] - 1)
    assert sum(map(fom, mine.values())) == pytest.approx(min(sum(map(fom, p)) for p in O.ordered_partitions([0, 1, 2, 3])))


def test_paths_packings_and_backward_rays_of_events(spark):
    e0, e1 = 0.8, 0.35
    cos = 1 - 0.51099895 * (1 / (e0 - e1) - 1 / e0)
    b = np.array([20.0, 0, 0]) + 2 * np.array([cos, np.sqrt(1 - cos**2), 0])
    rows = [(1, 3, 20.0, 0.0, 0.0, e1, 0, 1, 1, 1), (1, 5, *map(float, b), e0 - e1, 0, 1, 1, 1), (1, 9, 0.0, 0.0, 25.0, 0.1, 0, 1, 1, 1), (2, 1, None, 0.0, 0.0, 0.2, 0, 1, 1, 1)]
    h = spark.createDataFrame(rows + rows[:1], HITS)
    got = [tuple(r) for r in S.energy_paths(h, [e0, 0.1], 0.01, 10.0).orderBy("energy", "path_no", "track_pos").collect()]
    assert got == [(1, 0.1, 0, 0, 9), (1, 0.8, 0, 0, 3), (1, 0.8, 0, 1, 5)]
    lab = {r["point_idx"]: r["cluster_id"] for r in S.cheapest_clusters(h).collect()}
    assert set(lab) == {3, 5, 9} and lab[3] == lab[5] != lab[9]
    back = S.transition_costs(h).collect()
    assert len(back) == 3 * 2 + 3 * 2 * 1 and {r["i"] for r in back} == {0, 3, 5, 9} and all(r["j"] not in (0, r["i"], r["k"]) for r in back)
    rays = O.backward_rays(h, e_min=0.05, e_max=0.5).collect()
    assert sorted(r["point_idx"] for r in rays) == [3, 5, 9]
    near = S.classified_clusters(h, (-1.0, 0, 0, 0, 0, 0), 5.0).collect()
    assert {r["point_idx"]: r["cluster_id"] for r in near} == {3: 0, 5: 0, 9: 1}


def test_set_packing_of_many_hits():
    n = 40
    cand = {(i,): 1.0 for i in range(n)} | {(i, i + 1): 0.3 for i in range(0, n, 2)} | {(i, i + 1): 0.9 for i in range(1, n - 1, 2)}
    assert S.set_packing(n, cand) == [(i, i + 1) for i in range(0, n, 2)]


def test_classes_of_merges(spark):
    from hitloom.operators import classes as K

    e = spark.createDataFrame([(1, i) for i in range(1, 9)] + [(2, 5), (2, 5), (2, None)], "event_id long, point_idx int")
    m = spark.createDataFrame([(1, 8, 3), (1, 3, 5), (1, 2, 1), (1, 2, 99), (1, None, 4), (3, 1, 2), (1, 8, 3)], "event_id long, a int, b int")
    c = K.merged_classes(e, m)
    assert {tuple(r) for r in c.collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 4), (1, 5, 3), (1, 6, 6), (1, 7, 7), (1, 8, 3), (2, 5, 5)}
    assert {tuple(r) for r in K.class_sizes(c, 2).collect()} == {(1, 1, 2), (1, 3, 3)}
    assert {(r["a"], r["b"], r["same"]) for r in K.in_same_class(m.where("event_id = 1 and a is not null"), c).collect()} == {(8, 3, True), (3, 5, True), (2, 1, True), (2, 99, False)}
    assert K.merged_classes(e.limit(0), m).count() == 0
