"""Registered queries of the reconstruction operators over the project's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitloom.functions import geometry as G, physics as P
from hitloom.operators import classes as K, coincidences as C, events as E, features as X, metrics as M, ordering as O, programs as S, ranking as R, tracks as T, training as N
from hitloom.plans import pipeline as PL
from hitloom.runtime import table

INNER = G.SHELLS["gretina"][0]
FEATURES = ["energy_sums", "oft", "tango", "angle"]
WEIGHTS = {"energy_sums": 0.1, "oft": -1.0, "tango": 0.5, "angle": 0.25}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Each hit once."""
    h = table(spark, sf, "interactions").select("event_id", "point_idx", "x", "y", "z", "e", "ts", "crystal_no", "seg_no", "interaction_type")
    return E.distinct_hits(h)


def _with_pads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "interactions").select("event_id", "point_idx", "x", "y", "z", "e", "ts", "crystal_no", "seg_no", "interaction_type", "pad").where("not isnan(e) and not isnan(x) and not isnan(y) and not isnan(z)")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "clusters").where("track_pos is not null")
    return c.groupBy("event_id", "cluster_id", "point_idx").agg(F.min("track_pos").alias("track_pos"))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return T.ordered_hits(table(spark, sf, "interactions"), table(spark, sf, "clusters"))


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of one crystal as a stand-in for a predicted clustering."""
    return _hits(spark, sf).where("crystal_no is not null").select("event_id", "point_idx", F.col("crystal_no").alias("cluster_id"), F.col("point_idx").alias("track_pos"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlaps(_predicted(spark, sf), _clusters(spark, sf))


def _rays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rays").select("event_id", "cluster_id", "n", "esum", "fom", "tracked").distinct()


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["row_id", *R.QID, "ordered", "acceptable", *FEATURES]
    return R.clean_rows(table(spark, sf, "training_rows").select(*cols).where("ray_event_id is not null and ray_cluster_id is not null"), FEATURES)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).withColumn("s", F.round(R.score(WEIGHTS), 9))


def _relative(spark: SparkSession, sf: str) -> DataFrame:
    return R.relative_rows(_rows(spark, sf), FEATURES, normalise=False)


def coincidences(anchored: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        h = _hits(spark, sf).where("ts is not null")
        c = C.coincidences(h, gap=40, anchored=anchored)
        return _rounded(c.groupBy("coincidence_ts").agg(F.count(F.lit(1)).alias("n_hits"), F.max("ts").alias("last_ts"), F.count_distinct("crystal_no").alias("n_crystals"), F.sum("e").alias("esum")))

    return run


def fom(method: str, **kw):
    return lambda spark, sf: _rounded(T.figures_of_merit(_tracks(spark, sf), method, **kw).select("event_id", "cluster_id", "n", "fom"))


def _merges(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that follow each other in a ray, and those of one segment, as merges."""
    from pyspark.sql.window import Window

    ray = Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx")
    seg = Window.partitionBy("event_id", "crystal_no", "seg_no").orderBy("point_idx")
    a = _clusters(spark, sf).select("event_id", F.lag("point_idx").over(ray).alias("a"), F.col("point_idx").alias("b"))
    b = _hits(spark, sf).where("crystal_no is not null and seg_no is not null").select("event_id", F.lag("point_idx").over(seg).alias("a"), F.col("point_idx").alias("b"))
    return a.unionByName(b).where("a is not null").distinct()


def q_known_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns, centred cosines and angles from energies of the textbook triangles."""
    pt = lambda *v: tuple(F.lit(float(x)) for x in v)
    a, b, c = pt(0, 0, 0), pt(3, 0, 0), pt(0, 4, 0)
    d, e, f = pt(0, 0, 0), pt(1, 0, 0), pt(0.5, 3**0.5 / 2, 0)
    theta = lambda x, y: P.theta_theory(F.lit(float(x)), F.lit(float(y)), -12.0)
    cases = [
        ("right 012", G.cos_turn(a, b, c)), ("right 201", G.cos_turn(c, a, b)), ("right 120", G.cos_turn(b, c, a)), ("equal 012", G.cos_turn(d, e, f)), ("equal 120", G.cos_turn(e, f, d)), ("equal 201", G.cos_turn(f, d, e)),
        ("centred 0", F.coalesce(G.cos_between(G.minus(b, a), G.minus(c, a)), F.lit(0.0))), ("centred 1", G.cos_between(G.minus(a, b), G.minus(c, b))),
        *[(f"theta {x} {y}", theta(x, y)) for x, y in ((4, 3.5), (3, 2.5), (2, 1.5), (1, 0.5), (4, 0.1))],
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("case"), v.alias("value")) for n, v in cases])).alias("r")
    return _rounded(spark.range(1).select(rows).select("r.case", "r.value"))


def q_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two clusters of hits of one crystal should be joined, by the known rays."""
    p = _predicted(spark, sf)
    ids = p.select("event_id", "cluster_id").distinct()
    pairs = ids.withColumnRenamed("cluster_id", "cluster_a").join(ids.withColumnRenamed("cluster_id", "cluster_b"), "event_id").where("cluster_a <> cluster_b")
    return M.join_validity(pairs, p, _clusters(spark, sf))


def selection(rule: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return R.selected_rows(_scored(spark, sf), rule).select("row_id", *R.QID, "s")

    return run


def metric(f):
    return lambda spark, sf: _rounded(f(_overlaps(spark, sf)))


def q_turns(spark: SparkSession, sf: str) -> DataFrame:
    s = T.steps(_tracks(spark, sf), "sum", INNER)
    return _rounded(s.select("event_id", "cluster_id", "k", "n", "point_idx", "way", "shell_way", "cos", "cos_err", "esum", "energy", "energy_after", "local"))


def q_attenuation(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("e")
    h = _hits(spark, sf).where("e > 0")
    return _rounded(h.select("event_id", "point_idx", P.mu_absorption(e).alias("absorption"), P.mu_compton(e).alias("compton"), P.mu_pair(e).alias("pair"), P.mu_total(e).alias("total"), P.edge_outgoing(e).alias("edge"), P.energy_sigma(e).alias("sigma"), P.single_depth(G.norm(G.point()), e, INNER).alias("depth_fom")))


def q_singles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.single_features(_tracks(spark, sf)))


def q_track_features(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["rsg_mean_1", "rsg_sum_2v", "rsl_norm_2", "rlg_wmean_1v", "c_penalty_sum_1", "rc_sum_1_penalty_removed", "rth_cap_mean_1", "cross_compt_ge_dist_sum", "-log_p_abs_final", "klein-nishina_rel_sum_sum", "first_energy_ratio", "tango_sigma", "rth_cap_mean_1_tango", "-log_klein-nishina_geo_sum_tango"]
    return _rounded(X.track_features(_tracks(spark, sf), wanted))


def q_all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every ordering feature at the energy sum and at the start-energy estimate."""
    return X.track_features(_tracks(spark, sf), X.names())


def q_simple_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(X.track_features(_tracks(spark, sf), ["distances_sum", "distances_mean", "ge_distances_sum", "c_penalty_sum_1", "rc_sum_1", "rc_mean_2", "rsg_sum_1", "rsg_mean_2", "first_r", "final_r", "first_energy_ratio", "final_energy_ratio", "first_is_not_largest", "first_is_not_closest"]))


def q_relative_normal(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.relative_rows(_rows(spark, sf), FEATURES))


def q_ray_model(spark: SparkSession, sf: str) -> DataFrame:
    """Linear ranking weights by column generation, one row."""
    w = R.column_generation(_relative(spark, sf), FEATURES)
    return spark.createDataFrame([w])


def q_lost(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters over the hits that remain when those of little energy are removed."""
    return E.reindexed_clusters(_clusters(spark, sf), E.without_low_energy(_hits(spark, sf), 0.05))


QUERIES = {
    "clean_hits": lambda s, d: _rounded(E.without_low_energy(_hits(s, d), 0.01).select("event_id", "point_idx", "new_idx", "e")),
    "removed_reindexed": q_lost,
    "merged_collisions": lambda s, d: _rounded(C.merged_collisions(_hits(s, d).where("x is not null and e is not null").select("event_id", "x", "y", "z", "e", "point_idx"), ["event_id"])),
    "coincidences_first": coincidences("first"),
    "coincidences_last": coincidences("last"),
    "track_energies": lambda s, d: _rounded(T.track_energies(_tracks(s, d)).select("event_id", "cluster_id", "n", "esum", F.col("first_hit.x").alias("x1"), F.col("first_hit.e").alias("e1"), F.col("second_hit.e").alias("e2"))),
    "track_turns": q_turns,
    "fom_angle": fom("angle"),
    "fom_cosine": fom("cosine"),
    "fom_local": fom("local"),
    "fom_agata": fom("agata"),
    "fom_oft": fom("oft"),
    "fom_selected": fom("selected"),
    "fom_zeros": fom("zeros"),
    "fom_local_scaled": fom("local", variance=True, power=1),
    "fom_angle_estimated": fom("angle", start="local", excess=T.EXCESS),
    "known_turns": q_known_turns,
    "join_validity": q_validity,
    "merged_classes": lambda s, d: K.merged_classes(_hits(s, d), _merges(s, d)),
    "class_sizes": lambda s, d: K.class_sizes(K.merged_classes(_hits(s, d), _merges(s, d)), 2),
    "in_same_class": lambda s, d: K.in_same_class(_merges(s, d).select("event_id", "a", (F.col("b") + 1).alias("b")), K.merged_classes(_hits(s, d), _merges(s, d))),
    "track_transitions": lambda s, d: M.transitions(_clusters(s, d), 2),
    "track_triples": lambda s, d: M.transitions(_clusters(s, d), 3),
    "hit_relations": lambda s, d: M.hit_relations(_clusters(s, d)),
    "best_partition": lambda s, d: O.best_partition(_hits(s, d)),
    "classified_clusters": lambda s, d: S.classified_clusters(_hits(s, d), (-0.4, -0.05, -0.1, -0.2, -3.0, 0.1), 2.5),
    "margin_weights": lambda s, d: s.createDataFrame([{k: float(v) for k, v in R.margin_weights(_relative(s, d), FEATURES).items()}]),
    "hits_in_detector": lambda s, d: _hits(s, d).where("x is not null").select("event_id", "point_idx", G.Detector.of("GRETINA").holds(G.point()).alias("inside")),
    "cumulant": lambda s, d: _rounded(M.resampled_cumulant(_rays(s, d), "fom", [0.0, 0.1, 0.25, 0.5, 1.0, 1.85, 5.0])),
    "energy_cost": lambda s, d: _rounded(M.energy_cost(_rays(s, d), [0.5, 0.662, 1.173, 1.332], 0.01)),
    "energy_paths": lambda s, d: S.energy_paths(_hits(s, d), [0.5, 0.662, 1.173, 1.332], 0.3, 8.0),
    "backward_rays": lambda s, d: O.backward_rays(_hits(s, d)),
    "cheapest_clusters": lambda s, d: S.cheapest_clusters(_hits(s, d)),
    "transition_costs": lambda s, d: S.transition_costs(_hits(s, d)),
    "clusters_to_track": lambda s, d: PL.found_clusters(E.distinct_hits(PL.clean(_with_pads(s, d), PL.Options())))[1],
    "run_statistics": lambda s, d: PL.run_statistics(_with_pads(s, d)),
    "packed_within_clusters": lambda s, d: _rounded(E.packed(_hits(s, d).where("e > 0 and not isnan(e)"), 0.5, _predicted(s, d)).select("event_id", "point_idx", "x", "y", "z", "e", "n_packed")),
    "twice_ordered_rays": lambda s, d: _rounded(PL.track(_with_pads(s, d), PL.Options(order_method="oft", second_order=True)).select("event_id", "cluster_id", "n", "esum", "fom", "tracked", "ts")),
    "hit_attenuation": q_attenuation,
    "single_features": q_singles,
    "track_features": q_track_features,
    "track_features_simple": q_simple_features,
    "track_features_all": q_all_features,
    "cluster_features": lambda s, d: _rounded(X.cluster_features(_tracks(s, d)).select("event_id", "cluster_id", "n", "centroid_r", "average_r")),
    "cluster_shapes": lambda s, d: X.cluster_features(_tracks(s, d)),
    "escape_probabilities": lambda s, d: X.escape_probabilities(_tracks(s, d)),
    "cluster_centres": lambda s, d: _rounded(E.cluster_centres(_tracks(s, d).select("event_id", "point_idx", "x", "y", "z", "e"), _clusters(s, d)), 9),
    "cluster_distances": lambda s, d: _rounded(E.cluster_distances(_hits(s, d), _clusters(s, d))),
    "pair_distances": lambda s, d: _rounded(E.pair_distances(_hits(s, d))),
    "triple_angles": lambda s, d: _rounded(E.triple_angles(_hits(s, d)).select("event_id", "i", "j", "k", "way", "cos")),
    "peak_events": lambda s, d: E.in_peak(_hits(s, d), _clusters(s, d), peak=0.5, width=0.1),
    "cone_clusters": lambda s, d: E.cone_clusters(_hits(s, d), 10.0),
    "linkage_average": lambda s, d: E.linkage_clusters(_hits(s, d), alpha=8.0, metric="euclidean", method="average"),
    "linkage_germanium": lambda s, d: E.linkage_clusters(_hits(s, d), alpha=4.0, metric="germanium", method="complete", time_gap=40),
    "linkage_directional": lambda s, d: E.linkage_clusters(_hits(s, d), alpha=8.0, metric="euclidean", method="directional", max_length=8),
    "packed_hits": lambda s, d: _rounded(E.packed(_hits(s, d).where("e > 0 and not isnan(e)"), 0.5).select("event_id", "point_idx", "x", "y", "z", "e", "interaction_type", "n_packed", "ts", "crystal_no", "seg_no")),
    "smeared_hits": lambda s, d: E.smeared(_hits(s, d)),
    "rotated_hits": lambda s, d: E.rotated(_hits(s, d), ["event_id"]),
    "flattened_tracks": lambda s, d: _rounded(E.flattened(_tracks(s, d))),
    "hits_outside_peaks": lambda s, d: E.without_peak_events(_hits(s, d), _clusters(s, d), peak=0.5, width=0.1).select("event_id", "point_idx"),
    "hits_of_long_rays": lambda s, d: E.of_rays(_hits(s, d), _clusters(s, d), _clusters(s, d).groupBy("event_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 3")).select("event_id", "point_idx"),
    "event_feature_statistics": lambda s, d: _rounded(X.event_statistics(T.track_energies(_tracks(s, d)), ["esum", "n"]), 9),
    "relative_energies": lambda s, d: _rounded(X.relative_features(T.track_energies(_tracks(s, d)), ["esum"]), 9),
    "tracks_without_heads": lambda s, d: E.without_heads(_tracks(s, d), 1).select("event_id", "cluster_id", "track_pos", "point_idx"),
    "split_events": lambda s, d: E.split_by_cluster(_hits(s, d), _clusters(s, d)).select("event_id", "cluster_id", "new_idx", "point_idx"),
    "joined_events": lambda s, d: E.joined_events(_hits(s, d).select("event_id", "point_idx"), _hits(s, d).select("event_id", F.shiftright("event_id", 1).alias("group_id")).distinct()),
    "clusters_by_smallest": lambda s, d: E.by_smallest(_clusters(s, d)).select("event_id", "cluster_id", "new_id", "point_idx"),
    "ordered_rays": lambda s, d: O.order_rays(table(s, d, "interactions"), table(s, d, "clusters")),
    "tried_orders": lambda s, d: O.tried_orders(table(s, d, "interactions"), table(s, d, "clusters")),
    "pair_counts": metric(M.pair_counts),
    "purity": metric(M.purity),
    "mismatches": metric(M.mismatches),
    "captured_clusters": metric(M.captured),
    "recovered_clusters": metric(M.recovered),
    "clusters_in_order": lambda s, d: M.in_order(_predicted(s, d), _clusters(s, d)),
    "spectrum": lambda s, d: _rounded(M.spectrum(_rays(s, d), 0.01)),
    "peak_to_total": lambda s, d: _rounded(M.peak_to_total(_rays(s, d), [0.25, 0.5, 1.0, 1.85], (0.4, 0.6))),
    "rank_relative": lambda s, d: _rounded(_relative(s, d)),
    "rank_relative_unit": q_relative_normal,
    "rank_select_least": selection("least"),
    "rank_select_neg": selection("neg"),
    "rank_select_pos_neg": selection("pos_neg"),
    "rank_select_best": selection("best"),
    "rank_select_neg_best": selection("neg_best"),
    "rank_select_n_neg": selection("n_neg"),
    "rank_select_all_neg": selection("all_neg"),
    "rank_solved": lambda s, d: R.solved(_relative(s, d).withColumn("s", F.round(R.score(WEIGHTS), 9))),
    "rank_acceptable": lambda s, d: R.acceptable_at_top(_scored(s, d)),
    "rank_weights": lambda s, d: _rounded(R.ray_weights(_rows(s, d)).select("row_id", "weight")),
    "rank_labels": lambda s, d: R.dense_labels(_rows(s, d)),
    "rank_mean_of_means": lambda s, d: _rounded(R.mean_of_means(_relative(s, d), FEATURES)),
    "rank_scaled": lambda s, d: _rounded(R.scaled(_rows(s, d), FEATURES).select("row_id", *FEATURES)),
    "rank_model": q_ray_model,
    "energy_clusters": lambda s, d: S.energy_clusters(_hits(s, d), [0.5, 0.662, 1.173, 1.332]),
    "dendrogram_peaks": lambda s, d: S.peak_clusters(_hits(s, d), [0.5, 0.662, 1.173, 1.332], 0.01),
    "training_orders": lambda s, d: N.order_rows(_hits(s, d), _clusters(s, d), ["rsg_mean_1", "c_penalty_sum_1", "rc_sum_1", "rth_cap_mean_1_tango"]),
    "tracked_rays": lambda s, d: PL.track(_with_pads(s, d)).select("event_id", "cluster_id", "n", "esum", "fom", "tracked", "ts"),
}

# --- SQL ---------------------------------------------------------------------------------------

_H = """h as (select event_id, point_idx, min(x) as x, min(y) as y, min(z) as z, min(e) as e, min(ts) as ts, min(crystal_no) as crystal_no, min(seg_no) as seg_no
           from interactions group by event_id, point_idx)"""
_C = """c as (select event_id, cluster_id, point_idx, min(track_pos) as track_pos from clusters where track_pos is not null group by all)"""
_T = f"""{_H}, {_C},
t0 as (select c.event_id, c.cluster_id, c.track_pos, c.point_idx, x, y, z, e from c join h using (event_id, point_idx)
       where x is not null and y is not null and z is not null and e > 0 and not (not isfinite(e))),
t1 as (select *, row_number() over w as k, count(*) over p as n, sum(e) over p as esum,
         coalesce(sum(e) over (w rows between unbounded preceding and 1 preceding), 0) as bef,
         coalesce(lag(x) over w, 0) as px, coalesce(lag(y) over w, 0) as py, coalesce(lag(z) over w, 0) as pz,
         lead(x) over w as nx, lead(y) over w as ny, lead(z) over w as nz,
         0.463 + 0.551 * sqrt(0.1 / e) as sb, coalesce(0.463 + 0.551 * sqrt(0.1 / lag(e) over w), 0.463) as sa, 0.463 + 0.551 * sqrt(0.1 / lead(e) over w) as sc
       from t0 window w as (partition by event_id, cluster_id order by track_pos, point_idx), p as (partition by event_id, cluster_id)),
t2 as (select *, sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2) as way, sqrt((nx-x)**2 + (ny-y)**2 + (nz-z)**2) as nway,
         (x-px)*(nx-x) + (y-py)*(ny-y) + (z-pz)*(nz-z) as dots, esum - bef as energy, case when k < n then esum - bef - e end as after from t1),
t3 as (select *, case when k < n then case when way * nway = 0 then -1.0 else greatest(-1.0, least(1.0, dots / (way * nway))) end end as cs,
         -(px*(x-px) + py*(y-py) + pz*(z-pz)) / greatest(way, 1e-10) as b1 from t2),
t4 as (select *, b1 * b1 - (px*px + py*py + pz*pz) + {INNER**2!r} as sq, 1 - cs as omc,
         sqrt((1 - cs**2) * ((sa**2 + sb**2) / (case when way <= 0 then 1 else way end)**2 + 2 * sb**2 * cs / ((case when way <= 0 then 1 else way end) * (case when nway <= 0 then 1 else nway end)) + (sb**2 + sc**2) / (case when nway <= 0 then 1 else nway end)**2)) as cerr from t3),
t5 as (select *, sqrt(greatest(sq, 0)) as hf from t4),
t6 as (select *, way - greatest(0, least(way, b1 + hf) - greatest(0, b1 - hf)) as shell,
         case when omc <= 0 then 123456789.0 else 0.5*e + sqrt(e**2/4 + e*{P.MEC2}/nullif(omc, 0)) end as loc,
         case when k < n then energy / (1 + energy/{P.MEC2}*omc) end as geo,
         1 - {P.MEC2} * (1/case when after > 0 then after end - 1/energy) as ct from t5)"""


def _mu(kind: str, e: str) -> str:
    x = f"ln({e} * 1e6)"
    if kind == "abs":
        a, b, c, d, f = P.ABSORPTION_FIT
        return f"(exp({a} * ln(1 + exp({b} * ({x} - {c}))) + ({d} * {x} + {f})) / {P.BARN} * {P.RANGE!r})"
    if kind == "compt":
        a, b, c, d, f = P.COMPTON_FIT
        return f"(exp({a} * exp({b} * ({x} - {c})) + ({d} * {x} + {f})) / {P.BARN} * {P.RANGE!r})"
    a, b, c = P.PAIR_FIT
    t = P.PAIR_THRESHOLD_EV
    return f"(case when {e} * 1e6 <= {t} then 0.0 else exp({a} * {x}**2 + {b} * {x} + {c}) * ({e}*1e6 * ({e}*1e6 - {t}))**3 / {P.BARN} * {P.RANGE!r} end)"


_PTS = "(values " + ", ".join(f"({a}, {fa}, {b}, {fb})" for (a, fa), (b, fb) in zip(P.SINGLES_DEPTH, P.SINGLES_DEPTH[1:])) + ") as pts(a, fa, b, fb)"
#: Single hits in a figure of merit: 1.85 where they lie deeper than their energy allows.
_ONE = f""" union all select event_id, cluster_id, n, case when sqrt(x*x + y*y + z*z) - {INNER} > coalesce((select fa + (e - a) * ((fb - fa) / (b - a)) from {_PTS} where e > a and e <= b), {P.SINGLES_DEPTH[-1][1]}) then 1.85::double else 0.0::double end as fom from t6 where n = 1"""


def _linked(where: str, near: str) -> str:
    """CTEs l(event_id, point_idx, low): hits ``o`` of an event with the least hit of their chain of pairs that are ``near``."""
    return f"""o as (select * from h where x is not null and y is not null and z is not null and ({where})),
pr as (select a.event_id, a.point_idx as i, b.point_idx as j from o a join o b on a.event_id = b.event_id and a.point_idx <> b.point_idx and {near}),
rc(event_id, i, j) as (select event_id, i, j from pr union select rc.event_id, rc.i, pr.j from rc join pr on rc.event_id = pr.event_id and rc.j = pr.i),
l as (select o.event_id, o.point_idx, min(least(o.point_idx, coalesce(rc.j, o.point_idx))) as low from o left join rc on rc.event_id = o.event_id and rc.i = o.point_idx group by o.event_id, o.point_idx)"""


#: The angle between two hits as seen from the origin: 0 for two hits there, null for one.
_NA, _NB = "sqrt(a.x*a.x + a.y*a.y + a.z*a.z)", "sqrt(b.x*b.x + b.y*b.y + b.z*b.z)"
_ANGLE = f"case when {_NA} * {_NB} > 0 then acos(greatest(-1, least(1, (a.x*b.x + a.y*b.y + a.z*b.z) / ({_NA} * {_NB})))) when {_NA} + {_NB} = 0 then 0 end"
_PADS = """h as (select event_id, point_idx, h.x as x, h.y as y, h.z as z, h.e as e, h.ts as ts, h.crystal_no as crystal_no, h.pad as pad from
  (select event_id, point_idx, min({'x': x, 'y': y, 'z': z, 'e': e, 'ts': ts, 'crystal_no': crystal_no, 'seg_no': seg_no, 'interaction_type': interaction_type, 'pad': pad}) as h
   from interactions where e > 0 and not isnan(e) and (x is null or not isnan(x)) and (y is null or not isnan(y)) and (z is null or not isnan(z)) group by event_id, point_idx))"""
_CLASSES = f"""{_H}, {_C}, m as (select distinct event_id, a, b from (select event_id, lag(point_idx) over (partition by event_id, cluster_id order by track_pos, point_idx) as a, point_idx as b from c
  union all select event_id, lag(point_idx) over (partition by event_id, crystal_no, seg_no order by point_idx), point_idx from h where crystal_no is not null and seg_no is not null) where a is not null),
pr as (select m.event_id, m.a as i, m.b as j from m join h x on x.event_id = m.event_id and x.point_idx = m.a join h y on y.event_id = m.event_id and y.point_idx = m.b union select m.event_id, m.b, m.a from m join h x on x.event_id = m.event_id and x.point_idx = m.a join h y on y.event_id = m.event_id and y.point_idx = m.b),
rc(event_id, i, j) as (select event_id, i, j from pr union select rc.event_id, rc.i, pr.j from rc join pr on rc.event_id = pr.event_id and rc.j = pr.i),
l as (select h.event_id, h.point_idx, min(least(h.point_idx, coalesce(rc.j, h.point_idx))) as low from h left join rc on rc.event_id = h.event_id and rc.i = h.point_idx group by h.event_id, h.point_idx)"""
_CONE = f"{_PADS}, " + _linked("true", f"{_ANGLE} <= 20.0 * pi() / 180 and abs(a.ts - b.ts) < 40")
_PACKED = _H.replace("min(seg_no) as seg_no", "min(seg_no) as seg_no, min(interaction_type) as interaction_type") + ", " + _linked("e > 0 and not isnan(e)", "sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 0.5")


_AGATA = f"""with {_T},
m as (select *, {_mu("abs", "energy")} as ma, {_mu("compt", "energy")} as mc, {_mu("pair", "energy")} as mp from t6 where n > 1),
v as (select *, ma + mc + mp as mt, (after - geo)**2 / (1e-6 * ((geo/energy)**4 + (n + 1 - (k - 1)) * (1 - (geo/energy)**2)**2) + (cerr * geo**2 / {P.MEC2})**2) * case when k = 1 then 2 else 1 end as v2 from m),
s as (select event_id, cluster_id, n, (sum(v2) filter (k < n) + sum(mc*shell - ln(mc/mt)) filter (k < n) + max(ma*shell - ln(ma/mt)) filter (k = n)) / (2*n - 1) as a from v group by event_id, cluster_id, n)
"""
_OV = f"""with {_H}, {_C}, p as (select event_id, point_idx, crystal_no as p from h where crystal_no is not null),
o as (select event_id, p, cluster_id as t, count(*) as n from p join c using (event_id, point_idx) group by all)"""
_R = """with r as (select distinct row_id, ray_event_id, ray_cluster_id, ordered, acceptable,
  case when energy_sums is null or (not isfinite(energy_sums)) or energy_sums = 123456789.0 then 0 else energy_sums end as energy_sums,
  case when oft is null or (not isfinite(oft)) or oft = 123456789.0 then 0 else oft end as oft,
  case when tango is null or (not isfinite(tango)) or tango = 123456789.0 then 0 else tango end as tango,
  case when angle is null or (not isfinite(angle)) or angle = 123456789.0 then 0 else angle end as angle
  from training_rows where ray_event_id is not null and ray_cluster_id is not null)"""
_S = _R + ", s0 as (select *, round(0.0 + energy_sums * 0.1 + oft * -1.0 + tango * 0.5 + angle * 0.25, 9) as s from r)"
_D = _R + """, tr as (select ray_event_id, ray_cluster_id, arg_min(energy_sums, row_id) as e0, arg_min(oft, row_id) as o0, arg_min(tango, row_id) as t0, arg_min(angle, row_id) as a0
     from r where ordered = 1 group by all),
d as (select row_id, ray_event_id, ray_cluster_id, energy_sums - e0 as energy_sums, oft - o0 as oft, tango - t0 as tango, angle - a0 as angle from r join tr using (ray_event_id, ray_cluster_id) where ordered <> 1)"""
_Q = "partition by ray_event_id, ray_cluster_id"


def _features_sql(start: str) -> str:
    """CTEs over t6 with the residuals of every turn at a start energy; ``r{suffix}`` has a row per hit of tracks of two or more."""
    x = "fs" if start == "sum" else "ft"
    first = "esum" if start == "sum" else "greatest(esum, coalesce(sum(case when k < n then (bef + loc) / (ls + 0.001 * sqrt(k)) end) over q / sum(case when k < n then 1 / (ls + 0.001 * sqrt(k)) end) over q, esum))"
    return f"""{x}1 as (select *, case when omc <= 0 or e <= 0 then 123456789.0 else 0.5 + 0.5 / nullif(sqrt(greatest(e*e/4 + e*{P.MEC2}/nullif(omc, 0), 0)), 0) * (e/2 + {P.MEC2}/nullif(omc, 0)) end as de,
 case when omc <= 0 or e <= 0 then 123456789.0 else 0.5 / nullif(sqrt(greatest(e*e/4 + e*{P.MEC2}/nullif(omc, 0), 0)), 0) * (e*{P.MEC2}) / (nullif(omc, 0) * nullif(omc, 0)) end as dc from t6 where n > 1),
{x}2 as (select *, sqrt((0.001*de)**2 + (cerr*dc)**2) as ls from {x}1),
{x}3 as (select *, {first} as st from {x}2 window q as (partition by event_id, cluster_id)),
{x}4 as (select *, st - bef as en, case when k < n then st - bef - e end as af, n - (k - 1) as lft from {x}3),
{x}5 as (select *, case when k < n then en / (1 + en/{P.MEC2}*omc) end as gm, 1 + {P.MEC2}/en - {P.MEC2}/case when af > 0 then af end as th, {_mu("abs", "en")} as ma, {_mu("compt", "en")} as mc, {_mu("pair", "en")} as mp from {x}4),
r{x} as (select *, ma + mc + mp as mt, abs(af - gm) as rsg, sqrt(1e-6 * ((gm/en)**4 + lft * (1 - (gm/en)**2)**2) + (cerr * gm**2 / {P.MEC2})**2) as rsg_s, abs(en - loc) as rsl, abs(loc - e - gm) as rlg,
 sqrt(1e-6 * ((de - 1 - (gm/nullif(af, 0))**2)**2 + lft * (gm/nullif(af, 0))**4) + cerr**2 * (dc - gm**2/{P.MEC2})**2) as rlg_s, abs(cs - th) as rc, case when th < -1 then 1.0::double when th is not null then 0.0::double end as pen,
 case when k < n then coalesce(abs(acos(cs) - acos(case when th is not null then greatest(th, -1) end)), 2 * pi()) end as rtc,
 {_kn("af/en")} as kns, {_kn("gm/en")} as kng from {x}5)"""


def _kn(ratio: str) -> str:
    """Klein-Nishina cross-section by polar angle, of a turn."""
    return f"case when k < n then {math.pi * P.R_0**2!r} * ({ratio}) * (1 + ({ratio}) * (({ratio}) - omc * (2 - omc))) * sqrt(greatest(omc * (2 - omc), 0)) end"


_PEAKS = f"""with {_H}, {_C}, j as (select c.*, x, y, z, e from c join h using (event_id, point_idx)),
r as (select event_id, cluster_id, sum(e) as esum, arg_min(x, track_pos) as x, arg_min(y, track_pos) as y, arg_min(z, track_pos) as z from j where x is not null and y is not null and z is not null group by all),
k as (select event_id, cluster_id, sum(e) as esum from j group by all)
select event_id, coalesce(bool_or(abs(k.esum * (1 - 0.0845 * (z / nullif(sqrt(x*x + y*y + z*z), 0))) / sqrt(1 - 0.0845**2) - 0.5) < 0.1), false) as in_peak from k left join r using (event_id, cluster_id) group by event_id"""


def _select(where: str) -> str:
    return _S + f""", k as (select *, row_number() over ({_Q} order by s, row_id) as r1, row_number() over ({_Q} order by s desc, row_id) as r2, min(s) over ({_Q}) as lo from s0)
select row_id, ray_event_id, ray_cluster_id, s from k where {where}"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c.split(' as ')[0]}, 6) as {c.split(' as ')[-1]}" for c in cols)


SQL = {
    "clean_hits": f"with {_H} select event_id, point_idx, row_number() over (partition by event_id order by point_idx) as new_idx, {_r('e')} from h where e > 0.01",
    "removed_reindexed": f"with {_H}, {_C}, w as (select event_id, point_idx, row_number() over (partition by event_id order by point_idx) as new_idx from h where e > 0.05) select event_id, cluster_id, track_pos, new_idx as point_idx from c join w using (event_id, point_idx)",
    "merged_collisions": f"with {_H} select event_id, {_r('x', 'y', 'z')}, round(sum(e), 6) as e, min(point_idx) as point_idx from h where x is not null and e is not null group by event_id, h.x, h.y, h.z",
    "coincidences_last": f"with {_H}, d as (select *, case when ts - lag(ts) over (order by ts) < 40 then 0 else 1 end as b from h where ts is not null), g as (select *, sum(b) over (order by ts) as g from d) select min(ts) as coincidence_ts, count(*) as n_hits, max(ts) as last_ts, count(distinct crystal_no) as n_crystals, round(sum(e), 6) as esum from g group by g",
    "coincidences_first": f"""with recursive {_H}, d as (select distinct ts from h where ts is not null),
n as (select ts, min(ts) over (order by ts range between 40 following and unbounded following) as nxt from d),
b as (select ts from (select ts, lag(ts) over (order by ts) as p from d) where p is null or ts - p >= 40),
a(ts) as (select ts from b union select n.nxt from a join n using (ts) where n.nxt is not null),
g as (select h.*, max(a.ts) over (order by h.ts) as anchor from h left join a on a.ts = h.ts where h.ts is not null)
select anchor as coincidence_ts, count(*) as n_hits, max(ts) as last_ts, count(distinct crystal_no) as n_crystals, round(sum(e), 6) as esum from g group by anchor""",
    "track_energies": f"with {_T} select event_id, cluster_id, n, round(max(esum), 6) as esum, round(max(x) filter (k = 1), 6) as x1, round(max(e) filter (k = 1), 6) as e1, round(max(e) filter (k = 2), 6) as e2 from t6 group by event_id, cluster_id, n",
    "track_turns": f"with {_T} select event_id, cluster_id, k, n, point_idx, {_r('way', 'shell as shell_way', 'cs as cos', 'cerr as cos_err', 'esum', 'energy', 'after as energy_after')}, round(loc, 6) as local from t6",
    "fom_angle": f"with {_T}, a as (select *, acos(cs) - acos(greatest(case when ct <= 1 then ct end, -1)) as r from t6 where n > 1 and k < n) select event_id, cluster_id, n, round(sqrt(sum(coalesce(case when ct <= 1 then r end, 2*pi())**2) + 0.4 * sum(greatest(0, -1 - ct))) / (n - 1), 6) as fom from a group by event_id, cluster_id, n" + _ONE,
    "fom_cosine": f"with {_T} select event_id, cluster_id, n, round(sqrt(sum((cs - greatest(ct, -1))**2)) / (n - 1) + 0.4 * sum(case when ct < -1 then 1 else 0 end), 6) as fom from t6 where n > 1 and k < n group by event_id, cluster_id, n" + _ONE,
    "fom_local": f"with {_T} select event_id, cluster_id, n, round(sum((energy - loc)**2), 6) as fom from t6 where n > 1 and k < n group by event_id, cluster_id, n" + _ONE,
    "fom_agata": _AGATA + "select event_id, cluster_id, n, round(a, 6) as fom from s" + _ONE,
    "fom_oft": _AGATA + "select event_id, cluster_id, n, round(exp(-a), 6) as fom from s" + _ONE,
    "hit_attenuation": f"""with {_H}, pts(a, fa, b, fb) as (values {", ".join(f"({a}, {fa}, {b}, {fb})" for (a, fa), (b, fb) in zip(P.SINGLES_DEPTH, P.SINGLES_DEPTH[1:]))}),
q as (select *, {_mu("abs", "e")} as ma, {_mu("compt", "e")} as mc, {_mu("pair", "e")} as mp from h where e > 0)
select event_id, point_idx, {_r("ma as absorption", "mc as compton", "mp as pair")}, round(ma + mc + mp, 6) as total, round(e / (1 + 2 * e / {P.MEC2}), 6) as edge, round(sqrt(1 + 3.7 * e) / 2.3548 / 1000, 6) as sigma,
case when sqrt(x*x + y*y + z*z) - {INNER} > coalesce((select fa + (e - a) * ((fb - fa) / (b - a)) from pts where e > a and e <= b), {P.SINGLES_DEPTH[-1][1]}) then 1.85::double else 0.0::double end as depth_fom from q""",
    "single_features": f"""with {_T}, pts(a, fa, b, fb) as (values {", ".join(f"({a}, {fa}, {b}, {fb})" for (a, fa), (b, fb) in zip(P.SINGLES_DEPTH, P.SINGLES_DEPTH[1:]))}),
q as (select *, greatest(sqrt(x*x + y*y + z*z) - {INNER}, 1e-16) as pen, {_mu("abs", "e")} + {_mu("compt", "e")} + {_mu("pair", "e")} as mu from t6 where n = 1),
g as (select *, {G.SHELLS["gretina"][1] - INNER!r} - pen as edg from q)
select event_id, cluster_id, {_r("pen as penetration_cm", "edg as edge_cm")}, round(mu, 6) as "linear_attenuation_cm-1", round(e, 6) as energy, round(pen*mu, 6) as pen_attenuation, round(exp(-pen*mu), 6) as pen_prob_remain, round(mu*exp(-pen*mu), 6) as pen_prob_density, round(1-exp(-pen*mu), 6) as pen_prob_cumu,
round(edg*mu, 6) as edge_attenuation, round(exp(-edg*mu), 6) as edge_prob_remain, round(mu*exp(-edg*mu), 6) as edge_prob_density, round(1-exp(-edg*mu), 6) as edge_prob_cumu, round(1/pen, 6) as inv_pen, round(1/nullif(edg, 0), 6) as inv_edge,
case when pen > coalesce((select fa + (e - a) * ((fb - fa) / (b - a)) from pts where e > a and e <= b), {P.SINGLES_DEPTH[-1][1]}) then 1.85::double else 0.0::double end as interpolated_range from g""",
    "track_features_simple": f"""with {_T} select event_id, cluster_id, n, round(max(esum), 6) as esum, round(sum(way), 6) as distances_sum, round(avg(way), 6) as distances_mean, round(sum(shell), 6) as ge_distances_sum,
sum(case when ct < -1 then 1.0::double when ct is not null then 0.0::double end) as c_penalty_sum_1, round(sum(abs(cs - ct)), 6) as rc_sum_1, round(sum(abs(cs - ct)**2) / (n - 1), 6) as rc_mean_2, round(sum(abs(after - geo)), 6) as rsg_sum_1, round(sum((after - geo)**2) / (n - 1), 6) as rsg_mean_2,
round(max(sqrt(x*x+y*y+z*z)) filter (k = 1), 6) as first_r, round(max(sqrt(x*x+y*y+z*z)) filter (k = n), 6) as final_r, round(max(e) filter (k = 1) / max(esum), 6) as first_energy_ratio, round(max(e) filter (k = n - 1) / (max(e) filter (k = n - 1) + max(e) filter (k = n)), 6) as final_energy_ratio,
case when max(e) > max(e) filter (k = 1) then 1.0::double else 0.0::double end as first_is_not_largest, case when min(sqrt(x*x+y*y+z*z)) < max(sqrt(x*x+y*y+z*z)) filter (k = 1) then 1.0::double else 0.0::double end as first_is_not_closest from t6 where n > 1 group by event_id, cluster_id, n""",
    "cluster_features": f"with {_T} select event_id, cluster_id, n, round(sqrt(avg(x)**2 + avg(y)**2 + avg(z)**2), 6) as centroid_r, round(avg(sqrt(x*x+y*y+z*z)), 6) as average_r from t6 group by event_id, cluster_id, n",
    "cluster_centres": f"with {_T}, u as (select distinct event_id, point_idx, x, y, z, e from t6), j as (select * from c join u using (event_id, point_idx)) select event_id, cluster_id, count(*) as n, round(sum(e), 9) as esum, round(avg(x), 9) as centroid_x, round(avg(y), 9) as centroid_y, round(avg(z), 9) as centroid_z, round(sum(e*x)/sum(e), 9) as barycentre_x, round(sum(e*y)/sum(e), 9) as barycentre_y, round(sum(e*z)/sum(e), 9) as barycentre_z from j group by event_id, cluster_id",
    "cluster_distances": f"with {_H}, {_C}, j as (select c.*, x, y, z from c join h using (event_id, point_idx) where x is not null and y is not null and z is not null), q as (select a.event_id, a.cluster_id as cluster_a, b.cluster_id as cluster_b, a.track_pos as pa, b.track_pos as pb, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) as d from j a join j b on a.event_id = b.event_id and a.cluster_id < b.cluster_id) select event_id, cluster_a, cluster_b, round(min(d), 6) as least, round(max(d), 6) as largest, round(avg(d), 6) as mean, round(arg_min(d, (-pa, pb)), 6) as tail_to_head from q group by all",
    "purity": _OV + ", b as (select event_id, p, max(n) as best, sum(n) as m from o group by all) select event_id, round(sum(best) / sum(m), 6) as purity, sum(best)::bigint as matched, sum(m)::bigint as hits from b group by event_id",
    "pair_counts": _OV + """, a as (select event_id, sum(n*(n-1)/2) as tp, sum(n) as hits from o group by 1),
b as (select event_id, sum(m*(m-1)/2) as pp from (select event_id, p, sum(n) as m from o group by all) group by 1), e as (select event_id, sum(m*(m-1)/2) as pt from (select event_id, t, sum(n) as m from o group by all) group by 1),
f as (select event_id, tp::double as tp, (pp - tp)::double as fp, (pt - tp)::double as fn, (hits*(hits-1)/2 - pp - pt + tp)::double as tn from a join b using (event_id) join e using (event_id))
select *, round(case when tp+fp = 0 then 1 else tp/(tp+fp) end, 6) as precision, round(case when tp+fn = 0 then 1 else tp/(tp+fn) end, 6) as recall, round(case when tp+fp+fn+tn = 0 then 1 else (tp+tn)/(tp+fp+fn+tn) end, 6) as rand_index, round(case when tp+fp+fn = 0 then 1 else tp/(tp+fp+fn) end, 6) as jaccard from f""",
    "mismatches": _OV + """, sp as (select event_id, p, sum(n) as sp from o group by all), st as (select event_id, t, sum(n) as st from o group by all),
q as (select sp.event_id, sp.p, st.t, (sp + st - 2 * coalesce(n, 0))::bigint as cost from sp join st using (event_id) left join o on o.event_id = sp.event_id and o.p = sp.p and o.t = st.t)
select event_id, p, arg_min(t, (cost, t)) as best_t, min(cost) as mismatch from q group by event_id, p""",
    "captured_clusters": _OV + """, x as (select event_id, p, count(*) > 1 as mixed from o group by all)
select event_id, t, sum(n)::bigint as n, count(*) > 1 as split_up, bool_or(mixed) as joined, not (count(*) > 1) and not bool_or(mixed) as correct from o join x using (event_id, p) group by event_id, t""",
    "recovered_clusters": _OV + """, x as (select event_id, p, count(*) > 1 as mixed from o group by all), y as (select event_id, t, not (count(*) > 1) and not bool_or(mixed) as correct from o join x using (event_id, p) group by event_id, t)
select event_id, count(*) as n_true, count(*) filter (correct) as n_recovered, bool_and(correct) as all_match from y group by event_id""",
    "spectrum": "with r as (select distinct event_id, cluster_id, n, esum, fom, tracked from rays where esum is not null and not isnan(esum)) select floor(esum / 0.01)::bigint as bin, round(floor(esum / 0.01)::bigint * 0.01::double, 6) as low, count(*) as n from r group by 1",
    "peak_to_total": """with r as (select distinct event_id, cluster_id, n, esum, fom, tracked from rays where fom is not null and not (not isfinite(fom)) and esum is not null), k(cut) as (values (0.25), (0.5), (1.0), (1.85)),
g as (select cut::double as cut, count(*) filter (fom <= cut and esum >= 0.4 and esum <= 0.6) as n_peak, count(*) filter (fom <= cut) as n_accepted, count(*) as n_all from r, k group by cut)
select *, round(n_peak / nullif(n_accepted, 0), 6) as peak_to_total, round(n_accepted / n_all, 6) as efficiency from g""",
    "triple_angles": f"""with {_H}, g as (select event_id, point_idx, x, y, z from h where x is not null and y is not null and z is not null and e > 0), o as (select * from g union all select distinct event_id, 0, 0.0, 0.0, 0.0 from g),
t as (select a.event_id, a.point_idx as i, b.point_idx as j, c.point_idx as k, b.x-a.x as ux, b.y-a.y as uy, b.z-a.z as uz, c.x-b.x as vx, c.y-b.y as vy, c.z-b.z as vz from o a join g b on a.event_id = b.event_id and a.point_idx <> b.point_idx join g c on c.event_id = b.event_id and c.point_idx <> b.point_idx and c.point_idx <> a.point_idx),
q as (select *, sqrt(ux*ux+uy*uy+uz*uz) as way, sqrt(vx*vx+vy*vy+vz*vz) as nway from t)
select event_id, i, j, k, round(way, 6) as way, round(case when way * nway = 0 then -1.0::double else greatest(-1, least(1, (ux*vx+uy*vy+uz*vz) / (way * nway))) end, 6) as cos from q""",
    "peak_events": _PEAKS,
    "fom_zeros": f"with {_T} select event_id, cluster_id, n, 0.0::double as fom from t6 group by event_id, cluster_id, n",
    "known_turns": """select "case", v0::double as "value" from (values ('right 012', -0.6), ('right 201', 0.0), ('right 120', -0.8), ('equal 012', -0.5), ('equal 120', -0.5), ('equal 201', -0.5), ('centred 0', 0.0), ('centred 1', 0.6),
 ('theta 4 3.5', round(0.19134129, 6)), ('theta 3 2.5', round(0.26177011, 6)), ('theta 2 1.5', round(0.41570088, 6)), ('theta 1 0.5', round(1.05985215, 6)), ('theta 4 0.1', -12.0)) as t("case", v0)""",
    "pair_distances": f"""with {_H}, q as (select a.event_id, a.point_idx as i, b.point_idx as j, a.x as ax, a.y as ay, a.z as az, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) as d, {_ANGLE} as angle,
 -(a.x*(b.x-a.x) + a.y*(b.y-a.y) + a.z*(b.z-a.z)) as m0 from h a join h b on a.event_id = b.event_id and a.point_idx < b.point_idx where a.x is not null and a.y is not null and a.z is not null and b.x is not null and b.y is not null and b.z is not null),
w as (select *, m0 / greatest(d, 1e-10) as m from q), v as (select *, sqrt(greatest(m*m - (ax*ax + ay*ay + az*az) + {INNER**2!r}, 0)) as hf from w)
select event_id, i, j, round(d, 6) as euclidean, round(angle, 6) as angle, round(d - greatest(0, least(d, m + hf) - greatest(0, m - hf)), 6) as material from v""",
    "hits_outside_peaks": f"with {_H}, pk as ({_PEAKS}) select event_id, point_idx from h where event_id not in (select event_id from pk where in_peak)",
    "clusters_in_order": _OV.split(", p as (")[0] + """, p as (select event_id, point_idx, crystal_no as p, row_number() over (partition by event_id, crystal_no order by point_idx) as rp from h where crystal_no is not null),
t as (select event_id, point_idx, cluster_id as t, row_number() over (partition by event_id, cluster_id order by track_pos, point_idx) as rt from c)
select t.event_id, t.t, bool_and(coalesce(rt = rp, false)) and count(distinct p) = 1 as ordered from t left join p using (event_id, point_idx) group by t.event_id, t.t""",
    "flattened_tracks": f"""with {_T}, f as (select event_id, cluster_id, k, point_idx, e, sum(case when k = 1 then {INNER} + shell else shell end) over w as along, first_value(x / nullif(sqrt(x*x + y*y + z*z), 0)) over w as ux,
 first_value(y / nullif(sqrt(x*x + y*y + z*z), 0)) over w as uy, first_value(z / nullif(sqrt(x*x + y*y + z*z), 0)) over w as uz from t6 window w as (partition by event_id, cluster_id order by k rows between unbounded preceding and current row))
select event_id, cluster_id, k, point_idx, round(e, 6) as e, round(ux * along, 6) as x, round(uy * along, 6) as y, round(uz * along, 6) as z from f""",
    "join_validity": _OV.split(", p as (")[0] + """, p as (select event_id, point_idx, crystal_no as p from h where crystal_no is not null), t as (select event_id, point_idx, cluster_id as t, row_number() over (partition by event_id, cluster_id order by track_pos, point_idx) as place from c),
o as (select event_id, p, min(t) as t, count(distinct t) = 1 and count(t) = count(*) as pure, arg_min(place, point_idx) as head, arg_max(place, point_idx) as tail from p left join t using (event_id, point_idx) group by all),
j as (select a.event_id, a.p as cluster_a, b.p as cluster_b, coalesce(a.pure and b.pure and a.t = b.t, false) as "join", coalesce(b.head = a.tail + 1, false) as follows from o a join o b on a.event_id = b.event_id and a.p <> b.p)
select event_id, cluster_a, cluster_b, "join", "join" and follows as "end" from j""",
    "cumulant": """with r as (select distinct event_id, cluster_id, n, esum, fom, tracked from rays where fom is not null and not isnan(fom)), k(t) as (values (0.0), (0.1), (0.25), (0.5), (1.0), (1.85), (5.0))
select t::double as t, round((count(*) filter (fom < t) + count(*) filter (fom <= t)) / 2.0 / count(*), 6)::double as cumulant from r, k group by t""",
    "energy_cost": """with r as (select distinct event_id, cluster_id, n, esum, fom, tracked from rays where esum is not null and not isnan(esum)), o as (select event_id, least(abs(esum - 0.5), abs(esum - 0.662), abs(esum - 1.173), abs(esum - 1.332)) as f from r)
select event_id, count(*) as n_rays, count(*) filter (f < 0.01) as in_peak, round(sum(case when f < 0.01 then 0 else f end), 6)::double as cost from o group by event_id""",
    "cone_clusters": f"with recursive {_H}, " + _linked("true", f"{_ANGLE} <= 10.0 * pi() / 180") + " select event_id, (dense_rank() over (partition by event_id order by low) - 1)::int as cluster_id, point_idx from l",
    "packed_hits": f"with recursive {_PACKED}, j as (select * from o join l using (event_id, point_idx)) select event_id, min(point_idx) as point_idx, {', '.join(f'round(sum(e*{c})/sum(e), 6) as {c}' for c in 'xyz')}, round(sum(e), 6) as e, max(j.interaction_type) as interaction_type, count(*) as n_packed, {', '.join(f'arg_min_null({c}, point_idx) as {c}' for c in ('ts', 'crystal_no', 'seg_no'))} from j group by event_id, low",
    "packed_within_clusters": f"with recursive {_PACKED}, p as (select event_id, point_idx, crystal_no as cl from h where crystal_no is not null), j as (select * from o join l using (event_id, point_idx) left join p using (event_id, point_idx)) select event_id, min(point_idx) as point_idx, {', '.join(f'round(sum(e*{c})/sum(e), 6) as {c}' for c in 'xyz')}, round(sum(e), 6) as e, count(*) as n_packed from j group by event_id, low, cl",
    "clusters_to_track": f"with recursive {_CONE}, k as (select event_id, point_idx, (dense_rank() over (partition by event_id order by low) - 1)::int as cluster_id from l) select event_id, cluster_id, count(*) as n, count(*) filter (pad > 0) as bad_pads, count(*) <= 8 and count(*) filter (pad > 0) = 0 as tracked from k join h using (event_id, point_idx) group by event_id, cluster_id",
    "run_statistics": f"with recursive {_CONE}, k as (select event_id, low, count(*) as n, count(*) filter (pad > 0) as bad from l join h using (event_id, point_idx) group by all) select 'pad' as what, pad::varchar as value, count(*) as n from h group by pad union all select 'crystal', crystal_no::varchar, count(*) from h group by crystal_no union all select 'clusters', null, count(*) from k union all select 'tracked clusters', null, count(*) filter (n <= 8 and bad = 0) from k union all select 'clusters with bad pads', null, count(*) filter (bad > 0) from k union all select 'events', null, count(distinct event_id) from o union all select 'events left out', null, count(*) from (select event_id from o group by event_id having count(*) > 300)",
    "track_features": f"""with {_T}, {_features_sql("sum")}, {_features_sql("tango")},
a as (select event_id, cluster_id, n, max(esum) as esum, sum(rsg) / (n - 1) as rsg_mean_1, sum((rsg/rsg_s)**2) as rsg_sum_2v, sqrt(sum(case when k < n then rsl**2 end)) / n as rsl_norm_2, sum(rlg/rlg_s) / sum(case when k < n then 1/rlg_s end) as rlg_wmean_1v,
 sum(case when k < n then pen end) as c_penalty_sum_1, sum(rc * (1 - pen)) as rc_sum_1_penalty_removed, sum(rtc) / (n - 1) as rth_cap_mean_1, sum(mc * shell) as cross_compt_ge_dist_sum, max(-ln(ma/mt)) filter (k = n) as pf, sum(kns / (mc / {P.RANGE!r})) as kn,
 max(e) filter (k = 1) / max(esum) as first_energy_ratio, stddev_pop(loc) as tango_sigma from rfs group by event_id, cluster_id, n),
b as (select event_id, cluster_id, sum(rtc) / (n - 1) as rt, sum(-ln(case when kng > 0 then kng * {P.RANGE!r} end)) as kg from rft group by event_id, cluster_id, n)
select event_id, cluster_id, n, {_r("esum", "rsg_mean_1", "rsg_sum_2v", "rsl_norm_2", "rlg_wmean_1v", "c_penalty_sum_1", "rc_sum_1_penalty_removed", "rth_cap_mean_1", "cross_compt_ge_dist_sum", "first_energy_ratio", "tango_sigma", "rt as rth_cap_mean_1_tango")},
 round(pf, 6) as "-log_p_abs_final", round(kn, 6) as "klein-nishina_rel_sum_sum", round(kg, 6) as "-log_klein-nishina_geo_sum_tango" from a join b using (event_id, cluster_id)""",
    "fom_selected": f"""with {_T}, {_features_sql("sum")}, {_features_sql("tango")}, w(a1, a2, a3, a4, a5, a6, a7, b1, b2, b3, b4) as (values ({", ".join(repr(w) for _, w in T.SELECTED)})),
a as (select event_id, cluster_id, n, sum(rsg) / (n - 1) as f1, sum(case when k < n then pen end) as f2, sum(rc * (1 - pen)) as f3, max(-ln(ma/mt)) filter (k = n) as f4, sum(mc * shell) as f5, max(-ln(mc/mt)) as f6, sum(kns / (mc / {P.RANGE!r})) as f7 from rfs group by event_id, cluster_id, n),
b as (select event_id, cluster_id, sum(rtc) / (n - 1) as g1, avg(mc * shell) as g2, sum(-ln(case when kng > 0 then kng / (mc / {P.RANGE!r}) end)) as g3, sum(-ln(case when kng > 0 then kng * {P.RANGE!r} end)) as g4 from rft group by event_id, cluster_id, n)
select event_id, cluster_id, n, round(0.0 + coalesce(f1*a1, 0) + coalesce(f2*a2, 0) + coalesce(f3*a3, 0) + coalesce(f4*a4, 0) + coalesce(f5*a5, 0) + coalesce(f6*a6, 0) + coalesce(f7*a7, 0) + coalesce(g1*b1, 0) + coalesce(g2*b2, 0) + coalesce(g3*b3, 0) + coalesce(g4*b4, 0), 6) as fom from a join b using (event_id, cluster_id), w""" + _ONE,
    "track_transitions": f"with {_C}, p as (select event_id, cluster_id, track_pos, point_idx from c union all select distinct event_id, cluster_id, -2147483648, 0 from c), q as (select event_id, cluster_id, row_number() over w - 1 as step, point_idx as p0, lead(point_idx) over w as p1 from p window w as (partition by event_id, cluster_id order by track_pos, point_idx)) select * from q where p1 is not null",
    "track_triples": f"with {_C}, p as (select event_id, cluster_id, track_pos, point_idx from c union all select distinct event_id, cluster_id, -2147483648, 0 from c), q as (select event_id, cluster_id, row_number() over w - 1 as step, point_idx as p0, lead(point_idx) over w as p1, lead(point_idx, 2) over w as p2 from p window w as (partition by event_id, cluster_id order by track_pos, point_idx)) select * from q where p2 is not null",
    "hit_relations": f"with {_C}, t as (select *, row_number() over (partition by event_id, cluster_id order by track_pos, point_idx) as k from c) select a.event_id, a.point_idx as i, b.point_idx as j, bool_or(a.cluster_id = b.cluster_id) as same, bool_or(a.cluster_id = b.cluster_id and b.k = a.k + 1) as follows from t a join t b on a.event_id = b.event_id and a.point_idx <> b.point_idx group by all",
    "hits_in_detector": f"with {_H} select event_id, point_idx, sqrt(x*x + y*y + z*z) between {G.SHELLS['gretina'][0]} and {G.SHELLS['gretina'][1]} as inside from h where x is not null",
    "merged_classes": f"with recursive {_CLASSES} select event_id, point_idx, low as representative from l",
    "class_sizes": f"with recursive {_CLASSES} select event_id, low as representative, count(*) as size from l group by event_id, low having count(*) > 1",
    "in_same_class": f"with recursive {_CLASSES} select m.event_id, m.a, m.b + 1 as b, coalesce(x.low = y.low, false) as same from m left join l x on x.event_id = m.event_id and x.point_idx = m.a left join l y on y.event_id = m.event_id and y.point_idx = m.b + 1",
    "hits_of_long_rays": f"with {_H}, {_C}, l as (select event_id, cluster_id from c group by all having count(*) > 3) select distinct event_id, point_idx from h join c using (event_id, point_idx) join l using (event_id, cluster_id)",
    "event_feature_statistics": f"with {_T}, r as (select event_id, cluster_id, n, max(esum) as esum from t6 group by event_id, cluster_id, n) select event_id, count(*) as n_rays, round(sum(esum), 9) as esum_sum, round(avg(esum), 9) as esum_mean, round(min(esum), 9) as esum_min, round(max(esum), 9) as esum_max, sum(n)::bigint as n_sum, round(avg(n), 9) as n_mean, min(n) as n_min, max(n) as n_max from r group by event_id",
    "relative_energies": f"with {_T}, r as (select event_id, cluster_id, n, max(esum) as esum from t6 group by event_id, cluster_id, n) select event_id, cluster_id, round(esum - avg(esum) over (partition by event_id), 9) as esum from r",
    "split_events": f"with {_H}, {_C} select event_id, cluster_id, row_number() over (partition by event_id, cluster_id order by track_pos, point_idx) as new_idx, point_idx from c join h using (event_id, point_idx)",
    "joined_events": f"with {_H} select event_id, event_id >> 1 as group_id, point_idx, row_number() over (partition by event_id >> 1 order by event_id, point_idx) as new_idx from h",
    "clusters_by_smallest": f"with {_C}, l as (select event_id, cluster_id, min(point_idx) as low from c group by all), k as (select *, dense_rank() over (partition by event_id order by low, cluster_id) - 1 as new_id from l) select event_id, cluster_id, new_id, point_idx from c join k using (event_id, cluster_id)",
    "tracks_without_heads": f"with {_T} select event_id, cluster_id, track_pos, point_idx from t6 where k > 1",
    "rank_relative": _D + f" select row_id, ray_event_id, ray_cluster_id, {_r('energy_sums', 'oft', 'tango', 'angle')} from d",
    "rank_relative_unit": _D + ", u as (select *, sqrt(energy_sums**2 + oft**2 + tango**2 + angle**2) as l from d) select row_id, ray_event_id, ray_cluster_id, " + ", ".join(f"round(case when l > 0 then {f} / l else 0 end, 6) as {f}" for f in FEATURES) + " from u",
    "rank_select_least": _select("r1 = 1"),
    "rank_select_neg": _select("r1 = 1 and s <= 0"),
    "rank_select_pos_neg": _select("case when lo <= 0 then r1 = 1 else r2 = 1 end"),
    "rank_select_best": _select("r2 = 1"),
    "rank_select_neg_best": _S + f", k as (select *, row_number() over ({_Q} order by s desc, row_id) as r2 from s0 where s <= 0) select row_id, ray_event_id, ray_cluster_id, s from k where r2 = 1",
    "rank_select_n_neg": _select("r1 <= 3 and s <= 0"),
    "rank_select_all_neg": _select("s <= 0"),
    "rank_solved": _D + " select ray_event_id, ray_cluster_id, min(round(0.0 + energy_sums * 0.1 + oft * -1.0 + tango * 0.5 + angle * 0.25, 9)) > 0 as solved, count(*) as n_rows from d group by all",
    "rank_acceptable": _S + f", k as (select *, min(s) over ({_Q}) as lo from s0) select ray_event_id, ray_cluster_id, bool_and(s > lo or acceptable = 1) as solved, count(*) as n_rows from k group by all",
    "rank_weights": _R + f" select row_id, round(1.0 / count(*) over ({_Q}), 6) as weight from r",
    "rank_labels": _R + " select ray_event_id, ray_cluster_id, dense_rank() over (order by ray_event_id, ray_cluster_id) - 1 as label from (select distinct ray_event_id, ray_cluster_id from r)",
    "rank_mean_of_means": _D + ", m as (select avg(energy_sums) as a, avg(oft) as b, avg(tango) as c, avg(angle) as g from d group by ray_event_id, ray_cluster_id), w as (select greatest(avg(a), 0) as a, greatest(avg(b), 0) as b, greatest(avg(c), 0) as c, greatest(avg(g), 0) as g from m) select round(a/(a+b+c+g), 6) as energy_sums, round(b/(a+b+c+g), 6) as oft, round(c/(a+b+c+g), 6) as tango, round(g/(a+b+c+g), 6) as angle from w",
    "rank_scaled": _R + ", v as (select stddev_pop(energy_sums) as a, stddev_pop(oft) as b, stddev_pop(tango) as c, stddev_pop(angle) as g from r) select row_id, round(energy_sums/a, 6) as energy_sums, round(oft/b, 6) as oft, round(tango/c, 6) as tango, round(angle/g, 6) as angle from r, v",
}
