"""Ordered tracks: one row per hit of a ray, with everything that follows from the order.

A track is the hits of one (event_id, cluster_id) in the order of ``track_pos``, preceded by the
origin. A track of n hits has n - 1 turns; the turn at a hit belongs to its row and is null at the last one.
All columns come from one window per track, so one shuffle serves steps, figures of merit and features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.functions import geometry as G, physics as P

KEY = ["event_id", "cluster_id"]


def ordered_hits(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hits of the tracks in ``clusters``: ``event_id, cluster_id, track_pos, point_idx, x, y, z, e``.

    Repeated rows count once (of differing ones the least); hits without position or energy and places without track_pos are left out.
    """
    h = hits.where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").groupBy("event_id", "point_idx").agg(F.min(F.struct("x", "y", "z", "e")).alias("h")).select("event_id", "point_idx", "h.*")
    c = clusters.where("track_pos is not null").groupBy("event_id", "cluster_id", "point_idx").agg(F.min("track_pos").alias("track_pos"))
    return c.join(h, ["event_id", "point_idx"])


def window() -> Window:
    return Window.partitionBy(*KEY).orderBy("track_pos", "point_idx")


def steps(ordered: DataFrame, start: str = "sum", inner: float = G.SHELLS["gretina"][0], error_model: str = "default", eres: float = 1e-3, excess: tuple[float, float] | None = None) -> DataFrame:
    """Per hit of a track: order, ways, turns, energies and local estimates.

    Columns besides the key: ``n, k`` (1-based), ``x, y, z, e``, ``way, shell_way`` from the hit before, ``cos, cos_err``
    of the turn, ``esum``, ``energy`` arriving at the hit and ``energy_after`` it, ``local`` estimate with ``local_sigma, d_e, d_cos``.

    ``start``: energy of the ray: 'sum' of its deposits, 'local' mean of the local estimates, 'weighted' by
    their errors; 'tango' is the larger of the weighted estimate and the sum. ``excess``: an estimate (of a track of three or more
    hits) is taken only where it lies above the sum by more than the first and less than the second. 'both' gives every hit twice, at the sum and
    at the tango start, with ``suffix`` '' and '_tango', from the same windows.
    """
    w = window()
    whole = Window.partitionBy(*KEY)
    a = ordered.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("esum", F.sum("e").over(whole))
    a = a.withColumn("before", F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    a = a.withColumn("sigma", G.position_error(F.col("e"), error_model))
    for c in "xyz":
        a = a.withColumn(f"p{c}", F.coalesce(F.lag(c).over(w), F.lit(0.0))).withColumn(f"n{c}", F.lead(c).over(w))
    origin = G.position_error(F.lit(0.0), error_model)
    a = a.withColumn("psigma", F.coalesce(F.lag("sigma").over(w), origin)).withColumn("nsigma", F.lead("sigma").over(w))
    here, prev, nxt = G.point(), G.point("p"), G.point("n")
    a = a.withColumn("way", G.distance(prev, here)).withColumn("next_way", G.distance(here, nxt))
    a = a.withColumn("shell_way", G.shell_distance(prev, here, inner, F.col("way")))
    a = a.withColumn("cos", F.when(F.col("k") < F.col("n"), G.cos_turn(prev, here, nxt)))
    args = [F.col(c) for c in ("cos", "way", "next_way", "psigma", "sigma", "nsigma")]
    a = a.withColumn("cos_err", G.cos_error(*args)).withColumn("omc", 1 - F.col("cos"))
    e, omc = F.col("e"), F.col("omc")
    a = a.withColumn("local", P.local_incoming(e, omc)).withColumn("d_e", P.local_d_energy(e, omc)).withColumn("d_cos", P.local_d_cos(e, omc))
    a = a.withColumn("local_sigma", F.sqrt((eres * F.col("d_e")) ** 2 + (F.col("cos_err") * F.col("d_cos")) ** 2))
    first = F.col("esum")
    turn = F.col("k") < F.col("n")
    if start == "local":
        first = F.coalesce(F.avg(F.when(turn, F.col("before") + F.col("local"))).over(whole), F.col("esum"))
    elif start in ("weighted", "tango", "both"):
        weight = F.when(turn, 1 / (F.col("local_sigma") + eres * F.sqrt(F.col("k").cast("double"))))
        first = F.coalesce(F.sum((F.col("before") + F.col("local")) * weight).over(whole) / F.sum(weight).over(whole), F.col("esum"))
        if start != "weighted":
            first = F.greatest(first, F.col("esum"))
    elif start != "sum":
        raise ValueError(f"unknown start energy {start!r}")
    if excess is not None:
        over = first - F.col("esum")
        first = F.when((F.col("n") > 2) & (over > excess[0]) & (over < excess[1]), first).otherwise(F.col("esum"))
    if start == "both":
        modes = F.array(F.struct(F.lit("").alias("suffix"), F.col("esum").alias("start")), F.struct(F.lit("_tango").alias("suffix"), F.col("_first").alias("start")))
        a = a.withColumn("_first", first).withColumn("_mode", F.explode(modes)).withColumns({"suffix": F.col("_mode.suffix"), "start": F.col("_mode.start")})
    else:
        a = a.withColumn("start", first)
    a = a.withColumn("energy", F.col("start") - F.col("before"))
    a = a.withColumn("energy_after", F.when(turn, F.col("energy") - F.col("e")))
    return a.select(*KEY, "n", "k", "point_idx", "x", "y", "z", "e", "way", "shell_way", "cos", "omc", "cos_err", "esum", "start", "before", "energy", "energy_after", "local", "local_sigma", "d_e", "d_cos", *(["suffix"] if start == "both" else []))


def residuals(steps_: DataFrame, extra: int = 0, eres: float = 1e-3) -> DataFrame:
    """Adds the residuals of every turn with their errors, theory angles, penalties and attenuations.

    ``rsg`` sum - geometric, ``rsl`` sum - local, ``rlg`` local - geometric energy, ``rc, rc_cap`` cosine, ``rth, rth_cap``
    angle; ``*_sigma`` their errors. ``extra`` hits are counted on top of those of the track in the error of energies.
    """
    e, after, omc, cos, cerr = (F.col(c) for c in ("energy", "energy_after", "omc", "cos", "cos_err"))
    left = F.col("n") + extra - (F.col("k") - 1)
    a = steps_.withColumn("geometric", F.when(F.col("k") < F.col("n"), P.outgoing(e, omc))).withColumn("cos_theory", P.cos_theory(e, after))
    g, ct = F.col("geometric"), F.col("cos_theory")
    share = g / e
    a = a.withColumn("rsg", F.abs(after - g)).withColumn("rsl", F.abs(e - F.col("local"))).withColumn("rlg", F.abs(F.col("local") - F.col("e") - g))
    a = a.withColumn("rsg_sigma", F.sqrt(eres**2 * (share**4 + left * (1 - share**2) ** 2) + (cerr * g**2 / P.MEC2) ** 2))
    a = a.withColumn("rsl_sigma", F.sqrt(eres**2 * ((1 - F.col("d_e")) ** 2 + left - 1) + (cerr * F.col("d_cos")) ** 2))
    share2 = g / F.nullif(after, F.lit(0.0))
    a = a.withColumn("rlg_sigma", F.sqrt(eres**2 * ((F.col("d_e") - 1 - share2**2) ** 2 + left * share2**4) + cerr**2 * (F.col("d_cos") - g**2 / P.MEC2) ** 2))
    capped = F.when(ct.isNotNull(), F.greatest(ct, F.lit(-1.0)))
    a = a.withColumn("rc", F.abs(cos - ct)).withColumn("rc_cap", F.abs(cos - capped))
    ct_sigma = P.cos_theory_sigma(e, after, left - 1, eres)
    a = a.withColumn("rc_sigma", F.sqrt(cerr**2 + (eres * ct_sigma) ** 2))
    turn, angle = F.col("k") < F.col("n"), F.acos(cos)
    fix = lambda c: F.when(turn, F.nanvl(F.coalesce(c, F.lit(float("nan"))), F.lit(2 * math.pi)))
    a = a.withColumn("rth", F.abs(fix(angle - P.theta_theory(e, after)))).withColumn("rth_cap", F.abs(fix(angle - F.acos(capped))))
    theta_err = cerr / F.nullif(F.sqrt(F.greatest(1 - cos**2, F.lit(0.0))), F.lit(0.0))
    a = a.withColumn("rth_sigma", F.sqrt(theta_err**2 + (eres * ct_sigma / F.nullif(F.sqrt(F.abs(1 - ct**2)), F.lit(0.0))) ** 2))
    a = a.withColumn("penalty", F.when(turn, P.penalty(ct))).withColumn("penalty_size", F.when(turn, P.penalty_size(ct)))
    a = a.withColumn("mu_abs", P.mu_absorption(e)).withColumn("mu_compt", P.mu_compton(e)).withColumn("mu_pair", P.mu_pair(e))
    return a.withColumn("mu", F.col("mu_abs") + F.col("mu_compt") + F.col("mu_pair"))


METHODS = ("angle", "cosine", "oft", "agata", "local", "selected", "feature", "zeros")
#: By how much a start-energy estimate may lie above the energy sum to be taken, in MeV.
EXCESS = (0.1, P.MEC2)


def _last(c: Column) -> Column:
    return F.max(F.when(F.col("k") == F.col("n"), c))


def fom_columns(method: str, variance: bool = False, power: float = 2) -> Column:
    """The figure of merit of a track of two or more hits, as an aggregate over :func:`residuals`.

    local: ``variance`` divides the residuals by their errors, ``power`` is the exponent they are summed with.
    """
    n = F.max("n")
    turn = F.col("k") < F.col("n")
    if method in ("angle", "aft"):
        return F.sqrt(F.sum(F.col("rth_cap") ** 2) + 0.4 * F.sum("penalty_size")) / (n - 1)
    if method in ("cosine", "cos"):
        return F.sqrt(F.sum(F.col("rc_cap") ** 2)) / (n - 1) + 0.4 * F.sum("penalty")
    if method in ("agata", "oft"):
        v2 = (F.col("rsg") / F.col("rsg_sigma")) ** 2 * F.when(F.col("k") == 1, 2.0).otherwise(1.0)
        ways = F.when(turn, F.col("mu_compt") * F.col("shell_way") - F.ln(F.col("mu_compt") / F.col("mu")))
        end = _last(F.col("mu_abs") * F.col("shell_way") - F.ln(F.col("mu_abs") / F.col("mu")))
        out = (F.sum(F.when(turn, v2)) + F.sum(ways) + end) / (2 * n - 1)
        return F.exp(-out) if method == "oft" else out
    if method == "local":
        r = F.col("rsl") / F.col("rsl_sigma") if variance else F.col("rsl")
        return F.sum(r**power)
    if method == "zeros":
        return F.lit(0.0)
    raise ValueError(f"unknown figure of merit {method!r}")


#: The features and weights of the ``selected`` figure of merit; the last four at the tango start energy.
SELECTED = (
    ("rsg_mean_1", 178.12747373389973), ("c_penalty_sum_1", 14.609762827450487), ("rc_sum_1_penalty_removed", 15.197480477333135), ("-log_p_abs_final", 7.626390460173996),
    ("cross_compt_ge_dist_sum", 5.733775515158737), ("-log_p_compt_max", 5.720142738181197), ("klein-nishina_rel_sum_sum", 904.9158988958409), ("rth_cap_mean_1_tango", 3.638575430293514),
    ("cross_compt_ge_dist_mean_tango", 77.14717485849123), ("-log_klein-nishina_rel_geo_sum_tango", 1.7177345247556102), ("-log_klein-nishina_geo_sum_tango", 3.5645076928669015),
)


def figures_of_merit(
    ordered: DataFrame, method: str = "oft", singles: str | None = "depth", inner: float = G.SHELLS["gretina"][0], share: float = 0.95, error_model: str = "default", start: str = "sum",
    excess: tuple[float, float] | None = None, weights: dict[str, float] | None = None, variance: bool = False, power: float = 2,
) -> DataFrame:
    """``event_id, cluster_id, n, esum, fom`` of every track; single hits by the ``singles`` method.

    Methods: angle, cosine, oft, agata, local (with ``variance`` and ``power`` as in :func:`fom_columns`), selected, feature (the ``weights`` of
    ordering features) and zeros. Singles: depth, continuous, probability, range, or None for 0. ``start``, ``excess``: the energy a ray
    begins with, as in :func:`steps`; ``EXCESS`` is the usual window.
    """
    if method in ("selected", "feature"):
        from hitloom.operators.features import weighted_features

        if method == "feature" and not weights:
            raise ValueError("'feature' needs weights")
        return weighted_features(ordered, dict(SELECTED) if method == "selected" else weights, singles, inner, share, error_model)
    s = steps(ordered, start, inner, error_model, excess=excess)
    r = residuals(s, extra=1)
    one = F.lit(0.0) if method == "zeros" else _single(singles, inner, share)
    return r.groupBy(*KEY).agg(F.max("n").alias("n"), F.max("esum").alias("esum"), F.when(F.max("n") == 1, F.max(one)).otherwise(fom_columns(method, variance, power)).alias("fom"))


def _single(singles: str | None, inner: float, share: float) -> Column:
    e, way = F.col("e"), F.col("shell_way")
    return {
        None: F.lit(0.0), "depth": P.single_depth(G.norm(G.point()), e, inner), "continuous": P.single_continuous(way, e),
        "probability": P.single_probability(way, e), "range": P.single_range(way, e, share=share),
    }[singles]


def track_energies(ordered: DataFrame) -> DataFrame:
    """Energy sum, hit count and first and second hit of every track."""
    hit = F.struct("x", "y", "z", "e")
    a = ordered.withColumn("k", F.row_number().over(window()))
    return a.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("esum"), F.max(F.when(F.col("k") == 1, hit)).alias("first_hit"), F.max(F.when(F.col("k") == 2, hit)).alias("second_hit"))
