"""Features of tracks, generated from residual families as aggregates over one window stage.

Names follow ``family_statistic``; with the suffix ``_tango`` a feature is taken at the local
start-energy estimate instead of the energy sum. Only the columns of the features asked for are computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hitloom.functions import geometry as G, physics as P
from hitloom.operators import tracks as T


def _turn(c: Column) -> Column:
    return F.when(F.col("k") < F.col("n"), c)


def _turns() -> Column:
    return F.max("n") - 1


def _first(c: Column) -> Column:
    return F.max(F.when(F.col("k") == 1, c))


def _mean_turn(c: Column) -> Column:
    return F.sum(_turn(c)) / F.nullif(_turns(), F.lit(0))


def _residual_family(name: str, col: str, sigma: str, kinds: str) -> dict[str, Column]:
    """Statistics of one residual: plain (p), divided by its error (v), of the first turn (f), with
    turns beyond the Compton edge removed (r). norm is the 2-norm over the number of hits."""
    r, s = F.col(col), F.col(sigma)
    v = r / s
    n = F.max("n")
    out = {}
    for tag, x in (("", r), ("v", v)):
        out[f"{name}_sum_1{tag}"] = F.sum(_turn(x))
        out[f"{name}_mean_1{tag}"] = _mean_turn(x)
        out[f"{name}_norm_2{tag}"] = F.sqrt(F.sum(_turn(x**2))) / n
        out[f"{name}_sum_2{tag}"] = F.sum(_turn(x**2))
        out[f"{name}_mean_2{tag}"] = _mean_turn(x**2)
        if "f" in kinds:
            out[f"{name}_sum_1{tag}_first"] = _first(_turn(x))
            out[f"{name}_mean_1{tag}_first"] = _first(_turn(x)) / F.nullif(_turns(), F.lit(0))
            out[f"{name}_sum_2{tag}_first"] = _first(_turn(x**2))
            out[f"{name}_mean_2{tag}_first"] = _first(_turn(x**2)) / F.nullif(_turns(), F.lit(0))
        if "r" in kinds:
            keep = 1 - F.col("penalty")
            out[f"{name}_sum_1{tag}_penalty_removed"] = F.sum(_turn(x * keep))
            out[f"{name}_mean_1{tag}_penalty_removed"] = _mean_turn(x * keep)
            out[f"{name}_sum_2{tag}_penalty_removed"] = F.sum(_turn(x**2 * keep))
            out[f"{name}_mean_2{tag}_penalty_removed"] = _mean_turn(x**2 * keep)
    out[f"{name}_wmean_1v"] = F.sum(_turn(v)) / F.nullif(F.sum(_turn(1 / s)), F.lit(0.0))
    out[f"{name}_wmean_2v"] = F.sum(_turn(v**2)) / F.nullif(F.sum(_turn(1 / s**2)), F.lit(0.0))
    if "f" in kinds:
        out[f"{name}_wmean_1v_first"] = _first(_turn(v * s))
        out[f"{name}_wmean_2v_first"] = _first(_turn((v * s) ** 2))
    if "r" in kinds:
        keep = 1 - F.col("penalty")
        left = F.sum(_turn(keep))
        out[f"{name}_wmean_1v_penalty_removed"] = F.when(left < 1, 0.0).otherwise(F.sum(_turn(v * keep)) / F.nullif(F.sum(_turn(keep / s)), F.lit(0.0)))
        out[f"{name}_wmean_2v_penalty_removed"] = F.when(left < 1, 0.0).otherwise(F.sum(_turn(v**2 * keep)) / F.nullif(F.sum(_turn((keep / s) ** 2)), F.lit(0.0)))
    return out


def _range(name: str, c: Column, stats: str) -> dict[str, Column]:
    all_ = {"sum": F.sum(c), "mean": F.avg(c), "max": F.max(c), "min": F.min(c), "final": T._last(c)}
    out = {f"{name}_{k}": all_[k] for k in stats.split() if k in all_}
    if "nonfinal" in stats:
        t = _turn(c)
        out |= {f"{name}_sum_nonfinal": F.sum(t), f"{name}_mean_nonfinal": F.avg(t), f"{name}_min_nonfinal": F.min(t)}
    return out


def _families() -> dict[str, Column]:
    out: dict[str, Column] = {}
    out |= _residual_family("rsg", "rsg", "rsg_sigma", "f")
    for name in ("rsl", "rlg"):
        out |= _residual_family(name, name, f"{name}_sigma", "")
    p, q = F.col("penalty"), F.col("penalty_size")
    out |= {"c_penalty_sum_1": F.sum(p), "c_penalty_mean_1": F.avg(p), "c_penalty_ell_sum_1": F.sum(q), "c_penalty_ell_mean_1": F.avg(q), "c_penalty_ell_sum_2": F.sum(q**2), "c_penalty_ell_mean_2": F.avg(q**2)}
    out |= _residual_family("rc_cap", "rc_cap", "rc_sigma", "") | _residual_family("rc", "rc", "rc_sigma", "r")
    out |= _residual_family("rth_cap", "rth_cap", "rth_sigma", "") | _residual_family("rth", "rth", "rth_sigma", "r")
    way, shell = F.col("way"), F.col("shell_way")
    out |= {"distances_sum": F.sum(way), "distances_mean": F.avg(way), "ge_distances_sum": F.sum(shell), "ge_distances_mean": F.avg(shell)}
    kinds = {"abs": "sum mean max min final", "compt": "sum mean max min nonfinal", "pair": "sum mean max min", "total": "sum mean max min"}
    for kind, stats in kinds.items():
        m = F.col("mu" if kind == "total" else f"mu_{kind}")
        for tag, c in (("", m), ("_dist", m * way), ("_ge_dist", m * shell)):
            out |= _range(f"cross_{kind}{tag}", c, stats)
    for kind, stats in list(kinds.items())[:3]:
        share = F.col(f"mu_{kind}") / F.col("mu")
        out |= _range(f"p_{kind}", share, stats) | _range(f"-log_p_{kind}", -F.ln(F.when(share > 0, share)), stats)
    e, after, omc = F.col("energy"), F.col("energy_after"), F.col("omc")
    sigma = F.col("mu_compt") / P.RANGE
    for rel in (True, False):
        for by in ("sum", "geo"):
            ratio = (after if by == "sum" else P.outgoing(e, omc)) / e
            kn = P.by_angle(P.klein_nishina(ratio, omc), omc)
            kn = _turn(kn / sigma if rel else kn * P.RANGE)
            name = f"klein-nishina_{'rel_' if rel else ''}{by}"
            out |= _range(name, kn, "sum mean max min") | _range(f"-log_{name}", -F.ln(F.when(kn > 0, kn)), "sum mean max min")
    r = G.norm(G.point())
    last = F.max(F.when(F.col("k") == F.col("n"), F.col("e")))
    penultimate = F.max(F.when(F.col("k") == F.col("n") - 1, F.col("e")))
    loc, ls = F.col("local"), F.col("local_sigma")
    out |= {
        "first_r": _first(r), "final_r": T._last(r), "first_energy_ratio": _first(F.col("e")) / F.max("esum"), "final_energy_ratio": penultimate / (penultimate + last),
        "first_is_not_largest": (F.max("e") > _first(F.col("e"))).cast("double"), "first_is_not_closest": (F.min(r) < _first(r)).cast("double"),
        "tango_variance": F.var_pop(loc), "tango_sigma": F.stddev_pop(loc), "tango_v_variance": 1 / F.nullif(F.sum(1 / ls**2), F.lit(0.0)), "tango_v_sigma": F.sqrt(1 / F.nullif(F.sum(1 / ls**2), F.lit(0.0))),
    }
    return out


def names(tango: bool = True) -> list[str]:
    """Every ordering feature but the escape probabilities, which :func:`escape_probabilities` gives."""
    base = list(_families())
    return base + [f"{b}_tango" for b in base] if tango else base


def track_features(ordered: DataFrame, wanted: list[str] | None = None, inner: float = G.SHELLS["gretina"][0], error_model: str = "default") -> DataFrame:
    """``event_id, cluster_id, n, esum`` and the ``wanted`` features of every track of two or more hits."""
    families = _families()
    wanted = wanted or list(families)
    unknown = [w for w in wanted if w.removesuffix("_tango") not in families]
    if unknown:
        raise ValueError(f"unknown features {unknown[:5]}")
    own = {x: [w for w in wanted if w.endswith("_tango") == bool(x)] for x in ("", "_tango")}
    if not own["_tango"]:
        r = T.residuals(T.steps(ordered, "sum", inner, error_model)).where("n > 1")
        return r.groupBy(*T.KEY).agg(F.max("n").alias("n"), F.max("esum").alias("esum"), *[families[w].alias(w) for w in wanted])
    # Both start energies come from the same windows, and both aggregates keep the tracks where they are: one shuffle.
    r = T.residuals(T.steps(ordered, "both", inner, error_model)).where("n > 1")
    base = list(dict.fromkeys(w.removesuffix("_tango") for w in wanted))
    per = r.groupBy(*T.KEY, "suffix").agg(F.max("n").alias("n"), F.max("esum").alias("esum"), *[families[b].alias(b) for b in base])
    side = lambda w, x: F.max(F.when(F.col("suffix") == x, F.col(f"`{w.removesuffix('_tango')}`"))).alias(w)
    return per.groupBy(*T.KEY).agg(F.max("n").alias("n"), F.max("esum").alias("esum"), *[side(w, x) for x in ("", "_tango") for w in own[x]])


def weighted_features(ordered: DataFrame, weights: dict[str, float], singles: str | None, inner: float, share: float, error_model: str = "default") -> DataFrame:
    """Figure of merit as a weighted sum of features; single hits by the ``singles`` method."""
    f = track_features(ordered, list(weights), inner, error_model)
    score = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    many = f.select(*T.KEY, "n", "esum", score.alias("fom"))
    # A single hit needs no windows: its way begins at the origin.
    one = ordered.groupBy(*T.KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("x", "y", "z", "e")).alias("h")).where("n = 1").select(*T.KEY, "n", "h.*")
    zero = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    ones = one.withColumn("shell_way", G.shell_distance(zero, G.point(), inner)).select(*T.KEY, "n", F.col("e").alias("esum"), T._single(singles, inner, share).alias("fom"))
    return many.unionByName(ones)


def single_features(ordered: DataFrame, inner: float = G.SHELLS["gretina"][0], outer: float = G.SHELLS["gretina"][1]) -> DataFrame:
    """Features of tracks of a single hit."""
    s = T.steps(ordered, "sum", inner).where("n = 1")
    pen = F.greatest(G.norm(G.point()) - inner, F.lit(1e-16))
    edge, mu = outer - inner - pen, P.mu_total(F.col("e"))
    a = s.withColumn("penetration_cm", pen).withColumn("edge_cm", edge).withColumn("linear_attenuation_cm-1", mu).withColumn("energy", F.col("e"))
    for name, d in (("pen", pen), ("edge", edge)):
        a = a.withColumn(f"{name}_attenuation", d * mu).withColumn(f"{name}_prob_remain", F.exp(-d * mu)).withColumn(f"{name}_prob_density", mu * F.exp(-d * mu)).withColumn(f"{name}_prob_cumu", 1 - F.exp(-d * mu))
    a = a.withColumn("inv_pen", 1 / pen).withColumn("inv_edge", 1 / F.nullif(edge, F.lit(0.0))).withColumn("interpolated_range", P.single_depth(pen, F.col("e"), 0.0))
    kept = ["penetration_cm", "edge_cm", "linear_attenuation_cm-1", "energy", "pen_attenuation", "pen_prob_remain", "pen_prob_density", "pen_prob_cumu", "edge_attenuation", "edge_prob_remain", "edge_prob_density", "edge_prob_cumu", "inv_pen", "inv_edge", "interpolated_range"]
    return a.select(*T.KEY, *[F.col(f"`{c}`") for c in kept])


def cluster_features(ordered: DataFrame, eres: float = 1e-3) -> DataFrame:
    """Shape of every cluster: ``n, centroid_r, average_r, length, width, aspect_ratio``.

    Length and width are from the eigenvalues of the covariance of its points, in closed form.
    """
    x = [F.col(c) for c in "xyz"]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(G.norm(tuple(x))).alias("average_r")] + [F.avg(c).alias(f"m{a}") for c, a in zip(x, "xyz")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    aggs += [F.covar_samp(x[i], x[j]).alias(f"c{i}{j}") for i, j in pairs]
    a = ordered.groupBy(*T.KEY).agg(*aggs)
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    q = (c[0, 0] + c[1, 1] + c[2, 2]) / 3
    off = c[0, 1] ** 2 + c[0, 2] ** 2 + c[1, 2] ** 2
    p = F.sqrt(((c[0, 0] - q) ** 2 + (c[1, 1] - q) ** 2 + (c[2, 2] - q) ** 2 + 2 * off) / 6)
    b = {k: (v - (q if k[0] == k[1] else 0)) / F.nullif(p, F.lit(0.0)) for k, v in c.items()}
    det = b[0, 0] * (b[1, 1] * b[2, 2] - b[1, 2] ** 2) - b[0, 1] * (b[0, 1] * b[2, 2] - b[1, 2] * b[0, 2]) + b[0, 2] * (b[0, 1] * b[1, 2] - b[1, 1] * b[0, 2])
    phi = F.acos(G.clip(det / 2)) / 3
    big, small = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    many = (F.col("n") > 1) & (p > 0)
    length = F.when(many, root(big)).otherwise(F.lit(eres))
    width = F.when(many, F.sqrt(root(small) * root(3 * q - big - small))).otherwise(F.lit(eres))
    return a.select(*T.KEY, "n", F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2).alias("centroid_r"), "average_r", length.alias("length"), width.alias("width"), (length / F.greatest(width, F.lit(1e-16))).alias("aspect_ratio"))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def escape_integral(before: np.ndarray, last: np.ndarray, deposit: np.ndarray, escaped: np.ndarray, mu: np.ndarray, outer: float) -> np.ndarray:
    """Chance that the energy beyond the deposits left the detector after the last hit of a track.

    The way out is averaged over the cone of the last scattering angle, by Gauss-Legendre nodes.
    """
    with np.errstate(all="ignore"):
        cos_open = 1 - P.MEC2 * (1 / escaped - 1 / (escaped + deposit))
        d = last - before
        d = d / np.linalg.norm(d, axis=1, keepdims=True)
        # Two directions across the axis.
        other = np.where(np.abs(d[:, :1]) < 0.9, np.array([[1.0, 0, 0]]), np.array([[0, 1.0, 0]]))
        u = np.cross(d, other)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = np.cross(d, u)
        sin_open = np.sqrt(np.clip(1 - cos_open**2, 0, None))
        theta = (np.concatenate([_NODES, _NODES]) + 1) * np.pi / 2 + np.repeat([0, np.pi], len(_NODES))
        w = np.concatenate([_WEIGHTS, _WEIGHTS]) * np.pi / 2
        total = np.zeros(len(last))
        for t, wt in zip(theta, w):
            ray = d * cos_open[:, None] + sin_open[:, None] * (u * np.cos(t) + v * np.sin(t))
            along = (last * ray).sum(1)
            way = -along + np.sqrt(along**2 - (last**2).sum(1) + outer**2)
            total += wt * np.exp(-mu * way) / (2 * np.pi)
        out = np.where(cos_open < -1, 0.0, total)
        out = np.where(np.linalg.norm(last, axis=1) > outer, 1.0, out)
        return np.where(escaped <= 0, 0.0, out)


def escape_probabilities(ordered: DataFrame, outer: float = G.SHELLS["gretina"][1], inner: float = G.SHELLS["gretina"][0], start: str = "tango") -> DataFrame:
    """``event_id, cluster_id, escape_probability, -log_escape_probability`` of tracks of two or more hits."""
    s = T.steps(ordered, start, inner).where("n > 1")
    hit = F.struct("x", "y", "z", "e")
    ends = s.groupBy(*T.KEY).agg(F.max(F.when(F.col("k") == F.col("n") - 1, hit)).alias("b"), F.max(F.when(F.col("k") == F.col("n"), hit)).alias("l"), (F.max("start") - F.max("esum")).alias("x"))
    ends = ends.select(*T.KEY, *[F.col(f"b.{c}").alias(f"b{c}") for c in "xyz"], *[F.col(f"l.{c}").alias(f"l{c}") for c in "xyze"], "x", P.mu_total(F.when(F.col("x") > 0, F.col("x"))).alias("mu"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v = escape_integral(p[["bx", "by", "bz"]].to_numpy(float), p[["lx", "ly", "lz"]].to_numpy(float), p["le"].to_numpy(float), p["x"].to_numpy(float), p["mu"].fillna(0).to_numpy(float), outer)
            yield pd.DataFrame({"event_id": p["event_id"], "cluster_id": p["cluster_id"], "escape_probability": v, "-log_escape_probability": -np.log(v + 1e-16)})

    return ends.mapInPandas(run, "event_id long, cluster_id int, escape_probability double, `-log_escape_probability` double")


def event_statistics(features: DataFrame, columns: list[str]) -> DataFrame:
    """Per event the sum, mean, least and largest of its rays' features: ``event_id, n_rays, <feature>_<statistic>``."""
    aggs = [f(F.col(f"`{c}`")).alias(f"{c}_{name}") for c in columns for name, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    return features.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rays"), *aggs)


def relative_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """Each ray's features minus the mean of those of its event."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("event_id")
    return features.select(*T.KEY, *[(F.col(f"`{c}`") - F.avg(F.col(f"`{c}`")).over(w)).alias(c) for c in columns])
