"""Cleaning, packing, splitting and joining of events, as joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.functions import geometry as G, physics as P
from hitloom.operators.linkage import cut_labels, single_labels


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row per (event_id, point_idx); of differing repeats the least."""
    rest = [c for c in hits.columns if c not in ("event_id", "point_idx")]
    return hits.groupBy("event_id", "point_idx").agg(F.min(F.struct(*rest)).alias("_h")).select("event_id", "point_idx", *[F.col(f"_h.{c}").alias(c) for c in rest])


def renumbered(hits: DataFrame) -> DataFrame:
    """``new_idx`` 1.. in the order of point_idx within each event."""
    return hits.withColumn("new_idx", F.row_number().over(Window.partitionBy("event_id").orderBy("point_idx")))


def without_low_energy(hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Hits above ``threshold``, renumbered; null energies are dropped."""
    return renumbered(hits.where(F.col("e") > threshold))


def without(hits: DataFrame, removal: DataFrame) -> DataFrame:
    """Hits that ``removal(event_id, point_idx)`` doesn't list, renumbered."""
    return renumbered(hits.join(removal, ["event_id", "point_idx"], "left_anti"))


def reindexed_clusters(clusters: DataFrame, hits: DataFrame, keep_empties: bool = False) -> DataFrame:
    """Clusters over the hits that are left, with their new numbers; emptied clusters may be kept as a row without hit."""
    kept = clusters.join(hits.select("event_id", "point_idx", "new_idx"), ["event_id", "point_idx"], "left" if keep_empties else "inner")
    if not keep_empties:
        return kept.select("event_id", "cluster_id", "track_pos", F.col("new_idx").alias("point_idx"))
    full = kept.where("new_idx is not null").select("event_id", "cluster_id", "track_pos", F.col("new_idx").alias("point_idx"))
    empty = clusters.select("event_id", "cluster_id").distinct().join(full, ["event_id", "cluster_id"], "left_anti")
    return full.unionByName(empty, allowMissingColumns=True)


def per_event(df: DataFrame, key: list[str], cols: list[str], order: list[str]) -> DataFrame:
    """One row per event with its ``cols`` as arrays in the given order."""
    items = F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])))
    a = df.groupBy(*key).agg(items.alias("_i"))
    return a.select(*key, *[F.col(f"_i.{c}").alias(c) for c in cols])


def packing_labels(hits: DataFrame, distance: float) -> DataFrame:
    """``event_id, point_idx, pack``: groups of hits linked by steps of at most ``distance`` (single linkage)."""
    arrays = per_event(hits.where("x is not null and y is not null and z is not null"), ["event_id"], ["point_idx", "x", "y", "z"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ev, idx, lab = [], [], []
            for r in pdf.itertuples(index=False):
                p = np.stack([r.x, r.y, r.z], 1).astype(float)
                d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
                idx.append(r.point_idx)
                lab.append(single_labels(d <= distance))
                ev.append(np.full(len(p), r.event_id))
            if ev:
                yield pd.DataFrame({"event_id": np.concatenate(ev), "point_idx": np.concatenate(idx), "pack": np.concatenate(lab)})

    return arrays.mapInPandas(run, "event_id long, point_idx int, pack int")


def packed(hits: DataFrame, distance: float, clusters: DataFrame | None = None) -> DataFrame:
    """Hits merged within ``distance``: energies added, place weighted by energy, largest type, the rest from the first hit.

    With ``clusters(event_id, point_idx, cluster_id)`` only hits of one cluster are merged (hits in none form one as well); which hits
    are linked is found over all of the event, as without.
    """
    labels = packing_labels(hits, distance)
    keys = ["event_id", "pack"]
    if clusters is not None:
        own = clusters.groupBy("event_id", "point_idx").agg(F.min("cluster_id").alias("_cluster"))
        labels, keys = labels.join(own, ["event_id", "point_idx"], "left"), [*keys, "_cluster"]
    e = F.col("e")
    a = hits.join(labels, ["event_id", "point_idx"]).groupBy(*keys)
    return a.agg(
        F.min("point_idx").alias("point_idx"),
        *[(F.sum(e * F.col(c)) / F.nullif(F.sum(e), F.lit(0.0))).alias(c) for c in "xyz"],
        F.sum(e).alias("e"),
        F.max("interaction_type").alias("interaction_type"),
        F.count(F.lit(1)).alias("n_packed"),
        *[F.min_by(c, "point_idx").alias(c) for c in ("ts", "crystal_no", "seg_no")],
        *([F.max("pad").alias("pad")] if "pad" in hits.columns else []),
    ).drop("pack", "_cluster")


def smeared(hits: DataFrame, seed: int = 1, model: str | None = None) -> DataFrame:
    """Positions and energies with Gaussian noise of the detector's resolution; energies not below 0.

    The position's error is 0.5 cm (full width) at 0.1 MeV, falling with the root of the energy, or that of an error ``model`` of
    :data:`geometry.POSITION_ERROR`.
    The noise is drawn from a hash of (seed, event, hit, axis), so it doesn't depend on how the data is split.
    """

    def gauss(tag: str):
        u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(f"{tag}{k}"), "event_id", "point_idx"), 11) + 0.5) / float(1 << 53)
        return F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * np.pi * u(1))

    e = F.col("e")
    sigma = 0.5 * F.sqrt(0.1 / F.nullif(F.greatest(e, F.lit(0.0)), F.lit(0.0))) / 2.3548
    if model is not None:
        sigma = G.position_error(F.coalesce(e, F.lit(0.0)), model)
    new = {c: F.col(c) + F.coalesce(sigma, F.lit(0.0)) * gauss(c) for c in "xyz"}
    return hits.withColumns(new | {"e": F.greatest(F.lit(0.0), e + P.energy_sigma(F.greatest(e, F.lit(0.0))) * gauss("e"))})


def cone_clusters(hits: DataFrame, alpha_degrees: float = 10.0, max_hits: int = 300, **kw) -> DataFrame:
    """Cone clustering: single linkage on the angle between hits as seen from the origin."""
    return linkage_clusters(hits, alpha_degrees=alpha_degrees, metric="great_circle", method="single", max_hits=max_hits, **kw)


def linkage_clusters(
    hits: DataFrame, alpha: float | None = None, alpha_degrees: float | None = None, metric: str = "great_circle", method: str = "single", time_gap: int | None = None, max_hits: int = 300,
    max_clusters: int = 30, inner: float = G.SHELLS["gretina"][0], max_length: int | None = None, centre_penalty: float = 0.0, centre_factor: float = 0.0,
) -> DataFrame:
    """``event_id, cluster_id, point_idx``: hierarchical clustering of each event's hits, cut at a distance.

    metric: euclidean, great_circle or germanium. method: single, complete, average, ward, or directional (with an optional
    longest cluster). Pairs farther apart in time than ``time_gap`` never join below the largest float. Where the cut leaves more
    than ``max_clusters``, that many are made. Clusters are numbered by their smallest hit. Events of more than ``max_hits`` are left
    out, as their matrix isn't bounded; hits without place are too.
    """
    cut = float(np.radians(alpha_degrees)) if alpha_degrees is not None else float(alpha)
    counts = hits.where("x is not null and y is not null and z is not null")
    sizes = counts.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_hits)
    arrays = per_event(counts.join(sizes.select("event_id"), "event_id"), ["event_id"], ["point_idx", "x", "y", "z", "ts"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ev, idx, lab = [], [], []
            for r in pdf.itertuples(index=False):
                p = np.stack([r.x, r.y, r.z], 1).astype(float)
                ts = np.array([np.nan if t is None else t for t in r.ts], float)
                ev.append(np.full(len(p), r.event_id))
                idx.append(r.point_idx)
                lab.append(cut_labels(p, ts, cut, metric, method, time_gap, max_clusters, inner, max_length, centre_penalty, centre_factor))
            if ev:
                yield pd.DataFrame({"event_id": np.concatenate(ev), "cluster_id": np.concatenate(lab), "point_idx": np.concatenate(idx)})

    return arrays.mapInPandas(run, "event_id long, cluster_id int, point_idx int")


def by_smallest(clusters: DataFrame) -> DataFrame:
    """Clusters numbered 0.. in the order of their smallest hit within each event."""
    low = clusters.groupBy("event_id", "cluster_id").agg(F.min("point_idx").alias("_low"))
    rank = low.withColumn("new_id", F.dense_rank().over(Window.partitionBy("event_id").orderBy("_low", "cluster_id")) - 1)
    return clusters.join(rank.drop("_low"), ["event_id", "cluster_id"])


def split_by_cluster(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each cluster as an event of its own: ``event_id, cluster_id, new_idx`` with the hit's columns."""
    a = clusters.join(hits, ["event_id", "point_idx"])
    return a.withColumn("new_idx", F.row_number().over(Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx")))


def joined_events(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Events of one group become one: ``group_id, new_idx, event_id, point_idx, ...`` in the order of the events."""
    a = groups.select("event_id", "group_id").join(hits, "event_id")
    return a.withColumn("new_idx", F.row_number().over(Window.partitionBy("group_id").orderBy("event_id", "point_idx")))


def cluster_centres(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Centroid and barycentre (weighted by energy) of every cluster."""
    a = clusters.join(hits, ["event_id", "point_idx"]).groupBy("event_id", "cluster_id")
    e = F.col("e")
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("esum"),
        *[F.avg(c).alias(f"centroid_{c}") for c in "xyz"], *[(F.sum(e * F.col(c)) / F.nullif(F.sum(e), F.lit(0.0))).alias(f"barycentre_{c}") for c in "xyz"],
    )


def cluster_distances(hits: DataFrame, clusters: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Between each two clusters of an event: least, largest and mean distance of their hits, and of head and tail.

    The pairs are those of one event, whose hits are bounded by the detector's readout.
    """
    h = clusters.join(hits.select("event_id", "point_idx", "x", "y", "z"), ["event_id", "point_idx"]).where("x is not null and y is not null and z is not null")
    a = h.select("event_id", F.col("cluster_id").alias("cluster_a"), F.col("track_pos").alias("pa"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = h.select("event_id", F.col("cluster_id").alias("cluster_b"), F.col("track_pos").alias("pb"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    d = G.distance(G.point("a"), G.point("b")) if metric == "euclidean" else G.angle_distance(G.point("a"), G.point("b"))
    j = a.join(b, "event_id").where("cluster_a < cluster_b").withColumn("d", d)
    return j.groupBy("event_id", "cluster_a", "cluster_b").agg(F.min("d").alias("least"), F.max("d").alias("largest"), F.avg("d").alias("mean"), F.min_by("d", F.struct(-F.col("pa"), F.col("pb"))).alias("tail_to_head"))


def pair_distances(hits: DataFrame, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """Euclidean, angular and material distance of each two hits of an event."""
    h = hits.where("x is not null and y is not null and z is not null")
    a = h.select("event_id", F.col("point_idx").alias("i"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = h.select("event_id", F.col("point_idx").alias("j"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    p, q = G.point("a"), G.point("b")
    return a.join(b, "event_id").where("i < j").select("event_id", "i", "j", G.distance(p, q).alias("euclidean"), G.angle_distance(p, q).alias("angle"), G.shell_distance(p, q, inner).alias("material"))


def triple_angles(hits: DataFrame, inner: float = G.SHELLS["gretina"][0], error_model: str = "default", eres: float = 1e-3, max_hits: int = 300) -> DataFrame:
    """For every way i -> j -> k over the origin (0) and the hits of an event: turn, its error, and the local energy estimate at j.

    ``event_id, i, j, k, way, shell_way, cos, cos_err, local, d_e, d_cos, local_sigma``. There are n cubed of them, so events of more
    than ``max_hits`` hits are left out.
    """
    h = hits.where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").select("event_id", "point_idx", "x", "y", "z", "e")
    sizes = h.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_hits).select("event_id")
    h = h.join(sizes, "event_id").withColumn("s", G.position_error(F.col("e"), error_model))
    zero = sizes.select("event_id", F.lit(0).alias("point_idx"), *[F.lit(0.0).alias(c) for c in "xyze"], G.position_error(F.lit(0.0), error_model).alias("s"))
    side = lambda df, t: df.select("event_id", F.col("point_idx").alias({"a": "i", "b": "j", "c": "k"}[t]), *[F.col(c).alias(f"{t}{c}") for c in ("x", "y", "z", "e", "s")])
    t = side(h.unionByName(zero), "a").join(side(h, "b"), "event_id").where("i <> j").join(side(h, "c"), "event_id").where("k <> j and k <> i")
    a, b, c = G.point("a"), G.point("b"), G.point("c")
    t = t.withColumn("way", G.distance(a, b)).withColumn("next_way", G.distance(b, c)).withColumn("cos", G.cos_turn(a, b, c))
    t = t.withColumn("shell_way", G.shell_distance(a, b, inner, F.col("way"))).withColumn("cos_err", G.cos_error(*[F.col(n) for n in ("cos", "way", "next_way", "as", "bs", "cs")]))
    e, omc = F.col("be"), 1 - F.col("cos")
    t = t.withColumn("local", P.local_incoming(e, omc)).withColumn("d_e", P.local_d_energy(e, omc)).withColumn("d_cos", P.local_d_cos(e, omc))
    t = t.withColumn("local_sigma", F.sqrt((eres * F.col("d_e")) ** 2 + (F.col("cos_err") * F.col("d_cos")) ** 2))
    return t.select("event_id", "i", "j", "k", "way", "shell_way", "cos", "cos_err", "local", "d_e", "d_cos", "local_sigma")


def in_peak(hits: DataFrame, clusters: DataFrame, beta: float = 0.0845, peak: float = 2.066, width: float = 0.06) -> DataFrame:
    """Events with a ray whose Doppler-corrected energy lies within ``width`` of ``peak``; the direction is that of the first hit."""
    h = clusters.join(hits, ["event_id", "point_idx"]).where("track_pos is not null")
    rays = h.groupBy("event_id", "cluster_id").agg(F.sum("e").alias("esum"), *[F.min_by(c, "track_pos").alias(c) for c in "xyz"])
    cos = F.col("z") / F.nullif(G.norm(G.point()), F.lit(0.0))
    return rays.withColumn("corrected", F.col("esum") * P.doppler(beta, cos)).groupBy("event_id").agg(F.coalesce(F.bool_or(F.abs(F.col("corrected") - peak) < width), F.lit(False)).alias("in_peak"))


def without_peak_events(hits: DataFrame, clusters: DataFrame, **kw) -> DataFrame:
    """Hits of the events without a ray in the peak (:func:`in_peak`); events without rays stay."""
    return hits.join(in_peak(hits, clusters, **kw).where("in_peak").select("event_id"), "event_id", "left_anti")


def of_rays(hits: DataFrame, clusters: DataFrame, rays: DataFrame) -> DataFrame:
    """Hits of the rays in ``rays(event_id, cluster_id)``, each hit once."""
    kept = clusters.join(rays.select("event_id", "cluster_id"), ["event_id", "cluster_id"], "left_semi").select("event_id", "point_idx").distinct()
    return hits.join(kept, ["event_id", "point_idx"], "left_semi")


def merged_clusters(first: DataFrame, second: DataFrame) -> DataFrame:
    """Clusters of two clusterings of the same events side by side; those of the second are numbered after the first's."""
    top = first.groupBy("event_id").agg(F.max("cluster_id").alias("_top"))
    moved = second.join(top, "event_id", "left").withColumn("cluster_id", (F.col("cluster_id") + F.coalesce(F.col("_top") + 1, F.lit(0))).cast("int")).drop("_top")
    return first.unionByName(moved)


def flattened(ordered: DataFrame, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """Tracks laid along the radius of their first hit: same energies and material ways, in one line."""
    from hitloom.operators.tracks import KEY, steps

    s = steps(ordered, "sum", inner)
    r = G.norm(G.point())
    so_far = Window.partitionBy(*KEY).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = {c: F.first(F.col(c) / F.nullif(r, F.lit(0.0))).over(so_far) for c in "xyz"}
    along = F.sum(F.when(F.col("k") == 1, inner + F.col("shell_way")).otherwise(F.col("shell_way"))).over(so_far)
    return s.select(*KEY, "k", "point_idx", "e", *[(first[c] * along).alias(c) for c in "xyz"])


def without_heads(ordered: DataFrame, n: int) -> DataFrame:
    """Tracks without their first ``n`` hits; tracks that short vanish."""
    k = F.row_number().over(Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx"))
    return ordered.withColumn("_k", k).where(F.col("_k") > n).drop("_k")


def rotated(hits: DataFrame, key: list[str], seed: int = 1) -> DataFrame:
    """Hits turned about the origin by one random rotation per ``key`` (uniform, from a hash of seed and key)."""
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), *key), 11) + 0.5) / float(1 << 53) for i in range(3)]
    a, b = F.sqrt(1 - u[0]), F.sqrt(u[0])
    qx, qy, qz, qw = a * F.sin(2 * np.pi * u[1]), a * F.cos(2 * np.pi * u[1]), b * F.sin(2 * np.pi * u[2]), b * F.cos(2 * np.pi * u[2])
    h = hits.withColumns({"_qx": qx, "_qy": qy, "_qz": qz, "_qw": qw})
    x, y, z, i, j, k, w = (F.col(c) for c in ("x", "y", "z", "_qx", "_qy", "_qz", "_qw"))
    new = {
        "x": (1 - 2 * (j * j + k * k)) * x + 2 * (i * j - k * w) * y + 2 * (i * k + j * w) * z,
        "y": 2 * (i * j + k * w) * x + (1 - 2 * (i * i + k * k)) * y + 2 * (j * k - i * w) * z,
        "z": 2 * (i * k - j * w) * x + 2 * (j * k + i * w) * y + (1 - 2 * (i * i + j * j)) * z,
    }
    return h.withColumns(new).drop("_qx", "_qy", "_qz", "_qw")
