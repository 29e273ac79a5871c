"""Order of the hits of each ray by search over permutations, many rays of one size at once."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hitloom.functions import geometry as G, physics as P
from hitloom.functions.arrays import material_way
from hitloom.operators.array_features import attenuations, weighted
from hitloom.operators.events import per_event
from hitloom.runtime import materialise

#: Numbers held at once by one scoring call.
BLOCK = 1_500_000


def _mu(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attenuation by absorption, Compton scattering and in all."""
    m = attenuations(e)
    return m["abs"], m["compt"], m["total"]


def scores(x: np.ndarray, e: np.ndarray, start: np.ndarray, method: str, inner: float, model: str = "default", eres: float = 1e-3, weights: dict[str, float] | None = None) -> np.ndarray:
    """Figure of merit of many orders: ``x`` (..., m, 3) and ``e`` (..., m) in order, ``start`` (...) energy of the ray.

    Methods as in :mod:`hitloom.operators.tracks`: angle, cosine, oft, agata, local, selected, zeros, and model, by the ``weights`` of
    ordering features. NaN where it isn't defined.
    """
    m = e.shape[-1]
    if method == "zeros":
        return np.zeros(e.shape[:-1])
    if method in ("selected", "model", "feature"):
        from hitloom.operators.tracks import SELECTED

        w = dict(SELECTED) if method == "selected" else weights
        if not w:
            raise ValueError(f"{method!r} needs weights")
        return weighted(x, e, start, w, inner, model, eres) if m > 1 else np.zeros(e.shape[:-1])
    before = np.concatenate([np.zeros_like(x[..., :1, :]), x[..., :-1, :]], -2)
    step = x - before
    d = np.sqrt((step**2).sum(-1))
    after = np.cumsum(e, -1)
    left = start[..., None] - (after - e)
    with np.errstate(all="ignore"):
        safe = np.where(d > 0, d, 1.0)
        dots = (step[..., :-1, :] * step[..., 1:, :]).sum(-1)
        cos = np.where((d[..., :-1] > 0) & (d[..., 1:] > 0), np.clip(dots / (safe[..., :-1] * safe[..., 1:]), -1, 1), -1.0)
        ei, eo = left[..., :-1], left[..., 1:]
        theory = 1 - P.MEC2 * (1 / np.where(eo > 0, eo, np.nan) - 1 / ei)
        if method in ("angle", "aft"):
            r = np.arccos(cos) - np.arccos(np.maximum(theory, -1))
            r = np.where(np.isnan(r), 2 * np.pi, r)
            over = np.maximum(0, -1 - np.nan_to_num(theory, nan=0.0))
            return np.sqrt((r**2).sum(-1) + 0.4 * over.sum(-1)) / max(m - 1, 1)
        if method in ("cosine", "cos"):
            r = cos - np.maximum(theory, -1)
            return np.sqrt((r**2).sum(-1)) / max(m - 1, 1) + 0.4 * (theory < -1).sum(-1)
        omc = 1 - cos
        deposit = e[..., :-1]
        if method == "local":
            local = np.where(omc > 0, deposit / 2 + np.sqrt(deposit**2 / 4 + deposit * P.MEC2 / np.where(omc > 0, omc, 1)), P.FILL)
            return ((ei - local) ** 2).sum(-1)
        if method not in ("oft", "agata"):
            raise ValueError(f"unknown figure of merit {method!r}")
        w0, w1 = G.POSITION_ERROR[model]
        s = np.where(e > 0, w0 + w1 * np.sqrt(0.1 / np.where(e > 0, e, 1)), w0)
        sa = np.concatenate([np.full_like(s[..., :1], w0), s[..., :-1]], -1)[..., :-1]
        sb, sc = s[..., :-1], s[..., 1:]
        ab, bc = safe[..., :-1], safe[..., 1:]
        cerr = np.sqrt((1 - cos**2) * ((sa**2 + sb**2) / ab**2 + 2 * sb**2 * cos / (ab * bc) + (sb**2 + sc**2) / bc**2))
        g = ei / (1 + ei / P.MEC2 * omc)
        q = g / ei
        n = m + 1 - np.arange(m - 1)
        sigma = np.sqrt(eres**2 * (q**4 + n * (1 - q**2) ** 2) + (cerr * g**2 / P.MEC2) ** 2)
        v = (eo - g) / sigma
        v2 = v**2
        v2[..., 0] *= 2
        mu_a, mu_c, mu = _mu(left)
        way = material_way(before, x, inner)
        out = v2.sum(-1) + (mu_c * way - np.log(mu_c / mu))[..., :-1].sum(-1) + mu_a[..., -1] * way[..., -1] - np.log(mu_a[..., -1] / mu[..., -1])
        out = out / (2 * m - 1)
        return np.exp(-out) if method == "oft" else out


_PERMS: dict[tuple[int, int], np.ndarray] = {}


def _perms(m: int, r: int) -> np.ndarray:
    if (m, r) not in _PERMS:
        _PERMS[m, r] = np.array(list(permutations(range(m), r)), np.int64)
    return _PERMS[m, r]


def search(x: np.ndarray, e: np.ndarray, width: int = 5, stride: int = 2, method: str = "oft", inner: float = G.SHELLS["gretina"][0], largest: bool | None = None, model: str = "default", weights: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best orders of ``c`` rays of n hits each: places (c, n) in the given hits, and the figure of merit.

    A window of ``width`` hits is permuted after those already fixed; of the best permutation the first ``stride`` are fixed and
    the window moves on. A window that would leave one hit takes it in. Ties go to the first permutation
    in the order of the hits. ``largest``: maximise; oft is maximised by itself.
    """
    c, n = e.shape
    if n == 1:
        return np.zeros((c, 1), np.int64), np.zeros(c)
    if method == "oft" and largest is None:  # exp(-v) falls to 0 for bad orders; v itself doesn't
        order, v = search(x, e, width, stride, "agata", inner, False, model)
        return order, np.exp(-v)
    total = e.sum(1)
    fixed = np.empty((c, 0), np.int64)
    rest = np.tile(np.arange(n), (c, 1))
    rows = np.arange(c)[:, None]
    while rest.shape[1]:
        m = rest.shape[1]
        if m == width + 1:
            width += 1
        r = min(width if width > 0 else m, m)
        perms = _perms(m, r)
        best, best_score = np.zeros(c, np.int64), np.full(c, -np.inf if largest else np.inf)
        per = max(1, BLOCK // max(1, len(perms) * (fixed.shape[1] + r) * (8 if method not in ("selected", "model", "feature") else 24)))
        for s in range(0, c, per):
            b = slice(s, s + per)
            tried = rest[b][:, perms]
            order = np.concatenate([np.repeat(fixed[b][:, None, :], len(perms), 1), tried], 2)
            k = rows[: len(order), :, None]
            sc = scores(x[b][k, order], e[b][k, order], np.repeat(total[b][:, None], len(perms), 1), method, inner, model, weights=weights)
            sc = np.where(np.isnan(sc), -np.inf if largest else np.inf, sc)
            best[b] = sc.argmax(1) if largest else sc.argmin(1)
            best_score[b] = sc[np.arange(len(sc)), best[b]]
        chosen = perms[best]
        take = m if r >= m else max(1, stride)
        fixed = np.concatenate([fixed, rest[rows, chosen[:, :take]]], 1)
        mask = np.ones((c, m), bool)
        mask[rows, chosen[:, :take]] = False
        rest = rest[mask].reshape(c, m - take)
    final = scores(x[rows, fixed], e[rows, fixed], total, method, inner, model, weights=weights) if n > 1 else np.zeros(c)
    return fixed, final


def order_rays(hits: DataFrame, clusters: DataFrame, method: str = "oft", width: int = 5, stride: int = 2, max_size: int = 8, inner: float = G.SHELLS["gretina"][0], model: str = "default", weights: dict[str, float] | None = None) -> DataFrame:
    """``event_id, cluster_id, track_pos, point_idx, score``: the best order found for each cluster.

    ``method`` and ``weights`` as in :func:`scores`.

    Clusters of one hit get score 0; those above ``max_size`` keep the order of their hits and have a null score. Rays of one size in a
    batch are scored together. Hits without place or positive energy are left out; repeated rows count once.
    """
    h = hits.select("event_id", "point_idx", "x", "y", "z", "e").where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    j = clusters.select("event_id", "cluster_id", "point_idx").distinct().join(h, ["event_id", "point_idx"])
    rays = per_event(j, ["event_id", "cluster_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            size = pdf["e"].map(len).to_numpy() if len(pdf) else np.empty(0, int)
            for n in np.unique(size):
                g = pdf[size == n]
                idx = np.stack(g["point_idx"].to_list())
                e = np.stack(g["e"].to_list()).astype(float)
                x = np.stack([np.stack(g[c].to_list()) for c in "xyz"], 2).astype(float)
                if n > max_size:
                    order, sc = np.tile(np.arange(n), (len(g), 1)), np.full(len(g), np.nan)
                else:
                    order, sc = search(x, e, width, stride, method, inner, model=model, weights=weights)
                rows = np.arange(len(g))[:, None]
                out.append(pd.DataFrame({"event_id": np.repeat(g["event_id"].to_numpy(), n), "cluster_id": np.repeat(g["cluster_id"].to_numpy(), n), "track_pos": np.tile(np.arange(n), len(g)).astype(np.int32), "point_idx": idx[rows, order].ravel(), "score": np.repeat(sc, n)}))
            if out:
                yield pd.concat(out)

    o = rays.mapInPandas(run, "event_id long, cluster_id int, track_pos int, point_idx int, score double")
    return o.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def tried_rays(hits: DataFrame, clusters: DataFrame, width: int = 5, max_size: int = 6, cols: tuple[str, ...] = (), rows: int = 400_000) -> DataFrame:
    """Every order of every small cluster, the given one first: ``event_id, cluster_id, order_no, track_pos, point_idx`` and the
    hits' ``cols``, partitioned by event_id with about ``rows`` rows each, so that nothing after it need be shuffled.

    The first ``width`` places of an order are permuted, all of them at ``width`` + 1 hits; of longer clusters an order holds
    those places only. Clusters above ``max_size`` hits are left out, as the number of their orders isn't bounded.
    """
    from hitloom.operators.tracks import ordered_hits

    o = ordered_hits(hits, clusters)
    a = per_event(o, ["event_id", "cluster_id"], ["track_pos", "point_idx", *cols], ["track_pos", "point_idx"])
    a = a.withColumn("n", F.size("point_idx")).where((F.col("n") <= max_size) & (F.col("n") > 1))
    a = materialise(a.select("event_id", "cluster_id", "n", F.arrays_zip("point_idx", *cols).alias("hits")), "rays")
    sizes = a.groupBy("n").count().collect()  # one row per size
    places = {r["n"]: r["n"] if r["n"] == width + 1 else min(r["n"], width) for r in sizes}
    total = sum(r["count"] * math.perm(r["n"], places[r["n"]]) * places[r["n"]] for r in sizes)
    orders = F.array().cast("array<array<int>>")
    for n, r in places.items():
        orders = F.when(F.col("n") == n, F.from_json(F.lit(json.dumps(_perms(n, r).tolist())), "array<array<int>>")).otherwise(orders)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rows))
    a = a.repartition(parts, "event_id").select("event_id", "cluster_id", "hits", F.posexplode(orders).alias("order_no", "order"))
    a = a.select("event_id", "cluster_id", "order_no", F.posexplode(F.transform("order", lambda i: F.col("hits")[i])).alias("track_pos", "hit"))
    return a.select("event_id", "cluster_id", "order_no", "track_pos", *[F.col(f"hit.{c}").alias(c) for c in ("point_idx", *cols)])


def tried_orders(hits: DataFrame, clusters: DataFrame, width: int = 5, max_size: int = 6) -> DataFrame:
    """The orders of :func:`tried_rays`, the given one marked: rows to learn from.

    ``event_id, cluster_id, order_no, ordered, track_pos, point_idx``.
    """
    t = tried_rays(hits, clusters, width, max_size)
    return t.select("event_id", F.col("cluster_id").cast("int").alias("cluster_id"), "order_no", (F.col("order_no") == 0).cast("int").alias("ordered"), "track_pos", F.col("point_idx").cast("int").alias("point_idx"))


def _reverse_values(pts: np.ndarray, en: np.ndarray, paths: np.ndarray, method: str, inner: float) -> np.ndarray:
    """Figures of merit of paths (c, m) of points; the first point of a path is where its ray comes from. Infinite where none is defined."""
    if paths.shape[1] < 3:
        return np.full(len(paths), np.inf)
    place, deposit = pts[paths], en[paths[:, 1:]]
    v = scores(place[:, 1:] - place[:, :1], deposit, deposit.sum(1), method, inner)
    return np.where(np.isnan(v), np.inf, v)


def _fronts(free: list[int], size: int) -> np.ndarray:
    """All sequences of ``size`` free hits, and those of one less behind the origin (0)."""
    plain, led = (np.array(p, int).reshape(len(p), k) for k in (size, size - 1) for p in [list(permutations(free, k))])
    return np.concatenate([plain, np.concatenate([np.zeros((len(led), 1), int), led], 1)])


def backward_tracks(x: np.ndarray, e: np.ndarray, width: int = 3, stride: int = 1, e_min: float = 0.09, e_max: float = 0.25, method: str = "angle", inner: float = G.SHELLS["gretina"][0]) -> tuple[list[list[int]], list[int]]:
    """Tracks of one event grown backward from hits that look like last ones (energy between ``e_min`` and ``e_max``), and the hits left.

    A growing path takes the ``stride`` nearest points of the best front: of all sequences of up to ``width`` - 1
    free hits, which the origin may lead, the one whose figure of merit is lowest, as long as it is lower than the path's own. It ends at the origin or
    when no front is better. All fronts of a size are scored at once. Of the finished paths, the best that share no hit are tracks.
    """
    n = len(e)
    pts, en = np.concatenate([np.zeros((1, 3)), x]), np.concatenate([[0.0], e])

    def grown(seed: int) -> tuple[float, list[int]]:
        path, free, value = [seed], [i for i in range(1, n + 1) if i != seed], np.inf
        while path[0] != 0:
            best, front = value, None
            for size in range(1, min(width - 1, len(free) + 1) + 1):
                fronts = _fronts(free, size)
                v = _reverse_values(pts, en, np.concatenate([fronts, np.tile(path, (len(fronts), 1))], 1), method, inner)
                if v.min() < best:
                    best, front = v.min(), fronts[v.argmin()]
            if front is None:
                break
            near = front[-stride:].tolist()
            path, free = near + path, [i for i in free if i not in near]
            value = _reverse_values(pts, en, np.array([path]), method, inner)[0]
        return value, [i - 1 for i in path if i]

    paths = sorted((v, tuple(p)) for v, p in map(grown, np.flatnonzero((en > e_min) & (en < e_max)).tolist()) if v < np.inf)
    tracks, used = [], set()
    for _, path in paths:
        if used.isdisjoint(path):
            tracks.append(list(path))
            used.update(path)
    return tracks, [i for i in range(n) if i not in used]


def backward_rays(hits: DataFrame, width: int = 3, stride: int = 1, e_min: float = 0.09, e_max: float = 0.25, method: str = "angle", inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, cluster_id, track_pos, point_idx``: every event by :func:`backward_tracks`; hits in no track have no cluster and place.

    The work of an event grows with the square of its hits times its seeds (at ``width`` 3), and holds one front's scores.
    Hits without place or positive energy are left out; repeated rows count once; an empty table gives an empty result.
    """
    h = hits.select("event_id", "point_idx", "x", "y", "z", "e").where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    events = per_event(h, ["event_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                tracks, left = backward_tracks(np.stack([r.x, r.y, r.z], 1).astype(float), np.asarray(r.e, float), width, stride, e_min, e_max, method, inner)
                rows += [(r.event_id, c, k, r.point_idx[i]) for c, t in enumerate(tracks) for k, i in enumerate(t)]
                rows += [(r.event_id, None, None, r.point_idx[i]) for i in left]
            yield pd.DataFrame(rows, columns=["event_id", "cluster_id", "track_pos", "point_idx"]).astype({"cluster_id": "Int32", "track_pos": "Int32"})

    return events.mapInPandas(run, "event_id long, cluster_id int, track_pos int, point_idx int")


def ordered_partitions(items: list[int]) -> Iterator[list[list[int]]]:
    """Every way to part items into lists: the clusterings of an event with an order in each cluster; clusters in no order.

    Each item in turn is put at every place of every list there is, or begins a list. There are 4,596,553 for nine items; they come one
    by one.
    """
    if not items:
        yield []
        return
    last = items[-1]
    for lists in ordered_partitions(items[:-1]):
        for k, one in enumerate(lists):
            for at in range(len(one) + 1):
                yield [*lists[:k], [*one[:at], last, *one[at:]], *lists[k + 1 :]]
        yield [*lists, [last]]


def best_partition(hits: DataFrame, method: str = "angle", single: float = 0.5, max_hits: int = 6, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, cluster_id, track_pos, point_idx``: of all ordered partitions of an event the one of least total figure of merit.

    A cluster of one hit weighs ``single``. Events of more than ``max_hits`` hits give a row without cluster, place and hit, so that none is
    passed over in silence.
    """
    h = hits.select("event_id", "point_idx", "x", "y", "z", "e").where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    events = per_event(h, ["event_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def best(x: np.ndarray, e: np.ndarray) -> list[list[int]]:
        value = {}
        for m in range(1, len(e) + 1):  # figures of all lists of one length at once
            lists = _perms(len(e), m)
            v = np.full(len(lists), single) if m == 1 else scores(x[lists], e[lists], e[lists].sum(1), method, inner)
            value |= dict(zip(map(tuple, lists.tolist()), np.where(np.isnan(v), 1e9, v).tolist()))
        return min(ordered_partitions(list(range(len(e)))), key=lambda p: (sum(value[tuple(c)] for c in p), len(p)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                if len(r.e) > max_hits:
                    rows.append((r.event_id, None, None, None))
                    continue
                found = sorted(best(np.stack([r.x, r.y, r.z], 1).astype(float), np.asarray(r.e, float)), key=min)
                rows += [(r.event_id, c, k, r.point_idx[i]) for c, one in enumerate(found) for k, i in enumerate(one)]
            yield pd.DataFrame(rows, columns=["event_id", "cluster_id", "track_pos", "point_idx"]).astype({"cluster_id": "Int32", "track_pos": "Int32", "point_idx": "Int32"})

    return events.mapInPandas(run, "event_id long, cluster_id int, track_pos int, point_idx int")
