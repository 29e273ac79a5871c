"""Exact searches over the hits of small events: subset sums, set packing, dendrogram peaks, trajectories.

They take the place of mathematical programs. Subset sums of at most ``MOST`` hits are taken over all bit masks and
above that met in the middle; set packing goes over the states that its candidates lead to. All are exact at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from hitloom.functions import geometry as G, physics as P
from hitloom.operators import linkage as L
from hitloom.operators.events import per_event

MOST = 16


def _bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def subset_sums(e: np.ndarray) -> np.ndarray:
    """Sum of every subset, by mask."""
    out = np.zeros(1)
    for v in e:
        out = np.concatenate([out, out + v])
    return out


def _small_sums(e: np.ndarray, at: np.ndarray, most: float, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums up to ``most`` of the subsets of at most ``largest`` of the hits ``at``, their sizes, and their hits, padded with -1."""
    sums, size, hits = np.zeros(1), np.zeros(1, np.int64), np.full((1, largest), -1, np.int32)
    for i in at:
        ok = np.flatnonzero((size < largest) & (sums + e[i] <= most))
        more = hits[ok]
        more[np.arange(len(ok)), size[ok]] = i
        sums, size, hits = np.concatenate([sums, sums[ok] + e[i]]), np.concatenate([size, size[ok] + 1]), np.concatenate([hits, more])
    k = np.argsort(sums, kind="stable")
    return sums[k], size[k], hits[k]


def closest_subset(e: np.ndarray, energies: list[float], tolerance: float = 0.05, largest: int = 8) -> list[int] | None:
    """The subset of at most ``largest`` hits whose sum is closest to one of ``energies``, if within ``tolerance``; ties as in
    :func:`subset_sum_stack`.

    Two halves of the hits are met in the middle: time and memory go with the subsets of a half whose sums
    don't exceed the largest energy, not with all.
    """
    slack, block = 1e-13, 1_000_000  # sums of two halves differ from those in the order of the hits by less than the slack
    most, by_size = max(energies) + tolerance + slack, np.argsort(e, kind="stable")
    low, low_size, low_hits = _small_sums(e, np.sort(by_size[::2]), most, largest)
    high, high_size, high_hits = _small_sums(e, np.sort(by_size[1::2]), most, largest)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for r in range(largest + 1):
            mine = np.flatnonzero((low_size <= largest - r) & (low_size + r > 0))
            other = np.flatnonzero(high_size == r)
            for k in range(0, len(other) * bool(len(mine)), block):
                yield mine, other[k : k + block]

    least = np.full(len(energies), np.inf)
    for mine, other in pairs():
        for k, v in enumerate(energies):
            at = np.searchsorted(low[mine], v - high[other])
            for side in (np.maximum(at - 1, 0), np.minimum(at, len(mine) - 1)):
                least[k] = min(least[k], np.abs(low[mine[side]] + high[other] - v).min())
    bound = min(least.min(), tolerance) + slack
    best: tuple | None = None
    for mine, other in pairs():
        for k in np.flatnonzero(least <= bound):
            v = energies[k]
            lo = np.searchsorted(low[mine], v - high[other] - bound - slack)
            count = np.searchsorted(low[mine], v - high[other] + bound + slack, "right") - lo
            # All pairs that may be the closest, in blocks; the sums are taken anew in the order of the hits.
            ends = np.cumsum(count)
            for start in range(0, int(ends[-1]), block):
                number = np.arange(start, min(start + block, int(ends[-1])))
                row = np.searchsorted(ends, number, "right")
                both = np.sort(np.concatenate([low_hits[mine[lo[row] + number - (ends - count)[row]]], high_hits[other[row]]], 1), 1)[:, -largest:]
                total = np.zeros(len(both))
                for c in both.T:
                    total = np.where(c >= 0, total + e[c], total)
                d = np.abs(total - v)
                tied = both[d == d.min()][:, ::-1]  # the smaller mask has the smaller last hit, then the one before
                first = tied[np.lexsort(tied.T[::-1])[0]]
                found = (float(d.min()), int(k), tuple(int(i) for i in first))
                if found[0] < tolerance and (best is None or found < best):
                    best = found
    return None if best is None else sorted(i for i in best[2] if i >= 0)


def subset_sum_stack(e: np.ndarray, energies: list[float], tolerance: float = 0.05, largest: int = 8) -> list[list[int]]:
    """Clusters whose energies come closest to known ones: the closest of all first, then on what is left.

    Each cluster has at most ``largest`` hits; hits that fit no energy form the last cluster. Ties go to
    the energy listed first, then to the smaller mask. While more than ``MOST`` hits are left, the closest is found by
    :func:`closest_subset`, then by all masks.
    """
    rest, out = np.arange(len(e)), []
    while len(rest) > MOST:
        c = closest_subset(e[rest], energies, tolerance, largest)
        if c is None:
            return [*out, rest.tolist()]
        out.append(rest[c].tolist())
        rest = np.delete(rest, c)
    return out + [rest[c].tolist() for c in _masked_stack(e[rest], energies, tolerance, largest)]


def _masked_stack(e: np.ndarray, energies: list[float], tolerance: float, largest: int) -> list[list[int]]:
    n = len(e)
    sums = subset_sums(e)
    size = np.array([m.bit_count() for m in range(1 << n)])
    left, out = (1 << n) - 1, []
    while left:
        masks = np.flatnonzero((size > 0) & (size <= largest) & ((np.arange(1 << n) & ~left) == 0))
        best = None
        for v in energies:
            d = np.abs(sums[masks] - v)
            k = int(d.argmin())
            if d[k] < tolerance and (best is None or d[k] < best[0]):
                best = (float(d[k]), int(masks[k]))
        if best is None:
            break
        out.append(_bits(best[1]))
        left &= ~best[1]
    if left:
        out.append(_bits(left))
    return out


def set_packing(n: int, candidates: dict[tuple[int, ...], float], single: float = 0.5) -> list[tuple[int, ...]]:
    """Disjoint candidate clusters that cover every hit at the least total figure of merit; [] if none do.

    Clusters of one hit weigh ``single``. Every step covers the first hit that isn't, so only states that candidates
    lead to are held, for any number of hits.
    """
    by_first: dict[int, list] = {}
    for mask, f, c in sorted((sum(1 << i for i in c), single if len(c) == 1 else f, tuple(c)) for c, f in candidates.items()):
        by_first.setdefault((mask & -mask).bit_length() - 1, []).append((mask, f, c))
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for first in range(n):
        # States whose first uncovered hit is this one; all sets that hold it and no earlier one may follow.
        here = {m: v for m, v in best.items() if m & ((1 << first) - 1) == (1 << first) - 1}
        best = {}
        for covered, (v, chosen) in here.items():
            steps = [(0, 0.0, None)] if covered >> first & 1 else by_first.get(first, [])
            for mask, f, c in steps:
                if not mask & covered:
                    new = (v + f, chosen if c is None else (*chosen, c))
                    if covered | mask not in best or new < best[covered | mask]:
                        best[covered | mask] = new
    return list(best.get((1 << n) - 1, (0.0, ()))[1])


def all_clusters(merges: list[tuple[int, int, float]], n: int) -> list[tuple[int, ...]]:
    """Every cluster of a dendrogram: the single hits, then those the merges make."""
    now = {i: (i,) for i in range(n)}
    out = list(now.values())
    for a, b, _ in merges:
        now[a] = tuple(sorted(now[a] + now.pop(b)))
        out.append(now[a])
    return out


def dendrogram_peaks(p: np.ndarray, e: np.ndarray, energies: list[float], tolerance: float = 0.005, cut: float = 0.4) -> np.ndarray:
    """Labels: disjoint clusters of the angular dendrogram whose energies are known ones, as many as possible, then the
    larger; the other hits by the usual cut."""
    n = len(e)
    if n == 1:
        return np.zeros(1, np.int32)
    merges = L.agglomerate(L.distances(p, "great_circle", 0.0), "single")
    peaks = [c for c in all_clusters(merges, n) if any(abs(e[list(c)].sum() - v) < tolerance for v in energies)]
    eps = 1 / max(1, sum(map(len, peaks)))
    # The clusters of a tree are nested or disjoint, so the best choice is made from the leaves up.
    best: dict[tuple[int, ...], tuple[float, list]] = {}
    for c in all_clusters(merges, n):
        parts = [best[d] for d in sorted(best, key=len, reverse=True) if set(d) < set(c)]
        inner: tuple[float, list] = (0.0, [])
        used: set[int] = set()
        for d in sorted((d for d in best if set(d) < set(c)), key=len, reverse=True):
            if used.isdisjoint(d):
                used |= set(d)
                inner = (inner[0] + best[d][0], inner[1] + best[d][1])
        own = (1 + eps * len(c), [c]) if c in peaks else (0.0, [])
        best[c] = max(own, inner, key=lambda v: v[0]) if parts else own
    chosen = best[tuple(range(n))][1]
    lab = np.full(n, -1)
    for k, c in enumerate(chosen):
        lab[list(c)] = k
    rest = np.flatnonzero(lab < 0)
    if len(rest):
        own = L.cut_labels(p[rest], np.zeros(len(rest)), cut, "great_circle", "single", None, max(1, len(rest)), 0.0)
        lab[rest] = own + len(chosen)
    return L.relabelled(lab)


def trajectories(p: np.ndarray, e: np.ndarray, first: int, energy: float, angle: float, longest: float, tolerance: float = 0.01, inner: float = G.SHELLS["gretina"][0]) -> list[list[int]]:
    """Paths from the origin over hit ``first`` that use up ``energy``, each turn within ``angle`` of the Compton formula
    and all ways in material within ``longest``.

    All open paths of one length are carried on together: a table of paths against hits says which steps are allowed.
    """
    pts, dep = np.concatenate([np.zeros((1, 3)), p]), np.concatenate([[0.0], e])
    way = L.material_matrix(pts, inner)
    paths, left, room = np.array([[0, first + 1]]), np.array([energy], float), np.array([longest], float)
    if e[first] > energy + tolerance:
        return []
    out: list[list[int]] = []
    while len(paths):
        here, before = paths[:, -1], paths[:, -2]
        after = left - dep[here]
        ends = np.abs(after) < tolerance
        out += [[k - 1 for k in q[1:]] for q in paths[ends].tolist()]
        with np.errstate(all="ignore"):
            theory = 1 + P.MEC2 / left - P.MEC2 / after
            u, v = pts[here] - pts[before], pts[None] - pts[here][:, None]
            turn = np.arccos(np.clip(np.einsum("ci,cni->cn", u, v) / np.maximum(np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=2), 1e-300), -1, 1))
            near = np.abs(np.arccos(theory)[:, None] - turn) <= angle  # false where no angle has that cosine
        ok = near & (~ends & (after > 0))[:, None] & (way[here] <= room[:, None]) & (dep[None] <= after[:, None] + tolerance)
        ok[:, 0] = False
        ok[np.repeat(np.arange(len(paths)), paths.shape[1]), paths.ravel()] = False
        c, j = np.nonzero(ok)
        paths, left, room = np.concatenate([paths[c], j[:, None]], 1), after[c], room[c] - way[here[c], j]
    return sorted(out)


def predicted_clusters(n: int, features: Callable[[list[int], list[int]], np.ndarray], predict: Callable[[np.ndarray], np.ndarray], cutoff: float = 1.0) -> list[list[int]]:
    """Greedy agglomeration: the ordered pair of clusters with the best predicted score is joined while it is above ``cutoff``."""
    clusters = [[i] for i in range(n)]
    score: dict[tuple[int, int], float] = {}
    todo = [(i, j) for i in range(n) for j in range(n) if i != j]
    while len(clusters) > 1:
        x = [(k, features(clusters[k[0]], clusters[k[1]])) for k in todo]
        ok = [(k, v) for k, v in x if np.isfinite(v).all()]
        score |= {k: 0.0 for k, _ in x}
        if ok:
            score |= dict(zip([k for k, _ in ok], map(float, predict(np.array([v for _, v in ok])))))
        (i, j), best = max(score.items(), key=lambda s: (s[1], -s[0][0], -s[0][1]))
        if best <= cutoff:
            break
        lo, hi = min(i, j), max(i, j)
        clusters[lo] = clusters[i] + clusters[j]
        del clusters[hi]
        shift = lambda k: k - (k > hi)
        score = {(shift(a), shift(b)): v for (a, b), v in score.items() if hi not in (a, b) and lo not in (a, b)}
        todo = [(lo, k) for k in range(len(clusters)) if k != lo] + [(k, lo) for k in range(len(clusters)) if k != lo]
    return clusters


TRANSITIONS = ("energy_short", "energy_left", "scatter_depth", "end_depth", "angle", "before", "after", "after_both", "way_in", "way_out", "one_minus_cos", "one_minus_cos_last", "cos_mismatch")


def transition_tensor(p: np.ndarray, e: np.ndarray, inner: float = G.SHELLS["gretina"][0]) -> np.ndarray:
    """For every way i -> j -> k over the origin (0) and the hits: what a scatter at j would cost, ``TRANSITIONS`` last.

    Energies are the local estimates at j. Ways that visit a point twice, or the origin after the start, are 0.
    """
    from hitloom.operators.ordering import _mu

    pts, dep = np.concatenate([np.zeros((1, 3)), p]), np.concatenate([[0.0], e])
    n = len(pts)
    d = L.material_matrix(pts, inner)
    v = pts[None] - pts[:, None]
    r = np.sqrt((v**2).sum(2))
    with np.errstate(all="ignore"):
        cos = np.einsum("ijx,jkx->ijk", v, v) / (r[:, :, None] * r[None])
        omc = 1 - np.where(np.isfinite(cos), np.clip(cos, -1, 1), -1)
        ej, ek = dep[None, :, None], dep[None, None, :]
        before = np.where(omc > 0, ej / 2 + np.sqrt(ej**2 / 4 + ej * P.MEC2 / np.where(omc > 0, omc, 1)), P.FILL)
        after = before - ej
        both = after - ek
        _, mc, _ = _mu(before)
        ma, mk, _ = _mu(after)
        depth_in, depth_out = mc * d[:, :, None], (ma + mk) * d[None]
        ratio = after / before
        sin2 = np.clip(1 - (1 - omc) ** 2, 0, None)
        kn = np.pi * P.R_0**2 * ratio**2 * (ratio + 1 / ratio - sin2) * np.sqrt(sin2) / (mc / P.RANGE)
        angle = np.where((depth_in > 0) & (kn > 0), -np.log(kn), 0)
        last = np.where(ek > 0, P.MEC2 / ek - P.MEC2 / (ek + ej), 0)
        t = np.stack(np.broadcast_arrays(np.maximum(-both, 0) / P.MEC2, np.maximum(both, 0) / P.MEC2, depth_in, depth_out, angle, before, after, both, d[:, :, None], d[None], omc, last, (omc - last) ** 2), -1).copy()
    i = np.arange(n)
    t[i, i, :], t[i, :, i], t[:, i, i] = 0, 0, 0
    t[:, :, 0], t[:, 0, :] = 0, 0
    return np.nan_to_num(t)


def along(tensor: np.ndarray, order: list[int]) -> np.ndarray:
    """Sum of a transition tensor along an order of hits (0-based), from the origin."""
    path = [0, *(k + 1 for k in order)]
    return sum((tensor[a, b, c] for a, b, c in zip(path, path[1:], path[2:])), np.zeros(tensor.shape[-1]))


def _labelled(hits: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    ok = hits.where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    arrays = per_event(ok, ["event_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                lab = run(np.stack([r.x, r.y, r.z], 1).astype(float), np.asarray(r.e, float))
                out.append(pd.DataFrame({"event_id": r.event_id, "cluster_id": np.asarray(lab, np.int32), "point_idx": r.point_idx}))
            if out:
                yield pd.concat(out)

    return arrays.mapInPandas(go, "event_id long, cluster_id int, point_idx int")


def energy_clusters(hits: DataFrame, energies: list[float], tolerance: float = 0.05, largest: int = 8) -> DataFrame:
    """``event_id, cluster_id, point_idx``: every event clustered to known energies."""

    def run(_: np.ndarray, e: np.ndarray) -> np.ndarray:
        lab = np.zeros(len(e), np.int32)
        for k, c in enumerate(subset_sum_stack(e, energies, tolerance, largest)):
            lab[c] = k
        return lab

    return _labelled(hits, run)


def peak_clusters(hits: DataFrame, energies: list[float], tolerance: float = 0.005, cut: float = 0.4) -> DataFrame:
    """``event_id, cluster_id, point_idx``: every event by :func:`dendrogram_peaks`."""
    return _labelled(hits, lambda p, e: dendrogram_peaks(p, e, energies, tolerance, cut))


def energy_paths(hits: DataFrame, energies: list[float], angle: float, longest: float, tolerance: float = 0.01, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, energy, path_no, track_pos, point_idx``: all :func:`trajectories` of every event, over every first hit and energy."""
    ok = hits.where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    arrays = per_event(ok, ["event_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                p, e = np.stack([r.x, r.y, r.z], 1).astype(float), np.asarray(r.e, float)
                for v in energies:
                    found = [t for first in range(len(e)) for t in trajectories(p, e, first, v, angle, longest, tolerance, inner)]
                    rows += [(r.event_id, v, k, i, r.point_idx[h]) for k, t in enumerate(found) for i, h in enumerate(t)]
            yield pd.DataFrame(rows, columns=["event_id", "energy", "path_no", "track_pos", "point_idx"])

    return arrays.mapInPandas(run, "event_id long, energy double, path_no int, track_pos int, point_idx int")


def cheapest_clusters(hits: DataFrame, method: str = "angle", single: float = 0.5, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, cluster_id, point_idx``: of the clusters of each event's angular dendrogram, the disjoint ones that cover
    it at the least total figure of merit (:func:`set_packing`). A cluster's figure is that of its hits by rising radius."""
    from hitloom.operators.ordering import scores

    def run(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = len(e)
        merges = L.agglomerate(L.distances(p, "great_circle", 0.0), "single") if n > 1 else []
        foms: dict[tuple[int, ...], float] = {}
        for c in all_clusters(merges, n):
            o = sorted(c, key=lambda i: (float(p[i] @ p[i]), i))
            v = float(scores(p[o][None], e[o][None], np.array([e[o].sum()]), method, inner)[0]) if len(c) > 1 else single
            foms[c] = 1e9 if np.isnan(v) else v
        lab = np.zeros(n, np.int32)
        for k, c in enumerate(sorted(set_packing(n, foms, single))):
            lab[list(c)] = k
        return lab

    return _labelled(hits, run)


def transition_costs(hits: DataFrame, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, i, j, k`` and ``TRANSITIONS``: the cost of every scatter of an event, a row per way i -> j -> k (0 is the origin).

    There are n cubed rows for n hits; they leave in batches of one start i each.
    """
    ok = hits.where("x is not null and y is not null and z is not null and e > 0 and not isnan(e)").dropDuplicates(["event_id", "point_idx"])
    arrays = per_event(ok, ["event_id"], ["point_idx", "x", "y", "z", "e"], ["point_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                p, e = np.stack([r.x, r.y, r.z], 1).astype(float), np.asarray(r.e, float)
                t, idx = transition_tensor(p, e, inner), np.concatenate([[0], r.point_idx])
                n = len(idx)
                for i in range(n):
                    j, k = (a.ravel() for a in np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij"))
                    keep = (j != i) & (k != i) & (j != k)
                    j, k = j[keep], k[keep]
                    yield pd.DataFrame({"event_id": r.event_id, "i": idx[i], "j": idx[j], "k": idx[k]} | {c: t[i, j, k, m] for m, c in enumerate(TRANSITIONS)})

    return arrays.mapInPandas(run, "event_id long, i int, j int, k int, " + ", ".join(f"{c} double" for c in TRANSITIONS))


def classified_clusters(hits: DataFrame, weights: tuple[float, ...], bias: float, cutoff: float = 0.5, inner: float = G.SHELLS["gretina"][0]) -> DataFrame:
    """``event_id, cluster_id, point_idx``: :func:`predicted_clusters` of every event by a logistic score of two clusters, the first's end
    against the second's start.

    ``weights`` of the least, largest and mean material way between their hits, the way from end to start, the angle between their centres and
    their energies' sum.
    """

    def run(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        way, angle = L.material_matrix(p, inner), L.distances(p, "great_circle", 0.0)

        def features(a: list[int], b: list[int]) -> np.ndarray:
            w = way[np.ix_(a, b)]
            return np.array([w.min(), w.max(), w.mean(), way[a[-1], b[0]], angle[np.ix_(a, b)].mean(), e[a + b].sum()])

        def score(x: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-(x @ np.asarray(weights) + bias)))

        lab = np.zeros(len(e), np.int32)
        for k, c in enumerate(sorted(predicted_clusters(len(e), features, score, cutoff), key=min)):
            lab[c] = k
        return lab

    return _labelled(hits, run)
