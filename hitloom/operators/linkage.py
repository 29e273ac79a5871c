"""Hierarchical clustering of the hits of one event, on small dense matrices."""

from __future__ import annotations

import numpy as np

from hitloom.functions.arrays import material_way

#: What is added to the distance of hits that can't belong together.
FAR = np.finfo(float).max / 4


def relabelled(labels: np.ndarray) -> np.ndarray:
    """Labels 0.. in the order of first appearance."""
    _, first, inv = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inv].astype(np.int32)


def single_labels(near: np.ndarray) -> np.ndarray:
    """Connected components of a threshold graph, numbered by smallest member."""
    lab = np.arange(len(near))
    while True:
        new = np.where(near, lab[None, :], len(near)).min(1)
        new = np.minimum(new, lab)
        new = new[new]
        if np.array_equal(new, lab):
            return relabelled(lab)
        lab = new


def material_matrix(p: np.ndarray, inner: float) -> np.ndarray:
    """Material distances of all pairs around a hollow sphere."""
    return material_way(p[:, None], p[None], inner)


def distances(p: np.ndarray, metric: str, inner: float, centre_penalty: float = 0.0, centre_factor: float = 0.0, threshold: float = 1e-3) -> np.ndarray:
    euclid = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    if metric == "euclidean":
        return euclid
    if metric in ("great_circle", "cosine"):
        # A point at the origin has no direction: it is a right angle off every other, and at no distance from its like.
        n = np.linalg.norm(p, axis=1)
        u = p / np.where(n > 0, n, 1)[:, None]
        d = np.arccos(np.clip(u @ u.T, -1, 1))
        none = n == 0
        d[none[:, None] & none] = 0
        return d
    if metric == "germanium":
        d = material_matrix(p, inner)
        crossed = euclid - d > threshold
        return d + np.maximum(euclid - d, 0) * centre_factor + crossed * centre_penalty
    raise ValueError(f"unknown metric {metric!r}")


def agglomerate(d: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of single, complete, average or ward linkage; a < b name clusters by their smallest member."""
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, bool)
    out = []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        h = d[i, j]
        out.append((i, j, float(h)))
        a, b = d[i], d[j]
        if method == "single":
            row = np.minimum(a, b)
        elif method == "complete":
            row = np.maximum(a, b)
        elif method == "average":
            row = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif method == "ward":
            t = size + size[i] + size[j]
            row = np.sqrt(np.maximum(((size + size[i]) * a**2 + (size + size[j]) * b**2 - size * h**2) / t, 0))
        else:
            raise ValueError(f"unknown method {method!r}")
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return out


def directional(d: np.ndarray, max_length: int | None = None, weight: float | None = None) -> list[tuple[int, int, float]]:
    """Linkage of paths: the union of i then j keeps the distances from the end of i and to the start of j.

    ``d[i, j]`` is the distance from the end of i to the start of j. Joins beyond ``max_length`` hits are put off while
    others are possible. ``weight`` mixes the other row and column in.
    """
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    length = np.ones(n, int)
    alive = np.ones(n, bool)
    most = max_length or n
    out = []
    for _ in range(n - 1):
        open_ = alive[:, None] & alive[None, :] & ~np.eye(n, dtype=bool)
        short = open_ & (length[:, None] + length[None, :] <= most)
        look = short if short.any() else open_
        i, j = divmod(int(np.where(look, d, np.inf).argmin()), n)
        lo, hi = min(i, j), max(i, j)
        out.append((lo, hi, float(d[i, j])))
        row, col = (d[i].copy(), d[:, j].copy()) if weight is None else ((1 - weight) * d[i] + weight * d[j], weight * d[:, i] + (1 - weight) * d[:, j])
        d[lo], d[:, lo] = row, col
        d[lo, lo] = np.inf
        length[lo] = length[i] + length[j]
        alive[hi] = False
    return out


def labels_at(merges: list[tuple[int, int, float]], n: int, cut: float, most: int | None = None) -> np.ndarray:
    """Flat clusters below a height; if that leaves more than ``most``, the merges that make ``most``."""
    take = [m for m in merges if m[2] <= cut]
    if most is not None and n - len(take) > most:
        take = sorted(merges, key=lambda m: m[2])[: n - most]
    lab = np.arange(n)
    for a, b, _ in take:
        x, y = lab[a], lab[b]
        lab[lab == max(x, y)] = min(x, y)
    return relabelled(lab)


def cut_labels(p: np.ndarray, ts: np.ndarray, cut: float, metric: str, method: str, time_gap: int | None, most: int, inner: float, max_length: int | None = None, centre_penalty: float = 0.0, centre_factor: float = 0.0) -> np.ndarray:
    """Cluster labels of one event's hits."""
    if len(p) == 1:
        return np.zeros(1, np.int32)
    d = distances(p, metric, inner, centre_penalty, centre_factor)
    if time_gap is not None:
        apart = ~(np.abs(ts[:, None] - ts[None]) < time_gap)
        np.fill_diagonal(apart, False)
        d = d + apart * FAR
    if method == "single" and len(p) > 2 and most >= len(p):
        return single_labels(d <= cut)
    merges = directional(d, max_length) if method == "directional" else agglomerate(d, method)
    return labels_at(merges, len(p), cut, most)
