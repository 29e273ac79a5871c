"""Similarity clusters of point patterns by mergeable cluster-feature trees and Ward agglomeration."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.llm.splits import components, roots
from hitloom.runtime import drop_table, materialise

#: Dimensions of the embedding, width of its kernel in cm, largest squared distance of patterns held equal.
DIMS = 128
WIDTH = 1.5
EQUAL = 3.5
#: Entries of a tree in memory; a fuller one is passed on and another begun.
LEAVES = 50_000
#: Entries that are compared with each other at once, and those that two leaves share a key with on average.
BLOCK = 4_000
SHARING = 1_000
#: Least chance that two leaves of one pattern have the same least cell in a turn, and the chance that is left of never meeting.
AGREE = 0.65
MISS = 1e-5
#: Edge of the lattice cells by which leaves find each other, in cm.
LATTICE = 6.0

_RNG = np.random.default_rng(20240305)
_W = (_RNG.standard_normal((3, DIMS)) / WIDTH).astype(np.float32)
_B = _RNG.uniform(0, 2 * np.pi, DIMS).astype(np.float32)


def embed(sets: list[np.ndarray], dims: int = DIMS) -> np.ndarray:
    """One vector per set of points: the sum of random Fourier features of its points.

    The squared distance of two vectors is about the number of points of either set without a
    counterpart in the other, in whatever order the points come; the fewer ``dims``, the more roughly.
    """
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), dims), np.float32)
    order = np.argsort(n, kind="stable")
    order = order[np.searchsorted(n[order], 1) :]
    if not len(order):
        return out
    f = np.concatenate([sets[i] for i in order.tolist()]).astype(np.float32) @ _W[:, :dims]
    f += _B[:dims]
    np.cos(f, out=f)
    at = 0
    for size, rows in zip(*_by_size(n[order])):  # sets of one size at once
        end = at + size * len(rows)
        out[order[rows]] = f[at:end].reshape(len(rows), size, dims).sum(1)
        at = end
    return out * np.float32((2 / dims) ** 0.5)


def _by_size(n: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct values of a rising array and the places of each."""
    size, first = np.unique(n, return_index=True)
    return size.tolist(), np.split(np.arange(len(n)), first[1:])


def _sets(flat) -> list[np.ndarray]:
    return [np.asarray(p, np.float32).reshape(-1, 3) for p in flat]


class _Node:
    """Entries of a node: counts, linear sums, and child nodes or numbers of leaf entries."""

    __slots__ = ("leaf", "n", "ls", "to")

    def __init__(self, leaf: bool, n: np.ndarray, ls: np.ndarray, to: list):
        self.leaf, self.n, self.ls, self.to = leaf, n, ls, to

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its squared distance."""
        c = self.ls / self.n[:, None]
        d = np.einsum("ij,ij->i", c, c)[None] - 2 * (x @ c.T)
        i = d.argmin(1)
        return i, d[np.arange(len(x)), i] + np.einsum("ij,ij->i", x, x)

    def taken(self, rows: np.ndarray) -> _Node:
        return _Node(self.leaf, self.n[rows], self.ls[rows], [self.to[i] for i in rows.tolist()])


class CFTree:
    """Cluster-feature tree: entries hold count and linear sum; leaves absorb within a radius.

    Whole batches are inserted at once, node by node. A node with more than ``width`` entries is split
    by its two farthest ones. Two trees merge by inserting the entries of one into the other.
    """

    def __init__(self, limit: float = EQUAL / 2, width: int = 32):
        self.limit, self.width = limit, width
        self.root = _Node(True, np.zeros(0), np.zeros((0, DIMS), np.float32), [])
        self.count = 0
        self.n, self.ls = np.zeros(0), np.zeros((0, DIMS), np.float32)  # per leaf entry

    def insert(self, ls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Add points (n = 1) or entries of another tree; returns the number of the leaf entry each went to."""
        at = np.zeros(len(ls), np.int64)
        if not len(ls):
            return at
        parts = self._into(self.root, np.arange(len(ls)), (ls / n[:, None]).astype(np.float32), ls, n, at)
        while len(parts) > 1:
            parts = self._split(_Node(False, np.array([p.n.sum() for p in parts]), np.stack([p.ls.sum(0) for p in parts]), parts))
        self.root = parts[0]
        grow = self.count - len(self.n)
        self.n, self.ls = np.concatenate([self.n, np.zeros(grow)]), np.concatenate([self.ls, np.zeros((grow, DIMS), np.float32)])
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        self.n[at[order[heads]]] += np.add.reduceat(n[order], heads)
        self.ls[at[order[heads]]] += np.add.reduceat(ls[order], heads, axis=0)
        return at

    def _into(self, node: _Node, rows: np.ndarray, x: np.ndarray, ls: np.ndarray, n: np.ndarray, at: np.ndarray) -> list[_Node]:
        if not node.leaf:
            near, _ = node.nearest(x[rows])
            kept, new = [], []
            for j in range(len(node.to)):
                own = rows[near == j]
                if len(own):
                    parts = self._into(node.to[j], own, x, ls, n, at)
                    if len(parts) == 1:
                        node.to[j] = parts[0]
                        node.n[j] += n[own].sum()
                        node.ls[j] += ls[own].sum(0)
                    else:
                        new += parts
                        continue
                kept.append(j)
            if not new:
                return [node]
            old = node.taken(np.array(kept, int))
            more = _Node(False, np.concatenate([old.n, [p.n.sum() for p in new]]), np.concatenate([old.ls, np.stack([p.ls.sum(0) for p in new])]), old.to + new)
            return self._split(more)
        rest = rows
        if len(node.n):
            near, d = node.nearest(x[rows])
            hit = d <= self.limit
            own, rest = rows[hit], rows[~hit]
            to = np.array(node.to)
            at[own] = to[near[hit]]
            np.add.at(node.n, near[hit], n[own])
            np.add.at(node.ls, near[hit], ls[own])
        if not len(rest):
            return [node]
        # What no entry takes in: the first is an entry of its own and takes in those near it, and so on.
        first: list[int] = []
        g = x[rest] @ x[rest].T
        q = np.diag(g)
        open_ = np.ones(len(rest), bool)
        groups = []
        while open_.any():
            i = int(open_.argmax())
            mine = open_ & (q + q[i] - 2 * g[i] <= self.limit)
            mine[i] = True
            open_ &= ~mine
            first.append(i)
            groups.append(rest[mine])
            at[rest[mine]] = self.count + len(groups) - 1
        numbers = list(range(self.count, self.count + len(groups)))
        self.count += len(groups)
        more = _Node(True, np.concatenate([node.n, [n[r].sum() for r in groups]]), np.concatenate([node.ls, np.stack([ls[r].sum(0) for r in groups])]), node.to + numbers)
        return self._split(more)

    def _split(self, node: _Node) -> list[_Node]:
        if len(node.n) <= self.width:
            return [node]
        c = node.ls / node.n[:, None]
        g = c @ c.T
        d = np.diag(g)[:, None] + np.diag(g) - 2 * g
        i, j = np.unravel_index(d.argmax(), d.shape)
        near = d[i] <= d[j]
        near[i], near[j] = True, False
        return self._split(node.taken(np.flatnonzero(near))) + self._split(node.taken(np.flatnonzero(~near)))


def ward(n: np.ndarray, ls: np.ndarray, equal: float = EQUAL, block: int = 2_048, parts: list[np.ndarray] | None = None) -> np.ndarray:
    """Ward agglomeration of cluster features: the number of the cluster of each.

    The pair whose union adds least to the squared sum is joined first, as long as the centres are
    within ``equal`` of each other. Only pairs that near are held; they are found in blocks. With ``parts`` (lists of
    entries) only entries of one part are joined.
    """
    m = len(n)
    group = np.arange(m)
    c = ls / n[:, None]
    sq = np.einsum("ij,ij->i", c, c)
    near: list[set[int]] = [set() for _ in range(m)]
    heap = []
    for part in [np.arange(m)] if parts is None else parts:
        q, cp = sq[part], c[part]
        for s in range(0, len(part), block):
            d = q[s : s + block, None] + q[None, s:] - 2 * (cp[s : s + block] @ cp[s:].T)
            i, j = np.nonzero(d <= equal)
            up = j > i
            for a, b, x in zip(part[i[up] + s].tolist(), part[j[up] + s].tolist(), d[i[up], j[up]].tolist()):
                near[a].add(b)
                near[b].add(a)
                heap.append((max(0.0, x) * n[a] * n[b] / (n[a] + n[b]), a, b))
    heapq.heapify(heap)
    alive = [True] * m
    n, ls = list(n), list(ls)
    parent = {}
    while heap:
        _, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        new = len(n)
        n.append(n[a] + n[b])
        ls.append(ls[a] + ls[b])
        alive[a] = alive[b] = False
        alive.append(True)
        parent[a] = parent[b] = new
        around = {x for x in near[a] | near[b] if alive[x]}
        near.append(set())
        ctr = ls[new] / n[new]
        for x in around:
            d = ctr - ls[x] / n[x]
            d = float(d @ d)
            if d <= equal:
                near[new].add(x)
                near[x].add(new)
                heapq.heappush(heap, (d * n[new] * n[x] / (n[new] + n[x]), new, x))

    def top(i: int) -> int:
        while i in parent:
            i = parent[i]
        return i

    for i in range(m):
        group[i] = top(i)
    return np.unique(group, return_inverse=True)[1]


_LEAF = "kind tinyint, id long, leaf long, n long, ls binary, rep array<float>"


def _grow(most: int, merging: bool, batch: int = 2_000):
    """Plant trees of about ``most`` entries from records (id, pts), or merge the entries of other trees into new ones.

    Yields the entries (kind 1: number, count, sums, one set of points; the sum of a single record follows from its points)
    and where each record or older entry went (kinds 0 and 2).
    """

    def out(tree: CFTree, ids: np.ndarray, at: np.ndarray, sets: list) -> Iterator[pd.DataFrame]:
        order = np.lexsort((ids, at))
        head = order[np.r_[True, np.diff(at[order]) > 0]]  # per entry its least id
        lowest = ids[head]
        moved = pd.DataFrame({"kind": np.int8(2 if merging else 0), "id": ids, "leaf": lowest[at], "n": 0, "ls": None, "rep": None}).astype({"id": "Int64"})
        entries = pd.DataFrame({"kind": np.int8(1), "id": None, "leaf": lowest, "n": tree.n.astype(np.int64), "ls": [b.tobytes() if k > 1 else None for b, k in zip(tree.ls, tree.n)], "rep": [sets[i] for i in head.tolist()]}).astype({"id": "Int64"})
        for t in (moved, entries):
            for s in range(0, len(t), 20_000):
                yield t.iloc[s : s + 20_000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, ids, at, sets = CFTree(), [], [], []
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                flat = part["rep" if merging else "pts"].tolist()
                ls = _sums(part) if merging else embed(_sets(flat))
                ids.append(part["leaf" if merging else "id"].to_numpy(np.int64))
                at.append(tree.insert(ls, part["n"].to_numpy(float) if merging else np.ones(len(part))))
                sets += flat
                if tree.count >= most or len(sets) >= 20 * most:
                    yield from out(tree, np.concatenate(ids), np.concatenate(at), sets)
                    tree, ids, at, sets = CFTree(), [], [], []
        if ids:
            yield from out(tree, np.concatenate(ids), np.concatenate(at), sets)

    return run


def _sums(pdf: pd.DataFrame) -> np.ndarray:
    """Linear sums; that of a single record is computed from its points."""
    ls = embed(_sets(pdf["rep"]))
    for k, b in enumerate(pdf["ls"]):
        if b is not None:
            ls[k] = np.frombuffer(b, np.float32)
    return ls


def _agglomerate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ward agglomeration of the leaves of several components: ``component, leaf, cluster``, and per cluster its ``n`` and ``ls``, on the row of its least leaf.

    All components of the frame go through one call; only leaves of one component are joined.
    """
    pdf = pdf.sort_values(["component", "leaf"]).reset_index(drop=True)
    ls, n = _sums(pdf), pdf["n"].to_numpy(float)
    ends = np.flatnonzero(np.diff(pdf["component"].to_numpy())) + 1
    group = ward(n, ls, parts=np.split(np.arange(len(pdf)), ends))
    first = np.full(group.max() + 1, len(pdf)) if len(pdf) else np.empty(0, int)
    np.minimum.at(first, group, np.arange(len(pdf)))
    total, sums = np.bincount(group, n), np.zeros((len(first), DIMS), np.float32)
    np.add.at(sums, group, ls)
    leaf = pdf["leaf"].to_numpy()
    head = first[group] == np.arange(len(pdf))
    return pd.DataFrame({"component": pdf["component"], "leaf": leaf, "cluster": leaf[first[group]], "n": np.where(head, total[group], 0).astype(np.int64), "ls": [sums[g].tobytes() if h else None for g, h in zip(group, head)]})


def lattice_keys(sets: list[np.ndarray], turns: range, hashes: int) -> np.ndarray:
    """``(len(sets), len(turns))`` keys: of each turn the ``hashes`` least of the hashes of the lattice cells of a set's points, in one.

    Lattice and hashes change with every turn. Sets of one pattern agree on the least cell with a
    chance of at least about their share of common points.
    """
    n = np.array([len(s) for s in sets])
    pts = np.concatenate(sets).astype(float)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(sets)), n)
    out = np.empty((len(sets), len(turns)), np.uint64)
    mix = lambda v: ((v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) ^ (v >> np.uint64(29))
    for k, turn in enumerate(turns):
        rng = np.random.default_rng([turn, 77])
        cell = np.floor((pts + rng.uniform(0, LATTICE, 3)) / LATTICE).astype(np.int64).view(np.uint64)
        h = np.full(len(pts), rng.integers(1 << 63), np.uint64)
        for a in range(3):
            h = mix(h + cell[:, a] * np.uint64(0xD6E8FEB86659FD93))
        key = np.full(len(sets), turn, np.uint64)
        for _ in range(hashes):
            least = np.minimum.reduceat(h, starts)
            key = mix(key * np.uint64(0xBF58476D1CE4E5B9) + least)
            h = np.where(h == least[owner], np.uint64(0xFFFFFFFFFFFFFFFF), h)  # sets of fewer cells end with the largest number
        out[:, k] = key
    return out.view(np.int64)


def _keyed(leaves: DataFrame, turns: range, hashes: int, keep: str) -> DataFrame:
    """``keep`` and ``keys array<long>``, one per turn."""
    kinds = dict(leaves.dtypes)
    names = [c.strip() for c in keep.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[names].assign(keys=list(lattice_keys(_sets(pdf["rep"]), turns, hashes)))

    return leaves.select(*names).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", keys array<long>")


#: Dimensions in which the entries under one key are compared first, and the squared distance up to which all of them are.
COARSE, LOOSE = 32, 7.0


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries under several keys -> links of those that are near each other under one key, as stars (u, least of them v)."""
    pdf = pdf[pdf["key"].duplicated(keep=False)].sort_values(["key", "leaf"])
    if not len(pdf):
        return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
    key = pdf["key"].to_numpy()
    # An entry that comes under several keys here is embedded once.
    leaf, one, inv = np.unique(pdf["leaf"].to_numpy(), return_index=True, return_inverse=True)
    sets = _sets(pdf["rep"].iloc[one])
    x = embed(sets, COARSE)
    q = np.einsum("ij,ij->i", x, x)[inv]
    x = x[inv]
    us, vs = [], []
    edges = np.flatnonzero(np.r_[True, np.diff(key) != 0, True])
    size = np.diff(edges)
    at = np.flatnonzero(np.repeat(size <= FEW, size))
    for step in range(1, FEW):  # small groups all at once: each row against the ones after it
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = q[at] + q[at + step] - 2 * np.einsum("ij,ij->i", x[at], x[at + step]) <= LOOSE
        us.append(inv[at[near] + step])
        vs.append(inv[at[near]])
    for a, b in zip(edges[:-1][size > FEW].tolist(), edges[1:][size > FEW].tolist()):
        for s in range(a, b, 2_048):
            e = min(b, s + 2_048)
            i, j = np.nonzero(q[s:e, None] + q[None, s:b] - 2 * (x[s:e] @ x[s:b].T) <= LOOSE)
            up = j > i
            us.append(inv[s + j[up]])
            vs.append(inv[s + i[up]])
    # What is near in few dimensions is measured in all, each pair and each entry once.
    pair = np.unique(np.minimum(np.concatenate(us), np.concatenate(vs)) * len(leaf) + np.maximum(np.concatenate(us), np.concatenate(vs)))
    i, j = pair // len(leaf), pair % len(leaf)
    i, j = i[i != j], j[i != j]
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    full = embed([sets[k] for k in some.tolist()])
    ok = np.zeros(len(i), bool)
    for s in range(0, len(i), 50_000):
        d = full[at[: len(i)][s : s + 50_000]] - full[at[len(i) :][s : s + 50_000]]
        ok[s : s + 50_000] = np.einsum("ij,ij->i", d, d) <= EQUAL
    ids, root = roots(leaf[j[ok]], leaf[i[ok]])
    far = ids != root
    return pd.DataFrame({"u": ids[far], "v": root[far]})


#: Groups of up to so many entries under one key are compared together.
FEW = 24


def near_leaves(leaves: DataFrame, block: int = BLOCK, sharing: float = SHARING, agree: float = AGREE, miss: float = MISS) -> DataFrame:
    """Links ``u, v`` that tie all entries ``(leaf, rep)`` of one pattern, over all entries, in one shuffle.

    Entries meet under keys of the ``hashes`` least cells in ``turns`` lattices. How many hashes a key
    takes follows from how crowded the cells are, so that an entry shares a key with about ``sharing`` others at most; more
    hashes mean more turns, so that two entries of one pattern miss each other in all of them with a
    chance below ``miss``, whatever the number of entries. A key with more than ``block`` entries is split into
    blocks, and every block is compared with every other: crowded keys lose no link.
    """
    n = leaves.count()
    first = _keyed(leaves, range(1), 1, "rep").groupBy(F.col("keys")[0].alias("key")).agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
    meet = min(0.9, first / max(1, n) ** 2)  # chance that two entries share one cell
    hashes = max(1, math.ceil(math.log(max(1.0, n / sharing)) / -math.log(max(meet, 1e-9))))
    turns = math.ceil(math.log(miss) / math.log(1 - agree**hashes))
    keyed = materialise(_keyed(leaves, range(1, turns + 1), hashes, "leaf, rep"), "keyed")
    every = keyed.select("leaf", "rep", F.explode("keys").alias("key"))
    crowded = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).select("key", F.ceil(2 * F.col("m") / block).cast("int").alias("blocks"))
    crowded = materialise(crowded, "crowded")
    own = F.pmod(F.xxhash64("leaf"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    split = every.join(crowded, "key", "left").select("leaf", "rep", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    buckets = F.lit(max(1, math.ceil(n * turns / (4 * block))))
    links = materialise(split.groupBy(F.pmod(F.xxhash64("key"), buckets).alias("bucket")).applyInPandas(_near, "u long, v long"), "links")
    for t in (keyed, crowded):
        drop_table(t)
    return links


def similar_sets(df: DataFrame, record: str = "event_id", points: str = "points", most: int = LEAVES, **kw) -> DataFrame:
    """``id, cluster, size, distance``: the members of every cluster of two or more and how far they are from its centre.

    1. Each partition plants cluster-feature trees of its records' embeddings; so copies collapse into one
       entry wherever they lie, and a pattern that holds most of the rows moves as a few entries. A tree holds at most ``most`` entries.
    2. The trees are reduced: their entries move to the task of a lattice key and are inserted into a new tree
       there, so that those of one pattern join over partitions.
    3. Leaves of one pattern that are still apart are tied (:func:`near_leaves`), and the leaves of each tied set are
       joined by Ward agglomeration as long as centres stay within ``EQUAL``.
    4. One full pass assigns the records: each is measured against all centres of its tied set; the nearest member of a centre is the most
       typical one. A record joins the nearest centre whose typical member its points match
       one to one within 1.1 cm, but for two; one that matches none stays apart.

    Null records, and sets that are null, empty or without any full position belong to no cluster. Repeated rows of a
    record count once (the least of its point lists is taken). Ties in distance go to the smaller id.
    """
    xyz = F.filter(F.col(points), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull() & ~F.isnan(p["x"] + p["y"] + p["z"]))
    flat = F.flatten(F.transform(xyz, lambda p: F.array(p["x"].cast("float"), p["y"].cast("float"), p["z"].cast("float"))))
    sets = df.select(F.col(record).cast("long").alias("id"), flat.alias("pts")).where("id is not null and size(pts) > 0").groupBy("id").agg(F.min("pts").alias("pts"))
    sets = materialise(sets, "sets")
    grown = materialise(sets.mapInPandas(_grow(most, False), _LEAF), "trees")
    planted = grown.where("kind = 1")
    # A key's entries go to one task, or to several where there are very many; what stays apart is tied below.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(planted.count() / most))
    salt = F.pmod(F.xxhash64("leaf"), F.lit(max(1, tasks // 64)))
    by_key = _keyed(planted, range(1), 1, "leaf, n, ls, rep").repartition(tasks, F.col("keys")[0], salt).drop("keys")
    merged = materialise(by_key.mapInPandas(_grow(most, True), _LEAF), "merged")
    leaves = merged.where("kind = 1").select("leaf", "n", "ls", "rep")
    tied = components(near_leaves(leaves, **kw))
    in_set = tied.select("u", "v").unionByName(tied.select(F.col("v").alias("u"), "v").distinct())
    parts = F.lit(max(1, math.ceil(in_set.count() / BLOCK)))
    joined = leaves.join(in_set, F.col("leaf") == F.col("u")).select(F.col("v").alias("component"), "leaf", "n", "ls", "rep")
    agglomerated = materialise(joined.groupBy(F.pmod(F.xxhash64("component"), parts).alias("part")).applyInPandas(_agglomerate, "component long, leaf long, cluster long, n long, ls binary"), "ward")
    alone = leaves.where("n > 1").join(in_set, F.col("leaf") == F.col("u"), "left_anti").select(F.col("leaf").alias("component"), F.col("leaf").alias("cluster"), "n", "ls")
    centres = agglomerated.where("ls is not null").select("component", "cluster", "n", "ls").unionByName(alone).select("component", "cluster", F.col("n").alias("weight"), "ls")
    step = merged.where("kind = 2").select(F.col("id").alias("old"), F.col("leaf").alias("new"))
    where = step.join(in_set, F.col("new") == F.col("u"), "left").select("old", F.coalesce("v", "new").alias("component"))
    own = grown.where("kind = 0").select("id", "leaf").join(where, F.col("leaf") == F.col("old")).select("id", "component")
    near = own.join(centres, "component").join(sets, "id").mapInPandas(_assign, "id long, cluster long, distance double, pts array<float>")
    near = materialise(near, "assigned")
    nearest = near.groupBy("id").agg(F.min(F.struct("distance", "cluster", "pts")).alias("a")).select("id", "a.*")
    typical = nearest.groupBy("cluster").agg(F.min(F.struct("distance", "id", "pts")).alias("t")).select("cluster", F.col("t.pts").alias("typical"))
    checked = near.join(typical, "cluster").mapInPandas(_check, "id long, cluster long, distance double").groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("a")).select("id", "a.*")
    checked = materialise(checked, "checked")
    for t in (sets, grown, merged, near):
        drop_table(t)
    sizes = checked.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")
    return checked.join(sizes, "cluster").select("id", F.col("first").alias("cluster"), "size", "distance")


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c = np.stack([np.frombuffer(b, np.float32) for b in pdf["ls"]]) / pdf["weight"].to_numpy(np.float32)[:, None] if len(pdf) else np.zeros((0, DIMS), np.float32)
        d = embed(_sets(pdf["pts"])) - c
        yield pd.DataFrame({"id": pdf["id"], "cluster": pdf["cluster"], "distance": np.einsum("ij,ij->i", d, d).astype(float).round(6), "pts": pdf["pts"]})


def matched(a: np.ndarray, b: np.ndarray, reach: float = 1.1) -> int:
    """Points of ``a`` paired one to one with points of ``b`` within ``reach``, nearest pairs first."""
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    n, rows, cols = 0, set(), set()
    for k in np.argsort(d, axis=None, kind="stable"):
        i, j = divmod(int(k), d.shape[1])
        if d[i, j] > reach:
            break
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            n += 1
    return n


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for a, b in zip(_sets(pdf["pts"]), _sets(pdf["typical"])):
            most, n = max(len(a), len(b)), matched(a, b)
            keep.append(most - n <= 2 and 2 * n > most)
        yield pdf.loc[keep, ["id", "cluster", "distance"]]


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster its size and its ``typical`` members nearest to the centre.

    Members of a large cluster are first reduced within hash buckets, then ranked.
    """
    few = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, typical)
    w = Window.partitionBy("cluster", "size", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("distance", "id")
    best = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    return best.groupBy("cluster", "size").agg(few.alias("t")).select("cluster", "size", F.col("t.id").alias("typical_members"))
