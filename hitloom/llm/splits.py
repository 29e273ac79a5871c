"""Train / validation / test splits that keep connected records together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import drop_table, materialise

def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links (u, v): every node with the smallest id of its tree."""
    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    parent = np.arange(len(ids))
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return ids, ids[parent]
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _fold(links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (kind, u, v) to stars (kind, node, root). A node of kind 1 and one of kind 0 may have the same id; every v and so every root is of kind 0."""
    k, u, v = (np.concatenate(x) for x in zip(*links))
    if not len(u):
        return k, u, v
    plain = k == 0
    ids, inv = np.unique(np.concatenate([u[plain], v]), return_inverse=True)
    others, at = np.unique(u[~plain], return_inverse=True)
    a = np.empty(len(u), np.int64)
    a[plain] = inv[: plain.sum()]
    a[~plain] = len(ids) + at
    node, root = roots(a, inv[plain.sum() :])
    keep = node != root
    node, root = node[keep], root[keep]
    kind = (node >= len(ids)).astype(np.int8)
    every = np.concatenate([ids, others])
    return kind, every[node], ids[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The local forest of one partition of links (kind, u, v) as stars, batches folded in as they come."""
    empty = np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)
    have, pending, held = empty, [], 0
    for b in batches:
        pending.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        held += b.num_rows
        if held > max(200_000, len(have[1])):
            have, pending, held = _fold([have, *pending]), [], 0
    have = _fold([have, *pending])
    for i in range(0, len(have[1]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in have], names=["kind", "u", "v"])


_LINK = "kind tinyint, u long, v long"


def components(links: DataFrame, rows_per_task: int = 2_000_000, fan_in: int = 8) -> DataFrame:
    """Connected components of ``links(u long, v long)``: ``(kind, u, v)`` = every node but the root, and its root.

    The root of a component is its smallest node. With a column ``kind`` (0 or 1) the nodes ``u`` of kind 1 have ids of
    their own space; every ``v``, and so every root, is of kind 0. Any 64-bit id will do.

    Each partition first reduces its own links to a spanning forest. Forests are then merged level by level, ``fan_in`` partitions into one, as
    long as a merged partition stays below ``rows_per_task`` links. When one partition is left it
    holds the answer. Otherwise the number of partitions stays as it is and every further level
    merges by child and lets parents that are children themselves be replaced by their own parents,
    until every link points at a root. No level gathers all links in one task or on the driver.

    Null ends and self-links tie nothing; repeated links are harmless; an empty table gives an empty
    result.
    """
    kind = F.col("kind").cast("tinyint") if "kind" in links.columns else F.lit(0).cast("tinyint")
    e = links.select(kind.alias("kind"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and (kind = 1 or u <> v)")
    parts = 0
    level = materialise(e.mapInArrow(_forest, _LINK), "forest")
    while True:
        n = level.count()
        least = max(1, math.ceil(n / rows_per_task))
        parts = max(least, (parts or max(1, level.rdd.getNumPartitions())) // fan_in)
        merged = level.repartition(parts, "kind", "u").mapInArrow(_forest, _LINK)
        if parts == 1:
            done = materialise(merged, "forest")
            drop_table(level)
            return done
        held = materialise(merged, "forest")
        # Parents that are children elsewhere; one row each, whatever the number of their links.
        up = held.where("kind = 0").groupBy(F.col("u").alias("v")).agg(F.min("v").alias("w"))
        jump = held.select("v").distinct().join(up, "v")
        multi = held.groupBy("kind", "u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        if not jump.limit(1).count() and not multi.count():
            drop_table(level)
            return held
        # A jump alone could lose the tie between two parents of one child, so the direct link of every jumped parent is kept.
        nxt = held.join(jump, "v", "left").select("kind", "u", F.coalesce("w", "v").alias("v")).union(jump.select(F.lit(0).cast("tinyint").alias("kind"), F.col("v").alias("u"), F.col("w").alias("v"))).distinct()
        drop_table(level)
        level = materialise(nxt, "forest")
        drop_table(held)


def ties(df: DataFrame, event: str, cluster: str, unknown: int = -1, **kw) -> DataFrame:
    """Components of records that share an event or a cluster: ``(kind 'e'|'c', id, root)``.

    ``root`` is the smallest event id of the component. Null events and null or ``unknown``
    clusters tie nothing. Nodes that are their own root are not listed.
    """
    links = df.select(F.lit(1).alias("kind"), F.col(cluster).cast("long").alias("u"), F.col(event).cast("long").alias("v")).where(F.col("u") != unknown)
    return components(links, **kw).select(F.when(F.col("kind") == 1, "c").otherwise("e").alias("kind"), F.col("u").alias("id"), F.col("v").alias("root"))


def _plan(sizes: list[tuple[int, int]], targets: list[tuple[str, float]]) -> list[tuple[int, str, int, int]]:
    """Greedy assignment of ``count`` groups of each ``size``, largest first, to the split furthest below target.

    Runs of equally large groups are dealt in bulk: the splits within one group of the furthest take
    turns until they reach the next. The outcome is that of the one-by-one greedy, up to which of two
    splits at the same distance comes first. Returns (size, split, first rank, past last rank).
    """
    targets = [(n, s) for n, s in targets if s and s > 0]
    whole = sum(s for _, s in targets)
    total = sum(s * c for s, c in sizes)
    short = [total * s / whole for _, s in targets]
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(targets)
        left = count
        while left:
            order = sorted(range(len(targets)), key=lambda j: (-short[j], j))
            top = [j for j in order if short[order[0]] - short[j] <= size]
            if len(top) == len(order):
                turns = left // len(top)
            else:
                turns = min(left // len(top), int((short[top[-1]] - short[order[len(top)]]) // size))
            for j in top:
                got[j] += turns
                short[j] -= turns * size
            left -= turns * len(top)
            if left and not turns or left < len(top) == len(order):
                for j in order[: min(left, 1 if len(top) < len(order) else len(top))]:
                    got[j] += 1
                    short[j] -= size
                    left -= 1
        at = 0
        for j, n in enumerate(got):
            if n:
                out.append((size, targets[j][0], at, at + n))
                at += n
    return out


def assign_splits(groups: DataFrame, targets: DataFrame, buckets: int = 256) -> DataFrame:
    """``groups(key string, size long)`` -> ``(key, split_name)`` by greedy largest-first assignment.

    The greedy needs only how many groups there are of each size. There are at most sqrt(2 n)
    different sizes over n rows, so that table is what one task works on, not the groups. Groups of
    one size are interchangeable and are numbered by hash: counts per (size, hash bucket), prefix-summed, plus
    the rank within the bucket. Deterministic for given keys and sizes.

    Splits with null or non-positive target get nothing; an empty ``groups`` gives an empty result.
    """
    want = [(r[0], float(r[1])) for r in targets.select("split_name", "target_share").where("split_name is not null and target_share > 0").orderBy("split_name").limit(10_000).collect()]
    if not want:
        raise ValueError("no split has a positive target share")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_plan(list(zip(pdf["size"].tolist(), pdf["n"].tolist())), want), columns=["size", "split_name", "lo", "hi"])

    hashed = groups.withColumn("h", F.xxhash64("key")).withColumn("b", F.pmod("h", F.lit(buckets)))
    counts = hashed.groupBy("size", "b").agg(F.count("*").alias("n"))
    ranges = counts.groupBy("size").agg(F.sum("n").alias("n")).groupBy(F.lit("").alias("whole")).applyInPandas(plan, "size long, split_name string, lo long, hi long")
    before = Window.partitionBy("size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("size", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    ranked = (
        hashed.withColumn("r", F.row_number().over(Window.partitionBy("size", "b").orderBy("h", "key")))
        .join(offs, ["size", "b"])
        .withColumn("r", F.col("r") - 1 + F.col("off"))
    )
    return ranked.alias("g").join(ranges.alias("t"), (F.col("g.size") == F.col("t.size")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("key", "split_name", F.col("g.size").alias("size"))


def grouped_splits(df: DataFrame, targets: DataFrame, row: str = "row_id", event: str = "ray_event_id", cluster: str = "ray_cluster_id", unknown: int = -1, **kw) -> DataFrame:
    """``(row, event, cluster, group_key, split_name)`` for every distinct row of ``df``.

    All records that share an event or a known cluster, directly or through others, get one split.
    A record without event follows its cluster; one with neither is a group of its own (its row id;
    rows that also lack an id form one group). Repeated rows count once.
    """
    rows = df.select(F.col(row).alias("_r"), F.col(event).cast("long").alias("_e"), F.col(cluster).cast("long").alias("_c")).distinct()
    tree = ties(rows, "_e", "_c", unknown, **kw)
    events = tree.where("kind = 'e'").select(F.col("id").alias("_e"), F.col("root").alias("er"))
    clusters = tree.where("kind = 'c'").select(F.col("id").alias("_c"), F.col("root").alias("cr"))
    known = F.when(F.col("_c") != unknown, F.col("_c"))
    keyed = (
        rows.join(events, "_e", "left")
        .join(clusters, "_c", "left")
        .withColumn(
            "key",
            F.when(F.col("_e").isNotNull(), F.concat(F.lit("e"), F.coalesce("er", "_e")))
            .when(F.col("cr").isNotNull(), F.concat(F.lit("e"), F.col("cr")))
            .when(known.isNotNull(), F.concat(F.lit("c"), known))
            .otherwise(F.concat(F.lit("r"), F.coalesce(F.col("_r").cast("string"), F.lit("")))),
        )
        .select("_r", "_e", "_c", "key")
    )
    keyed = materialise(keyed, "keyed")
    placed = assign_splits(keyed.groupBy("key").agg(F.count("*").alias("size")), targets)
    return keyed.join(placed.select("key", "split_name"), "key").select(F.col("_r").alias(row), F.col("_e").alias(event), F.col("_c").alias(cluster), F.col("key").alias("group_key"), "split_name")
