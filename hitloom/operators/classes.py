"""Classes of hits that merges make: disjoint sets per event, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hitloom.operators.events import per_event


def _least(idx: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each element's class after the merges (a, b); pairs with an unknown element merge nothing."""
    at = {int(v): k for k, v in enumerate(idx)}
    pairs = np.array([(at[x], at[y]) for x, y in zip(a, b) if x in at and y in at], int).reshape(-1, 2)
    low = np.arange(len(idx))
    while True:
        new = low.copy()
        np.minimum.at(new, pairs[:, 0], low[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], low[pairs[:, 0]])
        new = new[new]
        if np.array_equal(new, low):
            return idx[low]
        low = new


def merged_classes(elements: DataFrame, merges: DataFrame) -> DataFrame:
    """``event_id, point_idx, representative``: the class of every element, named by its least member, after all ``merges(event_id, a, b)``.

    An element that nothing merges is a class of its own; merges that name an element that isn't there, or null, do nothing; the order of merges
    and repeated rows don't matter; an empty table gives an empty result.
    """
    e = per_event(elements.select("event_id", "point_idx").where("point_idx is not null").distinct(), ["event_id"], ["point_idx"], ["point_idx"])
    m = merges.where("a is not null and b is not null").groupBy("event_id").agg(F.collect_set(F.struct("a", "b")).alias("m")).select("event_id", F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    both = e.join(m, "event_id", "left").select("event_id", "point_idx", *[F.coalesce(c, F.array().cast("array<int>")).cast("array<int>").alias(c) for c in "ab"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                idx = np.asarray(r.point_idx)
                out.append(pd.DataFrame({"event_id": r.event_id, "point_idx": idx, "representative": _least(idx, r.a, r.b)}))
            if out:
                yield pd.concat(out)

    return both.mapInPandas(run, "event_id long, point_idx int, representative int")


def class_sizes(classes: DataFrame, least: int = 1) -> DataFrame:
    """``event_id, representative, size``: the classes of at least ``least`` members (2: those that aren't trivial)."""
    return classes.groupBy("event_id", "representative").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def in_same_class(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``event_id, a, b, same`` of ``pairs(event_id, a, b)``; false where one isn't in any class."""
    side = lambda c: classes.select("event_id", F.col("point_idx").alias(c), F.col("representative").alias(f"_{c}"))
    j = pairs.select("event_id", "a", "b").join(side("a"), ["event_id", "a"], "left").join(side("b"), ["event_id", "b"], "left")
    return j.select("event_id", "a", "b", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))
