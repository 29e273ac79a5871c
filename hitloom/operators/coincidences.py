"""Time coincidences of hits and their flattening into events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hitloom.operators.sessions import session_starts


def _anchored(gap: int):
    """Rows (shard, start of the chain, time) in order to (shard, time, time of the first hit of its coincidence).

    Within ``gap`` of the chain's start that is the start; only the hits beyond it are folded, one after the other. What a batch
    hands to the next is one chain and its last anchor, so chains may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        anchor = 0
        for b in batches:
            shard, start, t = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            out = start.copy()
            beyond = np.flatnonzero(t - start >= gap)
            names = shard.take(pa.array(beyond)).to_pylist()
            for i, name, s, u in zip(beyond.tolist(), names, start[beyond].tolist(), t[beyond].tolist()):
                if (name, s) != at:
                    at, anchor = (name, s), s
                if u - anchor >= gap:
                    anchor = u
                out[i] = anchor
            yield pa.RecordBatch.from_arrays([shard, b.column(2), pa.array(out)], names=["_shard", b.schema.names[2], "coincidence_ts"])

    return run


def coincidences(hits: DataFrame, ts: str = "ts", gap: int = 40, anchored: str = "first", shard: str | None = None) -> DataFrame:
    """Adds ``coincidence_ts``: the time of the first hit of each hit's coincidence.

    anchored 'last': a hit belongs where its distance to the hit before is below ``gap``. anchored
    'first': where its distance to the first hit of the coincidence is. Either is exact for any number of tasks: a silence
    of ``gap`` ends a coincidence under both rules, so chains between silences are found by the
    session sweep, and the fold from the first hit runs inside chains, over distinct times.

    Without ``shard`` the hits are one stream. Hits without time are left out.
    """
    keyed = hits.withColumn("_shard", F.lit(0) if shard is None else F.col(shard))
    chains = session_starts(keyed, "_shard", ts, gap - 1)
    if anchored == "last":
        marks = chains.withColumnRenamed("start_ts", "coincidence_ts")
    elif anchored == "first":
        order = ["_shard", "start_ts", ts]
        kinds = dict(chains.dtypes)
        schema = f"_shard {kinds['_shard']}, {ts} long, coincidence_ts long"
        marks = chains.select(*order).repartition("_shard", "start_ts").sortWithinPartitions(*order).mapInArrow(_anchored(gap), schema)
    else:
        raise ValueError(f"unknown anchor {anchored!r}")
    return keyed.join(marks, ["_shard", ts]).drop("_shard")


def calibrated(hits: DataFrame, combine: bool = True) -> DataFrame:
    """Crystal records to hits of events: millimetres and keV to cm and MeV, energies scaled to the crystal's total.

    ``hits(coincidence_ts, timestamp, crystal_id, tot_e, sum_e, x, y, z, e, seg)`` one row per interaction point. Points
    without energy are dropped; with ``combine`` points at one place are merged into the first, their energies added.
    """
    a = hits.where("e > 0").select(
        "coincidence_ts", F.col("timestamp").alias("ts"), F.col("crystal_id").alias("crystal_no"), F.col("seg").alias("seg_no"),
        *[(F.col(c) / 10).alias(c) for c in "xyz"], (F.col("e") / 1000 * F.col("tot_e") / F.nullif(F.col("sum_e"), F.lit(0.0))).alias("e"), (F.ln("tot_e") - F.ln("sum_e")).alias("energy_factor"),
        *(["pad"] if "pad" in hits.columns else []),
    ).where("e > 0")
    return merged_collisions(a, ["coincidence_ts"]) if combine else a


def merged_collisions(hits: DataFrame, event: list[str]) -> DataFrame:
    """Hits of an event at exactly one place become one: the earliest, with the sum of the energies."""
    rest = [c for c in hits.columns if c not in (*event, "x", "y", "z", "e")]
    order = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)
    first = F.min(order).alias("_first")
    out = hits.groupBy(*event, "x", "y", "z").agg(F.sum("e").alias("e"), first)
    return out.select(*event, "x", "y", "z", "e", *[F.col(f"_first.{c}").alias(c) for c in rest])
