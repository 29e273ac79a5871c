"""Coincidences of live hits, as stateful Structured Streaming per shard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "shard int, coincidence_ts long, last_ts long, n_hits int, esum double"
STATE = "ts array<long>, e array<double>, newest long"


def folded(ts: list[int], e: list[float], gap: int, anchored: str) -> list[tuple[int, int, int, float]]:
    """Coincidences of hits in time order: (first, last, hits, energy)."""
    out: list[list] = []
    for t, v in sorted(zip(ts, e)):
        ref = out[-1][0 if anchored == "first" else 1] if out else None
        if ref is None or t - ref >= gap:
            out.append([t, t, 0, 0.0])
        out[-1][1] = t
        out[-1][2] += 1
        out[-1][3] += v
    return [tuple(o) for o in out]


def coincidence_stream(hits: DataFrame, gap: int = 40, late: int = 1_000, anchored: str = "first", idle_ms: int | None = None) -> DataFrame:
    """Closed coincidences of ``hits(shard int, ts long, e double)``, in append mode.

    A hit may come up to ``late`` ticks behind the newest of its shard and still finds its place: hits are held until
    the newest is ``late + gap`` past a silence that closes their chain. Later ones are dropped. What is
    held when a shard is idle for ``idle_ms`` of processing time is given out; without it, it waits for more hits. The state is the hits of the open chains, no more.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, e, newest = [], [], None
        if state.exists:
            ts, e, newest = list(state.get[0]), list(state.get[1]), state.get[2]
        flush = state.hasTimedOut
        floor = newest - late if newest is not None else None
        if not flush:
            for pdf in parts:
                for t, v in zip(pdf["ts"], pdf["e"]):
                    if pd.notna(t) and (floor is None or t > floor):
                        ts.append(int(t))
                        e.append(0.0 if pd.isna(v) else float(v))
                        newest = int(t) if newest is None else max(newest, int(t))
        pairs = sorted(zip(ts, e))
        cut = len(pairs) if flush else 0
        if not flush and newest is not None:
            for i in range(1, len(pairs) + 1):  # a silence behind which nothing more may come
                following = pairs[i][0] if i < len(pairs) else newest + late + 1
                if following - pairs[i - 1][0] >= gap and pairs[i - 1][0] + gap <= newest - late:
                    cut = i
        done, held = pairs[:cut], pairs[cut:]
        if flush:
            state.remove()
        else:
            state.update(([t for t, _ in held], [v for _, v in held], newest))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        rows = folded([t for t, _ in done], [v for _, v in done], gap, anchored)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["shard", "coincidence_ts", "last_ts", "n_hits", "esum"])

    return hits.groupBy("shard").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout)


def spectrum_stream(rays: DataFrame, width: float = 0.01, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Energies of rays counted per time window and bin: ``rays(at timestamp, esum double)``."""
    a = rays.where(F.col("esum").isNotNull() & ~F.isnan("esum")).withWatermark("at", late)
    return a.groupBy(F.window("at", window), F.floor(F.col("esum") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
