"""Activity sessions per source by a sweep over interval deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Ticks in one sweep cell, as a power of two (2**26 ticks of 10 ns are 0.67 s).
CELL_BITS = 26


def session_marks(hits: DataFrame, gap: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """Swept deltas of ``hits(_s, _t)``: ``_s, t, up, level, start`` per source and time.

    ``start`` is the start of the session that is open at ``t``; ``up`` hits begin there; ``level`` intervals are
    open after it, so 0 closes the session.
    """
    end = F.coalesce(F.try_add(F.col("_t"), F.lit(gap)), F.lit(2**63 - 1))
    deltas = (
        hits.select(
            "_s",
            F.explode(
                F.array(
                    F.struct(F.col("_t").alias("t"), F.lit(1).cast("long").alias("up"), F.lit(0).cast("long").alias("dn")),
                    F.struct(end.alias("t"), F.lit(0).cast("long").alias("up"), F.lit(1).cast("long").alias("dn")),
                )
            ).alias("d"),
        )
        .groupBy("_s", F.col("d.t").alias("t"))
        .agg(F.sum("d.up").alias("up"), F.sum("d.dn").alias("dn"))
        .withColumn("cell", F.shiftright("t", cell_bits))
    )
    within = Window.partitionBy("_s", "cell").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)

    swept = deltas.withColumn("run", F.sum(F.col("up") - F.col("dn")).over(within))
    offsets = (
        deltas.groupBy("_s", "cell")
        .agg(F.sum(F.col("up") - F.col("dn")).alias("net"))
        .select("_s", "cell", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("off"))
    )
    level = swept.join(offsets, ["_s", "cell"]).withColumn("level", F.col("run") + F.col("off"))
    # Before the deltas of this instant the level was level - up + dn; starts come before ends.
    level = level.withColumn("opens", F.when((F.col("level") - F.col("up") + F.col("dn") == 0) & (F.col("up") > 0), F.col("t")))
    opened = (
        level.groupBy("_s", "cell")
        .agg(F.max("opens").alias("m"))
        .select("_s", "cell", F.max("m").over(before).alias("earlier"))
    )
    return (
        level.withColumn("here", F.max("opens").over(within))
        .join(opened, ["_s", "cell"])
        .select("_s", "t", "up", "level", F.coalesce("here", "earlier").alias("start"))
    )

def session_starts(df: DataFrame, source: str, ts: str, gap: int, cell_bits: int = CELL_BITS) -> DataFrame:
    """``source, ts, start_ts`` for every distinct (source, ts) that isn't null."""
    hits = df.select(F.col(source).alias("_s"), F.col(ts).cast("long").alias("_t")).where("_s is not null and _t is not null")
    return session_marks(hits, gap, cell_bits).where("up > 0").select(F.col("_s").alias(source), F.col("t").alias(ts), F.col("start").alias("start_ts"))


def sessionize(
    df: DataFrame,
    source: str = "crystal_no",
    ts: str = "ts",
    event: str = "event_id",
    gap: int = 200_000,
    cell_bits: int = CELL_BITS,
) -> DataFrame:
    """Sessions of each source: ``source, start_ts, end_ts, duration, n_events, n_hits``.

    Each hit opens an interval ``[ts, ts + gap]``: a delta of +1 at its start and -1 at its end.
    A session is open while the running sum of deltas is above zero and is closed by the crossing
    back to zero, so hits exactly ``gap`` apart share a session.

    The sweep is split into cells of ``2**cell_bits`` ticks per source. Deltas are first summed per
    ``(source, time)``, which bounds a cell at ``2**cell_bits`` rows however many hits fall in it and
    lets a source with most of the rows spread over all tasks. Cell totals are prefix-summed in a
    second, small window and added back, so no task ever holds a whole source.

    Defined cases: rows with null source or ts are ignored; a null event counts in ``n_hits`` but not in
    ``n_events``; repeated rows add to ``n_hits`` only; equal times belong together; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    hits = df.select(
        F.col(source).alias("_s"), F.col(ts).cast("long").alias("_t"), F.col(event).alias("_e")
    ).where("_s is not null and _t is not null")
    marked = session_marks(hits, gap, cell_bits)
    spans = marked.groupBy("_s", "start").agg(
        F.max(F.when(F.col("level") == 0, F.col("t"))).alias("closed"),
        F.max(F.when(F.col("up") > 0, F.col("t"))).alias("last"),
        F.sum("up").alias("n_hits"),
    )
    starts = marked.where("up > 0").select("_s", F.col("t").alias("_t"), "start")
    counts = (
        hits.where("_e is not null")
        .join(starts, ["_s", "_t"])
        .groupBy("_s", "start", "_e")
        .agg(F.lit(1).alias("one"))
        .groupBy("_s", "start")
        .agg(F.count("*").alias("n_events"))
    )
    # The zero crossing lies one gap after the last hit; only a saturated time differs.
    end_ts = F.when(F.col("closed") < 2**63 - 1, F.col("closed") - gap).otherwise(F.col("last"))
    return spans.join(counts, ["_s", "start"], "left").select(
        F.col("_s").alias(source),
        F.col("start").alias("start_ts"),
        end_ts.alias("end_ts"),
        (end_ts - F.col("start")).alias("duration"),
        F.coalesce("n_events", F.lit(0)).alias("n_events"),
        "n_hits",
    )
