"""Exact and mergeable percentiles per group by bisection of value intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import drop_table, materialise

DEFAULT = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _rank(n, p):
    """1-based rank of the discrete percentile: the least k with k >= p * n."""
    return F.greatest(F.lit(1), F.ceil(F.col(p) * F.col(n))).cast("long")


def _scale(v):
    """A rising function of a value inside [lo, hi] that makes it about as fine near 0 as far out."""
    far = F.signum(v) * F.log1p(F.abs(v))
    return F.when(F.col("lo") > 0, F.ln(v)).when(F.col("hi") < 0, -F.ln(-v)).otherwise(far)


def _section(sections: int):
    """Which of the sections of [lo, hi] holds ``_v``: by :func:`_scale` if that tells the ends well apart, else by value. lo is in
    the first and hi in the last, so every pass shrinks an interval."""
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("_v")
    wide = _scale(hi) - _scale(lo)
    # Halved before subtracting, so that the full range of doubles doesn't overflow.
    share = F.when(wide > 1e-6, (_scale(v) - _scale(lo)) / wide).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.greatest(F.lit(0), F.least(F.lit(sections - 1), F.floor(share * sections))).cast("int")


def bisect_percentiles(df: DataFrame, keys: list[str], value: str, percentiles=DEFAULT, sections: int = 256, tolerance: float = 0.0, max_passes: int = 64, weight: str | None = None) -> DataFrame:
    """Percentiles of ``value`` per group: ``keys, p, n, lo, hi``; the true percentile lies in [lo, hi].

    For each group and percentile an interval of values is held that contains the target rank. A
    pass cuts every open interval at ``sections - 1`` inner points (2 sections: plain bisection), counts the
    rows below them, and keeps the section that holds the rank, shrunk to the smallest and largest value
    counted in it. The points are equally far apart in the logarithm (:func:`_scale`) while the interval is wide, so that a few
    extreme values cost no passes, then in the value. An interval is resolved when it holds one value, or is no wider than ``tolerance``.
    With tolerance 0 ``lo = hi`` is the exact discrete percentile (the value at rank ceil(p n)). ``weight``: a column of how many rows
    a row stands for, as in a summary; rows of null or no weight are left out.

    The counts are sums, so partitions combine before the shuffle and a group with most of the rows is
    never gathered. A pass joins the rows once with the open intervals, of which there are at most as many as groups times percentiles,
    however many the rows; later passes read only the rows that the pass before found inside. Intervals of
    a group are equal or disjoint, so a row counts in at most one.

    Defined cases: null and NaN values are left out; infinities count as values; null keys form
    groups as in GROUP BY; a group without values has no row; repeated rows count as often as they occur; an empty table gives an
    empty result.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    stands = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(value).cast("double").alias("_v"), stands.cast("long").alias("_m")).where("_v is not null and not isnan(_v) and _m > 0")
    # Infinite values become the largest finite ones for cutting, and are restored at the end.
    big = 1.7976931348623157e308
    rows = rows.withColumn("_v", F.greatest(F.least("_v", F.lit(big)), F.lit(-big)) + F.lit(0.0))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in k], F.lit(True))

    spans = rows.groupBy(*k).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_m").alias("n"))
    state = spans.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))).withColumn("want", _rank("n", "p")).select(*k, "p", "n", "want", "lo", "hi")
    state = materialise(state, "state")
    live = rows
    done: list[DataFrame] = []
    for passes in range(max_passes):
        closed = (F.col("lo") == F.col("hi")) | (F.col("hi") - F.col("lo") <= tolerance)
        done.append(state.where(closed).select(*k, "p", "n", "lo", "hi"))
        state = state.where(~closed)
        if not state.limit(1).count():
            break
        cuts = state.select(*k, "lo", "hi").distinct()
        inside = live.alias("r").join(cuts.alias("c"), same("r", "c") & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*[F.col(f"r.{c}") for c in k], "_v", "_m", "lo", "hi")
        if passes:  # all rows are inside in the first pass
            inside = materialise(inside, "inside")
            if live is not rows:
                drop_table(live)
            live = inside.select(*k, "_v", "_m")
        counts = inside.withColumn("s", _section(sections)).groupBy(*k, "lo", "hi", "s").agg(F.sum("_m").alias("m"), F.min("_v").alias("a"), F.max("_v").alias("b"))
        w = Window.partitionBy(*k, "lo", "hi").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = counts.withColumn("upto", F.sum("m").over(w)).alias("c")
        held = state.alias("t")
        state_next = held.join(
            below, same("t", "c") & (F.col("t.lo") == F.col("c.lo")) & (F.col("t.hi") == F.col("c.hi")) & (F.col("want") <= F.col("upto")) & (F.col("want") > F.col("upto") - F.col("m"))
        ).select(*[F.col(f"t.{c}") for c in k], "p", "n", (F.col("want") - F.col("upto") + F.col("m")).alias("want"), F.col("a").alias("lo"), F.col("b").alias("hi"))
        state = materialise(state_next, "state")
    else:
        done.append(state.select(*k, "p", "n", "lo", "hi"))
    out = reduce(DataFrame.union, done)
    restore = lambda c: F.when(F.col(c) >= big, F.lit(float("inf"))).when(F.col(c) <= -big, F.lit(float("-inf"))).otherwise(F.col(c)).alias(c)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "p", "n", restore("lo"), restore("hi"))


def summarise(df: DataFrame, keys: list[str], part: str, value: str, resolution: float = 0.001) -> DataFrame:
    """Mergeable summary of each part (a day, a partition): ``keys, part, cell, m, lo, hi``.

    The cells are ``floor(value / resolution)``, the same for every part, with the rows counted in
    them and their extremes. Summaries made at different times combine by :func:`merge`.
    Null and NaN values are left out, infinite ones are kept in the outermost cells.
    """
    v = F.col(value).cast("double")
    cell = F.when(F.abs(v) / resolution < 9e18, F.floor(v / resolution)).otherwise(F.when(v > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63) + 1)))
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, part, cell.cast("long").alias("cell"))
        .agg(F.count("*").alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    )


def merge(summary: DataFrame, keys: list[str]) -> DataFrame:
    """One summary for all parts: counts add up, extremes widen."""
    return summary.groupBy(*keys, "cell").agg(F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def summary_percentiles(merged: DataFrame, keys: list[str], percentiles=DEFAULT) -> DataFrame:
    """``keys, p, n, lo, hi`` from a merged summary, by bisection of its cells with their counts; hi - lo is below the summary's resolution."""
    found = bisect_percentiles(merged, keys, "cell", percentiles, weight="m").select(*[F.col(c).alias(f"_{c}") for c in keys], "p", "n", F.col("lo").cast("long").alias("_cell"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], F.col("cell") == F.col("_cell"))
    return merged.join(found, same).select(*keys, "p", "n", "lo", "hi")
