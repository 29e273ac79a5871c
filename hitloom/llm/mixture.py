"""Mixing sources to target weights by capped Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import materialise

#: Bins of the hash-seeded uniform per source; bounds what one task sees of a source.
BINS = 1 << 16


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k = 0 .. cap - 1 of a Poisson variable with mean ``rate``."""
    if rate == math.inf:
        return [0.0] * cap
    steps, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        steps.append(min(1.0, total))
    return steps


def _solve(u: np.ndarray, tokens: np.ndarray, want: float, cap: int) -> float:
    """The mean rate at which the replicated tokens come closest to ``want``.

    The uniforms are fixed, so each record's count is a step function of the rate that never
    falls, and so is the total: bisection finds the step that crosses ``want``.
    """

    def total(rate: float) -> float:
        return float(sum(tokens[u >= s].sum() for s in poisson_steps(rate, cap)))

    if want <= 0 or not len(u):
        return 0.0
    lo, hi = 0.0, 1.0
    while total(hi) < want and hi < 1e4:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        if not lo < mid < hi:
            break
        if total(mid) < want:
            lo = mid
        else:
            hi = mid
    return hi if abs(total(hi) - want) <= abs(total(lo) - want) else lo


def mixture_plan(sized: DataFrame, targets: DataFrame, fill: float = 0.95, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """One row per source that has a target: shares wanted, tokens there, the rate and its count thresholds.

    ``sized(id, source, n_tokens)``. Without ``total_tokens`` the mix is ``fill`` times the largest in
    which every source with text reaches its share within its cap. Where ``total_tokens`` asks more of a source than its cap
    allows, that source gives all it may. Shares of listed sources without any text can't be
    met; the others keep their proportions to each other.

    Work per source is bounded: records are first summed into ``BINS`` bins of their uniform.
    """
    want = targets.select(F.col("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(1))).alias("cap")).where("source is not null and target_share > 0").dropDuplicates(["source"])
    bins = (
        sized.where("n_tokens > 0")
        .select("source", "n_tokens", F.floor(uniform("id", seed) * BINS).cast("int").alias("bin"))
        .groupBy("source", "bin")
        .agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    )
    bins = materialise(bins, "bins")
    there = bins.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n_docs"))
    sources = want.join(there, "source", "left").select("source", "target_share", "cap", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
    # One small window over the listed sources.
    w = Window.partitionBy(F.lit("listed"))
    ok = (F.col("tokens") > 0) & (F.col("cap") > 0)
    reached = F.sum(F.when(ok, F.col("target_share"))).over(w)
    if total_tokens is None:
        total = F.min(F.when(ok, F.col("cap") * F.col("tokens") / F.col("target_share"))).over(w) * reached * fill
    else:
        total = F.lit(float(total_tokens))
    sources = sources.withColumn("want_tokens", F.when(ok, F.col("target_share") / reached * total).otherwise(F.lit(0.0)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        has = pdf.dropna(subset=["bin"])
        u = (has["bin"].to_numpy(float) + 0.5) / BINS
        rate = _solve(u, has["bin_tokens"].to_numpy(float), float(row["want_tokens"]), int(row["cap"]))
        return pd.DataFrame({"source": [row["source"]], "rate": [rate], "steps": [poisson_steps(rate, int(row["cap"]))]})

    rates = sources.join(bins.select("source", "bin", F.col("tokens").alias("bin_tokens")), "source", "left").groupBy("source").applyInPandas(solve, "source string, rate double, steps array<double>")
    return sources.select("source", "target_share", "cap", "tokens", "n_docs", "want_tokens").join(rates, "source")


def uniform(doc: str, seed: int):
    """A uniform in [0, 1) from the hash of the record's id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc)), 11) / F.lit(float(1 << 53))


def mix(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """The mix in a global random order: ``id, source, n_tokens, copy_no, position_key``.

    A record's count is the inverse of the Poisson distribution of its source's rate at the
    record's hash-seeded uniform, at most the source's cap. The uniform is taken at its bin's middle, as in the plan, so that what the
    plan solved for is what comes out. The shuffle sorts by a hash of (record, copy)
    over range partitions: a new order for each seed, the same for a given one.

    Records with null source, without target, or with no tokens aren't used. Equal ids share their draw.
    """
    u = (F.floor(uniform("id", seed) * BINS) + 0.5) / BINS
    n = F.size(F.filter("steps", lambda s: u >= s))
    copies = (
        sized.where("n_tokens > 0")
        .join(plan.select("source", "steps"), "source")
        .withColumn("n", n)
        .where("n > 0")
        .select("id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
        .withColumn("position_key", F.xxhash64(F.lit(seed + 1), "id", "copy_no"))
    )
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(parts, "position_key").sortWithinPartitions("position_key", "id", "copy_no")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and reached share of every listed source, with the tokens and repeats behind them."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_docs"), F.max("copy_no").alias("most_repeats"))
    rows = plan.select("source", "target_share", "cap", "tokens", "n_docs").join(got, "source", "left")
    rows = rows.select("source", "target_share", "cap", "tokens", "n_docs", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mixed_tokens", "mixed_docs", "most_repeats")])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit("listed")))
    return rows.withColumn("reached_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
