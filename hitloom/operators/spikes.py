"""Implausible readings of hits: isolation forests per source, stuck runs and physical limits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import drop_table, materialise

#: Ticks of 10 ns in a day.
DAY = 8_640_000_000_000
#: Width of a cell of log energy in the level statistics.
CELL = 0.01
FEATURES = ("level", "difference", "seasonal", "run_e")
#: Features are cut off at so many spreads from normal; the forest's boxes reach as far.
REACH = 12.0
#: Hits that the all-time median counts as in a day's own median.
PULL = 20.0
#: Hits that one task of the sorted pass takes.
ROWS = 1_000_000
#: Width of a bin of scores, and the least middle of the empty stretch that may part spikes off.
BIN = 0.005
FLOOR = 0.45


def _middle(counts: DataFrame, keys: list[str], cell: str, out: str) -> DataFrame:
    """``keys, out, n``: the weighted median of ``cell`` (counts in ``n``) per key, in windows over the counts."""
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("_u", F.sum("n").over(w.orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum("n").over(w))
    return upto.where(2 * F.col("_u") >= F.col("_n")).groupBy(*keys).agg(F.min(cell).alias(out), F.max("_n").alias("n"))


def _levels(cells: DataFrame) -> DataFrame:
    """Normal behaviour from counts ``crystal_no, day, cell, n`` of log energy: ``crystal_no, day, med, med_all, sigma, n``.

    The median of a day is drawn toward that of all days by ``PULL`` hits' weight, so a day of few hits follows the
    crystal and one of many its own gain. ``day`` is null in the crystal's own row. ``sigma`` is the spread of what is left
    after the days' medians. All steps are windows over counts; their size grows with the days, not with the hits.
    """
    mid = lambda c: (F.col(c) + 0.5) * CELL
    whole = _middle(cells.groupBy("crystal_no", "cell").agg(F.sum("n").alias("n")), ["crystal_no"], "cell", "m").select("crystal_no", mid("m").alias("med_all"), F.col("n").alias("n_all"))
    daily = _middle(cells.where("day is not null"), ["crystal_no", "day"], "cell", "m").join(whole, "crystal_no").select("crystal_no", "day", ((F.col("n") * mid("m") + PULL * F.col("med_all")) / (F.col("n") + PULL)).alias("med"))
    left = cells.join(whole, "crystal_no").join(daily, ["crystal_no", "day"], "left").withColumn("away", F.floor(F.abs(mid("cell") - F.coalesce("med", "med_all")) / CELL))
    spread = _middle(left.groupBy("crystal_no", "away").agg(F.sum("n").alias("n")), ["crystal_no"], "away", "m").select("crystal_no", F.greatest(F.lit(CELL), 1.4826 * mid("m")).alias("sigma"))
    own = whole.join(spread, "crystal_no")
    days = daily.join(own, "crystal_no").select("crystal_no", "day", "med", "med_all", "sigma", "n_all")
    return days.unionByName(own.select("crystal_no", F.lit(None).cast("long").alias("day"), F.lit(None).cast("double").alias("med"), "med_all", "sigma", "n_all")).withColumnRenamed("n_all", "n")


def _runs(part: np.ndarray, vals: list[np.ndarray], ok: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Runs of values that stay within ``tol`` from hit to hit, per part (crystal), over rows that are ``ok``.

    Returns for all rows the run length and whether the row's run is the first (1), last (2) or only (3)
    one of its part here, and for these runs (part, place, length, first values, last values).
    """
    n = len(part)
    length, end, ends = np.ones(n, np.int64), np.zeros(n, np.int8), []
    idx = np.flatnonzero(ok)
    if not len(idx):
        return length, end, ends
    p = part[idx]
    v = [a[idx] for a in vals]
    new_part = np.r_[True, p[1:] != p[:-1]]
    step = np.zeros(len(idx), bool)
    for a in v:
        step[1:] |= ~(np.abs(a[1:] - a[:-1]) <= tol)
    brk = new_part | step
    run = np.cumsum(brk) - 1
    first = np.flatnonzero(brk)
    last = np.r_[first[1:] - 1, len(idx) - 1]
    size = last - first + 1
    length[idx] = size[run]
    head = new_part[first]
    tail = np.r_[head[1:], True]
    place = head * 1 + tail * 2
    end[idx] = place[run]
    for j in np.flatnonzero(place):
        ends.append((int(p[first[j]]), int(place[j]), int(size[j]), [float(a[first[j]]) for a in v], [float(a[last[j]]) for a in v]))
    return length, end, ends


def _features(tol_e: float, tol_x: float, centres: np.ndarray, reach: float):
    """One range partition of hits, sorted by (crystal_no, ts, event_id, point_idx), to feature rows and the runs at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        blk = TaskContext.get().partitionId()
        get = lambda c: t.column(c).to_numpy()
        crystal, event, point = get("crystal_no"), get("event_id"), get("point_idx")
        x, y, z, e = (get(c).astype(float) for c in ("x", "y", "z", "e"))
        timed = t.column("ts").is_valid().to_numpy()
        level, seasonal, flag = get("level").astype(float), get("seasonal").astype(float), get("flag")
        flag = flag.copy()
        lost = np.flatnonzero(flag & 2)
        for s in range(0, len(lost), 10_000):
            q = lost[s : s + 10_000]
            d2 = (x[q, None] - centres[:, 0]) ** 2 + (y[q, None] - centres[:, 1]) ** 2 + (z[q, None] - centres[:, 2]) ** 2
            flag[q[(d2 <= reach * reach).any(1)]] |= 4
        has_e = timed & ~np.isnan(e)
        run_e, end_e, ends_e = _runs(crystal, [e], has_e, tol_e)
        run_x, end_x, ends_x = _runs(crystal, [x, y, z], timed & ~np.isnan(x + y + z), tol_x)
        diff = np.zeros(len(e))
        i = np.flatnonzero(has_e & ~np.isnan(seasonal))
        if len(i):
            # The least of the steps to two neighbours on either side: a spike leaves all of them, a normal reading beside it doesn't.
            v, c = seasonal[i], crystal[i]
            steps = np.full((4, len(i)), np.inf)
            for j, k in enumerate((1, 2)):
                same = c[k:] == c[:-k]
                steps[2 * j, k:][same] = (v[k:] - v[:-k])[same]
                steps[2 * j + 1, :-k][same] = (v[:-k] - v[k:])[same]
            least = steps[np.abs(steps).argmin(0), np.arange(len(i))]
            diff[i] = np.where(np.isfinite(least), least, 0.0)
        n, m = len(e), len(ends_e) + len(ends_x)
        none = pa.nulls(n, pa.float64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(n, np.int8)), pa.array(crystal.astype(np.int32)), pa.array(np.full(n, blk, np.int32)), pa.array(event), pa.array(point.astype(np.int32)), pa.array(flag.astype(np.int8)),
                pa.array(level.astype(np.float32)), pa.array(seasonal.astype(np.float32)), pa.array(diff.astype(np.float32)), pa.array(run_e), pa.array(run_x), pa.array(end_e), pa.array(end_x),
                pa.nulls(n, pa.int8()), none, none, none, none, none, none,
            ],
            names=_COLUMNS,
        )
        if m:
            rows = [(0, *r) for r in ends_e] + [(1, *r) for r in ends_x]
            pad = lambda a: (list(a) + [0.0, 0.0])[:3]
            cols = {c: pa.nulls(m, ty) for c, ty in _TYPES.items()}
            cols |= {
                "kind": pa.array(np.ones(m, np.int8)), "blk": pa.array(np.full(m, blk, np.int32)), "field": pa.array([r[0] for r in rows], pa.int8()), "crystal_no": pa.array([r[1] for r in rows], pa.int32()),
                "end_e": pa.array([r[2] for r in rows], pa.int8()), "run_e": pa.array([r[3] for r in rows], pa.int64()),
            }
            for j, (a, b) in enumerate((("fx", "lx"), ("fy", "ly"), ("fz", "lz"))):
                cols[a] = pa.array([pad(r[4])[j] for r in rows], pa.float64())
                cols[b] = pa.array([pad(r[5])[j] for r in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([cols[c] for c in _COLUMNS], names=_COLUMNS)

    return run


_TYPES = {
    "kind": pa.int8(), "crystal_no": pa.int32(), "blk": pa.int32(), "event_id": pa.int64(), "point_idx": pa.int32(), "flag": pa.int8(), "level": pa.float32(), "seasonal": pa.float32(), "difference": pa.float32(),
    "run_e": pa.int64(), "run_x": pa.int64(), "end_e": pa.int8(), "end_x": pa.int8(), "field": pa.int8(), "fx": pa.float64(), "fy": pa.float64(), "fz": pa.float64(), "lx": pa.float64(), "ly": pa.float64(), "lz": pa.float64(),
}
_COLUMNS = list(_TYPES)


def _stitched(ends: DataFrame, tol_e: float, tol_x: float) -> DataFrame:
    """Whole lengths of runs that go on over partitions: ``crystal_no, field, blk, place, whole``."""
    tol = F.when(F.col("field") == 0, F.lit(tol_e)).otherwise(F.lit(tol_x))
    w = Window.partitionBy("crystal_no", "field").orderBy("blk", "end_e")
    near = F.lit(True)
    for a, b in (("fx", "lx"), ("fy", "ly"), ("fz", "lz")):
        near = near & (F.abs(F.col(a) - F.lag(b).over(w)) <= tol)
    joined = (F.lag("blk").over(w) != F.col("blk")) & near
    runs = ends.withColumn("j", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("r", F.sum("j").over(w))
    whole = F.sum("run_e").over(Window.partitionBy("crystal_no", "field", "r"))
    return runs.select("crystal_no", "field", "blk", F.col("end_e").alias("place"), whole.alias("whole"))


# --- isolation forest -------------------------------------------------------------------------


def _c(n) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def fit_forest(data: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, sample: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isolation trees in heap order: split feature (-1: leaf), split value, and depth at a leaf.

    Each tree takes its own subsample and splits at a uniform place between its smallest and largest
    values, widened to ``low`` and ``high``: so a feature that is constant in normal data still parts off
    readings that leave that constant.
    """
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    nodes = 2 ** (depth + 1) - 1
    feat = np.full((trees, nodes), -1, np.int8)
    cut = np.zeros((trees, nodes), np.float32)
    path = np.zeros((trees, nodes), np.float32)
    for t in range(trees):
        own = data[rng.permutation(len(data))[:sample]]
        todo = [(0, np.arange(len(own)), np.minimum(own.min(0), low), np.maximum(own.max(0), high), 0)]
        while todo:
            i, rows, a, b, d = todo.pop()
            if d == depth or len(rows) <= 1:
                path[t, i] = d + _c(max(1, len(rows)))
                continue
            wide = np.flatnonzero(b > a)
            if not len(wide):
                path[t, i] = d + _c(len(rows))
                continue
            f = int(rng.choice(wide))
            s = float(rng.uniform(a[f], b[f]))
            feat[t, i], cut[t, i] = f, s
            left = own[rows, f] < np.float32(s)
            for child, take, is_left in ((2 * i + 1, rows[left], True), (2 * i + 2, rows[~left], False)):
                # Below the root the box is that of the rows inside, cut at the split.
                na, nb = (own[take].min(0), own[take].max(0)) if len(take) else (a.copy(), b.copy())
                na, nb = np.maximum(a, np.minimum(na, low)), np.minimum(b, np.maximum(nb, high))
                (nb if is_left else na)[f] = s
                todo.append((child, take, na, nb, d + 1))
    return feat, cut, path


def score_forest(data: np.ndarray, feat: np.ndarray, cut: np.ndarray, path: np.ndarray, sample: int) -> np.ndarray:
    """Anomaly score in (0, 1] of every row; near 1 where it is parted off after few splits."""
    total = np.zeros(len(data))
    flat = np.ascontiguousarray(data, np.float32).ravel()
    base = np.arange(len(data)) * data.shape[1]
    for t in range(len(feat)):
        f, c, p = feat[t], cut[t], path[t]
        at = np.zeros(len(data), np.int32)
        live = np.arange(len(data))
        node = at
        while True:
            fn = f[node]
            inner = fn >= 0
            if not inner.all():
                out = ~inner
                total[live[out]] += p[node[out]]
                live, node, fn = live[inner], node[inner], fn[inner]
                if not len(live):
                    break
            node = 2 * node + 1 + (flat[base[live] + fn] >= c[node])
    return np.exp2(-total / len(feat) / max(_c(sample), 1e-9))


def _matrix(pdf: pd.DataFrame, stuck: int) -> np.ndarray:
    """Features of readings; what isn't there is at its normal value, and so are runs that are too short to be stuck."""
    a = np.empty((len(pdf), len(FEATURES)), np.float32)
    for j, c in enumerate(FEATURES[:3]):
        a[:, j] = np.clip(np.nan_to_num(pdf[c].to_numpy(float), nan=0.0), -REACH, REACH)
    run = pdf["run_e"].to_numpy(float)
    a[:, 3] = np.where(run >= stuck, np.minimum(np.log2(run), REACH), 0.0)
    return a


_MODEL = "crystal_no int, feat binary, cut binary, path binary, size int, top double"


def _train(trees: int, sample: int, most: int, stuck: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "event_id", "point_idx"]).head(most)
        data = _matrix(pdf, stuck)
        size = min(sample, max(2, len(data) // 2))
        far = np.array([REACH, REACH, REACH, REACH], np.float32)
        feat, cut, path = fit_forest(data, -far * np.array([1, 1, 1, 0], np.float32), far, trees, size, np.random.default_rng([seed, abs(int(pdf["crystal_no"].iloc[0]))]))
        # What a reading scores that lies beyond everything, on the side where that is less.
        ends = np.array([[REACH, REACH, REACH, 0], [-REACH, -REACH, -REACH, 0]], np.float32)
        top = float(score_forest(ends, feat, cut, path, size).min())
        return pd.DataFrame({"crystal_no": [pdf["crystal_no"].iloc[0]], "feat": [feat.tobytes()], "cut": [cut.tobytes()], "path": [path.tobytes()], "size": [size], "top": [top]})

    return run


def _score(trees: int, stuck: int):
    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = rows[["event_id", "point_idx", "crystal_no", "flag", "run_e", "run_x"]].copy()
        out["score"], out["plain"], out["top"], out["judged"] = 0.0, 0.0, 1.0, False
        if len(model) and len(rows):
            m = model.iloc[0]
            shape = (trees, -1)
            forest = np.frombuffer(m["feat"], np.int8).reshape(shape), np.frombuffer(m["cut"], np.float32).reshape(shape), np.frombuffer(m["path"], np.float32).reshape(shape), int(m["size"])
            data = _matrix(rows, stuck)
            out["score"] = score_forest(data, *forest)
            out["plain"] = out["score"]
            runs = np.flatnonzero(data[:, 3] > 0)
            if len(runs):  # what the reading would score outside its run: a stuck one need not be a spike
                data[runs, 3] = 0
                plain = out["plain"].to_numpy().copy()
                plain[runs] = score_forest(data[runs], *forest)
                out["plain"] = plain
            out["top"] = float(m["top"])
            # The energy of a hit in another crystal isn't judged, and doesn't count for the bar.
            out["judged"] = rows["level"].notna() & (rows["flag"] & 4 == 0)
        return out

    return run


def score_bars(scored: DataFrame) -> DataFrame:
    """``crystal_no, bar``: the score above which a reading of the crystal is a spike.

    Scores are counted in bins per crystal, over all its readings. Normal readings fill the bins from the middle
    outward; the bar is the middle of the widest empty stretch above the median bin, up to what a reading beyond
    everything scores, whose middle is at least ``FLOOR``. Nothing depends on how many readings are spikes.
    """
    bins = scored.where("judged").groupBy("crystal_no", F.floor(F.least("plain", "top") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.max("top").alias("top"))
    w = Window.partitionBy("crystal_no")
    mid = _middle(bins, ["crystal_no"], "bin", "mid").select("crystal_no", "mid")
    end = bins.groupBy("crystal_no").agg((F.floor(F.max("top") / BIN)).alias("bin"))
    marks = bins.select("crystal_no", "bin").unionByName(end).distinct().join(mid, "crystal_no").where("bin >= mid")
    gaps = marks.withColumn("nxt", F.lead("bin").over(w.orderBy("bin"))).withColumn("at", (F.col("bin") + 1 + F.col("nxt")) / 2 * BIN).where(F.col("at") >= FLOOR)
    widest = gaps.groupBy("crystal_no").agg(F.max_by("at", F.struct(F.col("nxt") - F.col("bin"), -F.col("bin"))).alias("bar"))
    return widest


def scored_readings(
    hits: DataFrame,
    crystals: DataFrame,
    reach: float = 4.2,
    max_energy: float = 1_000.0,
    tol_e: float = 5e-6,
    tol_x: float = 5e-4,
    stuck: int = 5,
    trees: int = 100,
    sample: int = 256,
    train_rows: int = 2_048,
    rows_per_task: int = ROWS,
    seed: int = 5,
) -> DataFrame:
    """Every distinct hit of a known crystal with its anomaly score, run lengths and rule flags.

    ``event_id, point_idx, crystal_no, flag, run_e, run_x, score, plain, judged, bar``; flag bits: 1 energy
    impossible, 2 position outside the named crystal, 4 position inside another one. ``plain`` is the score
    without the run-length feature; a judged reading is a spike where ``plain`` reaches its crystal's ``bar``.

    1. Level statistics: counts of (crystal, day, cell of log e) over all hits, one mergeable table, give each
       crystal's medians by day (gains may change between days) and spread.
    2. Hits are range-partitioned by (crystal, ts, event, point) into as many parts as their number asks for, which
       splits a crystal with most of the rows. One sorted pass computes differences and lengths of stuck runs; the
       runs at the ends of partitions are stitched in a small table.
    3. An isolation forest per crystal is fitted on at most ``train_rows`` of its hits (those of least
       hash) on level, difference, seasonal level and run length, and scores every hit, in groups of (crystal, partition).
    4. The bar comes from the counts of all scores of the crystal (:func:`score_bars`).
    """
    spark = hits.sparkSession
    names = ["event_id", "point_idx", "x", "y", "z", "e", "ts", "crystal_no"]
    number = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    raw = hits.where("event_id is not null and point_idx is not null").select("event_id", "point_idx", *[number(c).alias(c) for c in "xyze"], F.col("ts").cast("long").alias("ts"), F.col("crystal_no").cast("int").alias("crystal_no")).select(*names)
    known = crystals.select(F.col("crystal_no").cast("int").alias("crystal_no"), "cx", "cy", "cz").where("crystal_no is not null").dropDuplicates(["crystal_no"])
    rows = known.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 crystals")
    centres = np.array([[r["cx"], r["cy"], r["cz"]] for r in rows if None not in (r["cx"], r["cy"], r["cz"])], float).reshape(-1, 3)

    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    placed = raw.join(known, "crystal_no").withColumn("away", F.coalesce(d2 > reach * reach, F.lit(False))).drop("cx", "cy", "cz")
    impossible = F.coalesce((F.col("e") <= 0) | (F.col("e") >= max_energy), F.lit(False))
    le = F.when(~impossible, F.ln(F.when(F.col("e") > 0, F.col("e"))))
    day = F.expr(f"ts div {DAY}").alias("day")
    cells = placed.where(~F.col("away") & ~impossible & F.col("e").isNotNull()).groupBy("crystal_no", day, F.floor(le / CELL).alias("cell")).agg(F.count("*").alias("n"))
    cells = materialise(cells, "cells")
    levels = materialise(_levels(cells), "levels")
    drop_table(cells)

    whole = levels.where("day is null").drop("day", "med")
    daily = levels.where("day is not null").select("crystal_no", "day", "med")
    leveled = (
        placed.withColumn("day", day)
        .join(whole, "crystal_no", "left")
        .join(daily, ["crystal_no", "day"], "left")
        .select(
            "crystal_no", "ts", "event_id", "point_idx", "x", "y", "z", "e",
            ((le - F.col("med_all")) / F.col("sigma")).cast("float").alias("level"), ((le - F.coalesce("med", "med_all")) / F.col("sigma")).cast("float").alias("seasonal"),
            (F.when(impossible, 1).otherwise(0) + F.when(F.col("away"), 2).otherwise(0)).cast("tinyint").alias("flag"),
        )
    )
    total = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rows_per_task))
    order = ["crystal_no", "ts", "event_id", "point_idx", "e", "x", "y", "z"]
    schema = ", ".join(f"{c} {_SQL[t]}" for c, t in _TYPES.items())
    # Copies of a hit are folded where they lie, before they could meet in one partition.
    feats = leveled.distinct().repartitionByRange(parts, *order[:4]).sortWithinPartitions(*order).mapInArrow(_features(tol_e, tol_x, centres, reach), schema)
    feats = materialise(feats, "features")
    ends = _stitched(feats.where("kind = 1").select("crystal_no", "field", "blk", "end_e", "run_e", "fx", "fy", "fz", "lx", "ly", "lz"), tol_e, tol_x)
    # Only runs that grew have to be written back.
    grown = lambda f, place, out: ends.where(F.col("field") == f).select("crystal_no", "blk", F.col("place").alias(place), F.col("whole").alias(out))
    own = feats.where("kind = 0").select("crystal_no", "blk", "event_id", "point_idx", "flag", "level", "seasonal", "difference", "run_e", "run_x", "end_e", "end_x")
    full = (
        own.join(grown(0, "end_e", "we"), ["crystal_no", "blk", "end_e"], "left")
        .join(grown(1, "end_x", "wx"), ["crystal_no", "blk", "end_x"], "left")
        .select("crystal_no", "blk", "event_id", "point_idx", "flag", "level", "seasonal", "difference", F.coalesce("we", "run_e").alias("run_e"), F.coalesce("wx", "run_x").alias("run_x"))
    )
    h = F.pmod(F.xxhash64(F.lit(seed), "event_id", "point_idx"), F.lit(1 << 32))
    drawn = own.where("level is not null").withColumn("h", h).join(whole.select("crystal_no", "n"), "crystal_no").where(F.col("h") * F.col("n") < F.lit(2.0 * train_rows * (1 << 32))).drop("n")
    models = materialise(drawn.groupBy("crystal_no").applyInPandas(_train(trees, sample, train_rows, stuck, seed), _MODEL), "forests")
    blocks = materialise(own.select("crystal_no", "blk").distinct(), "blocks")
    wanted = blocks.join(models, "crystal_no").toDF("source", "block", *[c.split()[0] for c in _MODEL.split(", ")[1:]])
    scored = (
        full.groupBy("crystal_no", "blk")
        .cogroup(wanted.groupBy("source", "block"))
        .applyInPandas(_score(trees, stuck), "event_id long, point_idx int, crystal_no int, flag tinyint, run_e long, run_x long, score float, plain float, top float, judged boolean")
    )
    scored = materialise(scored, "scored")
    for t in (levels, feats, models, blocks):
        drop_table(t)
    return scored.join(score_bars(scored), "crystal_no", "left").drop("top")


_SQL = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double"}


def implausible_readings(hits: DataFrame, crystals: DataFrame, stuck: int = 5, **kw) -> DataFrame:
    """``event_id, point_idx, field, reason, score``: one row per implausible reading and reason.

    field 'e': impossible energies; energies that the crystal's forest sets apart from its other readings; stuck energies: ``stuck`` or more successive hits (by ts, event_id, point_idx)
    with the same reading apart from the last digit. field 'x': positions inside no crystal, and stuck ones. field
    'crystal_no': unknown numbers, and positions inside another crystal; then neither e nor x is judged.

    Null and NaN readings are no cases and don't interrupt a run; hits without ts are in no run; hits of null
    or unknown crystals aren't judged on e and x; rows without event_id or point_idx name no hit and are left out. Repeated rows count once; an empty table gives an empty result; further columns
    are ignored.
    """
    known = crystals.select(F.col("crystal_no").cast("int").alias("crystal_no")).where("crystal_no is not null").distinct()
    foreign = hits.where("event_id is not null and point_idx is not null").select("event_id", "point_idx", F.col("crystal_no").cast("int").alias("crystal_no")).where("crystal_no is not null").join(known, "crystal_no", "left_anti").distinct()
    scored = scored_readings(hits, crystals, stuck=stuck, **kw)
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    here = ~bit(4)
    case = lambda field, reason: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"))
    reasons = F.array_compact(
        F.array(
            F.when(bit(4), case("crystal_no", "inside another crystal")),
            F.when(here & bit(2), case("x", "outside all crystals")),
            F.when(here & (F.col("run_x") >= stuck), case("x", "stuck")),
            F.when(here & bit(1), case("e", "impossible energy")),
            F.when(here & (F.col("run_e") >= stuck), case("e", "stuck")),
            F.when(F.col("judged") & (F.col("plain") >= F.col("bar")), case("e", "spike")),
        )
    )
    cases = scored.select("event_id", "point_idx", F.col("score").cast("double").alias("score"), F.explode(reasons).alias("r")).select("event_id", "point_idx", "r.field", "r.reason", "score")
    return cases.unionByName(foreign.select("event_id", "point_idx", F.lit("crystal_no").alias("field"), F.lit("unknown crystal").alias("reason"), F.lit(1.0).alias("score")))
