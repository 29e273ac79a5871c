"""Comparison of clusterings, and spectra. All from counts of overlaps, never from pairs of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def overlaps(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """``event_id, p, t, n``: hits that a predicted and a true cluster of an event share. Repeated rows count once."""
    p = predicted.select("event_id", "point_idx", F.col("cluster_id").alias("p")).distinct()
    t = true.select("event_id", "point_idx", F.col("cluster_id").alias("t")).distinct()
    return p.join(t, ["event_id", "point_idx"]).groupBy("event_id", "p", "t").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(ov: DataFrame) -> DataFrame:
    """Per event: pairs of hits together in both (tp), only predicted (fp), only true (fn), in neither (tn), and
    precision, recall, Rand and Jaccard index. Without positive pairs precision and recall are 1."""
    two = lambda c: c * (c - 1) / 2
    both = ov.groupBy("event_id").agg(F.sum(two(F.col("n"))).alias("tp"), F.sum("n").alias("hits"))
    side = lambda c: ov.groupBy("event_id", c).agg(F.sum("n").alias("m")).groupBy("event_id").agg(F.sum(two(F.col("m"))).alias(f"pairs_{c}"))
    a = both.join(side("p"), "event_id").join(side("t"), "event_id")
    a = a.select("event_id", "tp", (F.col("pairs_p") - F.col("tp")).alias("fp"), (F.col("pairs_t") - F.col("tp")).alias("fn"), (two(F.col("hits")) - F.col("pairs_p") - F.col("pairs_t") + F.col("tp")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda x, y: F.when(y == 0, 1.0).otherwise(x / F.nullif(y, F.lit(0.0)))
    return a.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "rand_index": share(tp + tn, tp + fp + fn + tn), "jaccard": share(tp, tp + fp + fn)})


def purity(ov: DataFrame) -> DataFrame:
    """Per event the share of hits in the best-matching true cluster of their predicted one."""
    best = ov.groupBy("event_id", "p").agg(F.max("n").alias("best"), F.sum("n").alias("m"))
    return best.groupBy("event_id").agg((F.sum("best") / F.sum("m")).alias("purity"), F.sum("best").alias("matched"), F.sum("m").alias("hits"))


def mismatches(ov: DataFrame) -> DataFrame:
    """``event_id, p, best_t, mismatch``: the true cluster that differs from a predicted one in fewest hits, and in how many.

    Clusters that share no hit can be nearest only if they are smaller than the difference; they
    are considered as the smallest true cluster of the event. Ties go to the smaller number.
    """
    sp = ov.groupBy("event_id", "p").agg(F.sum("n").alias("sp"))
    st = ov.groupBy("event_id", "t").agg(F.sum("n").alias("st"))
    shared = ov.join(sp, ["event_id", "p"]).join(st, ["event_id", "t"]).select("event_id", "p", "t", (F.col("sp") + F.col("st") - 2 * F.col("n")).alias("cost"))
    smallest = st.groupBy("event_id").agg(F.min(F.struct("st", "t")).alias("s"))
    apart = sp.join(smallest, "event_id").select("event_id", "p", F.col("s.t").alias("t"), (F.col("sp") + F.col("s.st")).alias("cost"))
    best = shared.unionByName(apart).groupBy("event_id", "p").agg(F.min(F.struct("cost", "t")).alias("b"))
    return best.select("event_id", "p", F.col("b.t").alias("best_t"), F.col("b.cost").alias("mismatch"))


def captured(ov: DataFrame) -> DataFrame:
    """Per true cluster: split over several predicted ones, joined with others, or correct."""
    targets = ov.groupBy("event_id", "t").agg((F.count(F.lit(1)) > 1).alias("split_up"), F.sum("n").alias("n"))
    mixed = ov.groupBy("event_id", "p").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    joined = ov.join(mixed, ["event_id", "p"]).groupBy("event_id", "t").agg(F.bool_or("mixed").alias("joined"))
    return targets.join(joined, ["event_id", "t"]).select("event_id", "t", "n", "split_up", "joined", (~F.col("split_up") & ~F.col("joined")).alias("correct"))


def recovered(ov: DataFrame) -> DataFrame:
    """Per event the true clusters, those fully recovered, and whether all are."""
    c = captured(ov)
    return c.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_true"), F.count_if("correct").alias("n_recovered"), F.bool_and("correct").alias("all_match"))


def in_order(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Per true cluster whether one predicted cluster holds the same hits in the same order."""
    keys = ["event_id", "point_idx"]
    rank = lambda df, c, r: df.where("track_pos is not null").select(*keys, "cluster_id", "track_pos").dropDuplicates([*keys, "cluster_id"]).withColumn(r, F.row_number().over(Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx"))).select(*keys, F.col("cluster_id").alias(c), r)
    j = rank(true, "t", "rt").join(rank(predicted, "p", "rp"), keys, "left")
    return j.groupBy("event_id", "t").agg((F.bool_and(F.coalesce(F.col("rt") == F.col("rp"), F.lit(False))) & (F.count_distinct("p") == 1)).alias("ordered"))


def spectrum(rays: DataFrame, width: float = 0.01, energy: str = "esum") -> DataFrame:
    """Rays counted by energy in bins of ``width``; null and NaN energies are left out."""
    e = F.col(energy)
    return rays.where(e.isNotNull() & ~F.isnan(e)).groupBy(F.floor(e / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("bin") * width).alias("low"), "n")


def peak_to_total(rays: DataFrame, cuts: list[float], peak: tuple[float, float]) -> DataFrame:
    """For each cut on the figure of merit: rays in the peak over all accepted, and accepted over all."""
    e, f = F.col("esum"), F.col("fom")
    inside = (e >= peak[0]) & (e <= peak[1])
    r = rays.where(f.isNotNull() & ~F.isnan(f) & e.isNotNull())
    a = r.select(inside.alias("inside"), F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), (f <= c).alias("ok")) for c in cuts])).alias("c"))
    g = a.groupBy("c.cut").agg(F.count_if(F.col("c.ok") & F.col("inside")).alias("n_peak"), F.count_if(F.col("c.ok")).alias("n_accepted"), F.count(F.lit(1)).alias("n_all"))
    return g.select("cut", "n_peak", "n_accepted", "n_all", (F.col("n_peak") / F.nullif(F.col("n_accepted"), F.lit(0))).alias("peak_to_total"), (F.col("n_accepted") / F.col("n_all")).alias("efficiency"))


def join_validity(pairs: DataFrame, clusters: DataFrame, true: DataFrame) -> DataFrame:
    """``event_id, cluster_a, cluster_b, join, end``: should two proposed clusters be one, and the second follow the first?

    ``pairs(event_id, cluster_a, cluster_b)``. join: all hits of both lie in one true cluster. end: as well, the first hit of b comes right
    after the last of a in that cluster's order. Order is that of ``track_pos``; a hit in no true cluster makes both false.
    """
    place = F.row_number().over(Window.partitionBy("event_id", "t").orderBy("track_pos", "point_idx"))
    t = true.select("event_id", "point_idx", F.col("cluster_id").alias("t"), "track_pos").withColumn("place", place).drop("track_pos")
    c = clusters.select("event_id", "cluster_id", "point_idx", "track_pos").join(t, ["event_id", "point_idx"], "left")
    order = F.struct("track_pos", "point_idx")
    own = c.groupBy("event_id", "cluster_id").agg(F.min("t").alias("t"), ((F.count_distinct("t") == 1) & (F.count("t") == F.count(F.lit(1)))).alias("pure"), F.min_by("place", order).alias("head"), F.max_by("place", order).alias("tail"))
    side = lambda n: own.select("event_id", *[F.col(x).alias(y) for x, y in (("cluster_id", f"cluster_{n}"), ("t", f"t{n}"), ("pure", f"p{n}"), ("head", f"h{n}"), ("tail", f"l{n}"))])
    j = pairs.select("event_id", "cluster_a", "cluster_b").join(side("a"), ["event_id", "cluster_a"]).join(side("b"), ["event_id", "cluster_b"])
    join = F.coalesce(F.col("pa") & F.col("pb") & (F.col("ta") == F.col("tb")), F.lit(False))
    return j.select("event_id", "cluster_a", "cluster_b", join.alias("join"), (join & F.coalesce(F.col("hb") == F.col("la") + 1, F.lit(False))).alias("end"))


def resampled_cumulant(values: DataFrame, column: str, points: list[float], normalise: bool = True) -> DataFrame:
    """``t, cumulant``: the share (or number) of values up to each of ``points``, those equal to it counted half."""
    v = F.col(column)
    ok = values.where(v.isNotNull() & ~F.isnan(v))
    sums = ok.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(float(t)).alias("t"), ((F.count_if(v < t) + F.count_if(v <= t)) / 2).alias("c")) for t in points]).alias("at"))
    rows = sums.select("n", F.explode("at").alias("p"))
    return rows.select("p.t", (F.col("p.c") / F.nullif(F.col("n"), F.lit(0)) if normalise else F.col("p.c")).alias("cumulant"))


def energy_cost(rays: DataFrame, energies: list[float], width: float = 0.002) -> DataFrame:
    """``event_id, n_rays, in_peak, cost``: rays of an event within ``width`` of a known energy, and how far the others are off in all."""
    off = F.array_min(F.array(*[F.abs(F.col("esum") - v) for v in energies]))
    a = rays.where("esum is not null and not isnan(esum)").withColumn("off", off)
    return a.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rays"), F.count_if(F.col("off") < width).alias("in_peak"), F.sum(F.when(F.col("off") < width, 0.0).otherwise(F.col("off"))).alias("cost"))


def transitions(ordered: DataFrame, length: int = 2) -> DataFrame:
    """``event_id, cluster_id, step, p0, p1, ...``: the hits that follow each other in every track, ``length`` at a time, from the origin (0)."""
    w = Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx")
    zero = ordered.select("event_id", "cluster_id").distinct().select("event_id", "cluster_id", F.lit(-(2**31)).cast("long").alias("track_pos"), F.lit(0).alias("point_idx"))
    path = ordered.select("event_id", "cluster_id", F.col("track_pos").cast("long").alias("track_pos"), "point_idx").unionByName(zero)
    rows = path.select("event_id", "cluster_id", (F.row_number().over(w) - 1).alias("step"), *[F.lead("point_idx", k).over(w).alias(f"p{k}") if k else F.col("point_idx").alias("p0") for k in range(length)])
    return rows.where(F.col(f"p{length - 1}").isNotNull())


def hit_relations(true: DataFrame) -> DataFrame:
    """``event_id, i, j, same, follows``: for each two hits of an event whether they share a true cluster and whether j comes right after i in it."""
    place = F.row_number().over(Window.partitionBy("event_id", "cluster_id").orderBy("track_pos", "point_idx"))
    t = true.select("event_id", "cluster_id", "point_idx", "track_pos").withColumn("place", place)
    side = lambda n, h: t.select("event_id", F.col("cluster_id").alias(f"c{n}"), F.col("point_idx").alias(h), F.col("place").alias(f"k{n}"))
    j = side("a", "i").join(side("b", "j"), "event_id").where("i <> j")
    same = F.col("ca") == F.col("cb")
    return j.groupBy("event_id", "i", "j").agg(F.bool_or(same).alias("same"), F.bool_or(same & (F.col("kb") == F.col("ka") + 1)).alias("follows"))
