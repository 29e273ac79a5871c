"""From hits to scored rays: cleaning, clustering, ordering, scoring, and the files at both ends."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitloom.functions.geometry import SHELLS
from hitloom.operators import coincidences as C, events as E, ordering as O, ranking as R, tracks as T
from hitloom.sources import frames as B


@dataclass
class Options:
    """Parameters of a run. Defaults are those of the usual tracking options (``KEYS``)."""

    detector: str = "gretina"
    time_gap: int = 40
    anchored: str = "first"
    alpha_degrees: float = 20.0
    cluster_gap: int | None = 40
    min_energy: float = 0.0
    packing_distance: float = 0.0
    order_method: str = "selected"
    order_model: str | None = None
    width: int = 5
    stride: int = 2
    second_order: bool = False
    second_method: str = "angle"
    second_width: int = 5
    second_stride: int = 2
    score_method: str = "angle"
    score_model: str | None = None
    singles: str | None = "depth"
    suppress_bad_pad: bool = True
    max_hits: int = 300
    max_ordered: int = 8
    untracked: bool = True
    full_output: bool = False
    global_coords: bool = False
    read_tracked: bool = False
    peak_only: bool = False

    @classmethod
    def load(cls, path: str) -> Options:
        """From a YAML file with the names of the fields, or with the option names of ``KEYS``; unknown names are an error."""
        import yaml

        with open(path) as f:
            return cls.of(yaml.safe_load(f) or {})

    @classmethod
    def of(cls, given: dict) -> Options:
        known = {f.name for f in fields(cls)}
        out, unknown = {}, []
        for key, value in given.items():
            if key in known:
                out[key] = value
            elif key in IGNORED:
                continue
            elif isinstance(KEYS.get(key), dict):
                for inner, v in (value or {}).items():
                    if inner not in KEYS[key]:
                        unknown.append(f"{key}.{inner}")
                    elif KEYS[key][inner]:
                        out[KEYS[key][inner]] = v
            elif key in KEYS:
                out[KEYS[key]] = value
            else:
                unknown.append(key)
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        if "detector" in out:
            out["detector"] = str(out["detector"]).lower()
        return cls(**out)


#: Option names of tracking files and the fields they set; an empty field is read and has no effect.
KEYS = {
    "DETECTOR": "detector", "COINCIDENCE_TIME_GAP": "time_gap", "SECONDARY_ORDER": "second_order", "MAX_HIT_POINTS": "max_hits", "GLOBAL_COORDS": "global_coords", "MONSTER_SIZE": "max_ordered",
    "TRACK_MOLY_PEAK": "peak_only", "SAVE_EXTENDED_MODE1": "full_output", "RECORD_UNTRACKED": "untracked", "SUPPRESS_BAD_PAD": "suppress_bad_pad", "READ_MODE1": "read_tracked",
    "order_FOM_kwargs": {"fom_method": "order_method", "model_filename": "order_model", "singles_method": "", "width": "width", "stride": "stride", "max_cluster_size": "max_ordered"},
    "secondary_order_FOM_kwargs": {"fom_method": "second_method", "model_filename": "", "singles_method": "", "width": "second_width", "stride": "second_stride", "max_cluster_size": ""},
    "eval_FOM_kwargs": {"fom_method": "score_method", "model_filename": "score_model", "singles_method": "singles", "max_cluster_size": ""},
    "cluster_kwargs": {"alpha_degrees": "alpha_degrees", "time_gap": "cluster_gap"},
}
#: Options of a process pool and of its output, which Spark has no use for.
IGNORED = ("NUM_PROCESSES", "VERBOSITY", "TIMEOUT_SECONDS", "PARTIAL_TRACK", "SAVE_INTERMEDIATE", "PRINT_FORMATTED", "REEVALUATE_FOM")


def clean(hits: DataFrame, o: Options) -> DataFrame:
    h = hits.where(F.col("e") > o.min_energy)
    return E.packed(h, o.packing_distance) if o.packing_distance > 0 else h


def _weights(method: str, model: str | None) -> dict[str, float] | None:
    return R.LinearModel.load(model).weights if method in ("model", "feature") and model else None


def found_clusters(hits: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of distinct hits by cone and time, and of each whether it is to be tracked: ``event_id, cluster_id, n, bad_pads, tracked``.

    A cluster isn't tracked if it has more than ``max_ordered`` hits, or, with ``suppress_bad_pad``, a hit whose ``pad`` is above 0; with
    ``peak_only`` the event must have a ray in the test peak.
    """
    o = options or Options()
    clusters = E.cone_clusters(hits, o.alpha_degrees, o.max_hits, time_gap=o.cluster_gap)
    pads = hits.select("event_id", "point_idx", F.col("pad") if "pad" in hits.columns else F.lit(None).cast("int").alias("pad"))
    size = clusters.join(pads, ["event_id", "point_idx"]).groupBy("event_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pad") > 0).alias("bad_pads"))
    ok = F.col("n") <= o.max_ordered
    if o.suppress_bad_pad:
        ok = ok & (F.col("bad_pads") == 0)
    size = size.withColumn("tracked", ok)
    if o.peak_only:
        inside = E.in_peak(hits, clusters.withColumn("track_pos", F.col("point_idx"))).where("in_peak").select("event_id", F.lit(True).alias("_in"))
        size = size.join(inside, "event_id", "left").withColumn("tracked", F.col("tracked") & F.coalesce("_in", F.lit(False))).drop("_in")
    return clusters, size


def track(hits: DataFrame, options: Options | None = None) -> DataFrame:
    """``event_id, cluster_id, n, esum, fom, tracked, ts, crystal_no, points`` of the rays found in ``hits``.

    ``hits(event_id, point_idx, x, y, z, e, ts, crystal_no, interaction_type, pad, ...)``. Events of more than ``max_hits`` hits are left
    out; clusters that aren't to be tracked (:func:`found_clusters`) keep the order of their hits and are marked. With ``second_order``
    the figure of merit is that of a second search's order; the order given out stays the first's.
    """
    o = options or Options()
    inner = SHELLS[o.detector][0]
    h = E.distinct_hits(clean(hits, o))
    clusters, kinds = found_clusters(h, o)
    marked = clusters.join(kinds.select("event_id", "cluster_id", "tracked"), ["event_id", "cluster_id"])
    # What isn't tracked keeps the order of its hits.
    plain = marked.where("not tracked").select("event_id", "cluster_id", F.col("point_idx").alias("track_pos"), "point_idx")
    wanted = marked.where("tracked").select("event_id", "cluster_id", "point_idx")

    def order(method: str, width: int, stride: int, weights: dict[str, float] | None) -> DataFrame:
        best = O.order_rays(h, wanted, method, width, stride, o.max_ordered, inner, weights=weights).select("event_id", "cluster_id", "track_pos", "point_idx")
        return best.unionByName(plain)

    tracks = T.ordered_hits(h, order(o.order_method, o.width, o.stride, _weights(o.order_method, o.order_model)))
    rated = T.ordered_hits(h, order(o.second_method, o.second_width, o.second_stride, None)) if o.second_order else tracks
    weights = _weights(o.score_method, o.score_model)
    scored = T.figures_of_merit(rated, "feature" if weights else o.score_method, o.singles, inner, weights=weights)
    extra = [c for c in ("ts", "crystal_no", "energy_factor") if c in h.columns]
    full = tracks.join(h.select("event_id", "point_idx", *extra), ["event_id", "point_idx"])
    for c, kind in (("ts", "long"), ("crystal_no", "int"), ("energy_factor", "double")):
        if c not in extra:
            full = full.withColumn(c, F.lit(None).cast(kind))
    pts = F.array_sort(F.collect_list(F.struct("track_pos", "point_idx", "x", "y", "z", "e", "ts", "crystal_no", "energy_factor")))
    rays = full.groupBy("event_id", "cluster_id").agg(pts.alias("p"))
    rays = rays.withColumn("points", F.transform("p", lambda q: F.struct(*[q[c].alias(c) for c in ("x", "y", "z", "e", "ts", "crystal_no", "energy_factor")])))
    first = F.get("points", 0)
    rays = rays.select("event_id", "cluster_id", "points", F.coalesce(first["ts"], F.col("event_id")).alias("ts"), first["crystal_no"].alias("crystal_no"))
    return scored.join(rays, ["event_id", "cluster_id"]).join(kinds.select("event_id", "cluster_id", "tracked"), ["event_id", "cluster_id"])


def run_statistics(hits: DataFrame, options: Options | None = None) -> DataFrame:
    """``what, value, n``: hits by pad and by crystal, clusters found, and events left out for their size, as counted while tracking."""
    h = E.distinct_hits(clean(hits, options or Options()))
    _, kinds = found_clusters(h, options)
    by = lambda what: h.groupBy(F.lit(what.split("_")[0]).alias("what"), F.col(what).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    most = (options or Options()).max_hits
    sizes = h.where("x is not null and y is not null and z is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("m"))
    left_out = sizes.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("m") > most).alias("events left out"))
    total = kinds.agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("clusters"), F.count_if("tracked").alias("tracked clusters"), F.count_if(F.col("bad_pads") > 0).alias("clusters with bad pads")).join(left_out, "one").drop("one")
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.lit(None).cast("string").alias("value"), F.col(f"`{c}`").alias("n")) for c in total.columns])).alias("r")).select("r.*")
    return by("pad").unionByName(by("crystal_no")).unionByName(rows)


def hits_of_file(spark: SparkSession, path: str, o: Options, matrices: DataFrame | None = None) -> DataFrame:
    """Hits of the coincidences of a file of crystal records."""
    pts = B.crystal_points(B.decode_crystals(B.frames(spark, path, B.TYPE_CRYSTAL)), None if o.global_coords else matrices)
    marked = C.coincidences(pts, "timestamp", o.time_gap, o.anchored)
    h = C.calibrated(marked)
    from pyspark.sql.window import Window

    return h.withColumnRenamed("coincidence_ts", "event_id").withColumn("point_idx", F.row_number().over(Window.partitionBy("event_id").orderBy("ts", "crystal_no", "x", "y", "z"))).withColumn("interaction_type", F.lit(None).cast("int"))


def hits_of_tracked(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a tracked file with all hits, to be tracked anew."""
    full = B.decode_tracked_full(B.frames(spark, path, B.TYPE_TRACKED_FULL))
    p = full.select(F.col("offset").alias("event_id"), F.col("timestamp").alias("at"), "ray_no", F.posexplode("points").alias("i", "p"))
    from pyspark.sql.window import Window

    idx = F.row_number().over(Window.partitionBy("event_id").orderBy("ray_no", "i"))
    return p.select("event_id", idx.alias("point_idx"), *[(F.col(f"p.{c}") / 10.0).alias(c) for c in "xyz"], (F.col("p.e") / 1000.0).alias("e"), (F.col("at") + F.col("p.dt")).alias("ts"), F.col("p.crystal_no").alias("crystal_no"), F.col("p.energy_factor").cast("double").alias("energy_factor"), F.lit(None).cast("int").alias("interaction_type"))


def track_file(spark: SparkSession, source: str, target: str, options: Options | None = None, matrices: DataFrame | None = None) -> None:
    """Raw file (or, with ``read_tracked``, a tracked one with all hits) to tracked file."""
    o = options or Options()
    hits = hits_of_tracked(spark, source) if o.read_tracked else hits_of_file(spark, source, o, matrices)
    B.write_frames(B.encode_tracked(track(hits, o), full=o.full_output, untracked=o.untracked), target, "overwrite")


def convert_file(spark: SparkSession, source: str, target: str) -> None:
    """Tracked file with all hits to one with the first two of each ray."""
    full = B.decode_tracked_full(B.frames(spark, source, B.TYPE_TRACKED_FULL))
    pts = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["e"].alias("e"), F.lit(None).cast("long").alias("ts"), p["crystal_no"].alias("crystal_no"), p["energy_factor"].alias("energy_factor")))
    rays = full.select(F.col("offset").alias("event_id"), F.col("ray_no").alias("cluster_id"), "esum", "fom", "tracked", F.col("timestamp").alias("ts"), "crystal_no", pts.alias("points"))
    B.write_frames(B.encode_tracked(rays, cm=False), target, "overwrite")


def _rays_of(full: DataFrame) -> DataFrame:
    """Hits of decoded rays in order, in cm and MeV."""
    p = full.select(F.col("offset").alias("event_id"), F.col("ray_no").alias("cluster_id"), F.posexplode("points").alias("track_pos", "p"))
    return p.select("event_id", "cluster_id", "track_pos", F.col("track_pos").alias("point_idx"), *[(F.col(f"p.{c}") / 10.0).alias(c) for c in "xyz"], (F.col("p.e") / 1000.0).alias("e"))


def rescored_file(spark: SparkSession, source: str, method: str = "oft", singles: str | None = "depth", detector: str = "gretina") -> DataFrame:
    """``event_id, cluster_id, n, esum, fom`` of the rays of a tracked file with all hits, scored anew."""
    full = B.decode_tracked_full(B.frames(spark, source, B.TYPE_TRACKED_FULL))
    return T.figures_of_merit(_rays_of(full), method, singles, SHELLS[detector][0])


def rescore_file(spark: SparkSession, source: str, target: str, options: Options | None = None) -> None:
    """A tracked file with all hits to one with the figures of merit of ``options``; order, hits and marks stay."""
    o = options or Options()
    full = B.decode_tracked_full(B.frames(spark, source, B.TYPE_TRACKED_FULL))
    weights = _weights(o.score_method, o.score_model)
    new = T.figures_of_merit(_rays_of(full), "feature" if weights else o.score_method, o.singles, SHELLS[o.detector][0], weights=weights).select("event_id", "cluster_id", F.col("fom").alias("new"))
    pts = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["e"].alias("e"), (F.col("timestamp") + p["dt"]).alias("ts"), p["crystal_no"].alias("crystal_no"), p["energy_factor"].alias("energy_factor")))
    rays = full.select(F.col("offset").alias("event_id"), F.col("ray_no").alias("cluster_id"), "esum", "fom", "tracked", F.col("timestamp").alias("ts"), "crystal_no", pts.alias("points"))
    rays = rays.join(new, ["event_id", "cluster_id"], "left").withColumn("fom", F.coalesce("new", "fom"))
    B.write_frames(B.encode_tracked(rays, full=o.full_output, cm=False, untracked=o.untracked), target, "overwrite")


def statistics(rays: DataFrame) -> DataFrame:
    """One row: events, rays, tracked rays, hits and energy of a run."""
    return rays.agg(F.count_distinct("event_id").alias("n_events"), F.count(F.lit(1)).alias("n_rays"), F.count_if("tracked").alias("n_tracked"), F.sum("n").alias("n_hits"), F.sum("esum").alias("energy"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="hitloom")
    p.add_argument("command", choices=["track", "convert", "rescore"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("options", nargs="?")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("hitloom").getOrCreate()
    options = Options.load(a.options) if a.options else None
    if a.command == "track":
        track_file(spark, a.source, a.target, options)
    elif a.command == "rescore":
        rescore_file(spark, a.source, a.target, options)
    else:
        convert_file(spark, a.source, a.target)


if __name__ == "__main__":
    main()
