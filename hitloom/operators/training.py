"""Training frames from hits with known rays, and the two-branch suppression model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hitloom.operators import events as E, features as X, ordering as O, tracks as T


def ray_states(hits: DataFrame, clusters: DataFrame, energies: DataFrame | None = None, tolerance: float = 0.02) -> DataFrame:
    """``event_id, cluster_id, n, esum, energy, complete``: whether a ray deposited all its energy.

    ``energies(event_id, cluster_id, energy)`` are the true ones; rays without are neither complete nor not (null).
    """
    t = T.track_energies(T.ordered_hits(hits, clusters)).select("event_id", "cluster_id", "n", "esum")
    if energies is None:
        return t.withColumns({"energy": F.lit(None).cast("double"), "complete": F.lit(None).cast("boolean")})
    return t.join(energies.select("event_id", "cluster_id", "energy"), ["event_id", "cluster_id"], "left").withColumn("complete", F.abs(F.col("esum") - F.col("energy")) < tolerance)


def order_rows(hits: DataFrame, clusters: DataFrame, features: list[str], energies: DataFrame | None = None, width: int = 5, max_size: int = 6, prepare: bool = False, packing: float = 0.6, seed: int = 1) -> DataFrame:
    """One row per tried order of every small ray with its features: ``event_id, cluster_id, order_no, ordered, complete, n, esum, ...``.

    ``prepare``: hits are packed and smeared first. Orders as in :func:`ordering.tried_rays`; the true one is number 0. Features of
    a ray tried in part are those of its tried places; its n and esum are the whole ray's.
    """
    h = E.smeared(E.packed(hits, packing), seed) if prepare else hits
    tried = O.tried_rays(h, clusters, width, max_size, ("x", "y", "z", "e"))
    # An order is a track of its own: its key is (event, cluster and order).
    f = X.track_features(tried.withColumn("cluster_id", F.concat_ws("/", "cluster_id", "order_no")).drop("order_no"), features)
    cut = F.split("cluster_id", "/")
    f = f.withColumn("order_no", cut[1].cast("int")).withColumn("cluster_id", cut[0].cast("int")).withColumn("ordered", (F.col("order_no") == 0).cast("int"))
    if energies is None and max_size <= width + 1:
        return f.withColumn("complete", F.lit(None).cast("boolean"))
    states = ray_states(h, clusters, energies).select("event_id", "cluster_id", F.col("n").alias("_n"), F.col("esum").alias("_esum"), "complete")
    return f.join(states, ["event_id", "cluster_id"], "left").withColumns({"n": F.col("_n"), "esum": F.col("_esum")}).drop("_n", "_esum")


def suppression_rows(hits: DataFrame, clusters: DataFrame, features: list[str], energies: DataFrame, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Rows to tell complete rays from others: of tracks of two or more hits, and of single hits."""
    o = T.ordered_hits(hits, clusters)
    states = ray_states(hits, clusters, energies, tolerance).where("complete is not null").select("event_id", "cluster_id", F.col("complete").cast("double").alias("label"))
    return X.track_features(o, features).join(states, ["event_id", "cluster_id"]), X.single_features(o).join(states, ["event_id", "cluster_id"])


class TwoBranchModel:
    """Suppression: one scaled logistic model for tracks, one for single hits; scores are probabilities of an incomplete ray."""

    def __init__(self, iterations: int = 50, reg: float = 1e-4):
        self.iterations, self.reg = iterations, reg
        self.branches: dict[str, tuple[list[str], object]] = {}

    def _fit(self, rows: DataFrame, features: list[str]):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        clean = _clean(rows, features)
        stages = [VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=self.iterations, regParam=self.reg)]
        return Pipeline(stages=stages).fit(clean)

    def fit(self, tracks: DataFrame, singles: DataFrame, features: list[str], single_features: list[str]) -> TwoBranchModel:
        self.branches = {"tracks": (features, self._fit(tracks, features)), "singles": (single_features, self._fit(singles, single_features))}
        return self

    def predict(self, tracks: DataFrame, singles: DataFrame) -> DataFrame:
        """``event_id, cluster_id, single, score``."""
        from pyspark.ml.functions import vector_to_array

        out = None
        for name, rows in (("tracks", tracks), ("singles", singles)):
            features, model = self.branches[name]
            p = model.transform(_clean(rows, features)).select("event_id", "cluster_id", F.lit(name == "singles").alias("single"), vector_to_array("probability")[0].alias("score"))
            out = p if out is None else out.unionByName(p)
        return out


def _clean(rows: DataFrame, features: list[str]) -> DataFrame:
    def fixed(name: str) -> Column:
        c = F.col(f"`{name}`").cast("double")
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)

    keep = [c for c in ("event_id", "cluster_id", "label") if c in rows.columns]
    return rows.select(*keep, *[fixed(f).alias(f"f{i}") for i, f in enumerate(features)])
