"""Learning to rank orders of rays: pairs, selections, checks and linear models."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import drop_table, materialise

QID = ["ray_event_id", "ray_cluster_id"]


def clean_rows(rows: DataFrame, features: list[str], sentinel: float = 123456789.0) -> DataFrame:
    """Distinct rows; features that are null, NaN or the sentinel become 0."""
    fix = {f: F.when(F.col(f).isNull() | F.isnan(f) | (F.col(f) == sentinel), 0.0).otherwise(F.col(f)) for f in features}
    return rows.withColumns(fix).distinct()


def scaled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features over their standard deviation (of the population), where that isn't 0; the mean stays."""
    std = rows.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()  # one row
    return rows.withColumns({f: F.col(f) / (std[f] if std[f] else 1.0) for f in features})


def relative_rows(rows: DataFrame, features: list[str], row: str = "row_id", qid: list[str] = QID, normalise: bool = True) -> DataFrame:
    """Each other order's features minus those of the true order of its ray, at unit length."""
    true = rows.where("ordered = 1").groupBy(*qid).agg(F.min_by(F.struct(*features), row).alias("_t"))
    d = rows.where("ordered <> 1").join(true, qid).select(row, *qid, *[(F.col(f) - F.col(f"_t.{f}")).alias(f) for f in features])
    if not normalise:
        return d
    n = F.sqrt(sum((F.col(f) ** 2 for f in features), F.lit(0.0)))
    return d.withColumn("_n", n).select(row, *qid, *[F.when(F.col("_n") > 0, F.col(f) / F.nullif(F.col("_n"), F.lit(0.0))).otherwise(0.0).alias(f) for f in features])


def score(weights: dict[str, float]) -> Column:
    return sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0))


def selected_rows(scored: DataFrame, rule: str, row: str = "row_id", qid: list[str] = QID, n: int = 3) -> DataFrame:
    """Rows per ray by a rule on ``s``, ties to the smaller row id.

    least; neg: the least if not above 0; pos_neg: that, else the largest; best: the largest; neg_best: the
    largest of those not above 0; n_neg: the ``n`` least not above 0; all_neg; all.
    """
    up, down = Window.partitionBy(*qid).orderBy("s", row), Window.partitionBy(*qid).orderBy(F.col("s").desc(), row)
    a = scored.where(F.col("s").isNotNull() & ~F.isnan("s"))
    least, most = F.row_number().over(up), F.row_number().over(down)
    neg = F.col("s") <= 0
    if rule == "all":
        return a
    if rule == "all_neg":
        return a.where(neg)
    if rule == "neg_best":
        return a.where(neg).withColumn("_r", F.row_number().over(down)).where("_r = 1").drop("_r")
    if rule == "best":
        return a.withColumn("_r", most).where("_r = 1").drop("_r")
    r = a.withColumn("_r", least)
    if rule == "least":
        return r.where("_r = 1").drop("_r")
    if rule == "neg":
        return r.where((F.col("_r") == 1) & neg).drop("_r")
    if rule == "n_neg":
        return r.where((F.col("_r") <= n) & neg).drop("_r")
    if rule == "pos_neg":
        low = F.min("s").over(Window.partitionBy(*qid))
        return r.withColumn("_m", most).withColumn("_low", low).where(F.when(F.col("_low") <= 0, F.col("_r") == 1).otherwise(F.col("_m") == 1)).drop("_r", "_m", "_low")
    raise ValueError(f"unknown rule {rule!r}")


def sign_changes(before: DataFrame, now: DataFrame, row: str = "row_id", qid: list[str] = QID) -> DataFrame:
    """The least row not above 0 of each ray whose score changed sign since the weights before."""
    j = now.join(before.select(row, F.col("s").alias("_old")), row).where((F.col("s") <= 0) & (F.col("_old") > 0)).drop("_old")
    return selected_rows(j, "least", row, qid)


def solved(relative: DataFrame, qid: list[str] = QID) -> DataFrame:
    """Per ray whether every other order scores above the true one."""
    return relative.groupBy(*qid).agg((F.min("s") > 0).alias("solved"), F.count(F.lit(1)).alias("n_rows"))


def acceptable_at_top(scored: DataFrame, qid: list[str] = QID) -> DataFrame:
    """Per ray whether every row tied at the least score is acceptable."""
    a = scored.where(F.col("s").isNotNull() & ~F.isnan("s")).withColumn("_low", F.min("s").over(Window.partitionBy(*qid)))
    return a.groupBy(*qid).agg(F.bool_and((F.col("s") > F.col("_low")) | (F.col("acceptable") == 1)).alias("solved"), F.count(F.lit(1)).alias("n_rows"))


def ray_weights(rows: DataFrame, qid: list[str] = QID) -> DataFrame:
    """``weight`` = 1 / rows of the ray, so that rays count alike."""
    return rows.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*qid)))


def dense_labels(rows: DataFrame, qid: list[str] = QID) -> DataFrame:
    """``label`` 0.. of the rays in order, from a small table of the distinct rays per prefix.

    Rays are numbered within hash-free ranges of their first key and the range totals prefix-summed.
    """
    keys = rows.select(*qid).distinct().withColumn("_p", F.coalesce(F.shiftright(F.col(qid[0]).cast("long"), 12), F.lit(-(2**62))))
    order = [F.col(c).asc_nulls_first() for c in qid]
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    sums = keys.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return keys.withColumn("_l", local).join(sums, "_p").select(*qid, (F.col("_l") - 1 + F.col("_o")).alias("label"))


def mean_of_means(relative: DataFrame, features: list[str], qid: list[str] = QID, non_negative: bool = True) -> DataFrame:
    """Start weights: mean per ray, mean over rays, negatives to 0, scaled to sum of absolutes 1. One row."""
    per = relative.groupBy(*qid).agg(*[F.avg(f).alias(f) for f in features])
    m = per.agg(*[F.avg(f).alias(f) for f in features])
    if non_negative:
        m = m.select(*[F.greatest(F.col(f), F.lit(0.0)).alias(f) for f in features])
    total = sum((F.abs(F.col(f)) for f in features), F.lit(0.0))
    return m.withColumn("_t", total).select(*[(F.col(f) / F.nullif(F.col("_t"), F.lit(0.0))).alias(f) for f in features])


def fit_linear(relative: DataFrame, features: list[str], kind: str = "svc", reg: float = 0.0, iterations: int = 100, qid: list[str] = QID) -> dict[str, float]:
    """Weights of a linear ranking model without intercept on mirrored relative rows, weighted per ray.

    kind: svc (hinge) or lr (logistic), trained distributed.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    w = ray_weights(relative, qid)
    mirrored = w.select(F.lit(1.0).alias("label"), "weight", *features).unionByName(w.select(F.lit(0.0).alias("label"), "weight", *[(-F.col(f)).alias(f) for f in features]))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(mirrored)
    make = LinearSVC if kind == "svc" else LogisticRegression
    model = make(featuresCol="features", labelCol="label", weightCol="weight", fitIntercept=False, standardization=False, regParam=reg, maxIter=iterations).fit(data)
    return dict(zip(features, [float(v) for v in model.coefficients]))


def column_generation(relative: DataFrame, features: list[str], row: str = "row_id", kind: str = "svc", first: str = "least", then: str = "neg", qid: list[str] = QID, **kw) -> dict[str, float]:
    """Weights from a growing set of active rows: fit, add each ray's worst row under the new weights, until none is new.

    It ends, as the active set only grows.
    """
    relative = materialise(relative, "relative")
    start = mean_of_means(relative, features, qid).first()
    weights = {f: float(start[f] or 0.0) for f in features}
    active = materialise(selected_rows(relative.withColumn("s", score(weights)), first, row, qid).select(row), "active")
    while True:
        weights = fit_linear(relative.join(active, row, "left_semi"), features, kind, qid=qid, **kw)
        chosen = selected_rows(relative.withColumn("s", score(weights)), then, row, qid).select(row)
        new = materialise(chosen.join(active, row, "left_anti"), "active")
        if new.isEmpty():
            return weights
        old, active = active, materialise(active.union(new).distinct(), "active")
        drop_table(old)
        drop_table(new)


def estimated_weights(relative: DataFrame, features: list[str], row: str = "row_id", first: str = "least", then: str = "neg", rounds: int = 10, qid: list[str] = QID) -> dict[str, float]:
    """Start weights without a solver: the mean of means over the rows that the weights so far select, until they stay."""
    start = mean_of_means(relative, features, qid).first()
    weights = {f: float(start[f] or 0.0) for f in features}
    for k in range(rounds):
        chosen = selected_rows(relative.withColumn("s", score(weights)), first if k == 0 else then, row, qid)
        new = mean_of_means(chosen, features, qid).first()
        nxt = {f: float(new[f] or 0.0) for f in features}
        if all(abs(nxt[f] - weights[f]) < 1e-9 for f in features) or not any(nxt.values()):
            break
        weights = nxt
    return weights


def margin_weights(relative: DataFrame, features: list[str], penalty: float = 1e-3, iterations: int = 60, step: float = 0.5, non_negative: bool = True) -> dict[str, float]:
    """Weights that put every row of ``relative`` (a false order minus the true one) a margin of 1 above 0, at the least mean shortfall
    plus ``penalty`` times their absolute sum: the linear program of ranking, by projected subgradients.

    Each iteration is one aggregate over all rows; steps fall with the root of their number and the best weights seen are returned. Features are
    scaled by their spread, and the weights scaled back.
    """
    spread = relative.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    scale = {f: float(spread[f]) if spread and spread[f] else 1.0 for f in features}
    x = {f: F.coalesce(F.col(f) / scale[f], F.lit(0.0)) for f in features}
    w = dict.fromkeys(features, 0.0)
    best, best_cost = w, math.inf
    for k in range(iterations):
        margin = sum((x[f] * w[f] for f in features), F.lit(0.0))
        short = margin < 1
        got = relative.agg(F.avg(F.greatest(F.lit(0.0), 1 - margin)).alias("_loss"), *[F.avg(F.when(short, -x[f]).otherwise(0.0)).alias(f) for f in features]).first()
        if got is None or got["_loss"] is None:
            break
        cost = got["_loss"] + penalty * sum(map(abs, w.values()))
        if cost < best_cost:
            best, best_cost = w, cost
        rate = step / math.sqrt(k + 1)
        sign = lambda v: (v > 0) - (v < 0)
        w = {f: w[f] - rate * (got[f] + penalty * sign(w[f])) for f in features}
        if non_negative:
            w = {f: max(0.0, v) for f, v in w.items()}
    return {f: v / scale[f] for f, v in best.items()}


def split_of_group(qid: list[str], share: float, seed: int = 0) -> Column:
    """True for the training side: a hash of the group, so that all of its rows agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *qid), F.lit(1_000_000)) >= int(share * 1_000_000)


class LinearModel:
    """Sparse linear scorer; weights are matched to columns by name, tiny ones are dropped."""

    def __init__(self, weights: dict[str, float], scale: dict[str, float] | None = None, bias: float = 0.0, threshold: float = 1e-8):
        self.weights, self.scale, self.bias, self.threshold = weights, scale or {}, bias, threshold

    @property
    def columns(self) -> list[str]:
        return [c for c, w in self.weights.items() if abs(w) > self.threshold]

    def column(self) -> Column:
        return sum((F.col(f"`{c}`") * (self.weights[c] / self.scale.get(c, 1.0)) for c in self.columns), F.lit(float(self.bias)))

    def save(self, path: str) -> None:
        names = list(self.weights)
        with open(path, "w") as f:
            json.dump({"model": "linear", "columns": names, "weights": [self.weights[c] for c in names], "scale": [self.scale.get(c, 1.0) for c in names], "bias": self.bias}, f)

    @classmethod
    def load(cls, path: str, threshold: float = 1e-8) -> LinearModel:
        with open(path) as f:
            d = json.load(f)
        return cls(dict(zip(d["columns"], d["weights"])), dict(zip(d["columns"], d.get("scale") or [1.0] * len(d["columns"]))), d.get("bias") or 0.0, threshold)
