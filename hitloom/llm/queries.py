"""Registered queries for the problems tagged llm, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from hitloom.llm import mixture as M, packing as K, percentiles as P, similarity as D, splits as S, tokens as T, truncation as C
from hitloom.runtime import materialise, table


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    """Each hit's energy once, on the day it first arrived, under its crystal and its segment."""
    hits = (
        table(spark, sf, "interactions")
        .where("e is not null and not isnan(e)")
        .groupBy("event_id", "point_idx", "crystal_no", "seg_no", "e")
        .agg(F.min("arrived_at").alias("at"))
        .select("crystal_no", "seg_no", "e", F.date_format("at", "yyyy-MM-dd").alias("day"))
    )
    hits = materialise(hits, "readings")
    return hits.select(
        F.explode(F.array(F.struct(F.lit("crystal").alias("level"), F.lit(None).cast("int").alias("seg")), F.struct(F.lit("segment").alias("level"), F.col("seg_no").alias("seg")))).alias("g"),
        "crystal_no", "e", "day",
    ).select("g.level", "crystal_no", F.col("g.seg").alias("seg_no"), "e", "day")


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of e per crystal and per (crystal, segment) over all days."""
    return P.bisect_percentiles(_readings(spark, sf), ["level", "crystal_no", "seg_no"], "e")


def p2_days_combined(spark: SparkSession, sf: str) -> DataFrame:
    """The same percentiles to 0.001 MeV, from day summaries that are made apart and merged."""
    keys = ["level", "crystal_no", "seg_no"]
    merged = P.merge(P.summarise(_readings(spark, sf), keys, "day", "e", 0.001), keys)
    return P.summary_percentiles(materialise(merged, "merged"), keys)


def p2_single_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of single days, to 0.001 MeV, from the same summaries."""
    keys = ["level", "crystal_no", "seg_no"]
    return P.summary_percentiles(materialise(P.summarise(_readings(spark, sf), keys, "day", "e", 0.001), "days"), [*keys, "day"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Coincidences that repeat one hit pattern: the smallest of each group with each other member."""
    members = D.similar_sets(table(spark, sf, "coincidences"))
    return members.where("id <> cluster").select(F.col("cluster").alias("event_id_a"), F.col("id").alias("event_id_b"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every group with its size and its most typical members."""
    return D.describe(D.similar_sets(table(spark, sf, "coincidences")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Events tied by shared rays: the smallest of each tied set with each other member."""
    tree = S.ties(table(spark, sf, "training_rows"), "ray_event_id", "ray_cluster_id")
    return tree.where("kind = 'e'").select(F.col("root").alias("event_id_a"), F.col("id").alias("event_id_b"))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every training row."""
    return S.grouped_splits(table(spark, sf, "training_rows"), table(spark, sf, "split_targets"))


def p5_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each split."""
    rows = p5_splits(spark, sf).groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_distinct("group_key").alias("n_groups"))
    n = F.coalesce("n_rows", F.lit(0))
    out = table(spark, sf, "split_targets").join(rows, "split_name", "left")
    return out.select("split_name", "target_share", n.alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (n / F.sum(n).over(Window.partitionBy(F.lit("listed")))).alias("share"))


def _sized(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Every document (of the sources in ``of``) with its size in tokens, counted once and kept."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    if of is not None:
        docs = docs.join(of.select("source"), "source", "left_semi")
    return materialise(T.with_token_counts(docs, "text"), "sized")


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's container, for each kind of container."""
    return K.pack(_sized(spark, sf).select("id", "n_tokens"), table(spark, sf, "container_sizes")).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each kind are, against the least possible number."""
    return K.fill_report(p6_containers(spark, sf), table(spark, sf, "container_sizes"))


def _planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sized documents of the listed sources, which alone can be in the mix, and the plan."""
    targets = table(spark, sf, "source_targets")
    sized = _sized(spark, sf, targets.where("target_share > 0"))
    return sized, materialise(M.mixture_plan(sized, targets), "plan")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix of documents in shuffled order."""
    return M.mix(*_planned(spark, sf)).withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each listed source."""
    sized, plan = _planned(spark, sf)
    return M.shares(M.mix(sized, plan), plan)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return C.truncated(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    return _judged(spark, sf).where("cut").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Cut texts per source; sources by name, null sources as one."""
    judged = _judged(spark, sf)
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), (F.count_if("cut") / F.count("*")).alias("cut_rate"))


def p5_split_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the splits, over all rows: every row once, no event and no known cluster in two splits, shares within a hundredth."""
    rows = materialise(p5_splits(spark, sf), "splits")
    one = F.lit(1).alias("one")
    leaks = lambda c: rows.where(F.col(c).isNotNull() & (F.col(c) != -1)).groupBy(c).agg(F.count_distinct("split_name").alias("k")).agg(one, F.count_if(F.col("k") > 1).alias(f"leaking_{c}"))
    shares = rows.groupBy("split_name").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit("all"))))
    met = shares.join(table(spark, sf, "split_targets"), "split_name").agg(one, F.bool_and(F.abs(F.col("share") - F.col("target_share")) <= 0.01).alias("shares_met"))
    size = rows.agg(one, F.count("*").alias("n_rows"), F.count_distinct("ray_event_id").alias("n_events"))
    return size.join(leaks("ray_event_id"), "one").join(leaks("ray_cluster_id"), "one").join(met, "one").drop("one")


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the containers of each kind: every document there, none overfull, none cut that fits, little space unused."""
    packed = materialise(p6_containers(spark, sf), "packed")
    kinds = table(spark, sf, "container_sizes")
    docs = packed.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("t")).join(kinds, "container_kind")
    per = docs.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("n_needless_cuts"))
    fill = K.fill_report(packed, kinds).select("container_kind", (F.col("fullest") <= F.col("capacity_tokens")).alias("none_overfull"), (F.col("fill_rate") > 0.95).alias("well_filled"))
    return per.join(fill, "container_kind")


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of each listed source of the mix: no document used too often, and its share (of those of the sources with text)
    off by no more than two of the largest documents."""
    sized, plan = _planned(spark, sf)
    largest = sized.agg(F.lit(1).alias("one"), F.max("n_tokens").alias("largest"))
    s = M.shares(M.mix(sized, plan), plan).withColumn("one", F.lit(1)).join(largest, "one")
    w = Window.partitionBy(F.lit("listed"))
    has = F.col("tokens") > 0
    want = F.coalesce(F.when(has, F.col("target_share")) / F.sum(F.when(has, F.col("target_share"))).over(w), F.lit(0.0))
    near = F.abs(F.col("reached_share") - want) * F.sum("mixed_tokens").over(w) <= 2 * F.col("largest")
    return s.select("source", has.alias("has_text"), (F.col("most_repeats") <= F.col("cap")).alias("within_cap"), near.alias("share_met"))


QUERIES = {
    "p2_percentiles": p2_percentiles,
    "p2_days_combined": p2_days_combined,
    "p2_single_days": p2_single_days,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_split_shares": p5_split_shares,
    "p5_split_check": p5_split_check,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}

_HITS = """
with h as (select event_id, point_idx, crystal_no, seg_no, e, strftime(min(arrived_at), '%Y-%m-%d') as day
           from interactions where e is not null and not isnan(e) group by all),
r as (select 'crystal' as level, crystal_no, null::int as seg_no, e, day from h
      union all select 'segment', crystal_no, seg_no, e, day from h),
ps as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double as p)
"""


def _by_cell(day: str) -> str:
    return _HITS + f""", c as (select level, crystal_no, seg_no{day}, floor(e / 0.001) as cell, count(*) as m, min(e) as lo, max(e) as hi from r group by all),
u as (select *, sum(m) over (partition by level, crystal_no, seg_no{day} order by cell) as upto, sum(m) over (partition by level, crystal_no, seg_no{day}) as n from c)
select level, crystal_no, seg_no{day}, p, n::bigint as n, lo, hi from u, ps where greatest(1, ceil(p * n)) <= upto and greatest(1, ceil(p * n)) > upto - m"""  # fmt: skip


SQL = {
    "p2_percentiles": _HITS
    + """, k as (select *, row_number() over (partition by level, crystal_no, seg_no order by e) as i, count(*) over (partition by level, crystal_no, seg_no) as n from r)
select level, crystal_no, seg_no, p, n, e as lo, e as hi from k, ps where i = greatest(1, ceil(p * n))""",
    "p2_days_combined": _by_cell(""),
    "p2_single_days": _by_cell(", day"),
    "p5_found": """
with recursive l as (select distinct ray_event_id as e, ray_cluster_id as c from training_rows
                     where ray_event_id is not null and ray_cluster_id is not null and ray_cluster_id <> -1),
n as (select distinct a.e as x, b.e as y from l a join l b using (c)),
t(x, y) as (select x, y from n union select t.x, n.y from t join n on t.y = n.x)
select min(y) as event_id_a, x as event_id_b from t group by x having min(y) <> x""",
    "p5_split_check": "with r as (select distinct row_id, ray_event_id, ray_cluster_id from training_rows) select count(*) as n_rows, count(distinct ray_event_id) as n_events, 0::bigint as leaking_ray_event_id, 0::bigint as leaking_ray_cluster_id, true as shares_met from r",
    "p6_check": "select container_kind, (select count(*) from documents) as n_docs, 0::bigint as n_needless_cuts, true as none_overfull, true as well_filled from container_sizes",
    "p7_check": "select source, exists (select 1 from documents d where d.source = t.source and d.text <> '') as has_text, true as within_cap, true as share_met from source_targets t",
}
