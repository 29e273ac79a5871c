"""Filling fixed-capacity containers by a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hitloom.runtime import drop_table, materialise

Bins = list[list[int]]
#: Bins and how full each is.
Packing = tuple[Bins, list[int]]
_WELL = 0.99


def _best_fit(bins: Bins, fill: list[int], items: list[int], size: list[int], cap: int) -> None:
    """Put ``items`` into the fullest bins that still hold them, largest first; open bins as needed. Bins are replaced, not appended to, as other packings share them."""
    items = sorted(items, key=lambda x: -size[x])
    room = sorted([(cap - f, i) for i, f in enumerate(fill) if cap - f >= size[items[-1]]]) if items else []
    for it in items:
        s = size[it]
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([it])
            fill.append(s)
            insort(room, (cap - s, len(bins) - 1))
        else:
            r, i = room.pop(at)
            bins[i] = [*bins[i], it]
            fill[i] += s
            insort(room, (r - s, i))


def _value(fill: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (their fill squared), which leave room to gain."""
    return -len(fill), sum(map(mul, fill, fill)) / (cap * cap)


def _fills(bins: Bins, size: list[int]) -> list[int]:
    return [sum([size[i] for i in g]) for g in bins]


def _put_back(bins: Bins, fill: list[int], items: list[int], size: list[int], cap: int) -> None:
    """Displaced items by best fit. Where that opens several bins, they are filled anew together if it makes them better."""
    kept = len(bins)
    _best_fit(bins, fill, items, size, cap)
    if len(bins) > kept + 1:
        anew = _fullest([i for g in bins[kept:] for i in g], size, cap)
        fills = _fills(anew, size)
        if _value(fills, cap) > _value(fill[kept:], cap):
            bins[kept:], fill[kept:] = anew, fills


def _cross(a: Packing, b: Packing, size: list[int], cap: int, rng: random.Random) -> Packing:
    """Child of ``a``: some whole well-filled bins of ``b`` are injected, bins of ``a`` with duplicates are
    dissolved, and the displaced items are put back by best fit."""
    order = sorted(range(len(b[0])), key=lambda j: -b[1][j])
    good = order[: max(1, len(order) // 2)]
    take = rng.sample(good, rng.randint(1, max(1, len(good) // 2)))
    chosen = [b[0][j] for j in take]
    inside = {i for g in chosen for i in g}
    bins, fill, displaced = [], [], []
    for g, f in zip(*a):
        if inside.isdisjoint(g):
            bins.append(g)
            fill.append(f)
        else:
            displaced += [i for i in g if i not in inside]
    # The emptiest bin is dissolved too: only so can a bin be saved.
    if bins:
        w = fill.index(min(fill))
        displaced += bins.pop(w)
        fill.pop(w)
    bins += chosen
    fill += [b[1][j] for j in take]
    _put_back(bins, fill, displaced, size, cap)
    return bins, fill


def _mutate(a: Packing, size: list[int], cap: int, rng: random.Random) -> Packing:
    """``a`` without its emptiest bin, some badly filled ones and three times as many of any kind (up to a fifteenth of all); what they
    held is put back by best fit."""
    every = range(len(a[0]))
    roomy = [j for j, f in enumerate(a[1]) if f < _WELL * cap]
    n = rng.randint(1, max(1, len(every) // 60))
    out = {a[1].index(min(a[1])), *rng.sample(roomy, min(n, len(roomy))), *rng.sample(every, min(3 * n, len(every)))}
    bins = [g for j, g in enumerate(a[0]) if j not in out]
    fill = [f for j, f in enumerate(a[1]) if j not in out]
    _put_back(bins, fill, [i for j in sorted(out) for i in a[0][j]], size, cap)
    return bins, fill


def _fullest(items: list[int], size: list[int], cap: int) -> Bins:
    """Bins one after the other: the largest item left, and again and again the one or two others that leave least room beside it."""
    left = sorted(items, key=lambda i: size[i])
    sizes = [size[i] for i in left]
    bins: Bins = []
    while left:
        bins.append([left.pop()])
        room = cap - sizes.pop()
        while sizes and sizes[0] <= room:
            k = bisect_right(sizes, room) - 1
            least, take = room - sizes[k], (k,)
            a, b = 0, min(len(sizes), bisect_right(sizes, room - sizes[0])) - 1
            # Beside each item in turn, from the largest down, the largest smaller one that fits.
            while a < b and least:
                a = max(a, min(b, bisect_right(sizes, room - sizes[b], a)) - 1)
                over = sizes[a] + sizes[b] - room
                if over <= 0 and -over < least:
                    least, take = -over, (a, b)
                b -= 1
            for k in reversed(take):
                room -= sizes.pop(k)
                bins[-1].append(left.pop(k))
    return bins


def _refilled(bins: Bins, size: list[int], cap: int, good: float) -> Bins:
    """The items of bins below ``good`` filled anew together."""
    well = [sum([size[i] for i in g]) >= good * cap for g in bins]
    return [g for g, w in zip(bins, well) if w] + _fullest([i for g, w in zip(bins, well) if not w for i in g], size, cap)


def _start(size: list[int], cap: int, rng: random.Random, how: int) -> Packing:
    """First individual: best fit by falling size; second: the same, the badly filled bins filled anew; third: the fullest bins;
    others: the fullest bins of random halves, the badly filled ones filled anew together."""
    bins: Bins = []
    items = list(range(len(size)))
    if how < 2:
        fill: list[int] = []
        _best_fit(bins, fill, items, size, cap)
        if how == 0:
            return bins, fill
        bins = _refilled(bins, size, cap, _WELL)
    elif how == 2:
        bins = _fullest(items, size, cap)
    else:
        rng.shuffle(items)
        half = len(items) // 2
        bins = _refilled(_fullest(items[:half], size, cap) + _fullest(items[half:], size, cap), size, cap, 0.98)
    return bins, _fills(bins, size)


def least_bins(size: list[int], cap: int) -> int:
    """A number of bins that no packing can do with fewer than.

    Items above half a bin share none with each other; for each k, items above cap - k share none with items of k and more, and what of the items
    from k to half a bin doesn't fit beside those above half needs bins of its own.
    """
    s = sorted(size)
    upto = [0, *accumulate(s)]
    half = bisect_left(s, cap // 2 + 1)
    best = max(math.ceil(upto[-1] / cap), len(s) - half)
    for k in sorted({v for v in s[:half] if v > 0}):
        alone, low = bisect_left(s, cap - k + 1), bisect_left(s, k)
        alone = max(alone, half)
        room = (alone - half) * cap - (upto[alone] - upto[half])
        best = max(best, len(s) - half + max(0, math.ceil((upto[half] - upto[low] - room) / cap)))
    return best


def evolve(size: list[int], cap: int, population: list[Bins], rng: random.Random, members: int = 6, generations: int = 12) -> list[Bins]:
    """One epoch of one island; the best individual comes first. Ends early where fewer bins are impossible.

    Parents are drawn by rank: the better of two for the one, any other for the second. Each generation brings two children by crossover
    and a mutant of each of the parents; whatever is better than the worst member and not as good as another takes its place.
    """
    least = least_bins(size, cap)
    pop = [(_value(fill, cap), (p, fill)) for p in population for fill in [_fills(p, size)]]
    while len(pop) < members and not (pop and max(v[0] for v, _ in pop) >= -least):
        new = _start(size, cap, rng, len(pop))
        pop.append((_value(new[1], cap), new))
    pop.sort(key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -pop[0][0][0] <= least or len(pop) < 2:
            break
        i = min(rng.sample(range(len(pop)), 2))
        j = rng.choice([x for x in range(len(pop)) if x != i])
        a, b = pop[i][1], pop[j][1]
        for new in (_cross(a, b, size, cap, rng), _cross(b, a, size, cap, rng), _mutate(a, size, cap, rng), _mutate(b, size, cap, rng)):
            v = _value(new[1], cap)
            if v > pop[-1][0] and all(v != w for w, _ in pop):
                pop[-1] = (v, new)
                pop.sort(key=lambda x: x[0], reverse=True)
    return [p for _, (p, _) in pop]


def _flat(bins: Bins) -> list[int]:
    """The bin of each item."""
    out = [0] * sum(map(len, bins))
    for b, g in enumerate(bins):
        for i in g:
            out[i] = b
    return out


def _nested(flat) -> Bins:
    bins: Bins = [[] for _ in range(max(flat) + 1 if len(flat) else 0)]
    for i, b in enumerate(flat):
        bins[b].append(i)
    return bins


_STATE = "container_kind string, cap long, shard long, ids array<long>, sizes array<long>, island int, pop array<array<int>>"


def _epoch(seed: int, members: int, generations: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pops = []
            for r in pdf.itertuples(index=False):
                size = [int(x) for x in r.sizes]
                rng = random.Random(f"{seed}/{r.container_kind}/{r.shard}/{r.island}")
                pops.append([_flat(p) for p in evolve(size, int(r.cap), [_nested([int(x) for x in p]) for p in r.pop], rng, members, generations)])
            yield pdf.assign(pop=pops)

    return run


def _pack_shards(shards: DataFrame, n_shards: int, seed: int, islands: int, epochs: int, members: int, generations: int) -> DataFrame:
    """The best packing found for each shard: ``container_kind, cap, shard, ids, sizes, best``.

    Every island of a shard evolves its own population over all items of the shard. After each epoch its elite moves to the next
    island of the ring: rows of islands are exchanged, never the items of other shards.
    A partition holds some four islands, each alone while there are few.
    """
    parts = min(n_shards * islands, max(64, math.ceil(n_shards * islands / 4)))
    empty = F.array().cast("array<array<int>>")
    state = shards.select("*", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), empty.alias("pop"))
    for e in range(epochs):
        state = state.repartition(parts, "container_kind", "shard", "island").mapInPandas(_epoch(seed + e, members, generations), _STATE)
        if e < epochs - 1:
            state = materialise(state, "islands")
            elite = state.select("container_kind", "shard", ((F.col("island") + 1) % islands).alias("island"), F.col("pop")[0].alias("elite"))
            state = state.join(elite, ["container_kind", "shard", "island"]).withColumn("pop", F.array_union(F.array("elite"), F.slice("pop", 1, members - 1))).select(*[c.split()[0] for c in _STATE.split(", ")])
    bins = F.array_max(F.col("pop")[0])
    best = state.groupBy("container_kind", "shard").agg(F.min_by(F.struct("cap", "ids", "sizes", F.col("pop")[0].alias("best")), F.struct(bins.alias("n"), F.col("island"))).alias("b"))
    return best.select("container_kind", "b.cap", "shard", "b.ids", "b.sizes", "b.best")


def pack(
    items: DataFrame,
    containers: DataFrame,
    shard_items: int = 5_000,
    islands: int = 2,
    epochs: int = 3,
    members: int = 6,
    generations: int = 24,
    levels: int = 3,
    good: float = 0.99,
    seed: int = 11,
) -> DataFrame:
    """``container_kind, container_id, id, piece_no, n_tokens``: every item of ``items(id long, n_tokens)`` in
    containers of every kind of ``containers(container_kind, capacity_tokens)``.

    An item above the capacity is cut into full pieces, each a container of its own, and a rest;
    all else stays whole. Items are dealt to shards of about ``shard_items`` by hash, so that the work grows with the data and no
    search sees more than a shard. The grouping genetic algorithm packs all items of a shard, on ``islands`` islands with elite migration between
    ``epochs``; it stops where fewer containers are
    impossible (:func:`least_bins`). Items whose containers stay below ``good`` are dealt anew, into
    fewer shards, up to ``levels`` times, so that the half-empty last container of each shard doesn't stay.

    Defined cases: null or negative sizes count as 0; items of size 0 are put in some container too; ids are distinct, rows without
    are left out;
    an empty table or no container gives an empty result; kinds with null or non-positive capacity are left out.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("cap")).where("container_kind is not null and cap > 0").dropDuplicates(["container_kind"])
    sized = items.where("id is not null").select("id", F.greatest(F.lit(0), F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n"))
    # Few kinds: each item is repeated once per kind.
    caps = kinds.limit(1_001).collect()
    if len(caps) > 1_000:
        raise ValueError("more than 1,000 kinds of container")
    each = F.array(*[F.struct(F.lit(r["container_kind"]).alias("container_kind"), F.lit(r["cap"]).alias("cap")) for r in caps]) if caps else F.array().cast("array<struct<container_kind:string,cap:bigint>>")
    cut = sized.select("id", "n", F.explode(each).alias("k")).select("id", "n", "k.container_kind", "k.cap").withColumn("full", F.when(F.col("n") > F.col("cap"), F.expr("n div cap")).otherwise(F.lit(0)))
    cut = materialise(cut, "cut")
    whole = cut.where("full > 0").select("container_kind", "id", "cap", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece_no")).select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("full"), "id", "piece_no").alias("container_id"), "id", "piece_no", F.col("cap").alias("n_tokens")
    )
    rest = cut.withColumn("n", F.col("n") - F.col("full") * F.col("cap")).where("full = 0 or n > 0").select("container_kind", "cap", "id", "n", (F.col("full") + 1).alias("piece_no"))
    rest = materialise(rest, "rest")
    pool = rest.select("container_kind", "cap", "id", "n")
    placed: list[DataFrame] = []
    for level in range(levels):
        counts = {r["container_kind"]: r["c"] for r in pool.groupBy("container_kind").agg(F.count("*").alias("c")).collect()}
        if not counts:
            break
        dealt = {kind: max(1, math.ceil(c / shard_items)) for kind, c in counts.items()}
        n_shards = F.lit(1).cast("long")
        for kind, c in dealt.items():
            n_shards = F.when(F.col("container_kind") == kind, F.lit(c).cast("long")).otherwise(n_shards)
        shards = (
            pool.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + level), "id"), n_shards))
            .groupBy("container_kind", "cap", "shard")
            .agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("items"))
            .select("container_kind", "cap", "shard", F.col("items.id").alias("ids"), F.col("items.n").alias("sizes"))
        )
        best = _pack_shards(materialise(shards, "shards"), sum(dealt.values()), seed + 100 * level, islands, epochs, members, generations)
        rows = best.select("container_kind", "cap", "shard", F.explode(F.arrays_zip("ids", "sizes", "best")).alias("i")).select("container_kind", "cap", "shard", F.col("i.ids").alias("id"), F.col("i.sizes").alias("n"), F.col("i.best").alias("bin"))
        rows = materialise(rows, "placed")
        named = rows.withColumn("container_id", F.concat_ws("-", "container_kind", F.lit(level), "shard", "bin"))
        if level == levels - 1 or all(c <= shard_items for c in counts.values()):
            placed.append(named.select("container_kind", "container_id", "id", "n"))
            break
        fill = rows.groupBy("container_kind", "shard", "bin").agg((F.sum("n") / F.max("cap") >= good).alias("keep"))
        judged = materialise(named.join(fill, ["container_kind", "shard", "bin"]), "judged")
        drop_table(rows)
        placed.append(judged.where("keep").select("container_kind", "container_id", "id", "n"))
        pool = judged.where("not keep").select("container_kind", "cap", "id", "n")
    out = whole
    for p in placed:
        out = out.unionByName(p.join(rest.select("container_kind", "id", "piece_no"), ["container_kind", "id"]).select("container_kind", "container_id", "id", "piece_no", F.col("n").alias("n_tokens")))
    return out


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, the least possible number by total size, and the share of space filled."""
    kinds = containers.select("container_kind", F.col("capacity_tokens").alias("cap"))
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"))
    return (
        per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
        .join(kinds, "container_kind")
        .select("container_kind", F.col("cap").alias("capacity_tokens"), "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("cap")).alias("least_possible"), (F.col("n_tokens") / (F.col("n_containers") * F.col("cap"))).alias("fill_rate"))
    )
