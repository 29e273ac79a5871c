import math
import random

import pytest

from hitloom.llm import mixture as M
from hitloom.llm.tokens import count_tokens, encoder, with_token_counts

SIZED = "id long, source string, n_tokens long, n int, steps int"


def sized(spark, n=3000):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]), rng.randint(0, 900), 0, 0) for i in range(n)]
    return spark.createDataFrame(rows, SIZED).select("id", "source", "n_tokens")


def targets(spark):
    return spark.createDataFrame([("big", 0.4, 1), ("mid", 0.35, 2), ("small", 0.2, 4), ("gone", 0.05, 9)], "source string, target_share double, max_repeats int")


def test_shares_caps_and_order(spark):
    s = sized(spark)
    plan = M.mixture_plan(s, targets(spark)).cache()
    mixed = M.mix(s, plan).cache()
    got = {r["source"]: r for r in M.shares(mixed, plan).collect()}
    assert set(got) == {"big", "mid", "small", "gone"} and got["gone"]["reached_share"] == 0
    for k, share in (("big", 0.4), ("mid", 0.35), ("small", 0.2)):
        assert got[k]["reached_share"] == pytest.approx(share / 0.95, abs=0.004)
        assert got[k]["most_repeats"] <= got[k]["cap"]
    rows = mixed.collect()
    keys = [r["position_key"] for r in rows]
    assert keys == sorted(keys) and all(r["n_tokens"] > 0 for r in rows)
    assert len({(r["id"], r["copy_no"]) for r in rows}) == len(rows)
    assert [r["id"] for r in M.mix(s, plan).collect()] == [r["id"] for r in rows]


def test_steps_are_the_poisson_distribution():
    s = M.poisson_steps(1.3, 4)
    assert s == pytest.approx([sum(math.exp(-1.3) * 1.3**j / math.factorial(j) for j in range(k + 1)) for k in range(4)])
    assert M.poisson_steps(0.0, 2) == [1.0, 1.0]


def test_more_than_there_is(spark):
    s = sized(spark, 300)
    plan = M.mixture_plan(s, targets(spark), total_tokens=10**9).cache()
    assert all(r["most_repeats"] == r["cap"] for r in M.shares(M.mix(s, plan), plan).collect() if r["tokens"])


def test_empty(spark):
    s = sized(spark, 0)
    plan = M.mixture_plan(s, targets(spark))
    assert M.mix(s, plan).count() == 0 and M.shares(M.mix(s, plan), plan).count() == 4


def test_token_counts(spark):
    texts = [None, "", "Hello, world!", "<|endoftext|> x", "a" * 5000, " " * 5000 + "b", "█" * 3000 + "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(df, "text").collect()}
    assert got == {i: len(encoder().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert count_tokens("\n" * 300_000) > 0
