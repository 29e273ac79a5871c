"""What must hold of the llm queries on the given tables, row by row."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from hitloom.llm import queries as Q, similarity as D, tokens as T
from tests.compare import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name):
    return Q.QUERIES[name](spark, DATA).collect()


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def test_p4_against_all_pairs(spark):
    """Every two coincidences matched point by point: members of a group differ by two points at most, each having lost or won one."""
    sets = {}
    for r in table(spark, "coincidences"):
        p = sorted([(q["x"], q["y"], q["z"]) for q in r["points"] or [] if None not in (q["x"], q["y"], q["z"])])
        if p and r["event_id"] is not None:
            sets[r["event_id"]] = min(p, sets.get(r["event_id"], p))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = np.array(sets[i]), np.array(sets[j])
            m = D.matched(a, b)
            if max(len(a), len(b)) - m <= 2 and 2 * m > max(len(a), len(b)):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    want = {(top(i), i) for i in ids if top(i) != i}
    assert {tuple(r) for r in rows(spark, "p4_found")} == want
    sizes = Counter(a for a, _ in want)
    got = rows(spark, "p4_groups")
    assert {(r["cluster"], r["size"]) for r in got} == {(k, v + 1) for k, v in sizes.items()}
    assert all(1 <= len(r["typical_members"]) <= 3 and all(top(m) == r["cluster"] for m in r["typical_members"]) for r in got)


def test_p5_splits_leak_nothing_and_meet_their_shares(spark):
    got, given = rows(spark, "p5_splits"), table(spark, "training_rows")
    assert len(got) == len({(r["row_id"], r["ray_event_id"], r["ray_cluster_id"]) for r in given})
    for key in ("ray_event_id", "ray_cluster_id"):
        seen = defaultdict(set)
        for r in got:
            if r[key] is not None and r[key] != -1:
                seen[r[key]].add(r["split_name"])
        assert all(len(v) == 1 for v in seen.values())
    share = Counter(r["split_name"] for r in got)
    for r in table(spark, "split_targets"):
        assert abs(share[r["split_name"]] / len(got) - r["target_share"]) < 0.02


def test_p6_places_every_document_once_and_overfills_nothing(spark):
    docs = {r["doc_id"]: T.count_tokens(r["text"]) for r in table(spark, "documents")}
    got = rows(spark, "p6_containers")
    for kind in table(spark, "container_sizes"):
        own = [r for r in got if r["container_kind"] == kind["container_kind"]]
        fill, per = Counter(), defaultdict(list)
        for r in own:
            fill[r["container_id"]] += r["n_tokens"]
            per[r["doc_id"]].append(r["n_tokens"])
        assert max(fill.values()) <= kind["capacity_tokens"]
        assert {k: sum(v) for k, v in per.items()} == docs
        assert all(len(v) == 1 or docs[k] > kind["capacity_tokens"] for k, v in per.items())


def test_p7_keeps_caps_and_meets_shares(spark):
    targets = {r["source"]: r for r in table(spark, "source_targets")}
    source = {r["doc_id"]: r["source"] for r in table(spark, "documents")}
    mix = rows(spark, "p7_mix")
    uses, tokens = Counter(r["doc_id"] for r in mix), Counter()
    for r in mix:
        tokens[r["source"]] += r["n_tokens"]
        assert source[r["doc_id"]] == r["source"]
    assert all(n <= targets[source[d]]["max_repeats"] for d, n in uses.items())
    there = {s for s in targets if any(x == s for x in source.values())}
    whole = sum(targets[s]["target_share"] for s in there)
    shares = {r["source"]: r["reached_share"] for r in rows(spark, "p7_shares")}
    for s in there:
        assert shares[s] == pytest.approx(tokens[s] / sum(tokens.values()))
        assert abs(shares[s] - targets[s]["target_share"] / whole) < 0.05  # a document is a large part of the smallest table
    key = [r["position_key"] for r in mix]
    assert key == sorted(key) and [r["doc_id"] for r in mix] != sorted(r["doc_id"] for r in mix)


def test_p8_calls_only_texts_cut_and_its_rates_add_up(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents")}
    found = {r["doc_id"] for r in rows(spark, "p8_found")}
    assert found and all(texts[d] for d in found)
    # A text that ends with a mark of its end somewhere in the corpus is complete; most cut ones end in a letter or a comma.
    assert sum(texts[d].rstrip(" .…\n�")[-1:].isalpha() or texts[d].rstrip()[-1:] in ",.…�" or texts[d].rstrip()[-1:].isdigit() for d in found) >= 0.8 * len(found)
    rates = rows(spark, "p8_rates")
    assert sum(r["n_cut"] for r in rates) == len(found) and sum(r["n_texts"] for r in rates) == sum(1 for t in texts.values() if t)


def test_p2_days_agree_with_exact_percentiles(spark):
    exact = {(r["level"], r["crystal_no"], r["seg_no"], r["p"]): r for r in rows(spark, "p2_percentiles")}
    merged = rows(spark, "p2_days_combined")
    assert len(merged) == len(exact)
    for r in merged:
        x = exact[r["level"], r["crystal_no"], r["seg_no"], r["p"]]
        assert r["n"] == x["n"] and r["lo"] <= x["lo"] <= r["hi"] and r["hi"] - r["lo"] < 0.001 * (1 + 1e-9)
