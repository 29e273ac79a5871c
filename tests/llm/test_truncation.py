import random

import numpy as np
from pyspark.sql import functions as F

from hitloom.llm import truncation as C

SCHEMA = "doc_id long, lang string, source string, text string, id string, cut string"
WORDS = "the court notes that claimant relied on lease and disputed boundary survey after hearing without further inquiry under code".split()
ENDS = ["So ordered.", "[…]", "Costs reserved", "Done at Pelorne, {} June 20{}", "Registrar: K. Vesolund", "* * *"]


def text(rng):
    body = " ".join(rng.choice(WORDS) for _ in range(rng.randint(150, 300)))
    return body[0].upper() + body[1:] + ".\n" + rng.choice(ENDS).format(rng.randint(1, 30), rng.randint(10, 24))


def corpus(n=1500):
    rng = random.Random(3)
    rows, cut = [], set()
    for i in range(n):
        t = text(rng)
        if rng.random() < 0.1:
            t = t[: rng.randint(200, len(t) - 45)].rstrip() + rng.choice(["", "", "...", "�", "\n"])
            cut.add(i)
        rows.append((i, rng.choice(["en", "EN", "eng", None]), rng.choice("ab"), t, "", ""))
    return rows, cut


def test_finds_cut_texts(spark):
    rows, cut = corpus()
    rows += [(5000, "en", "a", None, "", ""), (5001, "en", "a", "", "", ""), (5002, "en", "a", "  \n", "", ""), (5003, "en", "a", "x", "", ""), (5004, "en", None, rows[5][3] * 400, "", "")]
    got = {r["doc_id"]: r for r in C.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k for k, r in got.items() if r["cut"] and k < 5000}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut)
    assert 5000 not in got and 5001 not in got and not got[5002]["cut"]
    assert {r["language"] for r in got.values()} == {"en", "other"}


def test_copies_of_a_cut_text_dont_vouch_for_each_other(spark):
    rows, cut = corpus(600)
    one = next(r for r in rows if r[0] in cut)
    rows += [(9000 + i, "en", "c", one[3], "", "") for i in range(200)]
    got = {r["doc_id"]: r["cut"] for r in C.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[9000 + i] for i in range(200))


def test_empty(spark):
    assert C.truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_are_exact():
    texts = ["abracadabra", "x  1 yé Zed Zoo", "a", "ab ra"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t.encode()) for t in texts)])
    views = C._views(raw, starts)
    c, at = views["text"]
    assert [c[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["abracadabra", "x 0 yé Zed Zoo", "a", "ab ra"]
    s, at = views["shape"]
    assert [s[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["abracadabra", "x 0 yé X X", "a", "ab ra"]
    h = C._hashes(c, [2, 12])
    assert h[2][0] == h[2][7] != h[2][1] and len(h[12]) == len(c) - 11


def test_padding_of_any_length_hides_nothing(spark):
    rows, cut = corpus(800)
    pads = [" " * 250, "\n" * 1000, "\x00" * 300, "\ufffd" * 260, " " * 6000, "..." + " " * 400]
    padded = [(i, l, s, t + pads[i % len(pads)] if i in cut else t, a, b) for i, l, s, t, a, b in rows]
    found = lambda r: {x["doc_id"] for x in C.truncated(spark.createDataFrame(r, SCHEMA)).where("cut").collect()}
    plain, got = found(rows), found(padded)
    assert len(plain & cut) >= 0.97 * len(cut) and got == plain


def test_tail_fills_the_longest_context(spark):
    texts = ["short", "x" * 500 + " ends here in words of many kinds, Sir " + "_" * 300, "The Long Name " * 3 + "A" * 5000, "word " * 100, "start of all " * 4 + "=" * 9000]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.tail(C.stripped(F.col("t"))).alias("t")).collect()]
    assert got[0] == "short" and len(got[1]) == len(texts[1]) and got[2] == texts[2] and len(got[3]) == 200 and got[4] == texts[4]


def test_partial_counts_add_up(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = pa.RecordBatch.from_arrays([pa.array([text(rng) for _ in range(40)])], names=["t"])
    full = {k: (18, b"\xff" * (1 << 15)) for k in range(len(C.CONTEXTS))}

    def counts():
        got = {}
        for b in C._count_inner(full)(iter([texts] * 3)):
            for k, h, m in zip(*(c.to_pylist() for c in b.columns)):
                got[k, h] = got.get((k, h), 0) + m
        return got

    want = counts()
    monkeypatch.setattr(C, "PENDING", 500)
    monkeypatch.setattr(C, "HELD", 700)
    assert counts() == want


def test_field_limits(spark):
    rows = [("a", 4000, 4010 + i, i < 9) for i in range(10)] + [("a", 100 + i, 100 + i, False) for i in range(90)] + [(None, 50, 60, True)] * 6 + [("b", 70, 70, False)] * 20 + [("b", 80, 80, True)] * 4
    got = {(r["source"], r["unit"], r["size"]): (r["n"], r["k"]) for r in C.field_limits(spark.createDataFrame(rows, "source string, chars int, bytes int, cut boolean")).collect()}
    assert got["a", "chars", 4000] == (10, 9) and got[None, "bytes", 60] == (6, 6) and got["a", "bytes", 4010] == (1, 1) and ("b", "chars", 70) not in got
    shift = lambda n, k, cut: spark.range(1).select(C.limit_shift(F.lit(n), F.lit(k), F.lit(cut), 0.1)).first()[0]
    assert shift(1, 1, True) == 0 and abs(shift(10, 9, True) - np.log(8.5 / 5.5 * 9)) < 1e-9 and shift(10, 9, False) > shift(10, 9, True) > shift(3, 2, True) > 0 and shift(1000, 20, False) == 0
