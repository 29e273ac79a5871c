import struct

import pytest
from pyspark.sql import functions as F

from hitloom.plans import pipeline as PL
from hitloom.sources import ascii as A, frames as B
from hitloom.streaming.coincidences import coincidence_stream, folded


def crystal_body(crystal, ts, pts, tot):
    b = B.CRYSTAL.pack(0, crystal, len(pts), tot, 1, 2, 3, 4, ts, ts, *[0.5] * 7, 0)
    for p in pts:
        b += B.CRYSTAL_POINT.pack(*p, 7, p[3])
    return b + b"\0" * B.CRYSTAL_POINT.size * (B.MAX_POINTS - len(pts))


def write_raw(path):
    recs = []
    for i in range(50):
        ts = 1000 * i
        recs.append((1, ts, crystal_body(5, ts, [(200.0, 1.0, 5.0, 100.0), (210.0, 8.0, 9.0, 200.0)], 303.0)))
        recs.append((1, ts + 20, crystal_body(6, ts + 20, [(-190.0, 30.0, 2.0, 511.0)], 511.0)))
        recs.append((99, ts, b"unknown"))
    with open(path, "wb") as f:
        for k, ts, b in recs:
            f.write(B.HEADER.pack(k, len(b), ts) + b)
        f.write(B.HEADER.pack(1, 464, 5)[:10])  # cut off


def test_layouts():
    assert (B.HEADER.size, B.CRYSTAL.size, B.CRYSTAL_POINT.size, B.RAY.size, B.RAY_HEAD.size, B.RAY_POINT.size, B.RAY_TAIL.size) == (16, 80, 24, 64, 24, 24, 8)


@pytest.mark.parametrize("split", [1 << 30, 2_000])
def test_frames_and_crystals(spark, tmp_path, split):
    path = str(tmp_path / "raw.bin")
    write_raw(path)
    B.register(spark)
    f = spark.read.format("hitframes").option("types", "1").option("splitBytes", split).load(path)
    assert f.count() == 100
    c = B.decode_crystals(f)
    row = c.where("crystal_id = 5").orderBy("timestamp").first()
    assert row["num"] == 2 and len(row["points"]) == 2 and row["points"][1]["e"] == 200.0
    m = spark.createDataFrame([(5, [float(v) for v in (0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 0, 1)])], "crystal_id int, m array<double>")
    p = B.crystal_points(c, m).where("crystal_id = 5 and i = 0").first()
    assert (p["x"], p["y"], p["z"]) == (1.0, 200.0, 15.0)


def test_raw_to_tracked_and_back(spark, tmp_path):
    raw, out, short = (str(tmp_path / n) for n in ("raw.bin", "out", "short"))
    write_raw(raw)
    PL.track_file(spark, raw, out, PL.Options(full_output=True, score_method="oft", order_method="oft"))
    full = B.decode_tracked_full(B.frames(spark, out, 33)).collect()
    assert len(full) == 100
    two = next(r for r in full if r["ndet"] == 2)
    assert two["esum"] == pytest.approx(303.0, rel=1e-5) and sorted(round(p["e"]) for p in two["points"]) == [101, 202]
    assert {r["crystal_no"] for r in full} == {5, 6}
    PL.convert_file(spark, out, short)
    t = B.decode_tracked(B.frames(spark, short, 3)).collect()
    assert len(t) == 100 and sum(r["second_hit"] is not None for r in t) == 50
    PL.rescore_file(spark, out, str(tmp_path / "new"), PL.Options(full_output=True, score_method="zeros"))
    new = B.decode_tracked_full(B.frames(spark, str(tmp_path / "new"), 33)).collect()
    strip = lambda r: (r["esum"], r["ndet"], r["timestamp"], r["crystal_no"], [tuple(p) for p in r["points"]])
    assert {r["fom"] for r in new} == {0.0} and sorted(map(strip, new)) == sorted(map(strip, full))
    again = {(r["event_id"], r["cluster_id"]): r["fom"] for r in PL.rescored_file(spark, out).collect()}
    for r in full:
        assert again[r["offset"], r["ray_no"]] == pytest.approx(r["fom"], rel=1e-3, abs=1e-6)


def test_grammars():
    assert list(A.steps(["1 1 1 100 10 20 30", "1 2 1 0 50 1 2 3", "2 1 1 7 1 1 1"])) == [(1, 1, 1, 1.0, 2.0, 3.0, 0.1, None, None, None, None), (1, 2, 2, 0.1, 0.2, 0.3, 0.05, None, None, None, None), (2, 1, 1, 0.1, 0.1, 0.1, 0.007, None, None, None, None)]
    m30 = ["FORMAT", "GAMMA 2", "$", "-1 500", "3 100 10 20 30 4 1.5 1", "-1 600", "-1 700", "5 200 1 1 1 2 0 2", "-1 800"]
    assert [(r[0], r[1], r[2], r[8]) for r in A.multiplicity(m30)] == [(0, 1, 1, 3), (1, 1, 1, 5)]
    assert list(A.true_energies(m30)) == [(0, 1, 500.0), (0, 2, 600.0), (1, 1, 700.0), (1, 2, 800.0)]
    assert [r[:3] for r in A.filtered(["event_id 4", "sum 1", "1: [1] 100 1 2 3", "2: [2] 50 1 2 3"])] == [(4, 1, 1), (4, 2, 2)]
    assert [r[8] for r in A.raw_steps(["event_id 4", "----", "1 [ 12] 100 1 2 3 a b", "2 [7] 50 1 2 3 a b"])] == [12, 7]
    d = ["D 1 9", "C 4 2", "1 100 1 2 3", "2 50 4 5 6", "E 1 1 9", "1000 0 0 0 1 2 0.1"]
    assert [(r[0], r[2], r[8], r[9]) for r in A.crystals(d)] == [(9, 1, 4, 1), (9, 2, 4, 2)]
    assert list(A.emitted(d)) == [(9, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 0.1, 1)]
    assert [r[:3] for r in A.measured(["filtered_012.x", "#1 a b 1 2 3 0.5 (t=77)", "We"])] == [(12, None, 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1 1 100 10 20 30\n1 1 2 50 10 20 30\n")
    (tmp_path / "b.txt").write_text("7 1 1 100 10 20 30\n")
    assert A.read_hits(spark, str(tmp_path), "steps").count() == 3


@pytest.mark.parametrize("anchored", ["first", "last"])
def test_stream_equals_fold(spark, tmp_path, anchored):
    rows = [(s, t, 1.0) for s in (1, 2) for t in [0, 30, 50, 90, 500, 510, 5000, 5039, 5078, 20_000]]
    df = spark.createDataFrame(rows, "shard int, ts long, e double")
    src = tmp_path / "in"
    for i, part in enumerate((df.where("ts < 60"), df.where("ts >= 60"))):
        part.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = coincidence_stream(stream, 40, 100, anchored).writeStream.format("memory").queryName(f"c_{anchored}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table(f"c_{anchored}").collect()}
    want = {(s, *c) for s in (1, 2) for c in folded([r[1] for r in rows if r[0] == s], [1.0] * 10, 40, anchored) if c[1] < 20_000}
    assert got == want


def test_cut_record_is_left_out(spark, tmp_path):
    f = spark.createDataFrame([(0, 1, 5, struct.pack("<i", 3))], B.FRAME)
    assert B.decode_crystals(f).count() == 0 and B.decode_tracked(f).where(F.lit(True)).count() == 0


def test_spans_start_at_records_and_damage_is_told(spark, tmp_path):
    path = str(tmp_path / "raw.bin")
    write_raw(path)
    data = open(path, "rb").read()
    B.register(spark)
    load = lambda split=1 << 30: spark.read.format("hitframes").option("splitBytes", split).load(path)
    whole = sorted(tuple(r) for r in load().select("offset", "type", "ts").collect())
    for split in (300, 1_111, 4_096):
        assert sorted(tuple(r) for r in load(split).select("offset", "type", "ts").collect()) == whole
    # A header overwritten in the middle, and a record cut at the end.
    at = whole[len(whole) // 2][0]
    with open(path, "wb") as h:
        h.write(data[:at] + b"\xff" * 16 + data[at + 16 : -3])
    f = load()
    got = f.collect()
    good = {r["offset"] for r in got if r["type"] != B.DAMAGED}
    assert good == {o for o, *_ in whole} - {at, whole[-1][0]}
    assert {r["offset"] for r in B.damaged(f).collect()} == {at, whole[-1][0]}
    assert sum(r["ts"] for r in got if r["type"] == B.DAMAGED) == sum(len(r["body"]) for r in got if r["type"] == B.DAMAGED) > 0


def test_short_records_are_told(spark):
    full = B.RAY_COUNT.pack(1, 0) + B.RAY_HEAD.pack(1.0, 1, 0.5, 1, 7) + B.RAY_POINT.pack(1, 2, 3, 4, 5, 6, 0.5) + B.RAY_TAIL.pack(6, 0, 0.0, 0.0)
    rows = [(0, 33, 5, full), (100, 33, 5, full[:-2]), (200, 3, 5, B.RAY_COUNT.pack(2, 0)), (300, 33, 5, B.RAY_COUNT.pack(0, 0)), (400, 1, 5, b"x")]
    f = spark.createDataFrame(rows, B.FRAME)
    one = B.decode_tracked_full(f).collect()
    assert [(r["offset"], r["ndet"], r["points"][0]["dt"], r["points"][0]["crystal_no"]) for r in one] == [(0, 1, 5, 6)]
    assert sorted(r["offset"] for r in B.damaged(f).collect()) == [100, 200, 400]
    assert B.decode_tracked(f).count() == 0 and B.decode_crystals(f).count() == 0


def test_emitted_records(spark):
    body = B.EMITTED.pack(2, 5, 1, 0.25) + B.EMITTED_RAY.pack(1, 1173.0, 0.1, 0.2, 0.3) + B.EMITTED_RAY.pack(2, 1332.0, 0.4, 0.5, 0.6)
    r = B.decode_emitted(spark.createDataFrame([(0, 11, 9, body), (50, 11, 9, body[:-1])], B.FRAME)).collect()
    assert len(r) == 1 and (r[0]["num"], r[0]["full"], r[0]["first_value"]) == (5, 1, 0.25) and [q["energy"] for q in r[0]["rays"]] == [1173.0, 1332.0] and r[0]["rays"][1]["mark"] == 2


def test_overwrite_keeps_the_old_until_the_new_is_there(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(0, 3, 1, B.RAY_COUNT.pack(0, 0))], B.FRAME)
    B.write_frames(good, out, "overwrite")
    bad = good.mapInPandas(lambda it: (1 / 0 for _ in it), B.FRAME)
    with pytest.raises(Exception):
        B.write_frames(bad, out, "overwrite")
    assert B.frames(spark, out).count() == 1
    B.write_frames(good.unionByName(good), out, "overwrite")
    assert B.frames(spark, out).count() == 2
    B.write_frames(good, out)
    assert B.frames(spark, "file://" + out).count() == 3


def test_blocks_are_read_apart(spark, tmp_path):
    text = "".join(f"event_id {i}\nsum 1\n1: [1] 100 1 2 3\n12: [2] 50 1 2 3\n" for i in range(50))
    (tmp_path / "f.txt").write_text(text)
    got = sorted((r["event_id"], r["ray"], r["point_idx"]) for r in A.read_hits(spark, str(tmp_path / "f.txt"), "filtered").select("event_id", F.col(A.SCHEMA.split(", ")[1].split()[0]).alias("ray"), "point_idx").collect())
    assert got == [(i, r, p) for i in range(50) for r, p in ((1, 1), (12, 2))]
    d = "".join(f"D 1 {i}\nC 4 1\n1 100 1 2 3\nE 1 1 {i}\n1000 0 0 0 1 2 0.1\n" for i in range(20))
    (tmp_path / "d.txt").write_text(d)
    assert A.read_hits(spark, str(tmp_path / "d.txt"), "crystals").count() == 20 and A.read_emitted(spark, str(tmp_path / "d.txt")).count() == 20


HIT = "event_id long, point_idx int, x double, y double, z double, e double, ts long, crystal_no int, seg_no int, interaction_type int, pad int"


def test_pads_time_gap_and_second_order(spark):
    row = lambda ev, i, x, y, e, ts=0, pad=0: (ev, i, x, y, 0.0, e, ts, 1, 1, 1, pad)
    near = [row(1, 1, 20.0, 0.0, 0.3), row(1, 2, 21.0, 0.5, 0.2), row(2, 1, 20.0, 0.0, 0.3), row(2, 2, 21.0, 0.5, 0.2, 0, 1), row(3, 1, 20.0, 0.0, 0.3), row(3, 2, 21.0, 0.5, 0.2, 900)]
    h = spark.createDataFrame(near, HIT)
    got = {(r["event_id"], r["cluster_id"]): (r["n"], r["tracked"]) for r in PL.track(h).collect()}
    assert got == {(1, 0): (2, True), (2, 0): (2, False), (3, 0): (1, True), (3, 1): (1, True)}
    loose = PL.Options(suppress_bad_pad=False, cluster_gap=None)
    assert {(r["event_id"], r["n"], r["tracked"]) for r in PL.track(h, loose).collect()} == {(i, 2, True) for i in (1, 2, 3)}
    twice = {r["event_id"]: r["fom"] for r in PL.track(h.where("event_id = 1"), PL.Options(second_order=True)).collect()}
    once = {r["event_id"]: r["fom"] for r in PL.track(h.where("event_id = 1"), PL.Options(order_method="angle")).collect()}
    assert twice == once
    stats = {(r["what"], r["value"]): r["n"] for r in PL.run_statistics(h).collect()}
    assert stats["pad", "1"] == 1 and stats["crystal", "1"] == 6 and stats["clusters", None] == 4 and stats["tracked clusters", None] == 3


def test_options_by_either_names(tmp_path):
    (tmp_path / "o.yaml").write_text("DETECTOR: GRETA\nMONSTER_SIZE: 6\nNUM_PROCESSES: 3\norder_FOM_kwargs:\n  fom_method: aft\n  width: 4\ncluster_kwargs:\n  alpha_degrees: 15\n  time_gap: 20\n")
    o = PL.Options.load(str(tmp_path / "o.yaml"))
    assert (o.detector, o.max_ordered, o.order_method, o.width, o.alpha_degrees, o.cluster_gap) == ("greta", 6, "aft", 4, 15, 20)
    assert PL.Options() == PL.Options(order_method="selected", score_method="angle", alpha_degrees=20.0, cluster_gap=40)
    with pytest.raises(ValueError):
        PL.Options.of({"order_FOM_kwargs": {"what": 1}})
