"""Framed binary files: a 16-byte header (type, length, time) and a body, as a Python data source.

``spark.read.format("hitframes")`` gives ``offset, type, ts, body``; decoding is a transformation, so only the bodies
of the types asked for leave the reader. ``df.write.format("hitframes")`` writes frames back. Paths may name any file
system that pyarrow knows (``file``, ``hdfs``, ``s3``, ...).
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from hitloom.runtime import ship


class Layout:
    """A binary layout that can be sent to workers, as compiled ones can't."""

    def __init__(self, fmt: str):
        self.fmt, self.size = fmt, struct.calcsize(fmt)

    def pack(self, *values) -> bytes:
        return struct.pack(self.fmt, *values)

    def unpack(self, data: bytes) -> tuple:
        return struct.unpack(self.fmt, data)

    def unpack_from(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.fmt, data, at)


# Layouts of the records, little-endian, without padding.
HEADER = Layout("<iiq")
CRYSTAL = Layout("<iiifiiiiqqfffffffi")
CRYSTAL_POINT = Layout("<ffffif")
RAY_COUNT = Layout("<ii")
RAY = Layout("<fifiqffffffffhhee")
RAY_HEAD = Layout("<fifiq")
RAY_POINT = Layout("<ffffihe")
RAY_TAIL = Layout("<hhee")
EMITTED = Layout("<iiif")
EMITTED_RAY = Layout("<iffff")
# Record types.
TYPE_CRYSTAL, TYPE_TRACKED, TYPE_TRACKED_FULL, TYPE_EMITTED = 1, 3, 33, 11
MAX_POINTS = 16

FRAME = "offset long, type int, ts long, body binary"
#: Type given to what lies between a damaged header and the next good one; ``ts`` is then its length, ``body`` its first bytes.
DAMAGED = -1
#: Largest body of a record, and headers in a row that must be sound for a reader to start there.
LARGEST, CHAIN = 1 << 24, 5


@dataclass
class _Span(InputPartition):
    path: str
    begin: int
    end: int
    size: int


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files with their sizes: the file itself, those of a folder, or those that a pattern names."""
    fs, p = _file_system(path)
    if any(ch in posixpath.basename(p) for ch in "*?["):
        folder, pattern = posixpath.split(p)
        return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch(f.base_name, pattern))
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(p)) if f.is_file and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".tmp"))
    return [(p, info.size)] if info.is_file else []


class HitFrames(DataSource):
    """Options: path (file, folder or pattern), types (comma-separated, all by default), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "hitframes"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.types = {int(t) for t in options.get("types", "").split(",") if t.strip()}
        self.split = int(options.get("splitBytes", 128 << 20))

    def partitions(self):
        """Spans of equal length; no header is read here. A record belongs to the span that its header begins in."""
        return [_Span(f, at, min(at + self.split, size), size) for f, size in _listed(self.path) for at in range(0, size, self.split)]

    def read(self, part: _Span) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            o, k, t, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(k, pa.int32()), pa.array(t, pa.int64()), pa.array(b, pa.binary())], names=["offset", "type", "ts", "body"])

        fs, _ = _file_system(self.path)
        with fs.open_input_file(part.path) as h:

            def bytes_at(at: int, n: int) -> bytes:
                h.seek(at)
                return h.read(n)

            def sound(at: int) -> bool:
                """Whether records follow each other from here, up to ``CHAIN`` of them or the end of the file."""
                for k in range(CHAIN):
                    if at == part.size:
                        return k > 0
                    if at + HEADER.size > part.size:
                        return k > 0  # a header cut by the end of the file
                    kind, length, _ = HEADER.unpack(bytes_at(at, HEADER.size))
                    if not (0 < kind < 256 and 0 <= length <= LARGEST):
                        return False
                    at += HEADER.size + length
                    if at > part.size:
                        return k > 0
                return True

            def next_record(at: int) -> int:
                """The first place from ``at`` on where records follow each other; the end of the file if there is none."""
                while at + HEADER.size <= part.size:
                    w = np.frombuffer(bytes_at(at, (1 << 20) + HEADER.size), np.uint8)
                    n = len(w) - HEADER.size + 1
                    may = (w[:n] > 0) & (w[1 : n + 1] == 0) & (w[2 : n + 2] == 0) & (w[3 : n + 3] == 0) & (w[7 : n + 7] <= LARGEST >> 24)
                    for i in np.flatnonzero(may).tolist():
                        if sound(at + i):
                            return at + i
                    at += n
                return part.size

            at = part.begin if part.begin == 0 else next_record(part.begin)
            while at < part.end:
                head = bytes_at(at, HEADER.size)
                kind, length, ts = HEADER.unpack(head) if len(head) == HEADER.size else (0, -1, 0)
                if 0 < kind and 0 <= length <= LARGEST and at + HEADER.size + length <= part.size:
                    if not self.types or kind in self.types:
                        rows.append((at, kind, ts, h.read(length)))
                        held += length
                    at += HEADER.size + length
                else:  # damaged or cut: told of, and passed over
                    nxt = next_record(at + 1)
                    if not self.types or DAMAGED in self.types:
                        rows.append((at, DAMAGED, nxt - at, bytes_at(at, min(nxt - at, 1 << 16))))
                    at = nxt
                if len(rows) >= 5_000 or held > 32 << 20:
                    if rows:
                        yield batch()
                    rows.clear()
                    held = 0
        if rows:
            yield batch()


class _Writer(DataSourceWriter):
    """Parts are written beside the old ones and take their place when the job has succeeded."""

    def __init__(self, options, schema, overwrite):
        self.path = options["path"]
        self.overwrite = overwrite

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, folder = _file_system(self.path)
        fs.create_dir(folder, recursive=True)
        final = posixpath.join(folder, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin")
        with fs.open_output_stream(final + ".tmp") as h:
            for r in rows:
                h.write(HEADER.pack(r["type"], len(r["body"]), r["ts"]) + bytes(r["body"]))
        return _Done(final)

    def commit(self, messages) -> None:
        fs, folder = _file_system(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file and fnmatch(f.base_name, "part-*.bin")]
        for m in messages:
            if m is not None:
                fs.move(m.path + ".tmp", m.path)
        if self.overwrite:
            for f in old:
                fs.delete_file(f)

    def abort(self, messages) -> None:
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.path + ".tmp").is_file:
                fs.delete_file(m.path + ".tmp")


@dataclass
class _Done(WriterCommitMessage):
    path: str


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(HitFrames)


def frames(spark: SparkSession, path: str, *types: int) -> DataFrame:
    register(spark)
    return spark.read.format("hitframes").option("types", ",".join(map(str, types))).load(path)


# --- decoding -----------------------------------------------------------------------------------

CRYSTALS = (
    "offset long, header_ts long, type int, crystal_id int, num int, tot_e float, core_e array<int>, timestamp long, trig_time long, t0 float, cfd float, chisq float, norm_chisq float,"
    " baseline float, prestep float, poststep float, pad int, points array<struct<x:float,y:float,z:float,e:float,seg:int,seg_e:float>>"
)
_P = "struct<x:float,y:float,z:float,e:float>"
TRACKED = f"offset long, header_ts long, ray_no int, esum float, ndet int, fom float, tracked int, timestamp long, first_hit {_P}, second_hit {_P}, crystal_no int, escaped int, local_energy float, local_fom float"
EMITTED_RAYS = "offset long, header_ts long, n_rays int, num int, full int, first_value float, rays array<struct<mark:int,energy:float,a:float,b:float,c:float>>"
TRACKED_FULL = "offset long, header_ts long, ray_no int, esum float, ndet int, fom float, tracked int, timestamp long, points array<struct<x:float,y:float,z:float,e:float,dt:int,crystal_no:int,energy_factor:float>>, crystal_no int, escaped int, local_energy float, local_fom float"


def _columns(schema: str) -> list[str]:
    return [f.name for f in _arrow(schema)]


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL one, of the few types that records have."""
    depth, parts, cur = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch

    def kind(t: str) -> pa.DataType:
        if t.startswith("array<"):
            return pa.list_(kind(t[6:-1]))
        if t.startswith("struct<"):
            return pa.struct([(n, kind(k)) for n, k in (x.split(":") for x in t[7:-1].split(","))])
        return {"int": pa.int32(), "long": pa.int64(), "float": pa.float32()}[t]

    return pa.schema([(n, kind(t)) for n, t in (x.split(" ", 1) for x in parts)])


class _Bytes:
    """The bodies of a batch as one buffer; fields are gathered by place, all records at once."""

    def __init__(self, body: pa.Array):
        body = body.cast(pa.large_binary())
        off = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        raw = body.buffers()[2]
        self.raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        self.begin, self.end = off[:-1], off[1:]

    def rows(self, at: np.ndarray, layout: Layout, names: list[str]) -> np.ndarray:
        """Records of a layout at the given places, as a structured array."""
        codes = {"i": "<i4", "q": "<i8", "f": "<f4", "h": "<i2", "e": "<f2"}
        kind = np.dtype([(n, codes[c]) for n, c in zip(names, layout.fmt[1:])])
        got = self.raw[at[:, None] + np.arange(kind.itemsize)] if len(at) else np.empty((0, kind.itemsize), np.uint8)
        return np.ascontiguousarray(got).view(kind)[:, 0]


def _structs(rows: np.ndarray, kind: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(rows[f.name].astype(f.type.to_pandas_dtype())) for f in kind], fields=list(kind))


def _lists(rows: np.ndarray, counts: np.ndarray, kind: pa.ListType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _structs(rows, kind.value_type))


def _spread(starts: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """Places of ``counts`` items of ``step`` bytes that follow each other from each start."""
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + (np.arange(counts.sum()) - first) * step


_CRYSTAL_NAMES = ["type", "crystal_id", "num", "tot_e", "c0", "c1", "c2", "c3", "timestamp", "trig_time", "t0", "cfd", "chisq", "norm_chisq", "baseline", "prestep", "poststep", "pad"]
_HEAD_NAMES = ["esum", "ndet", "fom", "tracked", "timestamp"]
_TAIL_NAMES = ["crystal_no", "escaped", "local_energy", "local_fom"]


def _crystals(b: _Bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """Which records are sound, the record of each row, and the columns."""
    ok = b.end - b.begin >= CRYSTAL.size
    at = b.begin[ok]
    v = b.rows(at, CRYSTAL, _CRYSTAL_NAMES)
    room = (b.end[ok] - at - CRYSTAL.size) // CRYSTAL_POINT.size
    n = np.clip(v["num"].astype(np.int64), 0, room)
    pts = b.rows(_spread(at + CRYSTAL.size, n, CRYSTAL_POINT.size), CRYSTAL_POINT, ["x", "y", "z", "e", "seg", "seg_e"])
    core = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(v) + 1, 4, np.int32)), pa.array(np.stack([v[f"c{i}"] for i in range(4)], 1).ravel()))
    kind = _arrow(CRYSTALS).field("points").type
    return ok, np.flatnonzero(ok), {n_: pa.array(v[n_]) for n_ in _CRYSTAL_NAMES if n_ not in ("c0", "c1", "c2", "c3")} | {"core_e": core, "points": _lists(pts, n, kind)}


def _tracked(b: _Bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    ok = b.end - b.begin >= RAY_COUNT.size
    n = np.zeros(len(ok), np.int64)
    n[ok] = b.rows(b.begin[ok], RAY_COUNT, ["n", "_"])["n"]
    ok &= (n >= 0) & (RAY_COUNT.size + np.maximum(n, 0) * RAY.size <= b.end - b.begin)
    n = n[ok]
    names = [*_HEAD_NAMES, *(f"{c}{i}" for i in (1, 2) for c in "xyze"), *_TAIL_NAMES]
    v = b.rows(_spread(b.begin[ok] + RAY_COUNT.size, n, RAY.size), RAY, names)
    kind = _arrow(TRACKED).field("first_hit").type
    hit = lambda i, mask: pa.StructArray.from_arrays([pa.array(v[f"{c}{i}"]) for c in "xyze"], fields=list(kind), mask=mask)
    cols = {c: pa.array(v[c]) for c in _HEAD_NAMES} | {c: pa.array(v[c].astype(np.int32 if v[c].dtype.kind == "i" else np.float32)) for c in _TAIL_NAMES}
    cols |= {"ray_no": pa.array(_spread(np.zeros(len(n), np.int64), n, 1).astype(np.int32)), "first_hit": hit(1, None), "second_hit": hit(2, pa.array(v["ndet"] <= 1))}
    return ok, np.repeat(np.flatnonzero(ok), n), cols


def _tracked_full(b: _Bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """The r-th rays of all records are read together, as where a ray ends follows from its hits."""
    ok = b.end - b.begin >= RAY_COUNT.size
    n, at = np.zeros(len(ok), np.int64), b.begin + RAY_COUNT.size
    n[ok] = b.rows(b.begin[ok], RAY_COUNT, ["n", "_"])["n"]
    ok &= n >= 0
    heads, tails, points, owner, number = [], [], [], [], []
    for r in range(int(n[ok].max(initial=0))):
        live = ok & (n > r)
        ok &= ~live | (at + RAY_HEAD.size <= b.end)
        live &= ok
        h = b.rows(at[live], RAY_HEAD, _HEAD_NAMES)
        size = RAY_HEAD.size + np.maximum(h["ndet"].astype(np.int64), 0) * RAY_POINT.size
        fits = (h["ndet"] >= 0) & (at[live] + size + RAY_TAIL.size <= b.end[live])
        ok[np.flatnonzero(live)[~fits]] = False
        who = np.flatnonzero(live)[fits]
        heads.append(h[fits])
        points.append(at[who] + RAY_HEAD.size)
        tails.append(b.rows(at[who] + size[fits], RAY_TAIL, _TAIL_NAMES))
        owner.append(who)
        number.append(np.full(len(who), r))
        at[who] += size[fits] + RAY_TAIL.size
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    owner, number, points = join(owner, np.int64), join(number, np.int64), join(points, np.int64)
    kind = lambda names, layout: np.dtype([(c, {"i": "<i4", "q": "<i8", "f": "<f4", "h": "<i2", "e": "<f2"}[x]) for c, x in zip(names, layout.fmt[1:])])
    heads, tails = join(heads, kind(_HEAD_NAMES, RAY_HEAD)), join(tails, kind(_TAIL_NAMES, RAY_TAIL))
    order = np.lexsort((number, owner))
    order = order[ok[owner[order]]]  # none of a record that ends too soon
    owner, number, points, heads, tails = (x[order] for x in (owner, number, points, heads, tails))
    counts = heads["ndet"].astype(np.int64)
    pts = b.rows(_spread(points, counts, RAY_POINT.size), RAY_POINT, ["x", "y", "z", "e", "dt", "crystal_no", "energy_factor"])
    cols = {c: pa.array(heads[c]) for c in _HEAD_NAMES} | {c: pa.array(tails[c].astype(np.int32 if tails[c].dtype.kind == "i" else np.float32)) for c in _TAIL_NAMES}
    return ok, owner, cols | {"ray_no": pa.array(number.astype(np.int32)), "points": _lists(pts, counts, _arrow(TRACKED_FULL).field("points").type)}


def _emitted(b: _Bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    ok = b.end - b.begin >= EMITTED.size
    at = b.begin[ok]
    v = b.rows(at, EMITTED, ["n_rays", "num", "full", "first_value"])
    n = v["n_rays"].astype(np.int64)
    fits = (n >= 0) & (EMITTED.size + np.maximum(n, 0) * EMITTED_RAY.size <= b.end[ok] - at)
    ok[np.flatnonzero(ok)[~fits]] = False
    at, v, n = at[fits], v[fits], n[fits]
    rays = b.rows(_spread(at + EMITTED.size, n, EMITTED_RAY.size), EMITTED_RAY, ["mark", "energy", "a", "b", "c"])
    return ok, np.flatnonzero(ok), {c: pa.array(v[c]) for c in ("n_rays", "num", "full", "first_value")} | {"rays": _lists(rays, n, _arrow(EMITTED_RAYS).field("rays").type)}


_DECODERS = {TYPE_CRYSTAL: (_crystals, CRYSTALS), TYPE_TRACKED: (_tracked, TRACKED), TYPE_TRACKED_FULL: (_tracked_full, TRACKED_FULL), TYPE_EMITTED: (_emitted, EMITTED_RAYS)}


def _decoded(f: DataFrame, kind: int) -> DataFrame:
    schema = _DECODERS[kind][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, names = _DECODERS[kind][0], _arrow(schema)
        for r in batches:
            if r.num_rows:
                _, owner, cols = one(_Bytes(r.column("body")))
                cols |= {"offset": r.column("offset").take(pa.array(owner)), "header_ts": r.column("ts").take(pa.array(owner))}
                yield pa.RecordBatch.from_arrays([cols[c.name].cast(c.type) for c in names], schema=names)

    return f.where(F.col("type") == kind).select("offset", "ts", "body").mapInArrow(run, schema)


def damaged(f: DataFrame) -> DataFrame:
    """``offset, type, size``: what the reader passed over (type ``DAMAGED``), and records too short for what they announce,
    which the decoders leave out. ``f`` must have been read without a choice of types for the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            kinds, bad = r.column("type").to_numpy(), np.zeros(r.num_rows, bool)
            b = _Bytes(r.column("body"))
            size = b.end - b.begin
            for kind, (one, _) in _DECODERS.items():
                own = np.flatnonzero(kinds == kind)
                if len(own):
                    bad[own] = ~one(_Bytes(r.column("body").take(pa.array(own))))[0]
            bad |= kinds == DAMAGED
            size = np.where(kinds == DAMAGED, r.column("ts").to_numpy(), size)
            keep = pa.array(np.flatnonzero(bad))
            yield pa.RecordBatch.from_arrays([r.column("offset").take(keep), r.column("type").take(keep), pa.array(size).take(keep)], names=["offset", "type", "size"])

    return f.select("offset", "type", "ts", "body").mapInArrow(run, "offset long, type int, size long")


def decode_crystals(f: DataFrame) -> DataFrame:
    """One row per crystal record with its interaction points, in the file's units (mm, keV)."""
    return _decoded(f, TYPE_CRYSTAL)


def decode_tracked(f: DataFrame) -> DataFrame:
    """One row per ray with its first and second hit."""
    return _decoded(f, TYPE_TRACKED)


def decode_tracked_full(f: DataFrame) -> DataFrame:
    """One row per ray with all of its hits."""
    return _decoded(f, TYPE_TRACKED_FULL)


def decode_emitted(f: DataFrame) -> DataFrame:
    """One row per record of simulated emission with its rays: a mark, the energy in keV and three numbers of direction each."""
    return _decoded(f, TYPE_EMITTED)


def crystal_points(crystals: DataFrame, matrices: DataFrame | None = None) -> DataFrame:
    """One row per interaction point with place in the world: ``matrices(crystal_id, m array<double>)`` are the
    16 numbers of each crystal's transform, applied to (x, y, z, 10); without them places are taken as they are."""
    a = crystals.withColumn("sum_e", F.aggregate("points", F.lit(0.0), lambda s, p: s + p["e"])).select("timestamp", "crystal_id", "tot_e", "sum_e", "pad", F.posexplode("points").alias("i", "p"))
    cols = ["timestamp", "crystal_id", "tot_e", "sum_e", "pad", "i"]
    a = a.select(*cols, *[F.col(f"p.{c}").cast("double").alias(c) for c in "xyze"], F.col("p.seg").alias("seg"))
    if matrices is None:
        return a
    from hitloom.functions.geometry import point, transformed

    j = a.join(matrices, "crystal_id", "left")
    t = transformed([F.get("m", i) for i in range(16)], point())
    return j.select(*cols, *[F.coalesce(v, F.col(c)).alias(c) for c, v in zip("xyz", t)], "e", "seg")


def world_matrices(spark: SparkSession, path: str, count: int = 124) -> DataFrame:
    """Crystal transforms from a file of float32 matrices: ``crystal_id, m``."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    m = np.frombuffer(raw, "<f4", count * 16).reshape(count, 16).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "crystal_id int, m array<double>")


def world_matrices_text(spark: SparkSession, path: str, count: int = 180) -> DataFrame:
    """Crystal transforms from text blocks of four lines: translation first, in mm, then the rows of the rotation."""
    rows = []
    for line in "".join(r["value"] + "\n" for r in spark.read.text(path, wholetext=True).collect()).splitlines():
        p = line.split()
        if len(p) == 5:
            rows.append([*map(float, p[2:]), 0.0])
        elif len(p) == 4:
            rows[-1] += [*map(float, p[1:]), 0.0]
    m = np.array(rows, float).reshape(-1, 4, 4)[:count]
    m = m[:, [1, 2, 3, 0], :]
    for i in range(4):
        m[:, i, 3], m[:, 3, i] = m[:, 3, i].copy(), 0.0
    m[:, 3, 3] = 10.0
    m[:, :, 3] /= 10.0
    return spark.createDataFrame([(i, [float(v) for v in r.ravel()]) for i, r in enumerate(m)], "crystal_id int, m array<double>")


# --- encoding -----------------------------------------------------------------------------------


def encode_tracked(rays: DataFrame, full: bool = False, cm: bool = True, untracked: bool = True) -> DataFrame:
    """Frames of tracked rays, one per event, in the order of cluster_id.

    ``rays(event_id, cluster_id, esum, fom, tracked, ts, crystal_no, points)`` with ``points`` the ordered hits
    ``array<struct<x,y,z,e,ts,crystal_no,energy_factor>>`` in cm and MeV (``cm``), written in mm and keV. ``untracked`` rays may be left out; the count is of
    those written. ``full``: all hits of a ray, else its first two.
    """
    r = rays if untracked else rays.where("tracked")
    items = F.array_sort(F.collect_list(F.struct("cluster_id", "esum", "fom", F.col("tracked").cast("int").alias("tracked"), "ts", "crystal_no", "points")))
    ev = r.groupBy("event_id").agg(items.alias("rays"), F.min("ts").alias("ts"))
    scale, ev_e = (10.0, 1000.0) if cm else (1.0, 1.0)

    def body(rays, ts) -> bytes:
        out = [RAY_COUNT.pack(len(rays), 0)]
        for q in rays:
            pts = q["points"]
            xyz = [[p["x"] * scale, p["y"] * scale, p["z"] * scale, p["e"] * ev_e] for p in pts]
            crystal, fom = int(q["crystal_no"] or 0), float(q["fom"] if q["fom"] is not None else np.nan)
            if full:
                out.append(RAY_HEAD.pack(q["esum"] * ev_e, len(pts), fom, q["tracked"] or 0, int(q["ts"])))
                for p, v in zip(pts, xyz):
                    dt = int((p["ts"] if p["ts"] is not None else q["ts"]) - q["ts"])
                    out.append(RAY_POINT.pack(*v, max(-(2**31), min(2**31 - 1, dt)), int(p["crystal_no"] or 0), float(p["energy_factor"] or 0.0)))
                out.append(RAY_TAIL.pack(crystal, 0, 0.0, 0.0))
            else:
                second = xyz[1] if len(xyz) > 1 else [0.0] * 4
                out.append(RAY.pack(q["esum"] * ev_e, len(pts), fom, q["tracked"] or 0, int(q["ts"]), *xyz[0], *second, crystal, 0, 0.0, 0.0))
        return b"".join(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"offset": pdf["event_id"], "type": np.int32(TYPE_TRACKED_FULL if full else TYPE_TRACKED), "ts": pdf["ts"], "body": [body(q, t) for q, t in zip(pdf["rays"], pdf["ts"])]})

    return ev.mapInPandas(run, FRAME)


def write_frames(f: DataFrame, path: str, mode: str = "append") -> None:
    register(f.sparkSession)
    f.select("offset", "type", "ts", "body").write.format("hitframes").mode(mode).save(path)


def shortened(full: DataFrame) -> DataFrame:
    """Rays with all hits (:func:`decode_tracked_full`) to rays with the first two."""
    hit = lambda i: F.when(F.size("points") > i, F.struct(*[F.get("points", i)[c].alias(c) for c in "xyze"]))
    return full.select(*[c for c in _columns(TRACKED) if c not in ("first_hit", "second_hit")], hit(0).alias("first_hit"), hit(1).alias("second_hit")).select(*_columns(TRACKED))
