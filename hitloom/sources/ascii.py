"""Text files of simulated and measured hits. Files are parsed whole, one task per file, as their records span lines.

Every reader gives ``event_id, ray, point_idx, x, y, z, e, ts, crystal_no, seg_no, interaction_type`` in cm and MeV;
what a grammar doesn't have is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from hitloom.runtime import ship

SCHEMA = "event_id long, ray int, point_idx int, x double, y double, z double, e double, ts double, crystal_no int, seg_no int, interaction_type int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
RAYS = "event_id long, ray int, energy double, x double, y double, z double, theta double, phi double, beta double, full_energy int"

Row = tuple


def _row(event, ray, i, x, y, z, e, ts=None, crystal=None, seg=None, kind=None) -> Row:
    return int(event), None if ray is None else int(ray), i, float(x) / 10, float(y) / 10, float(z) / 10, float(e) / 1000, ts, crystal, seg, kind


def steps(lines: Iterable[str]) -> Iterator[Row]:
    """event ray step [zero] energy x y z, one hit a line."""
    last, i = None, 0
    for line in lines:
        p = line.split()
        if len(p) not in (7, 8):
            continue
        i = i + 1 if p[0] == last else 1
        last = p[0]
        yield _row(p[0], p[1], i, *p[-3:], p[-4])


def measured(lines: Iterable[str]) -> Iterator[Row]:
    """Blocks 'filtered_NNN...', '#' lines with place, energy and time, closed by 'We'. Places in cm, energies in MeV."""
    event, pts = None, []
    for line in lines:
        if line.startswith("filtered"):
            event, pts = int(line.split("_")[1][:3]), []
        elif line.startswith("#"):
            p = line.split()
            pts.append((*map(float, p[3:7]), float(p[-1][3:-1])))
        elif line.startswith("We") and event is not None:
            for i, (x, y, z, e, ts) in enumerate(pts, 1):
                yield event, None, i, x, y, z, e, ts, None, None, None


def crystals(lines: Iterable[str]) -> Iterator[Row]:
    """D blocks: C lines with crystal and number of points, then seg energy x y z; E lines are skipped here."""
    it = iter(lines)
    for line in it:
        p = line.split()
        if not p or p[0] != "D":
            continue
        i = 0
        for _ in range(int(p[1])):
            _, crystal, n = next(it).split()
            for _ in range(int(n)):
                seg, e, x, y, z = next(it).split()
                i += 1
                yield _row(p[2], None, i, x, y, z, e, None, int(crystal), int(seg))


def emitted(lines: Iterable[str]) -> Iterator[tuple]:
    """E blocks: the emitted rays of each event, energies in MeV."""
    it = iter(lines)
    for line in it:
        p = line.split()
        if p and p[0] == "E":
            for k in range(int(p[1])):
                e, x, y, z, theta, phi, beta = map(float, next(it).split())
                yield int(p[3]), k + 1, e / 1000, x, y, z, theta, phi, beta, int(p[2])


def multiplicity(lines: Iterable[str]) -> Iterator[Row]:
    """Header up to '$' with 'GAMMA n'; then events of n rays, each begun by '-1 energy'; hits: crystal e x y z seg time type."""
    n, event, ray, i, body = 1, -1, 0, 0, False
    for line in lines:
        p = line.split()
        if not body:
            if p and p[0] == "GAMMA":
                n = int(p[1])
            body = bool(p) and p[0] == "$"
            continue
        if not p:
            break
        if p[0] == "-1":
            ray = ray % n + 1
            if ray == 1:
                event, i = event + 1, 0
        elif event >= 0 and len(p) >= 8:
            i += 1
            yield _row(event, ray, i, p[2], p[3], p[4], p[1], float(p[6]), int(p[0]), int(p[5]), int(p[7]))


def true_energies(lines: Iterable[str]) -> Iterator[tuple]:
    """Of the multiplicity grammar: event, ray and the energy in its '-1' line."""
    n, event, ray, body = 1, -1, 0, False
    for line in lines:
        p = line.split()
        if not body:
            if p and p[0] == "GAMMA":
                n = int(p[1])
            body = bool(p) and p[0] == "$"
        elif not p:
            break
        elif p[0] == "-1":
            ray = ray % n + 1
            event += ray == 1
            yield event, ray, float(p[1])


def filtered(lines: Iterable[str]) -> Iterator[Row]:
    """'event_id n' blocks; hits: 'cluster: [no] e x y z'; 'sum' lines are skipped."""
    event, i = None, 0
    for line in lines:
        p = line.split()
        if not p or p[0] == "sum":
            continue
        if p[0] == "event_id":
            event, i = int(p[1]), 0
        elif p[0][0].isdigit() and event is not None:
            i += 1
            yield _row(event, int(p[0].rstrip(":")), i, p[3], p[4], p[5], p[2])


def raw_steps(lines: Iterable[str]) -> Iterator[Row]:
    """'event_id n' blocks; hits of 9 ('[', '12]') or 8 ('[12]') words with the crystal in brackets; one ray 0."""
    event, i = None, 0
    for line in lines:
        p = line.split()
        if not p or p[0] == "----":
            continue
        if p[0] == "event_id":
            event, i = int(p[1]), 0
        elif p[0][0].isdigit() and event is not None and len(p) in (8, 9):
            o = len(p) - 8
            i += 1
            crystal = int(p[2][:-1]) if o else int(p[1][1:-1])
            yield _row(event, 0, i, *p[3 + o : 6 + o], p[2 + o], None, crystal)


GRAMMARS: dict[str, Callable[[Iterable[str]], Iterator[Row]]] = {
    "steps": steps, "measured": measured, "crystals": crystals, "multiplicity": multiplicity, "filtered": filtered, "raw_steps": raw_steps,
}


#: Words that begin a block of lines which means the same wherever it stands; such files are cut into blocks and read by many tasks.
BLOCKS = {"crystals": "D", "filtered": "event_id", "raw_steps": "event_id", "emitted": "D"}


def _parsed(spark: SparkSession, path: str, parse, schema: str, block: str | None = None) -> DataFrame:
    """Rows of a grammar. Without a ``block`` word a grammar counts from line to line over its file, so a file is one task's."""
    ship(spark)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        for pdf in parts:
            for text in pdf["value"]:
                if block and text[:1].isspace():  # the separator took the block's first word
                    text = block + text
                for r in parse(text.splitlines()):
                    rows.append(r)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    text = spark.read.text(path, lineSep=f"\n{block}") if block else spark.read.text(path, wholetext=True)
    return text.mapInPandas(run, schema)


def read_hits(spark: SparkSession, path: str, grammar: str) -> DataFrame:
    return _parsed(spark, path, GRAMMARS[grammar], SCHEMA, BLOCKS.get(grammar))


def read_emitted(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, emitted, RAYS, BLOCKS["emitted"])


def read_true_energies(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, true_energies, "event_id long, ray int, energy double")
