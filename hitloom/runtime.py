"""Session helpers shared by all operators: table access, durable intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every Python worker of the application this package, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="hitloom-"), "hitloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, named by ``spark.checkpoint.dir`` or set by ``setCheckpointDir``.

    Where the session names none, a single machine (master ``local[...]``) gets a temporary folder, set once and
    kept for the session's lifetime; on a cluster that is an error, since tables in a machine's own folder would be
    read back incomplete elsewhere.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.hitloom.sharedDir", None)
    if path is None:
        set_ = sc._jsc.sc().getCheckpointDir()
        path = set_.get() if set_.isDefined() else None
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hitloom-")
        spark.conf.set("spark.hitloom.sharedDir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The files are columnar and compressed, so later passes read only the columns they need.
    They are removed when the session's JVM ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/hitloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if parent.getName().startswith("hitloom-"):
            parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
