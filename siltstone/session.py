"""What a session needs before it runs this package's queries."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PIECE = 4 << 20


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of
    its own; on a cluster that would be a folder of one machine, so it must be set there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/tables/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again when an executor is lost."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, unless the session sets its own bound: a batch of long texts is held by the JVM
    and the Python worker at once, in copies."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(PIECE))


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes."""
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes, so that what Python makes of one is bounded too."""
    for b in batches:
        step = max(1, b.num_rows * size // max(size, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def ship(spark: SparkSession) -> None:
    """Let executors import this package: add it to the session's files, once, unless their path has it."""
    sc = spark.sparkContext
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(sc, "_siltstone", False) or any(Path(p).resolve() == ROOT for p in paths):
        return
    archive = Path(tempfile.mkdtemp()) / "siltstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "siltstone").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._siltstone = True
