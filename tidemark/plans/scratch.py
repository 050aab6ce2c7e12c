"""Intermediate tables, row bounds and table paths.

Intermediates are written to the folder the cluster shares (``spark.checkpoint.dir``), so
they outlive a lost executor. A folder of our own is used only where that setting is
unset and the session runs on one machine, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local_dir


_paths: set[str] = set()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; it read back, with its lineage cut, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    _paths.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """``stored`` without the path: the table stays until ``temporary`` or the application ends."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _paths.discard(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was stored inside. Results must have been written by then, since they may read it."""
    before = set(_paths)
    try:
        yield
    finally:
        for path in _paths - before:
            discard(spark, path)


@atexit.register
def _discard_all() -> None:
    """Delete what is left when the driver ends with its session still running."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in list(_paths):
            try:
                discard(spark, path)
            except Exception:  # the session is gone or going: the tables stay
                return


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``: unlike ``materialize`` it keeps partitions and their row order."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when a count shows at most ``max_rows`` rows, else leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """See to it that Python workers can import this package: where neither their folder nor PYTHONPATH has it, Spark hands them an archive of it."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in known):
        return
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    archive = (folder if folder.is_dir() else Path(tempfile.mkdtemp())) / f"tidemark-{uuid.uuid4().hex}.zip"  # read on the driver, sent by Spark
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
