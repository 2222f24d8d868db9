"""The folder every executor can read, for checkpoints, models and written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where one process does all.

    That folder goes when the process ends.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; owned by the ``scratch`` around it, if any."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies; nothing happens where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Owns what is written to the shared folder inside, and deletes it at the end, also after an error.

    For jobs that write their results: tables and models that steps inside store for
    themselves do not outlive the job. DataFrames that read them must not either. A
    scope inside another deletes its own; what is stored outside of any scope stays.
    """
    before = _OWNED.set([])
    owned = _OWNED.get()
    try:
        yield owned
    finally:
        _OWNED.reset(before)
        for path in owned:
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in front of work that reads the table several times, and
    survives the loss of any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
