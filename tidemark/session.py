"""Session helpers: reliable checkpoints and per-run folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_inside: ContextVar[list[str] | None] = ContextVar("pins", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session inside one process may fall back to a folder of its own; elsewhere a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        named = sc.getCheckpointDir()
    return named


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, for one run's files."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}/{uuid.uuid4().hex}"


@contextmanager
def pins(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is pinned inside it; use results before that."""
    paths: list[str] = []
    token = _inside.set(paths)
    try:
        yield
    finally:
        _inside.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that every later branch reads
    the same rows, only the columns it needs, and survives the loss of executors.

    Spark does not clean these folders up: inside ``pins`` they go at its end, elsewhere
    they stay.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "pinned")
    df.write.parquet(path)
    if (paths := _inside.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
