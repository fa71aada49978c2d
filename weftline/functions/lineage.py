"""Cutting the lineage of iterative jobs in storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint directory exists and all of Spark is on
    one machine (tests) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in reliable storage and forget how it came about."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


@contextmanager
def noting() -> Iterator[list[str]]:
    """The scratch paths that are given out meanwhile, for :func:`release` once nothing is to be computed from them any more."""
    token = _noted.set(paths := [])
    try:
        yield paths
    finally:
        _noted.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch folders and forget them."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Columnar and compressed, so better than :func:`cut` for wide or large tables that are
    read several times.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pile:
    """Frames of equal columns that come one after the other, put together in steps.

    ``FEW`` frames of a step become one of the next, so a row is written again only as often as
    the logarithm of the number of frames, and a plan over all of them stays small.
    """

    FEW = 8

    def __init__(self, *frames: DataFrame) -> None:
        self._steps: list[list[DataFrame]] = [[]]
        for df in frames:
            self.add(df)

    def add(self, df: DataFrame) -> None:
        """Put ``df``, which has been computed, on the pile."""
        for step in self._steps:
            step.append(df)
            if len(step) < self.FEW:
                return
            df = settle(reduce(DataFrame.unionByName, step), "pile")
            step.clear()
        self._steps.append([df])

    def all(self) -> DataFrame:
        """Everything on the pile, of which there has to be something."""
        return reduce(DataFrame.unionByName, [df for step in reversed(self._steps) for df in step])
