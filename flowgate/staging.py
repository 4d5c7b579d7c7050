"""Reliable intermediate results.

A table that several later jobs read is computed once and written to the shared checkpoint folder. The
loss of an executor then costs no recomputation of the lineage, and the planner knows the table's size.

Such tables stay, as results that are read from them may be used at any time. A chain of steps whose results are written before the next
one starts can give them up earlier, see ``links_of_a_chain``, and so can a step whose result is written, see ``passing``.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flowgate-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if getattr(_here, "open", None) is not None:
        _here.open.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Compute once, write as Parquet below the checkpoint folder, read from there afterwards."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at its end; what is read later has to be written to a path from outside."""
    outer = getattr(_here, "open", None)
    _here.open = []
    try:
        yield
    finally:
        paths, _here.open = _here.open, outer
        delete(spark, paths)


def links_of_a_chain(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step (spark, rows, ...) of a chain in which each step's result is written before the next step is given it.

    When a step starts, the tables that the step before it (of this thread) has staged are deleted, unless the rows that it is given still
    come from one of them.
    """

    @functools.wraps(step)
    def run(spark: SparkSession, rows: DataFrame, *more) -> DataFrame:
        before = getattr(_here, "finished", [])
        if before:
            read = rows.inputFiles()
            names = {path.rsplit("/", 1)[1] for path in before}
            if not any(part in names for file in read for part in file.split("/")):
                delete(spark, before)
        _here.open = []
        try:
            return step(spark, rows, *more)
        finally:
            _here.finished, _here.open = _here.open, None

    return run
