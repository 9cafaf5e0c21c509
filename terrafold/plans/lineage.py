"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folders written inside each open ``passing``, innermost last.
_passing: list[list[str]] = []


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` (a temporary folder only on one
    machine, where that is unset) and read it back, so that a lost executor costs no
    recomputing of earlier steps.  With ``by``, each value of that column has a folder,
    so that reading one value opens no other file."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{tempfile.gettempdir()}/terrafold-checkpoints"
    path = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """The tables that ``cut`` writes inside go at the end, so that rounds without end
    don't fill the shared folder.  Nothing lazy that reads them may be used later."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
