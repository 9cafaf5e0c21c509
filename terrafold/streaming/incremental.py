"""Incremental runs: new district rows arrive as files and are processed once.

The batch functions are the same as without a stream; what has been read is kept
in the stream's checkpoint, and results replace the partitions of their districts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrafold.operators.results import write_upsert


def process_new(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs ``process`` over the files that arrived since the last call, then stops."""

    def batch(rows: DataFrame, _: int) -> None:
        write_upsert(process(rows), target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
