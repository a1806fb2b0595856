"""How many tasks a shuffle is dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES = 2**22  # input bytes of a task


def input_bytes(*frames: DataFrame) -> int:
    """Bytes of the files that frames are read from, by the plan's leaves; no job runs.  Leaves of unknown size count as 0."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        total += sum(s for s in sizes if s < 2**60)
    return total


def tasks(*frames: DataFrame, each: int | None = None) -> int:
    """Spark's own number of shuffle tasks, or one for `each` (BYTES) bytes of input if those are more.

    A task's share, and with it its memory, stays the same as the input grows, whatever the session's setting is.
    """
    spark = frames[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-input_bytes(*frames) // (each or BYTES)))
