"""Tables that several branches of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def written(frame: DataFrame) -> DataFrame:
    """The rows computed once: written to the session's checkpoint folder, or where none is set kept in Spark's storage."""
    return frame.checkpoint() if frame.sparkSession.conf.get("spark.checkpoint.dir", None) else frame.persist()


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys over as many partitions as the session shuffles into. For rows that stand for much work each:
    partitions by number aren't merged for having few bytes."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
