"""Rows numbered without a sort of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets in which rows are numbered; a key has as many offsets at most.
BUCKETS = 1024


def numbered(frame: DataFrame, ids: Sequence[str], keys: Sequence[str] = (), seed: int = 42, name: str = "place") -> DataFrame:
    """Adds `name`: 0, 1, 2 ... over the rows of each key, in an order hashed from the ids.

    Two levels: rows are numbered inside a hash bucket, and the sizes of a key's earlier buckets are added; these are at
    most BUCKETS rows a key. So no task holds all rows of a key, and there are no gaps.
    """
    bucket = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(BUCKETS))
    rows = frame.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[F.col(k) for k in keys], F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_of_bucket"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *ids), *ids))
    same = F.col("_bucket") == F.col("_of_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.withColumn("_own", own).join(sizes, same).withColumn(name, F.col("_own") + F.col("_offset") - 1)
    return out.drop("_own", "_bucket", "_of_bucket", "_offset", *[f"_of_{k}" for k in keys])
