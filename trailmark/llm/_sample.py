"""Bounded, repeatable samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, bound: int) -> DataFrame:
    """The texts of at most `bound` labelled rows, those whose ids hash lowest.

    labels: `id_col` and label columns. Only ids are ordered; the chosen ones (at most `bound` rows, which bounds the
    broadcast) then meet the texts without a shuffle.
    """
    few = labels.orderBy(F.xxhash64(F.col(id_col)), *labels.columns).limit(bound)
    return docs.join(F.broadcast(few), id_col)
