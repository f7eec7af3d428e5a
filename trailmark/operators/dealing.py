"""Values dealt to other rows by bijections of the rows' numbers, counted where they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the values dealt to a page of rows, which a task holds, and pages of a table at most: beyond that pages grow.
PAGE_BYTES, PAGES = 16 << 20, 1024
#: The page of the rows' own values among what is sent.
OWN = -1


def _planes(values: np.ndarray) -> bytes:
    """The doubles' bytes, the first ones of all values, then the second ones and so on: values with few digits compress well so."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.float64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes, rows: int) -> np.ndarray:
    """The doubles of _planes, as an array of so many rows."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.float64).reshape(rows, -1)


def _coded(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A code for each value, and how many different ones there are."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def _counted(columns: Sequence[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of coded columns, a row of each different kind, and how many rows are of that kind."""
    code, kinds = columns[0]
    for c, k in columns[1:]:
        if kinds * k >= 1 << 62:
            old, code = np.unique(code, return_inverse=True)
            kinds = len(old)
        code, kinds = code * k + c, kinds * k
    if kinds > 8 * len(code):
        _, some, counts = np.unique(code, return_index=True, return_counts=True)
        return some, counts
    counts, some = np.bincount(code, minlength=kinds), np.zeros(kinds, np.int64)
    some[code] = np.arange(len(code))
    there = np.flatnonzero(counts)
    return some[there], counts[there]


def dealt_counts(numbered: DataFrame, features: Sequence[str], label: str, number: str, n: int, maps: Sequence[tuple[int, int]]) -> DataFrame:
    """feature, repeat, label, features, _n: how many rows of each label have each vector, as they are (feature and repeat -1) and
    when the values of a feature (its place in `features`) come from row (a i + b) mod n for row i, for each repeat's (a, b).

    Rows are numbered 0 to n - 1. Pages of consecutive rows send each other page the values it is dealt in all repeats, packed
    and in the order of their numbers, so no row has a key of its own. A vector may come in several rows, a few from each
    task. Features and label are taken as doubles; a missing value is NaN, and rows without a label are only dealt out.
    """
    width = len(features)
    size = max(PAGE_BYTES // (8 * width * max(1, len(maps))), -(-n // PAGES), 1)
    back = [pow(a, -1, n) for a, _ in maps]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        j = rows.column("_j").to_numpy()
        order = np.argsort(j)
        j = j[order]
        own = np.stack([rows.column(c).to_numpy()[order] for c in range(1, rows.num_columns)])
        page = int(j[0]) // size
        # Short numbers, as there are few pages, are sorted by digits.
        targets = [(np.mod(inverse * np.mod(j - b, n), n) // size).astype(np.int16) for inverse, (_, b) in zip(back, maps, strict=True)]
        # By target page, in it by repeat, in it by number.
        to = np.concatenate(targets)
        place = np.argsort(to, kind="stable")
        ends = np.cumsum(np.bincount(to, minlength=int(to.max()) + 1))
        dealt = own[1:, place % len(j)]
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([OWN], pa.int32()), pa.array([_planes(own)], pa.binary())], names=["target", "page", "sent"])
        for q, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if start < end:
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([page], pa.int32()), pa.array([_planes(dealt[:, start:end])], pa.binary())], names=["target", "page", "sent"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = pa.Table.from_batches(batches)
        pieces = {p: (_values(s, width + 1 if p == OWN else width)) for p, s in zip(sent.column("page").to_pylist(), sent.column("sent").to_pylist(), strict=True)}
        own, first = pieces.pop(OWN), sent.column("target")[0].as_py() * size
        told = np.flatnonzero(~np.isnan(own[0]))
        rows = own[:, told]
        codes = [_coded(v) for v in rows]

        def counted(feature: int, repeat: int, new: np.ndarray) -> pa.RecordBatch:
            # Column 0 is the label.
            some, counts = _counted([_coded(new) if c == feature + 1 else own_code for c, own_code in enumerate(codes)])
            parts = [np.full(len(some), feature, np.int32), np.full(len(some), repeat, np.int32), *[(new if c == feature + 1 else v)[some] for c, v in enumerate(rows)], counts]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["feature", "repeat", label, *features, "_n"])

        yield counted(-1, -1, rows[0])
        i = np.arange(first, first + own.shape[1], dtype=np.int64)
        at = dict.fromkeys(pieces, 0)
        for repeat, (a, b) in enumerate(maps):
            j = np.mod(a * i + b, n)
            lot = []
            for p, k in zip(*np.unique(j // size, return_counts=True), strict=True):
                lot.append(pieces[p][:, at[p] : at[p] + k])
                at[p] += k
            new = np.empty((width, len(i)))
            new[:, np.argsort(j)] = np.concatenate(lot, axis=1)
            for feature in range(width):
                yield counted(feature, repeat, new[feature][told])

    number_of = F.col(number).cast("bigint")
    doubles = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{k}") for k, c in enumerate((label, *features))]
    pages = numbered.select(number_of.alias("_j"), *doubles).groupBy(F.floor(F.col("_j") / size)).applyInArrow(send, "target int, page int, sent binary")
    columns = ", ".join(f"`{c}` double" for c in (label, *features))
    return pages.groupBy("target").applyInArrow(count, f"feature int, repeat int, {columns}, _n bigint")
