"""Tables of numbers that tasks make parts of: sums of counters, bit filters, Gram matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import map_arrow

#: Numbers of a part.
CHUNK = 1 << 13
#: Tasks whose parts of a table are put together by one group; what these give is put together then.
GATHER = 256
PARTS = "chunk int, task bigint, values binary"


def parts(table: np.ndarray) -> pa.RecordBatch:
    """The parts of a task's table that aren't all zero."""
    rows = np.concatenate([table, np.zeros(-len(table) % CHUNK, table.dtype)]).reshape(-1, CHUNK)
    own = np.flatnonzero(rows.any(1))
    task = pa.array(np.full(len(own), TaskContext.get().partitionId()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), task, pa.array([rows[k].tobytes() for k in own], pa.binary())], names=["chunk", "task", "values"])


def gathered(rows: DataFrame, dtype: str, size: int, add: np.ufunc) -> np.ndarray:
    """A table of `size` numbers of which tasks made parts (PARTS): the parts of a chunk are reduced by `add`, those of
    GATHER tasks at a time, so that a group stays small however many tasks there are."""

    def reduce(key, some):
        values = add.reduce([np.frombuffer(x.as_py(), dtype) for x in some["values"]], 0, dtype)
        return pa.table({"chunk": some["chunk"][:1], "task": pa.array([key[-1].as_py() if len(key) > 1 else 0], pa.int64()), "values": pa.array([values.tobytes()], pa.binary())})

    some = rows.groupBy("chunk", F.floor(F.col("task") / GATHER).alias("tasks")).applyInArrow(reduce, PARTS)
    out = np.zeros(size + -size % CHUNK, dtype).reshape(-1, CHUNK)
    for r in some.groupBy("chunk").applyInArrow(reduce, PARTS).collect():
        out[r["chunk"]] = np.frombuffer(r["values"], dtype)
    return out.ravel()[:size]


def filter_bits(keys: int, most: int = 1 << 28) -> int:
    """Bits of a filter of so many keys: 32 to 64 for each, from 2^16 to `most` (a broadcast of `most` / 8 bytes)."""
    return min(most, 1 << max(16, (32 * keys - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a hashed key, from its lower and its upper half."""
    h = h.view(np.uint64)
    return tuple((x & np.uint64(bits - 1)).astype(np.int64) for x in (h, (h >> np.uint64(32)) * np.uint64(0x9E3779B1)))


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits (a power of two) for the hashed keys of a frame (one bigint column). A full one lets more pass."""

    def run(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for h in _places(np.ascontiguousarray(batch.column(0)), bits):
                np.bitwise_or.at(table, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield parts(table)

    return gathered(map_arrow(keys.toDF("h"), run, PARTS), "u1", bits // 8, np.bitwise_or)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = ((table[h >> 3] >> (h & 7).astype(np.uint8)) & 1 for h in _places(h, 8 * len(table)))
    return a & b == 1
