"""Arrow batch helpers shared by the operators whose tasks run numpy or regular expressions."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a task works on; a longer single text is one step of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch about, unless the session asks for less: 10,000 long texts at once would take both sides' memory.
BATCH_BYTES = 4 << 20

_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand the memory that a worker has freed back to the system, which it would keep for its next tasks."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def own_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that starts and ends with a worker's freed memory handed back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def map_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of BATCH_BYTES about, whose tasks leave no memory behind."""
    conf = frame.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_BATCHES))) > BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return frame.mapInArrow(own_memory(run), schema)


def text_array(column: pa.Array) -> pa.Array:
    """A text column as 64-bit-offset strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a text_array, without a copy of the bytes."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with at most `limit` text bytes (one row at least), each with its text_array."""
    if not batch.num_rows:
        return
    column = text_array(batch.column(text))
    at = byte_view(column)[1]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start), column.slice(start, stop - start)
        start = stop


def map_texts(frame: DataFrame, text: str, schema: str, step: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch | None] | None = None, task: Callable[[], Callable] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded text size; `step` gets the slice and its texts (null: empty). With `task`, each
    task calls that for a step of its own, which lives as long as the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = task() if task else step
        for batch in batches:
            for part, texts in chunks(batch, text, limit):
                out = own(part, texts)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(frame, run, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; where none is set, a new local one in local mode, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so that later steps don't recompute them."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


@contextmanager
def written_table(frame: DataFrame) -> Iterator[DataFrame]:
    """The rows written as Parquet to the shared checkpoint folder, for steps that read them several times; removed at the end.
    Takes a fraction of a checkpoint's room. What outlives the block mustn't read it."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(frame.schema).parquet(path)
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
