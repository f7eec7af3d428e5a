"""Packing of documents into training sequences: bounded-space best fit in each partition, leftovers merged at the end."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import chunks, cut, map_arrow
from trailmark.llm._tokens import WordEncoder

#: Partitions whose last, partly filled windows are merged by one task.
MERGE_PARTITIONS = 256


class Packer:
    """Keeps at most `open_windows` open windows of `length` tokens and gives out finished ones.

    A piece goes into the window that it fills best. If none has room, the fullest one takes as much of the piece as
    fits and is emitted, and the rest is placed anew; so an emitted window has no padding. A window is a list of
    (key, start, ids, doc_tokens) pieces.
    """

    def __init__(self, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.windows: list[list[tuple]] = []
        self.free: list[int] = []

    def _take(self, i: int) -> list[tuple]:
        self.free.pop(i)
        return self.windows.pop(i)

    def add(self, key, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list[tuple]]:
        while len(ids) >= self.length:
            yield [(key, start, ids[: self.length], doc_tokens)]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [f for f in self.free if f >= len(ids)]
            if fits:
                i = self.free.index(min(fits))
                n = len(ids)
            elif len(self.windows) < self.most:
                self.windows.append([])
                self.free.append(self.length)
                i, n = len(self.windows) - 1, len(ids)
            else:
                n = min(self.free)
                i = self.free.index(n)
            self.windows[i].append((key, start, ids[:n], doc_tokens))
            self.free[i] -= n
            start, ids = start + n, ids[n:]
            if not self.free[i]:
                yield self._take(i)

    def drain(self) -> Iterator[list[tuple]]:
        """Merge the open windows, emptiest into fullest; all that come out but the last are full."""
        order = sorted(range(len(self.windows)), key=lambda i: self.free[i])
        left = [self.windows[i] for i in order]
        self.windows, self.free, self.most = [], [], 1
        for window in left:
            for piece in window:
                yield from self.add(*piece)
        if self.windows:
            yield self._take(0)


def _powers(window: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Cut the last, partly filled window at powers of two, which need no padding."""
    size = sum(len(p[2]) for p in window)
    part, room = [], 1 << (size.bit_length() - 1)
    for key, start, ids, doc_tokens in window:
        while len(ids):
            n = min(room, len(ids))
            part.append((key, start, ids[:n], doc_tokens))
            start, ids, room, size = start + n, ids[n:], room - n, size - n
            if not room:
                yield part
                part, room = [], 1 << (size.bit_length() - 1) if size else 0


def _rows(window: list[tuple], sequence: int, with_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for key, start, ids, doc_tokens in window:
        crc = zlib.crc32(ids)
        out.append((key, start, len(ids), crc, doc_tokens, sequence, offset, ids.tolist() if with_ids else None))
        offset += len(ids)
    return out


COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, open_windows: int = 16, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack every document's ids (and `end_id` after them) into sequences of at most `length` tokens.

    Returns a row per piece: `id_col`, start (ids of the document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit numbers), doc_tokens (ids of the document with the end id), sequence_id, offset in the
    sequence and, with `keep_ids`, ids. Each partition packs its rows as they come, with `open_windows` open windows;
    the one partly filled window that a partition leaves is merged with those of MERGE_PARTITIONS partitions, and what
    then remains is cut at powers of two. Null and empty texts are documents of the end id alone; very long texts fill
    whole sequences; repeated rows are packed each for itself; an empty table gives no rows; other columns aren't read.
    No row moves but the leftovers (under `length` tokens from each partition).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = f"id {id_type}, {COLUMNS}, ids array<int>, part bigint"
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, part, made = WordEncoder(tokenizer_path), Packer(length, open_windows), TaskContext.get().partitionId(), 0
        schema: pa.Schema | None = None

        def table(rows: list[tuple], left: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.list_(pa.int32())), pa.array([part if left else None] * len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            schema = batch.schema
            for rows, texts in chunks(batch, "text"):
                ids, at = coder.encode(texts.to_pylist(), end_id)
                out = []
                for key, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for window in packer.add(key, 0, ids[a:b].copy(), b - a):
                        out += _rows(window, (part << 32) + made, keep_ids)
                        made += 1
                if out:
                    yield table(out, False)
        for window in packer.drain():
            full = sum(len(p[2]) for p in window) == length
            yield table(_rows(window, (part << 32) + made, keep_ids or not full), not full)
            made += 1

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        packer, out = Packer(length, 1), []
        group = int(pieces["part"].iloc[0]) // MERGE_PARTITIONS
        pieces = pieces.sort_values(["part", "offset"], kind="stable")
        windows = [w for p in pieces.itertuples() for w in packer.add(p.id, p.start, np.asarray(p.ids, "<u4"), p.doc_tokens)]
        for window in packer.drain():
            windows += [window] if sum(len(p[2]) for p in window) == length else _powers(window, length)
        for k, window in enumerate(windows):
            out += _rows(window, (1 << 62) + (group << 32) + k, keep_ids)
        return pd.DataFrame([(*r, None) for r in out], columns=names)

    first = cut(map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, columns))
    last = first.where(F.col("part").isNotNull()).groupBy(F.floor(F.col("part") / MERGE_PARTITIONS).alias("group")).applyInPandas(merge, columns)
    out = first.where(F.col("part").isNull()).unionByName(last).drop("part").withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")
