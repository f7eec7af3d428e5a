"""Repeated passages: overlapping windows of lines are hashed, and later occurrences of a window are cut out."""

from __future__ import annotations

import struct
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut, map_texts

_BLANK = " \t\r\x0b\x0c"


def window_rows(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """(first line, last line, 128-bit hash as two signed numbers) of every run of `size` lines that aren't blank."""
    lines = [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(_BLANK))]
    out = []
    for k in range(len(lines) - size + 1):
        run = lines[k : k + size]
        out.append((run[0][0], run[-1][0], *struct.unpack("<qq", blake2b("\n".join(s for _, s in run).encode(), digest_size=16).digest())))
    return out


def cut_lines(text: str, covered: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the covered ranges (ends included), and how many lines that took."""
    lines, gone, at = text.split("\n"), 0, 0
    kept: list[str] = []
    for first, last in sorted(covered):
        if last < at:
            continue
        kept += lines[at : max(at, first)]
        gone += last + 1 - max(at, first)
        at = last + 1
    return "\n".join(kept + lines[at:]), gone


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, text_hash, first, last) of every window that occurred before, in order of (id, text_hash, line)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        row, found = [], []
        for i, text in enumerate(texts.to_pylist()):
            new = window_rows(text, size)
            found += new
            row += [i] * len(new)
        cols = zip(*found, strict=True) if found else [[]] * 4
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]], names=["id", "text_hash", "first", "last", "h1", "h2"])

    frame = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    seen = map_texts(frame, "text", f"id {kind}, text_hash bigint, first int, last int, h1 bigint, h2 bigint", step)
    # Written first, so that the join below gets both sides from plain exchanges, whose large partitions Spark splits.
    origin = cut(seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "first")).alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return seen.join(origin, ["h1", "h2"]).where(F.struct("id", "text_hash", "first") > F.col("origin")).select("id", "text_hash", "first", "last")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, drop_emptied: bool = False) -> DataFrame:
    """Cut every window of `size` consecutive lines that occurred earlier in the corpus out of the later texts.

    Lines end at "\\n" and are compared without blanks at their ends; blank lines are passed over and only go when they
    lie inside a removed passage. Occurrences are ordered by (id, hash of the text, line): the first stays, and the union of
    the others' lines is removed. Returns the input's columns, with the text changed, and then `lines_before` and `lines_removed`
    (bigint). With `drop_emptied`, texts that had lines and lose all their content go. Null texts stay null; texts with
    fewer lines stay as they are; rows with a null id are left alone and not counted; rows that share id and text are
    one occurrence and get the same result; those two names replace columns of the input so named.
    Scale: one shuffle of hashed windows, pre-aggregated by hash, one join whose hot hashes can be split, one shuffle
    of the texts by id; a task holds one document's ranges.
    """
    covered = repeated_windows(docs, id_col, text_col, size).groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("covered"))
    names = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    fields = [docs.schema[c] for c in names]
    left = docs.select(names).toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(id_col)}", names.index(text_col)
    both = left.withColumn("__h", F.xxhash64(f"c{t}")).join(covered.toDF("__id", "__th", "__covered"), (F.col(i) == F.col("__id")) & (F.col("__h") == F.col("__th")), "left").drop("__h", "__id", "__th")
    both = both.withColumn("__text", F.col(f"c{t}"))

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        known, out, before, gone, keep = part.column(t).is_valid().to_pylist(), [], [], [], []
        for text, ok, ranges in zip(texts.to_pylist(), known, part.column(len(names)).to_pylist(), strict=True):
            new, n = cut_lines(text, [(r["first"], r["last"]) for r in ranges]) if ranges else (text, 0)
            out.append(new if ok else None)
            before.append(text.count("\n") + 1 if ok else 0)
            gone.append(n)
            keep.append(not (drop_emptied and n and not new.strip()))
        cols = [*[pa.array(out, pa.string()) if k == t else part.column(k) for k in range(len(names))], pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[*[f"c{k}" for k in range(len(names))], "b", "g"]).filter(pa.array(keep))

    schema = ", ".join([*[f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)], "b bigint, g bigint"])
    return map_texts(both, "__text", schema, step).toDF(*names, "lines_before", "lines_removed")


#: The same result in DuckDB.
ORACLE = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, trim(l, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), runs AS (
  SELECT doc_id, pos AS first, lead(pos, 2) OVER w AS last, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS run
  FROM lines WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM runs WHERE run IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS pos FROM later
), raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL
), kept AS (
  SELECT raw.doc_id, string_agg(l, chr(10) ORDER BY raw.pos) AS text FROM raw ANTI JOIN gone ON raw.doc_id = gone.doc_id AND raw.pos = gone.pos GROUP BY raw.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE length(d.text) - length(replace(d.text, chr(10), '')) + 1 END::BIGINT AS lines_before,
  (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id)::BIGINT AS lines_removed
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
