"""Benchmark decontamination: Wu-Manber multi-pattern search for test strings in whole texts.

Texts and test strings are brought to one form: A-Z in lower case, the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with one
blank before, between and after them. A test string is a window of `size` consecutive words of an item, or the whole item
if it has fewer. In that form an occurrence of a window is an occurrence of its bytes, blanks at both ends included.

Windows are searched by classes of similar length, so that a short one doesn't shorten the others' jumps. For a class, the
shift table says of each hashed block of bytes how far its end is from the end of the first `reach` bytes of any window
that holds it; a block that none holds lets the search jump by nearly `reach` bytes. Where the shift is 0, the block's bucket
gives the windows whose first `reach` bytes end with it; their first bytes and then the whole window are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut, map_texts

#: Bytes of test strings that one search looks for; more are searched block after block. Bounds what is collected and broadcast.
BLOCK_BYTES = 8 << 20
#: Words of an item that one row holds at most; longer items are cut into overlapping pieces.
PIECE_WORDS = 4096
#: Bytes of text that one lane of a search walks through; all lanes of a slice step together. Bytes compared at a time.
LANE, COMPARE = 256, 1 << 20
#: Zero bytes before a stream, so that the 8 bytes up to any place can be read.
_PAD = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_blank = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in _lower)


def stream_of(raw: bytes) -> bytes:
    """The words of a UTF-8 text with one blank before, between and after them; one blank if there are none."""
    out = b" " + raw.translate(_blank) + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def windows_of(stream: bytes, size: int) -> list[bytes]:
    """The windows of `size` words of a stream, repeats included; a stream of fewer words is one window."""
    words = stream.split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, without a copy."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


@dataclass
class LengthClass:
    """One class of windows. number: the windows' numbers in bucket order; starts: the first of each bucket; data, at, size:
    the windows' bytes, places in them and lengths; first: their first 8 bytes (fewer, if `reach` is less)."""

    reach: int
    block: int
    bits: int
    shift: np.ndarray
    starts: np.ndarray
    number: np.ndarray
    first: np.ndarray
    data: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def hashed(self, eights: np.ndarray) -> np.ndarray:
        """The table entry of a block, from the 8 bytes that end with it."""
        return ((eights >> np.uint64(8 * (8 - self.block))) * _FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in a stream that has _PAD zero bytes before and after it."""
        eights, end = _eights(text), len(text) - _PAD
        ends = np.arange(_PAD + self.reach, end + 1, LANE)
        stops = np.minimum(ends + LANE, end + 1)
        places, buckets = [], []
        while len(ends):
            entry = self.hashed(eights[ends - 8])
            jump = self.shift[entry]
            stop = jump == 0
            if stop.any():
                places.append(ends[stop] - self.reach)
                buckets.append(entry[stop])
                jump[stop] = 1
            ends = ends + jump
            on = ends < stops
            ends, stops = ends[on], stops[on]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, bucket = np.concatenate(places), np.concatenate(buckets)
        found = [self._confirmed(text, eights, end, place[i : i + LANE * 64], bucket[i : i + LANE * 64]) for i in range(0, len(place), LANE * 64)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _confirmed(self, text: np.ndarray, eights: np.ndarray, end: int, place: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.starts[bucket + 1] - self.starts[bucket]
        own = np.repeat(self.starts[bucket] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(place, n)
        may = ((eights[place] & _low(self.reach)) == self.first[own]) & (place + self.size[own] <= end)
        place, own = place[may], own[may]
        same = np.zeros(len(place), bool)
        before = np.cumsum(self.size[own]) - self.size[own]
        lo = 0
        while lo < len(place):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + COMPARE)))
            size = self.size[own[lo:hi]]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            unlike = text[np.repeat(place[lo:hi], size) + inside] != self.data[np.repeat(self.at[own[lo:hi]], size) + inside]
            same[lo:hi] = np.add.reduceat(unlike, np.cumsum(size) - size, dtype=np.int64) == 0
            lo = hi
        return place[same], self.number[own[same]]


def _low(reach: int) -> np.uint64:
    return np.uint64((1 << 8 * min(8, reach)) - 1)


def length_class(windows: list[bytes], numbers: np.ndarray) -> LengthClass:
    """The tables of windows of similar length. The first 256 bytes of a window are looked at, at most."""
    reach = min(256, min(map(len, windows)))
    block = max(1, min(8, reach // 2))
    size = np.array([len(w) for w in windows])
    data = np.frombuffer(bytes(_PAD) + b"".join(windows) + bytes(_PAD), np.uint8)
    at = np.cumsum(size) - size + _PAD
    bits = int(min(20, max(12, np.ceil(np.log2(4 * len(windows) * reach)))))
    out = LengthClass(reach, block, bits, np.full(1 << bits, reach - block + 1, np.int64), np.zeros(0), numbers, np.zeros(0), data, at, size)
    eights = _eights(data)
    # Later ends lie nearer to the end, so they overwrite.
    for e in range(block, reach + 1):
        out.shift[out.hashed(eights[at + e - 8])] = reach - e
    entry = out.hashed(eights[at + reach - 8])
    order = np.argsort(entry, kind="stable")
    out.starts = np.searchsorted(entry[order], np.arange((1 << bits) + 1))
    out.number, out.at, out.size = numbers[order], at[order], size[order]
    out.first = eights[out.at] & _low(reach)
    return out


@dataclass
class Search:
    """A block of test strings ready to search for. words: words of each window; item_starts, items: its items' numbers; names: their ids."""

    classes: list[LengthClass]
    words: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: pa.Array

    def hits(self, streams: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """For each stream the ranges of words in occurring windows (first and last word from 0; merged) and the items of these windows."""
        parts = [s + b"\0" for s in streams]
        text = np.frombuffer(bytes(_PAD) + b"".join(parts) + bytes(_PAD), np.uint8)
        begin = np.cumsum([_PAD, *map(len, parts)])
        found = [c.search(text) for c in self.classes]
        place, window = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        row = np.searchsorted(begin, place, "right") - 1
        # A word's number over all streams is the number of blanks before it; a stream's last blank parts it from the next.
        blanks = np.flatnonzero(text == 32) if len(place) else place
        first = np.searchsorted(blanks, place)
        order = np.argsort(first, kind="stable")
        first, last = first[order], (first + self.words[window] - 1)[order]
        reach = np.maximum.accumulate(last)
        new = np.ones(len(first), bool)
        new[1:] = first[1:] > reach[:-1]
        end = np.append(new[1:], True)[: len(new)]
        of = row[order][new]
        base = np.searchsorted(blanks, begin[of])
        ranges = pa.StructArray.from_arrays([pa.array(first[new] - base, pa.int64()), pa.array(reach[end] - base, pa.int64())], ["first", "last"])
        n = self.item_starts[window + 1] - self.item_starts[window]
        item = self.items[np.repeat(self.item_starts[window] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pairs = np.unique(np.repeat(row, n) * (len(self.names) + 1) + item)
        who, item = pairs // (len(self.names) + 1), pairs % (len(self.names) + 1)
        listed = lambda rows, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(streams) + 1)), pa.int32()), values)
        return listed(of, ranges), listed(who, self.names.take(pa.array(item)))


def prepare(strings: Iterable[tuple[str | None, bytes]], size: int = 10) -> Search:
    """strings: (item id as text, stream). The windows of an item without id are searched for, but name no item."""
    number: dict[bytes, int] = {}
    names: dict[str, int] = {}
    pairs = set()
    for item, stream in strings:
        name = None if item is None else names.setdefault(item, len(names))
        for window in windows_of(stream, size):
            k = number.setdefault(window, len(number))
            if name is not None:
                pairs.add((k, name))
    windows = list(number)
    own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    kinds = np.array([len(w).bit_length() for w in windows], np.int64)
    classes = [length_class([windows[i] for i in np.flatnonzero(kinds == k)], np.flatnonzero(kinds == k)) for k in np.unique(kinds)]
    return Search(classes, np.array([w.count(b" ") - 1 for w in windows], np.int64), np.searchsorted(own[:, 0], np.arange(len(windows) + 1)), own[:, 1], pa.array(list(names), pa.string()))


def item_strings(tests: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, stream) of the items that have words; long ones in pieces of PIECE_WORDS words that overlap by size - 1."""

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        row, out = [], []
        for i, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            words = stream_of(raw).split()
            for at in range(0, max(len(words) - size + 1, min(1, len(words))), PIECE_WORDS):
                row.append(i)
                out.append(b" " + b" ".join(words[at : at + PIECE_WORDS + size - 1]) + b" ")
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["item", "stream"])

    frame = tests.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_texts(frame, "text", "item string, stream binary", step).distinct()


def _covered(ranges: Column) -> Column:
    """Words in sorted ranges, which may overlap."""
    start = F.struct(F.lit(-1).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("n"))
    grown = lambda acc, r: F.struct(F.greatest(acc["reach"], r["last"]).alias("reach"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), r["last"] - F.greatest(acc["reach"], r["first"] - 1))).alias("n"))
    return F.aggregate(ranges, start, grown, lambda acc: acc["n"])


def find_contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where the windows of `size` words of the tests' items occur in the documents.

    Returns a row for each document: the id, `n_words` (bigint), `hits` (ranges of words inside occurring windows: first and
    last, from 0, in order), `n_hit` (bigint: words in them) and `items` (ids, as text, of items with occurring windows;
    sorted). Null and empty texts have no words; rows with a null id and repeated rows stay, each with its result. Items
    without words find nothing; items without id find words but aren't named; items that share an id are one. Other columns
    are left out.
    Scale: the documents are read once and nothing is shuffled while the test strings take at most `block_bytes`; more are
    searched for in blocks of about that size, each with a pass over the documents, and only ids and found ranges meet in a
    join. What is collected and broadcast is one block. Ranges found by different blocks may overlap.
    """
    strings = cut(item_strings(tests, item_col, item_text_col, size))
    total = strings.agg(F.sum(F.octet_length("stream"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    key = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    found = [_searched(frame, strings.where(F.pmod(F.xxhash64("item", "stream"), F.lit(blocks)) == k), key, size, k > 0) for k in range(blocks)]
    out = found[0]
    if blocks > 1:
        some = found[0].where(F.size("hits") > 0).select("id", "text_hash", "hits", "items")
        for more in found[1:]:
            some = some.unionByName(more.select("id", "text_hash", "hits", "items"))
        some = some.groupBy("id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        some = some.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), F.col("hits").alias("all_hits"), F.col("items").alias("all_items"))
        out = out.join(some, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left").select("id", "n_words", F.coalesce("all_hits", "hits").alias("hits"), F.coalesce("all_items", "items").alias("items"))
    return out.select(F.col("id").alias(id_col), "n_words", "hits", _covered(F.col("hits")).alias("n_hit"), F.array_sort("items").alias("items"))


def _searched(frame: DataFrame, strings: DataFrame, key: str, size: int, hits_only: bool) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(prepare([(r["item"], bytes(r["stream"])) for r in strings.collect()], size))

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        streams = [stream_of(raw) for raw in texts.cast(pa.large_binary()).to_pylist()]
        hits, items = shared.value.hits(streams)
        words = pa.array([s.count(b" ") - 1 for s in streams], pa.int64())
        out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), words, hits, items], names=["id", "text_hash", "n_words", "hits", "items"])
        return out.filter(pa.array(np.diff(np.asarray(hits.offsets)) > 0)) if hits_only else out

    return map_texts(frame, "text", f"id {key}, text_hash bigint, n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<string>", step)


def contamination_report(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """Counts and a digest of the items' ids for each document, from find_contamination."""
    found = find_contamination(docs, tests)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same result in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT r, p.k, i, item_id FROM places p JOIN windows v ON p.k = v.k AND p.s = v.s
), hit AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS pos FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
