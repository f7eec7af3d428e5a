"""Jaccard join of documents on word n-grams: size-banded tiles, bitmap bounds, exact intersection.

Two sets whose similarity reaches t share one of the first n - ceil(t n) + 1 members of each under any common order
(prefix filter). Members are ordered by how often they occur, as counted in SKETCH hash counters, so prefixes hold rare
shingles. A tile is the documents that hold one prefix shingle, in bands of similar size. In a tile, the parities of
hashed bits bound the overlap from above: sets whose bitmaps differ in d bits differ in d members at least. What passes
is decided by intersecting the sorted shingle arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import chunks, cut, map_arrow, map_texts, release
from trailmark.llm._components import connected_components
from trailmark.llm._words import Words, mix

#: Counters of the frequency sketch (4 bytes each; a broadcast of fixed size), in CHUNK-sized parts for their sum.
SKETCH, CHUNK = 1 << 20, 1 << 13
#: Bits of a filter of hashed keys (a broadcast of fixed size), in parts of CHUNK bytes. A full filter only lets more pass.
FILTER_BITS = 1 << 26
#: Documents of a tile that one task compares with as many others at a time, and rows of small tiles that it takes together.
BLOCK, LUMP = 4096, 2_000
#: Tasks whose parts of a table are put together by one group; what these give is put together then.
GATHER = 256


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Members that a partner must share with a set of n: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def bitmap_bits(n: int | np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the power of two from 2n on, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64))


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap (bytes) at a smaller width (in bits, a power of two)."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width // 8), 0)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, h = Words(texts).shingle_sets(size)
    return row, h, np.bincount(row, minlength=len(texts))


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """id, text -> (id, n, node, bits): set size, 64-bit hash of the whole set (null if empty), parity bitmap."""

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        row, h, n = _sets(texts, size)
        starts = np.cumsum(n) - n
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h, 2), out=sums[1:])
        node = mix(sums[starts + n] - sums[starts] + n.astype(np.uint64), 3).view(np.int64)
        width = bitmap_bits(n)
        at = np.cumsum(width) - width
        bits = np.bincount(at[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(width.sum())).astype(np.uint8) & 1
        packed = np.packbits(bits, bitorder="little")
        ends = np.concatenate([[0], np.cumsum(width // 8)]).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(packed.tobytes())])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(node, mask=n == 0), binary], names=["id", "n", "node", "bits"])

    return map_texts(docs, "text", f"id {docs.schema['id'].dataType.simpleString()}, n int, node bigint, bits binary", step)


def _gathered(rows: DataFrame, dtype: str, size: int, add: np.ufunc) -> np.ndarray:
    """A table of `size` numbers of which tasks made parts (chunk, task, values): the parts of a chunk are reduced by `add`,
    those of GATHER tasks at a time, so that a group stays small however many tasks there are."""

    def reduce(key, parts):
        values = add.reduce([np.frombuffer(x.as_py(), dtype) for x in parts["values"]], 0, dtype)
        return pa.table({"chunk": parts["chunk"][:1], "task": pa.array([key[-1].as_py() if len(key) > 1 else 0], pa.int64()), "values": pa.array([values.tobytes()], pa.binary())})

    some = rows.groupBy("chunk", F.floor(F.col("task") / GATHER).alias("tasks")).applyInArrow(reduce, _PARTS)
    out = np.zeros(size, dtype).reshape(-1, CHUNK)
    for r in some.groupBy("chunk").applyInArrow(reduce, _PARTS).collect():
        out[r["chunk"]] = np.frombuffer(r["values"], dtype)
    return out.ravel()


_PARTS = "chunk int, task bigint, values binary"


def _parts(table: np.ndarray) -> pa.RecordBatch:
    parts = table.reshape(-1, CHUNK)
    own = np.flatnonzero(parts.any(1))
    task = pa.array(np.full(len(own), TaskContext.get().partitionId()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), task, pa.array([parts[k].tobytes() for k in own], pa.binary())], names=["chunk", "task", "values"])


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all texts fall on each of SKETCH counters. Tasks count alone; the sums take SKETCH numbers."""

    def run(batches):
        total = np.zeros(SKETCH, "<u4")
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                total += np.bincount((Words(texts).shingles(size)[1] >> np.uint64(44)).astype(np.int64), minlength=SKETCH).astype("<u4")
        yield _parts(total)

    return _gathered(map_arrow(docs.select("text"), run, _PARTS), "<u4", SKETCH, np.add)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Bits set for the hashed keys of a frame (h bigint)."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            h = np.asarray(batch.column(0), np.int64) & (FILTER_BITS - 1)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        yield _parts(bits)

    return _gathered(map_arrow(keys.toDF("h"), run, _PARTS), "u1", FILTER_BITS // 8, np.bitwise_or)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.int64) & (FILTER_BITS - 1)
    return (bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def prefix_rows(docs: DataFrame, size: int, percent: int, counts: np.ndarray, bits: np.ndarray | None = None) -> DataFrame:
    """(token, node) of each text's prefix; with `bits`, of the tokens that pass that filter only."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, bits))

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        row, h, n = _sets(texts, size)
        starts = np.cumsum(n) - n
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h, 2), out=sums[1:])
        node = mix(sums[starts + n] - sums[starts] + n.astype(np.uint64), 3).view(np.int64)
        order = np.lexsort((h, shared.value[0][(h >> np.uint64(44)).astype(np.int64)], row))
        rank = np.arange(len(h)) - starts[row]
        kept = order[rank < (n - least_overlap(n, percent) + 1)[row]]
        if shared.value[1] is not None:
            kept = kept[passes(shared.value[1], h[kept])]
        return pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(node[row[kept]])], names=["token", "node"])

    return map_texts(docs.select("text"), "text", "token bigint, node bigint", step)


def bound_pairs(n: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i before j) of a tile whose sizes and bitmaps allow the similarity, band by band."""
    order = np.argsort(n, kind="stable")
    size = n[order]
    band = np.floor(np.log(size) / math.log(100 / percent) + 1e-9).astype(int)
    found_i, found_j = [], []
    for b in np.unique(band):
        own = np.flatnonzero(band == b)
        near = np.flatnonzero((band == b) | (band == b + 1))
        width = int(bitmap_bits(size[own[0]]))
        own_bits = np.stack([fold(np.frombuffer(bits[order[k]], np.uint8), width) for k in own]).view(np.uint64)
        near_bits = own_bits if len(near) == len(own) else np.stack([fold(np.frombuffer(bits[order[k]], np.uint8), width) for k in near]).view(np.uint64)
        for at, k in enumerate(own):
            differ = np.bitwise_count(near_bits ^ own_bits[at]).sum(1).astype(np.int64)
            both = size[near] + size[k]
            overlap = (both - differ) // 2
            ok = (near > k) & (100 * np.minimum(overlap, size[k]) >= percent * (both - np.minimum(overlap, size[k])))
            found_i.append(np.full(ok.sum(), order[k]))
            found_j.append(order[near[ok]])
    return np.concatenate(found_i), np.concatenate(found_j)


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def bounded_rows(p: np.ndarray, q: np.ndarray, x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Which pairs of sets of p and q members, with bitmaps x and y, may have the similarity; pairs of equal widths at once."""
    out = np.zeros(len(p), bool)
    (x_data, x_at, x_len), (y_data, y_at, y_len) = _rows_of(x), _rows_of(y)
    shape = x_len << 32 | y_len
    for one in np.unique(shape):
        own = np.flatnonzero(shape == one)
        width = int(min(x_len[own[0]], y_len[own[0]]))
        step = max(1, (1 << 22) // max(1, int(x_len[own[0]] + y_len[own[0]])))
        for lo in range(0, len(own), step):
            k = own[lo : lo + step]
            sides = [np.bitwise_xor.reduce(data[at[k][:, None] + np.arange(size[k[0]])].reshape(len(k), -1, width), 1) for data, at, size in ((x_data, x_at, x_len), (y_data, y_at, y_len))]
            differ = np.bitwise_count((sides[0] ^ sides[1]).view(np.uint64)).sum(1).astype(np.int64)
            both = p[k].astype(np.int64) + q[k]
            overlap = np.minimum((both - differ) // 2, np.minimum(p[k], q[k]))
            out[k] = 100 * overlap >= percent * (both - overlap)
    return out


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and bitmaps allow the similarity."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")

    def run(batches):
        for batch in batches:
            ok = bounded_rows(np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2), batch.column(3), percent)
            yield batch.select([4, 5]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both.select("na", "nb", "xa", "xb", "a", "b"), run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity; texts: (node, n, z), z the compressed text."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("z").alias(f"z{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "za", "zb")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            work = np.cumsum(np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64))
            lo = 0
            while lo < batch.num_rows:
                done = work[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(work, done + 150_000, "right")))
                part, pairs = batch.slice(lo, hi - lo), hi - lo
                # A leader comes in many pairs; each text is unpacked and hashed once.
                nodes = np.concatenate([np.asarray(part.column(c), np.int64) for c in (0, 1)])
                _, first, which = np.unique(nodes, return_index=True, return_inverse=True)
                packed = [part.column(4 if k < pairs else 5)[k % pairs].as_py() for k in first.tolist()]
                row, h, n = _sets(pa.array([unpack(z).decode() for z in packed], pa.large_string()), size)
                start = np.cumsum(n) - n
                take = n[which]
                at = np.repeat(start[which] - np.cumsum(take) + take, take) + np.arange(take.sum())
                row, h = np.repeat(np.arange(2 * pairs) % pairs, take), h[at]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
                shared = np.bincount(row[1:][same], minlength=pairs)
                total = take[:pairs] + take[pairs:]
                yield part.select([0, 1]).filter(pa.array(100 * shared >= percent * (total - shared)))
                lo = hi

    return map_arrow(both, run, "a bigint, b bigint")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, z) of the documents that stand for the wanted classes (node, n, cid). A filter of the wanted ids keeps
    most other texts from being shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("cid"))))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            part = batch.filter(pa.array(passes(shared.value, np.asarray(batch.column(1), np.int64))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((x or "").encode()) for x in part.column(2).to_pylist()], pa.binary())], names=["id", "z"])

    kind = docs.schema["id"].dataType.simpleString()
    packed = map_arrow(docs.select("id", F.xxhash64("id").alias("h"), "text"), run, f"id {kind}, z binary")
    return packed.join(wanted, F.col("id") == F.col("cid")).select("node", "n", "z")


def tile_pairs(rows: DataFrame, count: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a tile and pass its bounds.

    rows: `count` rows (token, blocks, node, n, bits, comp), blocks of the row's tile. A tile of more than BLOCK documents is compared block by
    block; small tiles are taken together, so that a group has about LUMP rows or two blocks.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "bits", "comp", "blocks")
    lumps = max(1, math.ceil(count / LUMP))
    cells = cells.withColumn("lump", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("token"), F.lit(lumps))).otherwise(F.lit(lumps) + F.xxhash64("token", "i", "j").bitwiseAND(F.lit((1 << 40) - 1))))

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("token", "ascending"), ("i", "ascending"), ("j", "ascending")])
        token, i, j = (np.asarray(cell[c]) for c in ("token", "i", "j"))
        own, node, n, comp = (np.asarray(cell[c]) for c in ("own", "node", "n", "comp"))
        bits = cell["bits"].to_pylist()
        edge = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        a, b = [], []
        for lo, hi in zip([0, *edge], [*edge, len(token)], strict=True):
            x, y = bound_pairs(n[lo:hi], bits[lo:hi], percent)
            x, y = x + lo, y + lo
            ok = (comp[x] != comp[y]) & ((i[lo] == j[lo]) | (own[x] != own[y]))
            a.append(np.minimum(node[x[ok]], node[y[ok]]))
            b.append(np.maximum(node[x[ok]], node[y[ok]]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cells.groupBy("lump").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Texts are lower-cased in A-Z and split at ASCII white space. A document's set holds its distinct `size`-word
    shingles; a shorter text is one shingle; null, empty and blank texts have an empty set and no link. Sets link when
    100 |A and B| >= percent |A or B|; component_id is the smallest id that links reach, the row's own included. Equal
    sets are one node, so copies, repeated rows and rows that share an id need no pairs. Rows with a null id keep their
    n_shingles and have no component. Links are exact but for collisions of 64-bit
    hashes, and of tiles that agree in both ends and 62 further bits.

    First each document is compared with the leader of each of its tiles; then tiles whose documents aren't yet in one
    component are compared in full. Only pairs in one component are left out, which loses no component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = docs.where("id is not null")
    sets = cut(set_table(docs, size))
    classes = cut(sets.where("id is not null and node is not null").groupBy("node").agg(F.min("id").alias("cid"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    counts = frequency_sketch(named, size)

    # Shingles with the same documents make the same tile, and one of them is enough. Their documents are compared by
    # least, greatest and two sums of 31 independent bits of each (with a bound of 2^32 rows, so that they can't overflow).
    one, two = F.shiftrightunsigned("node", 33), F.shiftrightunsigned(F.xxhash64("node"), 33)
    tiles = prefix_rows(named, size, percent, counts).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(one).alias("s"), F.sum(two).alias("u")).where("lo < hi")
    tiles = cut(tiles.groupBy("lo", "hi", "s", "u").agg(F.min("token").alias("token")).select("token"))
    release(spark)
    bits = bit_filter(tiles)
    # Made distinct before they meet the tiles, so that a popular shingle's rows lie in many tasks and the join can be split.
    members = cut(prefix_rows(named, size, percent, counts, bits).distinct().join(tiles, "token").select("token", "node"))
    wanted = cut(members.select("node").distinct().join(classes.drop("bits"), "node"))
    texts = cut(packed_texts(named, wanted))
    release(spark)

    # Documents with few words of their own are in many tiles, and most others of a group are similar to them.
    fame = members.groupBy("node").agg(F.count(F.lit(1)).alias("fame"))
    leaders = cut(members.join(fame, "node").groupBy("token").agg(F.max(F.struct("fame", "node"))["node"].alias("leader")))
    pairs = members.join(leaders, "token").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = cut(verified(bounded(pairs, classes, percent), texts, size, percent))
    roots = cut(connected_components(links))
    release(spark)

    rows = members.select("token", "node").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("comp"))
    open_tiles = rows.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count(F.lit(1)).alias("c")).where("p < q")
    open_tiles = cut(open_tiles.select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    if not open_tiles.isEmpty():
        # The bitmaps join last, so that they are shuffled once.
        left = cut(rows.join(open_tiles, "token"))
        full = left.join(classes.select("node", "n", "bits"), "node").select("token", "blocks", "node", "n", "bits", "comp")
        more = verified(tile_pairs(full, left.count(), percent), texts, size, percent)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(cut(more))
        roots = cut(connected_components(links))

    least = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "cid")
    firsts = cut(least.groupBy("root").agg(F.min("cid").alias("component_id")))
    label = least.select("node", "root").join(firsts, "root").select(F.col("node").alias("member"), "component_id")
    out = sets.join(label, F.col("node") == F.col("member"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


#: The same result in DuckDB, pair by pair.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words
), members AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) + any_value(b.n) AS total
  FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM shared WHERE 100 * k >= 75 * (total - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = sets.doc_id) AS component_id FROM sets
"""
