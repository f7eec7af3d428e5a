"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut, map_arrow

#: Rows that one task compares with so many queries at a time, both about.
ROW_BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries whose visits one task finds.
VISIT_BLOCK = 256
#: A leaf of more rows is split again, by k-means on at most so many of its vectors, while the tree's centroids take less than
#: NODE_BYTES: the tree is broadcast, so its size needs a bound. At 64 components that is 131,072 nodes.
LEAF_ROWS, LEAF_SAMPLE, NODE_BYTES = 2048, 1000, 64 << 20


@dataclass
class Tree:
    """centroids of all nodes but the root; children: first and last child of each node (equal: a leaf); leaf: its number or -1."""

    dim: int
    centroids: np.ndarray
    children: list[tuple[int, int]]
    leaf: list[int]
    root: tuple[int, int]

    @property
    def leaves(self) -> int:
        return max(self.leaf, default=-1) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centroid at each level."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            (lo, hi), rows = todo.pop()
            if lo == hi or not len(rows):
                continue
            c = self.centroids[lo:hi]
            near = (0.5 * (c * c).sum(1) - x[rows] @ c.T).argmin(1) + lo
            for node in range(lo, hi):
                own = rows[near == node]
                if self.leaf[node] >= 0:
                    out[own] = self.leaf[node]
                else:
                    todo.append((self.children[node], own))
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """The leaves by best-bin-first: always on from the open node whose centroid has the largest product."""
        heap: list[tuple[float, int]] = []
        nodes = self.root
        leaf = self.leaf
        while True:
            for node, score in zip(range(*nodes), (self.centroids[slice(*nodes)] @ q).tolist(), strict=True):
                heapq.heappush(heap, (-score, node))
            while heap and leaf[heap[0][1]] >= 0:
                yield leaf[heapq.heappop(heap)[1]]
            if not heap:
                return
            nodes = self.children[heapq.heappop(heap)[1]]

    def visit(self, q: np.ndarray, most: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first `most` leaves. With `counts` (rows of each leaf), further ones until those visited hold `least` rows."""
        found: list[int] = []
        held = least if counts is None else 0
        for leaf in self.order(q):
            if len(found) >= most and held >= least:
                break
            found.append(leaf)
            held += 0 if counts is None else int(counts[leaf])
        return found

    def split(self, parts: dict[int, np.ndarray]) -> Tree:
        """A tree in which each node of `parts` has these centroids below it. Leaves are numbered along the tree, so that
        neighbours have neighbouring numbers."""
        children, made = list(self.children), len(self.centroids)
        for node, below in parts.items():
            children[node] = (made, made + len(below))
            made += len(below)
        children += [(0, 0)] * (made - len(children))
        leaf, todo, count = [-1] * made, list(range(*self.root))[::-1], 0
        while todo:
            node = todo.pop()
            if children[node][0] < children[node][1]:
                todo += list(range(*children[node]))[::-1]
            else:
                leaf[node], count = count, count + 1
        return Tree(self.dim, np.concatenate([self.centroids, *parts.values()]), children, leaf, self.root)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (0.5 * (c * c).sum(1) - x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, near


def _width(rows: int, leaf_rows: int, branch: int) -> int:
    """Into how many parts a node goes: twice as many as leaves of full size need, as parts differ in size."""
    return max(2, min(branch, -(-2 * rows // leaf_rows)))


def fit_tree(x: np.ndarray, branch: int = 16, leaf_size: int = 64, seed: int = 3) -> Tree:
    """Split the sample by k-means into `branch` parts or fewer, and each part again until it has at most `leaf_size` vectors."""
    rng = np.random.default_rng(seed)
    centroids: list[np.ndarray] = []
    children: list[tuple[int, int]] = []
    leaf: list[int] = []

    def add(parts: list[np.ndarray]) -> tuple[int, int]:
        lo = len(centroids)
        for p in parts:
            centroids.append(p.mean(0))
            children.append((0, 0))
            leaf.append(-1)
        return lo, len(centroids)

    root = add([x]) if len(x) else (0, 0)
    todo, made = [(root[0], x)] if len(x) else [], 0
    while todo:
        node, own = todo.pop()
        parts = []
        if len(own) > leaf_size and len(distinct := np.unique(own, axis=0)) > 1:
            _, near = _kmeans(distinct, min(_width(len(own), leaf_size, branch), len(distinct)), rng)
            groups = [distinct[near == g] for g in np.unique(near)]
            parts = groups if len(groups) > 1 else []
        if parts:
            children[node] = add(parts)
            todo += list(zip(range(*children[node]), parts, strict=True))
        else:
            leaf[node], made = made, made + 1
    return Tree(x.shape[1], np.array(centroids).reshape(-1, x.shape[1]), children, leaf, root)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the vectors of `dim` finite components that aren't all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan"))).reshape(len(rows), dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in one order, so that equal vectors have equal scores."""
    return np.add.reduce(q * x, 1)


def best(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, x: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, score) of each query's k best others, ties to the smaller id; exact in this block.

    `seen` (queries x vectors) says which vectors a query may have.
    """
    rough = q @ x.T
    rough[q_id[:, None] == v_id[None, :]] = -np.inf
    if seen is not None:
        rough[~seen] = -np.inf
    if x.shape[0] > k:
        kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(q) @ np.abs(x).max(0))
        kept = rough >= np.where(np.isfinite(kth), kth - slack, -np.inf)[:, None]
    else:
        kept = np.ones_like(rough, bool)
    kept &= np.isfinite(rough)
    i, j = np.nonzero(kept)
    score = _products(q[i], x[j])
    order = np.lexsort((v_id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


def packs(counts: np.ndarray, size: int = ROW_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(pack of each leaf, blocks of each pack): neighbouring leaves share a pack of about `size` rows; a larger leaf has a
    pack of its own, of several blocks."""
    pack, blocks, room = np.zeros(len(counts), np.int32), [], 0
    for leaf, n in enumerate(counts.tolist()):
        if n > room or not blocks:
            blocks.append(max(1, -(-n // size)))
            room = size if n <= size else n
        pack[leaf] = len(blocks) - 1
        room -= n
    return pack, np.array(blocks or [1], np.int32)


@dataclass
class Index:
    tree: Tree
    visits: int
    recall: float


def _vectors(frame: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return frame.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))


def indexed_rows(vectors: DataFrame, tree: Tree, copies: int | None = None) -> DataFrame:
    """(vec_id, v, leaf) of every row that takes part. With `copies`, of equal vectors in an Arrow batch only the
    `copies` smallest ids: no more of them can be among a query's best, so a very common vector stays small."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column(1), shared.value.dim)
            if copies is not None and len(rows):
                ids = np.asarray(batch.column(0))[rows]
                same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
                order = np.lexsort((ids, same))
                # Repeated rows first, so that they don't take the places of other ids.
                order = order[np.r_[True, (np.diff(same[order]) != 0) | (np.diff(ids[order]) != 0)]]
                rank = np.arange(len(order)) - np.searchsorted(same[order], same[order])
                kept = np.sort(order[rank < copies])
                rows, x = rows[kept], x[kept]
            if len(rows):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.assign(x), pa.int32())], names=["vec_id", "v", "leaf"])

    return map_arrow(vectors, run, "vec_id bigint, v array<double>, leaf int")


def grow(vectors: DataFrame, tree: Tree, copies: int, branch: int = 16, leaf_rows: int = LEAF_ROWS, node_bytes: int = NODE_BYTES) -> Tree:
    """Split leaves of more than `leaf_rows` rows, level by level, until none is left or the centroids take `node_bytes`.

    A level counts the rows of each leaf over the whole table, and each large leaf is split in a task of its own by k-means on
    at most LEAF_SAMPLE of its vectors, those whose hashes are lowest. Only the new centroids come to the driver. A leaf whose
    sampled vectors are all equal stays whole. Where the bound is reached, the largest leaves have gone first.
    """
    spark, dim, whole = vectors.sparkSession, tree.dim, set()

    def parts(rows: pa.Table) -> pa.Table:
        x = np.unique(_matrix(rows["v"], dim)[1], axis=0)
        _, near = _kmeans(x, min(_width(rows["count"][0].as_py(), leaf_rows, branch), len(x)), np.random.default_rng(3))
        centroids = [x[near == g].mean(0).tolist() for g in np.unique(near)]
        return pa.table({"leaf": pa.array([rows["leaf"][0].as_py()] * len(centroids), pa.int32()), "c": pa.array(centroids, pa.list_(pa.float64()))})

    while True:
        rows = indexed_rows(vectors, tree, copies)
        node_of = {leaf: node for node, leaf in enumerate(tree.leaf) if leaf >= 0}
        counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().where(F.col("count") > leaf_rows).collect()}
        room = max(0, node_bytes // (8 * dim) - len(tree.centroids)) // branch
        large = sorted((leaf for leaf in counts if node_of[leaf] not in whole), key=lambda leaf: (-counts[leaf], leaf))[:room]
        if not large:
            return tree
        # Twice the share of the sample, so that a leaf hardly ever has fewer vectors than that; the rank bounds it.
        shares = spark.createDataFrame([(leaf, counts[leaf], 2.0 * LEAF_SAMPLE / counts[leaf]) for leaf in large], "leaf int, count bigint, share double")
        place = F.xxhash64("vec_id", "v")
        few = rows.join(F.broadcast(shares), "leaf").where(F.pmod(place, F.lit(1 << 30)) < F.col("share") * (1 << 30))
        few = few.withColumn("place", place).withColumn("n", F.row_number().over(Window.partitionBy("leaf").orderBy("place", "vec_id")))
        made = few.where(F.col("n") <= LEAF_SAMPLE).select("leaf", "count", "v").groupBy("leaf").applyInArrow(parts, "leaf int, c array<double>").toArrow()
        of, below = np.asarray(made["leaf"]), np.asarray(made["c"].combine_chunks().flatten()).reshape(-1, dim)
        new = {node_of[leaf]: own for leaf in large if len(own := below[of == leaf]) > 1}
        whole |= {node_of[leaf] for leaf in large} - new.keys()
        tree = tree.split(new)


def build_index(frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 20_000, calibration: int = 200, k: int = 20, target: float = 0.95, branch: int = 16, leaf_size: int = 64, leaf_rows: int = LEAF_ROWS) -> Index | None:
    """Fit the upper tree on at most `sample` vectors, split its large leaves further (see grow), and calibrate how many leaves a search visits. None without vectors.

    Calibration takes `calibration` rows as queries, finds their k best among all rows exactly (each task keeps k for
    each query), and takes the smallest number of leaves whose best-bin-first visits find `target` of them. They are kept
    out of the fit where the sample has four times as many. Of equal vectors in the sample one counts.
    The sample and the queries are the rows whose ids hash lowest; their number bounds what the driver holds.
    """
    vectors = _vectors(frame, id_col, vec_col)
    dims = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return None
    dim = dims[0]["dim"]
    few = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    rows, x = _matrix(few["v"], dim)
    if not len(rows):
        return None
    # A very common vector is one query of the calibration, which it would else make up.
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])
    rows, x = rows[first], x[first]
    # A tree fits its own vectors better than others, so the queries are kept out of it where there are enough.
    tree = fit_tree(x[calibration:] if len(x) >= 4 * calibration else x, branch, leaf_size)
    tree = grow(vectors, tree, k + 1, branch, leaf_rows)
    q_id, q = np.asarray(few["vec_id"])[rows][:calibration], x[:calibration]
    shared = frame.sparkSession.sparkContext.broadcast((q_id, q))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, own = _matrix(batch.column(1), dim)
            if len(r):
                i, j, score = best(*shared.value, np.asarray(batch.column(0))[r], own, k)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.asarray(batch.column(0))[r][j]), pa.array(score), pa.array(np.asarray(batch.column(2))[r][j])], names=["q", "vec_id", "score", "leaf"])

    near = map_arrow(indexed_rows(vectors, tree, k + 1), exact, "q int, vec_id bigint, score double, leaf int")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("q", "leaf").toArrow()
    asked, leaf = np.asarray(ranked["q"]), np.asarray(ranked["leaf"])
    needed = []
    for i in range(len(q)):
        own = leaf[asked == i].tolist()
        place: dict[int, int] = {}
        missing = set(own)
        for n, found in enumerate(tree.order(q[i]) if own else (), 1):
            place[found] = n
            missing.discard(found)
            if not missing:
                break
        needed += [place[found] for found in own]
    needed = np.sort(needed or [1])
    at = min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)
    visits = int(needed[at])
    return Index(tree, visits, float((needed <= visits).mean()))


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def search(frame: DataFrame, queries: DataFrame, index: Index | None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """Each query's k nearest rows found (largest inner product, ties to the smaller id): query_id, rank, vec_id, score.

    Rows and queries whose vector is null, zero, of another length, or holds null or non-finite components take no part;
    a row isn't its own neighbour (rows are told apart by id, so repeated ids count once a vector). A query goes on past the
    calibrated number of leaves until they hold k other rows, so it has fewer than k only where there are fewer.
    Neighbouring leaves lie together in packs of about ROW_BLOCK rows, larger leaves in several blocks. A query goes once to
    each pack that it visits, with the leaves it visits there, in groups of about QUERY_BLOCK of that pack's queries; a task
    holds one such pair, whatever the size of a leaf, and gives k rows a query. A pack's rows are sent once for each of its
    own groups, so what is sent grows with the visits, not with rows times queries.
    """
    spark = frame.sparkSession
    if index is None:
        return spark.createDataFrame([], RESULT)
    rows = indexed_rows(_vectors(frame, id_col, vec_col), index.tree, k + 1).dropDuplicates(["vec_id", "v"])
    # Rows with the query's own id, of which there may be several vectors, come on top of the k others.
    same = _vectors(frame, id_col, vec_col).groupBy("vec_id").agg(F.count(F.lit(1)).alias("same"))
    asked = _vectors(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    # A row for each leaf at most; their number is bounded by NODE_BYTES.
    counts = np.zeros(index.tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    pack, blocks = packs(counts)
    count = asked.count()
    shared = spark.sparkContext.broadcast((index, pack, counts))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pack", pa.int32()), ("leaves", pa.list_(pa.int32()))]))
        found, pack_of, held = shared.value
        for batch in batches:
            own, x = _matrix(batch.column(1), found.tree.dim)
            if len(own):
                goals = []
                for v, same in zip(x, np.asarray(batch.column(2))[own].tolist(), strict=True):
                    leaves = np.sort(np.array(found.tree.visit(v, found.visits, held, k + same)))
                    goals.append([{"pack": int(p), "leaves": leaves[pack_of[leaves] == p].tolist()} for p in np.unique(pack_of[leaves])])
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(goals, kind)], names=["query_id", "q", "goals"])

    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    asked = asked.join(same, "vec_id", "left").select("vec_id", "v", F.coalesce("same", F.lit(0)).alias("same")).repartition(max(1, -(-count // VISIT_BLOCK)))
    goals = cut(map_arrow(asked, visits, "query_id bigint, q array<double>, goals array<struct<pack:int,leaves:array<int>>>"))
    groups = goals.select(F.explode("goals.pack").alias("pack")).groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("groups"))
    places = spark.createDataFrame([(i, int(p), int(blocks[p])) for i, p in enumerate(pack)], "leaf int, pack int, blocks int").join(F.broadcast(groups), "pack")
    left = goals.select("query_id", "q", F.explode("goals").alias("g")).select("query_id", "q", "g.pack", "g.leaves").join(F.broadcast(places.drop("leaf").distinct()), "pack")
    left = left.select("query_id", "q", "leaves", "pack", part("query_id", F.col("groups")).alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    right = rows.join(F.broadcast(places), "leaf").select("vec_id", "v", "leaf", "pack", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("a"), part("vec_id", F.col("blocks")).alias("b"))

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        ids = [np.asarray(t[c]) for t, c in ((q, "query_id"), (r, "vec_id"))]
        if not q.num_rows or not r.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tree = shared.value[0].tree
        (leaf, row), lists = np.unique(np.asarray(r["leaf"]), return_inverse=True), q["leaves"].combine_chunks()
        asked, seen = np.repeat(np.arange(q.num_rows), np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(leaf, seen), len(leaf) - 1)
        may = np.zeros((q.num_rows, len(leaf)), bool)
        may[asked[leaf[at] == seen], at[leaf[at] == seen]] = True
        i, j, score = best(ids[0], _matrix(q["q"], tree.dim)[1], ids[1], _matrix(r["v"], tree.dim)[1], k, may[:, row])
        return pa.table({"query_id": ids[0][i], "vec_id": ids[1][j], "score": score})

    keys = ["pack", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(frame: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by 20."""
    return search(frame, frame.where(F.col("vec_id") % 20 == 0), build_index(frame, k=k), k=k)
