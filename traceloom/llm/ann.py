"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in numpy on a bounded sample of vectors; every row is assigned to a leaf.
A query walks the tree best bin first through a priority queue, which gives an order of the
leaves; a bounded set of queries is answered by brute force over all rows, and the number of
leaves visited is widened until these reach the recall asked for.  The visits then meet the
leaves in a grouped Spark job, in which a large leaf is split into parts.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
neither do null ids; vectors of different lengths are no candidates for each other, so each length
is searched by itself; of several rows of one query id the vector that sorts first asks, and all
of them stay candidates of others; rows with the query's own id are never its neighbours; an empty table, or a query without candidates, gives no
rows; ties go to the smaller ``vec_id``; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, saved

#: Bounds of what is held by the driver and sent to the tasks: vectors that fit the tree, and queries that calibrate it.
SAMPLE_ROWS, CALIBRATION_QUERIES = 16_384, 128


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding`` (array of float) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.filter("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))


def _nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1)[None] - 2 * (x @ centers.T), axis=1)


class Tree:
    """Nodes 0.. of a k-means tree; ``children[i]`` is empty for a leaf."""

    def __init__(self, sample: np.ndarray, branch: int = 8, leaf_rows: int = 96, seed: int = 7):
        self.centers, self.children = [sample.mean(0) if len(sample) else np.zeros(1)], [[]]
        rng, todo = np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) <= leaf_rows:
                continue
            centers = x[rng.choice(len(x), branch, replace=False)].copy()
            for _ in range(8):
                own = _nearest_center(x, centers)
                for k in range(branch):
                    if (own == k).any():
                        centers[k] = x[own == k].mean(0)
            own = _nearest_center(x, centers)
            parts = [k for k in range(branch) if (own == k).any()]
            if len(parts) < 2:
                continue
            for k in parts:
                self.children[node].append(len(self.centers))
                self.centers.append(centers[k])
                self.children.append([])
                todo.append((len(self.centers) - 1, x[own == k]))
        self.centers = np.array(self.centers)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node] or not len(rows):
                out[rows] = node
                continue
            kids = np.array(self.children[node])
            own = _nearest_center(x[rows], self.centers[kids])
            todo += [(kid, rows[own == k]) for k, kid in enumerate(kids.tolist())]
        return out

    def visit_order(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        away = ((self.centers - q) ** 2).sum(1)
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                out.append(node)
            for kid in self.children[node]:
                heapq.heappush(heap, (float(away[kid]), kid))
        return out

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)


def _top(ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of ``x`` to ``q``, ties to the smaller id, without the query's own id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == qid] = np.inf
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        near = np.arange(len(d))
    near = near[np.isfinite(d[near])]
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return near, d[near]


def _with_leaf(vectors: DataFrame, tree) -> DataFrame:
    def assign(batches):
        for b in batches:
            leaf = tree.value.leaf_of(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "embedding", "leaf"])

    return vectors.mapInArrow(assign, "vec_id long, embedding array<double>, leaf long")


def _calibrate(held: DataFrame, tree: Tree, queries: list, k: int, recall: float) -> int:
    """Leaves to visit until the neighbours found by brute force over all rows are met with ``recall``."""
    if not queries:
        return 1
    spark = held.sparkSession
    sent = spark.sparkContext.broadcast(([r["vec_id"] for r in queries], np.array([r["embedding"] for r in queries])))

    def brute(batches):
        for b in batches:
            ids, x, leaf = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for n, (qid, q) in enumerate(zip(*sent.value)):
                near, d = _top(ids, x, qid, q, k)
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(near), pa.int32()), pa.array(ids[near]), pa.array(d), pa.array(leaf[near])], ["n", "vec_id", "score", "leaf"])

    w = Window.partitionBy("n").orderBy("score", "vec_id")
    true = held.mapInArrow(brute, "n int, vec_id long, score double, leaf long").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("n", "leaf").collect()
    needed = []
    for n, r in enumerate(queries):
        rank = {leaf: i + 1 for i, leaf in enumerate(tree.visit_order(np.array(r["embedding"]), tree.leaves))}
        needed += [rank[t["leaf"]] for t in true if t["n"] == n]
    if not needed:
        return 1
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, recall: float = 0.97, report: dict | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest rows found, by Euclidean distance.

    ``report``, if given, receives the number of leaves and of those visited.
    """
    v = usable(vectors)
    lengths = sorted(r[0] for r in v.select(F.size("embedding")).distinct().collect())  # a handful
    found = [_search(v.filter(F.size("embedding") == n), is_query, k, recall, report) for n in lengths]
    empty = v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, found) if found else empty


def _search(v: DataFrame, is_query: str, k: int, recall: float, report: dict | None) -> DataFrame:
    """Of vectors of one length."""
    spark = v.sparkSession
    sample = hashed_sample(v, "vec_id", SAMPLE_ROWS).select("embedding").limit(SAMPLE_ROWS).collect()
    tree = Tree(np.array([r["embedding"] for r in sample]) if sample else np.zeros((0, 1)))
    sent = spark.sparkContext.broadcast(tree)
    held = saved(_with_leaf(v, sent), "ann-leaves")
    rows = held.groupBy("leaf").count().collect()  # as many as the tree has leaves, at most
    total = sum(r["count"] for r in rows)
    part_rows = max(256, min(8192, total // 512))
    parts = {r["leaf"]: -(-r["count"] // part_rows) for r in rows}
    asking = held.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = hashed_sample(asking, "vec_id", CALIBRATION_QUERIES).collect()
    most = _calibrate(held, tree, first, k, recall)
    if report is not None:
        report |= {"leaves": tree.leaves, "visited": most, "rows": total}
    of = spark.sparkContext.broadcast(parts)

    def visits(batches):
        for b in batches:
            out = [(qid, e, leaf, p) for qid, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for leaf in sent.value.visit_order(np.array(e), most) for p in range(of.value.get(leaf, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()))], ["query_id", "q", "leaf_", "part_"])

    def dealt(batches):
        for b in batches:
            n = np.array([of.value[x] for x in b.column(2).to_pylist()], np.int64)
            mixed = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mixed.astype(np.int64) % n)], ["vec_id", "embedding", "leaf", "part"])

    asked = asking.mapInArrow(visits, "query_id long, q array<double>, leaf_ long, part_ long")
    rows_ = held.mapInArrow(dealt, "vec_id long, embedding array<double>, leaf long, part long")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qids, ranks, ids_, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            ids, x, qs = left.column("vec_id").to_numpy(), _matrix(left.column("embedding")), _matrix(right.column("q"))
            for qid, q in zip(right.column("query_id").to_numpy(), qs):
                near, d = _top(ids, x, qid, q, k)
                qids.append(np.full(len(near), qid))
                ids_.append(ids[near])
                scores.append(d)
        cat = lambda a, t: np.concatenate(a).astype(t) if a else np.array([], t)
        return pa.table({"query_id": cat(qids, np.int64), "vec_id": cat(ids_, np.int64), "score": cat(scores, np.float64)})

    found = rows_.groupBy("leaf", "part").cogroup(asked.groupBy("leaf_", "part_")).applyInArrow(meet, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
