"""Ranked lexical search by two trees: one over the items, one over each chunk of documents.

Documents become vectors of the items' terms (one pass over the texts).  Both trees split their
vectors in halves along their widest direction, and every node holds the largest value of each term
below it.  A pair of nodes is bounded by the product of these maxima; a pair whose bound is below
the weakest kth score among its items is dropped with all that is below it, which loses nothing.
Kth scores start from a scored part of the documents and rise while a task works.  Each task
returns its best rows of every item; Spark ranks them.

All scores are whole numbers below 2**53, so products in doubles are exact.

Items are held by every task in slices of bounded size (``SLICE_BYTES`` of text): any benchmark of
less is one slice, a larger one makes several, each of which reads the documents again.

Defined cases: a null text has no terms; rows of one ``item_id`` (null too) are one item with the
terms of all; each row of documents is a document of its own; null ``doc_id`` ranks behind others
of equal score; an item without terms, or whose terms no document holds, has no rows; empty tables
give no rows; columns other than ``item_id``, ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .terms import WORDS_AND_DIGITS, terms

#: Text of the items that tasks hold at once, documents of a chunk, terms of an item block, leaves of both trees.
SLICE_BYTES, CHUNK_DOCS, BLOCK_TERMS, DOC_LEAF, ITEM_LEAF = 16 << 20, 1024, 4096, 8, 8
#: One document in so many is scored first, for the kth scores to start from.
FIRST_OF = 64


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``ids`` and ``tfs`` (packed int32) of the documents with a term."""

    def read(batches):
        ids_of = vocabulary.value
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms(data, WORDS_AND_DIGITS)
                if found:
                    held = [(ids_of[t], n) for t, n in Counter(found).items() if t in ids_of]
                    flat = np.array(held, np.int32).reshape(-1, 2)
                    flat = flat[np.argsort(flat[:, 0])]
                    for column, x in zip(out, (doc_id, len(found), flat[:, 0].tobytes(), flat[:, 1].tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n", "ids", "tfs"])

    text = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return text.mapInArrow(read, "doc_id long, n long, ids binary, tfs binary")


def frequencies(held: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; tasks send sums."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in held.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def halves(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows of ``x`` in which each leaf of ``leaf`` rows, and each node above it, lies in one piece."""
    order, step = np.arange(len(x)), leaf << max(0, (-(-len(x) // leaf) - 1).bit_length())
    while step > leaf:
        step //= 2
        for first in range(0, len(x), 2 * step):
            rows = order[first : first + 2 * step]
            at = x[rows] - x[rows].mean(0)
            spread, widest = at.T @ at, np.ones(x.shape[1])
            for _ in range(8):  # towards the direction of the largest variance
                widest = spread @ widest
                widest /= np.abs(widest).max() or 1.0
            order[first : first + 2 * step] = rows[np.argsort(at @ widest, kind="stable")]
    return order


def projected(x: np.ndarray) -> np.ndarray:
    return x @ np.random.default_rng(1).standard_normal((x.shape[1], 48))


def maxima(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Largest values of each node, from the leaves (of ``leaf`` rows) up to the root."""

    def pooled(y: np.ndarray, width: int) -> np.ndarray:
        return np.maximum.reduceat(y, np.arange(0, len(y), width), axis=0)

    out = [pooled(x, leaf)]
    while len(out[-1]) > 1:
        out.append(pooled(out[-1], 2))
    return out


class Block:
    """Items that lie together in the item tree, over their own terms: weights by item, and maxima by node."""

    def __init__(self, items: list[int], sets: list[np.ndarray], weight: np.ndarray):
        self.terms = np.unique(np.concatenate([sets[i] for i in items]))
        x = np.zeros((len(items), len(self.terms)))
        for row, i in enumerate(items):
            x[row, np.searchsorted(self.terms, sets[i])] = weight[sets[i]]
        near = halves(projected(x), ITEM_LEAF)
        self.items, self.weights = np.array(items)[near], x[near]
        self.nodes = maxima(self.weights, ITEM_LEAF)
        self.columns = [np.flatnonzero(node) for node in self.nodes[0]]


def blocks_of(sets: list[np.ndarray], weight: np.ndarray) -> list[Block]:
    """Items with the same rare terms lie together; a block takes items until it has ``BLOCK_TERMS`` terms."""
    order = sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: tuple(sets[i][np.argsort(-weight[sets[i]], kind="stable")][:3].tolist()))
    out, now, size = [], [], 0
    for i in order:
        if now and size + len(sets[i]) > 2 * BLOCK_TERMS:
            out.append(Block(now, sets, weight))
            now, size = [], 0
        now.append(i)
        size += len(sets[i])
    return [*out, Block(now, sets, weight)] if now else out


class Best:
    """The ``k`` best rows of each item so far; ``least`` is the score that a row must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, np.maximum(least, 1.0)  # only scores above 0 count
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        old = self.rows.get(item, (scores[:0], ids[:0], missing[:0]))
        s, i, m = (np.concatenate(x) for x in zip(old, (scores, ids, missing)))
        first = np.lexsort((i, m, -s))[: self.k]
        self.rows[item] = s[first], i[first], m[first]
        if len(first) == self.k:
            self.least[item] = max(self.least[item], s[first[-1]])


class Chunk:
    """Documents as rows of (row, term, impact) and their ids."""

    def __init__(self, doc_ids: list, n: list[int], ids: list[bytes], tfs: list[bytes], docs: int, length: int):
        self.missing = np.array([d is None for d in doc_ids])
        self.doc_ids = np.array([d or 0 for d in doc_ids], np.int64)
        m = np.array([10 + 90 * x * docs // length for x in n], np.int64)
        self.rows = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        self.terms = np.frombuffer(b"".join(ids), np.int32).astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
        self.impacts = (1_000_000_000 * tf // (1000 * tf + 8 * m[self.rows])).astype(float)

    def meet(self, block: Block, best: Best, seen: dict) -> None:
        """Adds to ``best`` every row that can still matter to an item of ``block``."""
        at = np.searchsorted(block.terms, self.terms)
        at[at == len(block.terms)] = 0
        here = block.terms[at] == self.terms
        rows, at, impacts = self.rows[here], at[here], self.impacts[here]
        root = np.zeros(len(block.terms))
        np.maximum.at(root, at, impacts)
        # the roots first: only rows with a term of the block take part
        if (block.weights @ root < best.least[block.items]).all():
            return
        some, rows = np.unique(rows, return_inverse=True)
        x = np.zeros((len(some), len(block.terms)))
        x[rows, at] = impacts
        order = halves(projected(x), DOC_LEAF)
        x, some = x[order], some[order]
        tree = maxima(x, DOC_LEAF)
        weakest = [np.minimum.reduceat(best.least[block.items], np.arange(0, len(block.items), ITEM_LEAF))]
        while len(weakest) < len(block.nodes):
            weakest.append(np.minimum.reduceat(weakest[-1], np.arange(0, len(weakest[-1]), 2)))
        d, i = len(tree) - 1, len(block.nodes) - 1
        doc, item = np.array([0]), np.array([0])
        while True:
            bound = np.zeros(len(doc))
            for node in np.unique(item):  # one product for all documents' nodes that meet an item node
                mine = item == node
                has = np.flatnonzero(block.nodes[i][node])
                bound[mine] = tree[d][np.ix_(doc[mine], has)] @ block.nodes[i][node][has]
            seen["pairs"] = seen.get("pairs", 0) + len(doc)
            open_ = bound >= weakest[i][item]
            doc, item, bound = doc[open_], item[open_], bound[open_]
            if not len(doc) or (d == 0 and i == 0):
                break
            if d:
                d -= 1
                doc, item = np.concatenate([2 * doc, 2 * doc + 1]), np.concatenate([item, item])
                doc, item = doc[doc < len(tree[d])], item[doc < len(tree[d])]
            if i:
                i -= 1
                doc, item = np.concatenate([doc, doc]), np.concatenate([2 * item, 2 * item + 1])
                doc, item = doc[item < len(block.nodes[i])], item[item < len(block.nodes[i])]
        for leaf in np.unique(item):
            mine = item == leaf
            near = np.argsort(-bound[mine])
            docs, bounds, has = doc[mine][near], bound[mine][near], block.columns[leaf]
            members = np.arange(leaf * ITEM_LEAF, min((leaf + 1) * ITEM_LEAF, len(block.items)))
            for first in range(0, len(docs), 4):
                if bounds[first] < best.least[block.items[members]].min():
                    break
                picked = (docs[first : first + 4, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
                picked = picked[picked < len(some)]
                scores = x[np.ix_(picked, has)] @ block.weights[np.ix_(members, has)].T
                seen["scored"] = seen.get("scored", 0) + scores.size
                for column, it in enumerate(block.items[members].tolist()):
                    good = scores[:, column] >= best.least[it]
                    if good.any():
                        to = some[picked[good]]
                        best.add(it, scores[good, column], self.doc_ids[to], self.missing[to])


def _searched(held: DataFrame, sent, k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: of every task, each item's best rows that reach the kth score known so far."""

    def search(batches):
        blocks, least, docs, length = sent.value
        best, seen = Best(least.copy(), k), {}
        for b in batches:
            for first in range(0, b.num_rows, CHUNK_DOCS):
                part = b.slice(first, CHUNK_DOCS)
                chunk = Chunk(*(c.to_pylist() for c in part.columns), docs, length)
                for block in blocks:
                    chunk.meet(block, best, seen)
        for item, (scores, ids, missing) in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=missing), pa.array(scores.astype(np.int64))], ["item", "doc_id", "score"])

    return held.mapInArrow(search, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _slice(docs: DataFrame, texts: list, k: int, report: dict | None) -> DataFrame | None:
    spark = docs.sparkSession
    of_item: dict = {}
    for item_id, data in texts:
        of_item.setdefault(item_id, set()).update(terms(data or b"", WORDS_AND_DIGITS))
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*of_item.values())))}
    names = list(of_item)
    sets = [np.array(sorted(vocabulary[t] for t in of_item[x]), np.int64) for x in names]
    held = saved(vectors(docs, spark.sparkContext.broadcast(vocabulary)), "lexical-vectors")
    n = held.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    if not n["docs"]:
        return None
    df = frequencies(held, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], float)
    blocks = blocks_of(sets, weight)
    start = np.zeros(len(names))
    some = held.filter(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(FIRST_OF)) == 0)
    kth = _ranked(_searched(some, spark.sparkContext.broadcast((blocks, start, n["docs"], n["length"])), k), k).filter(F.col("rank") == k)
    for r in kth.toLocalIterator():  # one number for each item of the slice, at most
        start[r["item"]] = r["score"]
    if report is not None:
        report |= {"items": len(names), "terms": len(vocabulary), "started": int((start > 0).sum())}
    found = _ranked(_searched(held, spark.sparkContext.broadcast((blocks, start, n["docs"], n["length"])), k), k)
    listed = spark.sparkContext.broadcast(names)

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([listed.value[i] for i in b.column(0).to_pylist()], pa.int64()), *b.columns[1:]], ["item_id", "rank", "doc_id", "score"])

    return found.select("item", "rank", "doc_id", "score").mapInArrow(named, "item_id long, rank int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, slice_bytes: int = SLICE_BYTES, report: dict | None = None) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents, exactly."""
    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("data"))
    size = read.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    slices = -(-size // slice_bytes)
    out = None
    for s in range(slices):
        texts = [(r["item_id"], r["data"]) for r in read.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).toLocalIterator()]
        found = _slice(docs, texts, k, report) if texts else None
        out = found if out is None else out.union(found) if found is not None else out
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
