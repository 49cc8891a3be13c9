"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-case words of a text and the first five characters of each word.  Over all
labelled rows, Spark counts each term's documents by class (near copies once); the terms that keep company with
either class beyond chance form the index vocabulary, weighted by plain TF-IDF.  A bounded sample of labelled
rows, half of it of each class as far as they go, becomes the example index: postings sorted by example, cut into
blocks with the largest weight of each term.  A text visits blocks in the order of their cosine bound until none
can hold a nearer example; examples of the very same text are no evidence for it, in calibration and in scores
alike, so no text's own label enters its score.  Votes of the nearest examples, weighted by the fourth power of the cosine, are
calibrated on a bounded sample of labelled rows.

Defined cases: null and empty texts, and texts without a term of the vocabulary, have no
neighbours and get the calibrated score of such texts; equal cosines go to the smaller example
id; a ``doc_id`` with several labels counts as toxic if one of them is, and of its several texts
the one that sorts first teaches; labels other than 0 and 1 are ignored; without labels of both classes every score is the share of toxic labels (0 without
any); repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, saved

#: Bounds of the model, which is held by the driver and sent to the tasks.
EXAMPLES, TERMS, CALIBRATION_ROWS = 4_000, 20_000, 8_000
#: Labelled rows that must hold a term before the G-test can judge it, neighbours that vote, and the power of the cosine.
LEAST_ROWS, NEIGHBOURS, POWER = 3, 31, 4
_WORD = re.compile(r"[^\W_]+")

SCHEMA = "doc_id long, score double, evidence array<struct<example: long, toxic: int, cosine: double>>"


def text_key(text: str | None) -> int:
    """By which a text knows the examples that are itself."""
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)


def terms_of(text: str | None) -> dict[str, int]:
    """Term -> count; whole words as they are, first five characters with a mark behind."""
    out: dict[str, int] = {}
    for w in _WORD.findall((text or "").lower()):
        out[w] = out.get(w, 0) + 1
        if len(w) > 5:
            p = w[:5] + "*"
            out[p] = out.get(p, 0) + 1
    return out


def _ranges(start: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the postings of all terms ``t``, term by term, and how many each has."""
    many = start[t + 1] - start[t]
    return np.arange(many.sum()) + np.repeat(start[t] - np.concatenate([[0], np.cumsum(many)[:-1]]), many), many


class Index:
    """Examples as postings sorted by term and example, with each block's largest weight of each term."""

    #: Blocks that are scored first, to learn what the others must reach.
    FIRST = 4

    def __init__(self, idf: dict[str, float], examples: list[tuple[int, int, dict[str, int]]], block: int = 64, keys: list[int] | None = None):
        self.terms = {t: i for i, t in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in sorted(idf)])
        found = [(i, y, *self.vector(tf), key) for (i, y, tf), key in sorted(zip(examples, keys or [0] * len(examples)), key=lambda x: x[0][0])]
        found = [x for x in found if len(x[2])]
        self.ids, self.labels, self.block = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int32), block
        self.keys = np.array([x[4] for x in found], np.int64)
        self.blocks = -(-len(found) // block)
        none = np.zeros(0)
        term = np.concatenate([none.astype(np.int64), *(x[2] for x in found)])
        example = np.repeat(np.arange(len(found)), [len(x[2]) for x in found])
        weight = np.concatenate([none, *(x[3] for x in found)])
        order = np.argsort(term, kind="stable")
        self.example, self.weight = example[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        cell = term[order] * max(self.blocks, 1) + self.example // block
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else none
        self.of_block = cell[first] % max(self.blocks, 1)
        self.most_start = np.searchsorted(cell[first] // max(self.blocks, 1), np.arange(len(self.terms) + 1))

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of unit length."""
        known = sorted((self.terms[t], n) for t, n in tf.items() if t in self.terms)
        t = np.array([x[0] for x in known], np.int64)
        w = (1 + np.log(np.array([x[1] for x in known], float))) * self.idf[t] if known else np.array([])
        norm = np.sqrt((w * w).sum())
        return t, w / norm if norm else w

    def nearest(self, tf: dict[str, int], k: int = 15, own: int | None = None) -> list[tuple[int, int, float]]:
        """The ``k`` examples of largest cosine above 0: (id, label, cosine); those whose text has the key ``own`` are left out.

        The blocks of the largest bounds are scored first, then at once all whose bound reaches the kth cosine so far.
        """
        t, q = self.vector(tf)
        if not len(t) or not self.blocks:
            return []
        at, many = _ranges(self.most_start, t)
        bound = np.bincount(self.of_block[at], np.repeat(q, many) * self.most[at], self.blocks)
        at, many = _ranges(self.start, t)
        example, value = self.example[at], np.repeat(q, many) * self.weight[at]
        block = example // self.block
        score, least = np.zeros(len(self.ids)), 0.0
        now = np.zeros(self.blocks, bool)
        now[np.argsort(-bound, kind="stable")[: self.FIRST]] = True
        done = np.zeros(self.blocks, bool)
        while (now & (bound > 0)).any():
            mine = now[block]
            score += np.bincount(example[mine], value[mine], len(score))
            done |= now
            if own is not None:
                score[self.keys == own] = 0
            if (score > 0).sum() >= k:
                least = np.partition(score, len(score) - k)[len(score) - k]
            now = ~done & (bound >= least - 1e-12)
        near = np.flatnonzero((score >= least) & (score > 0))
        near = near[np.lexsort((near, -score[near]))][:k]
        return [(int(self.ids[e]), int(self.labels[e]), float(min(1.0, score[e]))) for e in near]


class Model:
    def __init__(self, index: Index | None, grid: np.ndarray, value: np.ndarray, none: float):
        self.index, self.grid, self.value, self.none = index, grid, value, none

    def score(self, text: str | None) -> tuple[float, list]:
        near = self.index.nearest(terms_of(text), NEIGHBOURS, text_key(text)) if self.index else []
        return (self.calibrated(vote(near)) if near else self.none), near

    def calibrated(self, v: float) -> float:
        return float(np.interp(v, self.grid, self.value))


def vote(near: list[tuple[int, int, float]]) -> float:
    """Share of toxic nearness; one more vote of full nearness stands for no evidence."""
    return sum(c**POWER for _, y, c in near if y) / (1 + sum(c**POWER for _, _, c in near))


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: nondecreasing values at the pools' mean places."""
    pools: list[list[float]] = []
    for a in np.unique(x):
        at = y[x == a]
        pools.append([a * len(at), at.sum(), len(at)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of the rows to learn from: those whose crc32(doc_id) mod 5 is not 0."""
    y = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(y, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def copy_key(text: str | None) -> str:
    """Five words from the one that hashes lowest; near copies mostly share it."""
    words = (text or "").split()
    if not words:
        return ""
    low = min({w for w in words if len(w) > 5} or set(words), key=lambda w: zlib.crc32(w.encode()))
    at = words.index(low)
    return " ".join(words[at : at + 5])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([copy_key(x.as_py()) for x in b.column(1)], pa.string())], ["doc_id", "text", "y", "key"])

    held = saved(labelled(docs, labels).select("doc_id", "text", "y").mapInArrow(keyed, "doc_id long, text string, y int, key string"), "tox-labelled")
    # what near copies share would else pass for many witnesses
    once = held.join(held.groupBy("key", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")
    n, n1 = once.select(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n1 < n:
        return Model(None, np.array([0.0]), np.array([0.0]), n1 / n if n else 0.0)

    def term_rows(batches):
        for b in batches:
            count: dict[str, list[int]] = {}
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                for t in terms_of(text.as_py()):
                    c = count.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], ["term", "n", "n1"])

    counts = once.select("text", "y").mapInArrow(term_rows, "term string, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    # G-test of each term against the share of toxic rows, with a bound that rises with the number of rows
    share = n1 / n
    p = F.col("n1") / F.col("n")
    x = F.coalesce(F.col("n1") * F.log(p / share), F.lit(0.0)) + F.coalesce((F.col("n") - F.col("n1")) * F.log((1 - p) / (1 - share)), F.lit(0.0))
    kept = counts.filter(F.col("n") >= LEAST_ROWS).withColumn("g", 2 * x).filter(F.col("g") > 2 * math.log(n))
    vocab = kept.orderBy(F.desc("g"), "term").limit(TERMS).collect()
    idf = {r["term"]: float(np.log(1 + n / r["n"])) for r in vocab}
    if not idf:
        return Model(None, np.array([0.0]), np.array([0.0]), share)
    sample = hashed_sample(held.filter("y = 1"), "doc_id", EXAMPLES // 2).unionByName(hashed_sample(held.filter("y = 0"), "doc_id", EXAMPLES // 2))
    sent = held.sparkSession.sparkContext.broadcast(idf)

    def only_known(batches):
        for b in batches:
            tf = [{t: c for t, c in terms_of(x.as_py()).items() if t in sent.value} for x in b.column(1)]
            keys = pa.array([text_key(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(t) for t in tf], pa.list_(pa.string())), pa.array([list(t.values()) for t in tf], pa.list_(pa.int64())), keys], ["doc_id", "y", "t", "c", "key"])

    small = "doc_id long, y int, t array<string>, c array<long>, key long"
    found = sample.select("doc_id", "text", "y").mapInArrow(only_known, small).collect()
    index = Index(idf, [(r["doc_id"], r["y"], dict(zip(r["t"], r["c"]))) for r in found], keys=[r["key"] for r in found])
    rest = hashed_sample(held, "doc_id", CALIBRATION_ROWS).select("doc_id", "text", "y").mapInArrow(only_known, small).collect()
    votes, ys, none = [], [], [0.0, 0.0]
    for r in rest:
        near = index.nearest(dict(zip(r["t"], r["c"])), NEIGHBOURS, r["key"])
        if near:
            votes.append(vote(near))
            ys.append(r["y"])
        else:
            none = [none[0] + r["y"], none[1] + 1]
    if not votes:
        return Model(index, np.array([0.0, 1.0]), np.array([0.0, 1.0]), (none[0] + 0.5 * share) / (none[1] + 0.5))
    grid, value = _isotonic(np.array(votes), np.array(ys, float))
    nothing = (none[0] + 0.5 * share) / (none[1] + 0.5)
    # nearness that fades out ends at the score of texts without neighbours
    return Model(index, np.concatenate([[0.0], grid]), np.concatenate([[nothing], value]), nothing)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``evidence`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            found = [sent.value.score(x.as_py()) for x in b.column(1)]
            ev = [[{"example": i, "toxic": y, "cosine": c} for i, y, c in near] for _, near in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(ev, pa.list_(pa.struct([("example", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))], ["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and 0/1 prediction of every document, learnt from ``labels``; with the evidence."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score(docs, fit(docs, labels)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
