"""Masked pseudo-likelihood: counts of words and of windows over all documents, smoothed by a bidirectional window network.

Every token is predicted from its neighbours on both sides.  Texts are held in blocks of numbered
words; Spark counts every word, and every word between every two neighbours, over all documents:
blocks send their distinct keys to the task of the key's part, which sends the counts back.  Words
and windows are known by 64-bit hashes.  A network of fixed size (the most frequent words are
classes of their own, the others share hashed classes; one embedding for each side, a hidden layer,
a softmax over classes) is trained in numpy on the counts of class windows.  A token's conditional
probability is its window's count against its neighbours' count, smoothed by the network's class
probability times the word's share of its class; logarithms sum to the document's score.  A token's
own occurrence is not counted for it, so a window seen once falls back to the network.

Defined cases: null and empty texts have no tokens, a sum of 0 and no mean; words that the corpus
does not hold count as one more in their class; texts outside the corpus meet its whole counts;
repeated rows give a row each; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import bucketed, saved
from .packed import by_part, narrow, numbers, planes, widened

#: Classes with a single word, and hashed classes.
OWN, SHARED = 64, 16
CLASSES = OWN + SHARED
EDGE = CLASSES  # stands outside both ends of a text
#: Weight of the network against counts; characters in a block; windows in a part.
SMOOTH, BLOCK_CHARS, PART_WINDOWS = 4.0, 1 << 22, 500_000
_ODD, _OUTSIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def blocks(docs: DataFrame, block_chars: int = 0) -> DataFrame:
    """Texts in blocks: ``words`` (hashes, the frequent first), ``at`` (each token's place in them) and ``many`` (tokens of each document)."""
    block_chars = block_chars or BLOCK_CHARS

    def rows(batches):
        part, n, ids, keys, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            words, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            cols = ([(part << 32) + n], [ids], [[len(k) for k in keys]], [words[order].tobytes()], [planes(place[at])])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["block", "doc_ids", "many", "words", "at"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                keys.append(wordhash.words(" ".join(tokens(text)))[0])
                chars += len(text or "")
                if chars >= block_chars:
                    yield out()
                    n, ids, keys, chars = n + 1, [], [], 0
        if ids:
            yield out()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "block long, doc_ids array<long>, many array<long>, words binary, at binary")


def _neighbours(x: np.ndarray, many: np.ndarray, edge) -> tuple[np.ndarray, np.ndarray]:
    """What stands to the left and right of each token of consecutive documents."""
    left, right = np.roll(x, 1), np.roll(x, -1)
    end = np.cumsum(many[many > 0])
    left[np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(end)]] = edge
    right[end - 1] = edge
    return left, right


def word_keys(words: np.ndarray, at: np.ndarray, many: np.ndarray):
    """Key, finer key and count of each distinct word."""
    return words, np.zeros(len(words), np.uint32), np.bincount(at, minlength=len(words)), None


def window_keys(words: np.ndarray, at: np.ndarray, many: np.ndarray):
    """Key of both neighbours, finer key of the word between them, and count of each distinct window; the window of each token."""
    w = words[at]
    left, right = _neighbours(w, many, _OUTSIDE)
    pair = wordhash.mix(left * _ODD + wordhash.mix(right + _ODD))
    full, first, which, n = np.unique(wordhash.mix(pair ^ wordhash.mix(w + _OUTSIDE)), return_index=True, return_inverse=True, return_counts=True)
    return pair[first], (full >> np.uint64(32)).astype(np.uint32), n, which


def _opened(words: bytes, at: bytes, many) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(words, np.uint64), numbers(at), np.array(many, np.int64)


def _counted(corpus: DataFrame, asked: DataFrame | None, keys, parts: int, name: str, summary: bool = False) -> DataFrame:
    """For each block and part: counts ``n`` of its finer keys and ``all`` of its keys over the corpus, in the block's order;
    with ``summary``, also each part's most frequent keys and totals by hashed class, without a block."""

    # most frequent keys are told by their whole hashes
    pack, opened = (np.ndarray.tobytes, lambda x: np.frombuffer(x, np.uint64)) if summary else (narrow, widened)

    def dealt(held: DataFrame, counts: bool) -> DataFrame:
        def rows(batches):
            for b in batches:
                for block, words, at, many in ([c[i].as_py() for c in b.columns] for i in range(b.num_rows)):
                    key, fine, n, _ = keys(*_opened(words, at, many))
                    order, cut = by_part(key, parts)
                    key, fine, n = key[order], fine[order], n[order] if counts else np.zeros(len(key), np.int64)
                    some = np.flatnonzero(np.diff(cut)).tolist()
                    cols = (some, [block] * len(some), [pack(key[cut[p] : cut[p + 1]]) for p in some], [fine[cut[p] : cut[p + 1]].tobytes() for p in some], [planes(n[cut[p] : cut[p + 1]]) for p in some])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "block", "key", "fine", "n"])

        return held.select("block", "words", "at", "many").mapInArrow(rows, "part int, block long, key binary, fine binary, n binary")

    def count(group: pa.Table) -> pa.Table:
        raw = {c: group.column(c).to_pylist() for c in group.column_names}
        key, fine = np.concatenate([opened(x) for x in raw["key"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in raw["fine"]])
        n = np.concatenate([numbers(x) for x in raw["n"]])
        order = np.lexsort((fine, key))
        k, f = key[order], fine[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        both = new | np.concatenate([[True], f[1:] != f[:-1]])
        found = []
        for first in (both, new):
            start = np.flatnonzero(first)
            each = np.empty(len(key), np.int64)
            each[order] = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(key))))
            found.append(np.minimum(each, 0xFFFFFFFF))
        cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw["fine"]])])
        out = [(b, p, *(planes(x[a:z]) for x in found)) for b, p, a, z in zip(raw["block"], raw["part"], cut[:-1].tolist(), cut[1:].tolist())]
        if summary:
            one = order[new]
            words, times = key[one], found[0][one]
            top = np.lexsort((words, -times))[:OWN]
            totals = np.array([times[words % np.uint64(SHARED) == c].sum() for c in range(SHARED)], np.int64)
            out.append((None, raw["part"][0], words[top].tobytes(), np.concatenate([times[top], totals]).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "part", "n", "all"])

    sent = dealt(corpus, True)
    if asked is not None:
        sent = sent.union(dealt(asked, False))
    return saved(sent.groupBy("part").applyInArrow(count, "block long, part int, n binary, all binary"), name)


def _classes(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of each word (by its hash)."""
    cls = OWN + (words % np.uint64(SHARED)).astype(np.int64)
    if len(own):
        order = np.argsort(own)
        i = np.minimum(np.searchsorted(own[order], words), len(own) - 1)
        hit = own[order][i] == words
        cls[hit] = order[i[hit]]
    return cls


def _windows(cls: np.ndarray, many: np.ndarray) -> np.ndarray:
    """One number for each token's (left, right, own) classes."""
    left, right = _neighbours(cls, many, EDGE)
    return (left * (CLASSES + 1) + right) * CLASSES + cls


class Network:
    """Softmax over classes from a hidden layer over the embeddings of both neighbours."""

    def __init__(self, width: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = CLASSES + 1
        self.p = [rng.normal(0, 0.3, (n, width)), rng.normal(0, 0.3, (n, width)), np.zeros(width), rng.normal(0, 0.1, (width, CLASSES)), np.zeros(CLASSES)]

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log probabilities of every pair of neighbours at once."""
        left, right, b, w, c = self.p
        h = np.tanh(left[:, None] + right[None] + b).reshape(-1, left.shape[1])
        z = h @ w + c
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, counts: np.ndarray, rounds: int = 300, rate: float = 0.02) -> "Network":
        """``counts``: how often each class (column) stood between each pair (row)."""
        total = max(counts.sum(), 1.0)
        share, rows = counts / total, counts.sum(1, keepdims=True) / total
        self.p[4][:] = np.log(counts.sum(0) / total + 1e-6)
        m, v = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p]
        n = CLASSES + 1
        for t in range(1, rounds + 1):
            h, logp = self.forward()
            dz = np.exp(logp) * rows - share
            dh = (dz @ self.p[3].T) * (1 - h * h)
            cube = dh.reshape(n, n, -1)
            grads = [cube.sum(1), cube.sum(0), dh.sum(0), h.T @ dz, dz.sum(0)]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-10)
        return self


class Model(NamedTuple):
    """The corpus in blocks, its word counts by block, and what has a fixed size: own words, totals and log probabilities of classes."""

    held: DataFrame
    words: DataFrame
    parts: int
    own: np.ndarray
    totals: np.ndarray
    logp: np.ndarray


def fit(docs: DataFrame) -> Model:
    """The corpus's word counts, and the log probability of every (left, right, own) class."""
    held = bucketed(blocks(docs), "block")
    spark = docs.sparkSession
    size = held.select(F.aggregate("many", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_WINDOWS))
    words = _counted(held, None, word_keys, parts, "lm-words", summary=True)

    def told(batches):
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, n = np.frombuffer(w, np.int64), np.frombuffer(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(w), pa.nulls(SHARED, pa.int64())]), pa.array([None] * len(w) + [*range(SHARED)], pa.int32()), pa.array(n)], ["word", "class", "n"])

    summary = words.filter("block is null").select("n", "all").mapInArrow(told, "word long, class int, n long")
    top = summary.filter("word is not null").orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    totals = np.zeros(CLASSES)
    for r in summary.filter("class is not null").groupBy("class").agg(F.sum("n").alias("n")).collect():
        totals[OWN + r["class"]] = r["n"]
    for i, r in enumerate(top):
        totals[i] = r["n"]
        totals[OWN + int(own[i] % np.uint64(SHARED))] -= r["n"]
    cells = (CLASSES + 1) ** 2 * CLASSES

    def count(batches):
        total = np.zeros(cells, np.int64)
        for b in batches:
            for block in ([c[i].as_py() for c in b.columns] for i in range(b.num_rows)):
                w, at, many = _opened(*block)
                if len(at):
                    total += np.bincount(_windows(_classes(w, own)[at], many), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["window", "n"])

    found = held.select("words", "at", "many").mapInArrow(count, "window long, n long").groupBy("window").agg(F.sum("n").alias("n")).collect()  # bounded by the number of class triples
    counts = np.zeros(cells)
    counts[np.array([r["window"] for r in found], np.int64)] = [r["n"] for r in found]
    _, logp = Network().fit(counts.reshape(-1, CLASSES)).forward()
    return Model(held, words, parts, own, totals, logp.ravel())


def score_own(model: Model) -> DataFrame:
    """As ``score``, of the documents that the model was fitted on: a token's own occurrence is left out of the counts."""
    return _score(None, model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_prob`` (sum of conditional log probabilities) and ``per_token`` (its mean) of every document.

    The documents are new to the model, whatever they hold; see ``score_own`` for those it was fitted on.
    """
    return _score(docs, model)


def _score(docs: DataFrame | None, model: Model) -> DataFrame:
    inside = docs is None
    held = model.held if inside else bucketed(blocks(docs).withColumn("block", -F.col("block") - 1), "block")
    asked = None if inside else held
    words = model.words if inside else _counted(model.held, asked, word_keys, model.parts, "lm-words")
    windows = _counted(model.held, asked, window_keys, model.parts, "lm-windows")
    back = words.withColumn("window", F.lit(False)).union(windows.withColumn("window", F.lit(True))).filter("block is not null" if inside else "block < 0")
    parts, own, totals = model.parts, model.own, model.totals
    sent = held.sparkSession.sparkContext.broadcast(model.logp)
    less = int(inside)  # a token's own occurrence

    def put_together(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = {(w, p): (n, a) for w, p, n, a in zip(*(right.column(c).to_pylist() for c in ("window", "part", "n", "all")))}
        for doc_ids, *block in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "words", "at", "many"))):
            w, at, many = _opened(*block)

            def counts(kind: bool, key: np.ndarray) -> list[np.ndarray]:
                order, cut = by_part(key, parts)
                found = [np.empty(len(key), np.int64) for _ in range(2)]
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    for x, data in zip(found, replies[kind, p]):
                        x[order[cut[p] : cut[p + 1]]] = numbers(data)
                return found

            logs = np.zeros(0)
            if len(at):
                cls = _classes(w, own)
                share = np.log(np.maximum(counts(False, w)[0], 1) / (totals[cls] + 1))
                pair, _, _, which = window_keys(w, at, many)
                n, all_ = ((x - less)[which] for x in counts(True, pair))
                smooth = sent.value[_windows(cls[at], many)] + share[at] + np.log(SMOOTH)
                with np.errstate(divide="ignore"):
                    logs = np.logaddexp(np.log(n), smooth) - np.log(all_ + SMOOTH)
            total = np.bincount(np.repeat(np.arange(len(many)), many), logs, len(many))
            mean = [s / k if k else None for s, k in zip(total.tolist(), many.tolist())]
            out.append(pa.table([pa.array(doc_ids, pa.int64()), pa.array(many), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], names=["doc_id", "n_tokens", "log_prob", "per_token"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["doc_id", "n_tokens", "log_prob", "per_token"])

    return held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(put_together, "doc_id long, n_tokens long, log_prob double, per_token double")
