"""Quality by weak labels.

Heuristic labellers vote keep, drop or abstain on every document.  Spark counts the vote patterns
of all documents; expectation-maximisation on these counts estimates each labeller's accuracy and
the share of good documents.  The posterior of each document's pattern then trains a linear scorer
on hashed features, on a bounded sample of documents; the scorer rates every document.

Defined cases: null and empty texts are dropped by the length labeller and get the score of a text
without features; ties of a pattern's posterior (0.5) count as good; without documents nothing is
trained and the result is empty; repeated rows give a row each; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

#: Bound of the documents that the scorer is trained on, and the width of its feature table.
TRAIN_DOCS, WIDTH = 20_000, 1 << 14
#: The heuristics' limits.
LIMITS = {"words": (5, 30), "symbols": (0.12, 0.03), "upper": (0.5, 0.2), "mean_word": (3, 14), "marks": (0.25, 0.08), "repeat": (0.5, 0.2), "digits": (0.3, 0.1), "bars": (0.1, 0.02), "again": (0.1, 0.02)}
LABELLERS = tuple(LIMITS)


def statistics(text: Column) -> dict[str, Column]:
    """The numbers that the labellers look at, as columns."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    count = lambda pattern: F.length(F.regexp_replace(text, pattern + "+", ""))  # whole runs at once
    n_words = F.greatest(F.size(words), F.lit(1))
    return {
        "words": F.size(words).cast("double"),
        "symbols": count(r"[\p{L}\p{N}\s.,;:!?'\"()-]") / n,
        "upper": count(r"[^\p{Lu}]") / F.greatest(count(r"[^\p{L}]"), F.lit(1)),
        "mean_word": count(r"\s") / n_words,
        "marks": count("[^!?*#%&$|]") / n_words,
        "repeat": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "digits": count("[^0-9]") / n,
        "bars": count("[^|]") / n_words,
        "again": F.size(F.filter(F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda a, b: a == b), lambda x: x)) / n_words,
    }


def votes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``pattern``: a character for each labeller, + keep, - drop, 0 abstain."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cols = []
    for name, x in statistics(F.col("text")).items():
        low, high = LIMITS[name]
        if name == "words":
            v = F.when(x < low, "-").when(x >= high, "+").otherwise("0")
        elif name == "mean_word":
            v = F.when((x < low) | (x > high), "-").when((x >= 4) & (x <= 10), "+").otherwise("0")
        else:
            v = F.when(x >= low, "-").when(x <= high, "+").otherwise("0")
        cols.append(v)
    return d.withColumn("pattern", F.concat(*cols))


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over vote patterns: share of good documents, each labeller's vote probabilities
    by class (bad, good; drop, abstain, keep), and each pattern's posterior of being good."""
    patterns = sorted(counts)
    v = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    n = np.array([counts[p] for p in patterns], float)
    post = np.clip(0.5 + 0.5 * (v - 1).mean(1) + 0.1, 0.02, 0.98)  # a labeller is better than chance
    theta = np.zeros((2, v.shape[1], 3))
    prior = 0.5
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = float((w[1].sum() + 1) / (n.sum() + 2))
        for k in range(3):
            theta[:, :, k] = w @ (v == k)
        theta = (theta + 0.5) / (w.sum(1)[:, None, None] + 1.5)
        like = np.log(theta[:, np.arange(v.shape[1])[None], v]).sum(2)
        post = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + like[0] - np.log(prior) - like[1], -50, 50)))
    return prior, theta, dict(zip(patterns, post.tolist()))


_WORD = re.compile(r"\S+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of length one: word shapes, endings and marks, counted on the whole text."""
    shapes: dict[str, int] = {}
    last = ""
    for w in _WORD.findall(text):
        if w == last:
            shapes["again"] = shapes.get("again", 0) + 1
        last = w
        if w.isalpha():
            key = "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "l"
            key += str(min(len(w), 12))
        else:
            key = "m" + "".join(sorted({c for c in w if not c.isalnum()}))[:4] + ("d" if w[-1].isdigit() else "")
        shapes[key] = shapes.get(key, 0) + 1
    lines = text.split("\n")
    shapes["repeat"] = len(lines) - len(set(lines))
    slots: dict[int, float] = {}
    for k, c in shapes.items():
        s = zlib.crc32(k.encode()) % WIDTH
        slots[s] = slots.get(s, 0.0) + c
    x = np.sqrt(np.array(list(slots.values())))
    return np.array(list(slots), np.int64), x / max(np.sqrt((x * x).sum()), 1e-9)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = 12, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by averaged stochastic gradients, in a fixed order."""
    w, b, total, total_b, n = np.zeros(WIDTH), 0.0, np.zeros(WIDTH), 0.0, 0
    grad = np.full(WIDTH, 1e-6)
    order = np.arange(len(rows))
    rng = np.random.default_rng(3)
    for p in range(passes):
        rng.shuffle(order)
        for i in order.tolist():
            s, x = rows[i]
            g = y[i] - 1 / (1 + np.exp(-(w[s] @ x + b)))
            grad[s] += (g * x) ** 2
            w[s] += rate * g * x / np.sqrt(grad[s])
            b += 0.05 * g
        if p >= passes // 2:
            total, total_b, n = total + w, total_b + b, n + 1
    return total / max(n, 1), total_b / max(n, 1)


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``keep`` (score of 0.5 or more) of every document."""
    spark = docs.sparkSession
    counts = {r["pattern"]: r["count"] for r in votes(docs).groupBy("pattern").count().collect()}  # 3 ** labellers at most
    if not counts:
        return spark.createDataFrame([], "doc_id long, score double, keep int")
    _, _, post = estimate(counts)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # tasks turn the sample into features, so its size in memory does not depend on its texts
    picked = hashed_sample(plain, "doc_id", TRAIN_DOCS)

    def featured(batches):
        for b in batches:
            f = [features(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in f], pa.list_(pa.int64())), pa.array([x for _, x in f], pa.list_(pa.float64()))], ["pattern", "s", "x"])

    sample = votes(picked).select("pattern", "text").mapInArrow(featured, "pattern string, s array<long>, x array<double>").collect()
    w, b = train([(np.array(r["s"], np.int64), np.array(r["x"])) for r in sample], np.array([post[r["pattern"]] for r in sample]))
    sent = spark.sparkContext.broadcast((w, b))

    def rate(batches):
        w, b = sent.value
        for x in batches:
            f = [features(t.as_py() or "") for t in x.column(1)]
            score = np.array([1 / (1 + np.exp(-(w[s] @ v + b))) for s, v in f])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "keep"])

    return plain.mapInArrow(rate, "doc_id long, score double, keep int")
