"""Benchmark decontamination by the q-gram lemma.

An item of ``m`` characters that stands in a text with at most ``e`` edits shares at least
``m - q + 1 - q * e`` of its character q-grams with it, inside a band of ``e`` diagonals either
side.  Each task counts the q-grams that a text shares with every item in overlapping diagonal
bands, keeps the bands that meet the bound, and verifies these by a banded alignment.

Texts and items are compared in lower case with runs of white space as one space.  Items are
indexed in slices of bounded size: the documents are scanned once for each slice, so that the
tasks' memory does not grow with the benchmark.

Defined cases: null and empty texts have no hits; items that are null or, when normalised,
shorter than ``least_chars`` are left out; equal items give a hit each; repeated rows give hits
each; empty tables give empty results; columns other than ``doc_id``, ``text``, ``item_id`` are
ignored by ``hits`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

Q, EDIT_SHARE, LEAST_CHARS, SLICE_CHARS = 8, 0.1, 40, 1 << 22
_SPACE = re.compile(r"\s+")


def normalise(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.array([], np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return h ^ (h >> np.uint64(29))


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of ``pattern`` against a part of ``text``, on the diagonals ``low`` to ``high`` only, and where that part ends.

    The part starts anywhere, or with the text if ``anchored``.  Places outside the text match nothing, which costs what
    leaving out the pattern's character costs.  More than ``most`` edits may count as more.  Rows of the band at once:
    insertions along a row are a running minimum.
    """
    m, n, width = len(pattern), len(text), high - low + 1
    padded = np.full(m + width, -1, np.int64)
    a, z = max(0, low), min(n, high + m)
    if a < z:
        padded[a - low : z - low] = text[a:z]
    at = np.arange(width)
    row = np.where(low + at >= 0, low + at, most + 1) if anchored else np.zeros(width, np.int64)
    step = np.empty(width, np.int64)
    for i, c in enumerate(pattern.tolist()):
        np.add(row, padded[i : i + width] != c, out=step)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        row = np.minimum.accumulate(step - at) + at
        if row.min() > most:
            return most + 1, n
    end = int(row.argmin())
    return int(row[end]), min(max(low + m + end, 0), n)


class ItemIndex:
    """The q-grams of one slice of items, with a bit table in front of them."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE, least_chars: int = LEAST_CHARS):
        kept = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= max(least_chars, q)]
        self.q, self.ids, self.codes = q, [i for i, _ in kept], [_codes(t) for _, t in kept]
        self.edits = np.array([min(int(len(c) * share), (len(c) - q) // q) for c in self.codes], np.int64)
        self.need = np.array([len(c) - q + 1 - q * e for c, e in zip(self.codes, self.edits)], np.int64)
        grams = [_grams(c, q) for c in self.codes]
        all_ = np.concatenate([*grams, np.array([], np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.array([], np.int64)])
        order = np.argsort(all_, kind="stable")
        self.item, self.place = item[order], place[order].astype(np.int64)
        self.grams, self.first, self.count = np.unique(all_[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << max(16, min(24, len(all_).bit_length() + 6)), bool)
        self.bits[all_ & np.uint64(len(self.bits) - 1)] = True

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) in the normalised text: the best place of each item found."""
        norm = normalise(text)
        codes = _codes(norm)
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.bits[grams & np.uint64(len(self.bits) - 1)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[k] == grams[at]
        at, k = at[same], k[same]
        n = self.count[k]
        if not len(k):
            return []
        # items of which too few q-grams occur at all are out before diagonals are looked at
        pos = np.repeat(at, n)
        ref = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = self.item[ref]
        likely = np.bincount(item, minlength=len(self.ids))[item] >= self.need[item]
        pos, ref, item = pos[likely], ref[likely], item[likely]
        if not len(item):
            return []
        diagonal = pos - self.place[ref]
        width = 2 * self.edits[item] + 1
        out: dict[int, tuple[int, int, int, int]] = {}
        for shift in (0, 1):  # bands of twice the width, each overlapping half of the next
            band = (diagonal + (shift * width)) // (2 * width)
            key = (item.astype(np.int64) << 40) + (band + (1 << 38))
            keys, which = np.unique(key, return_inverse=True)
            # a q-gram of the item counts once in a band
            gram = np.unique(which.astype(np.int64) * (1 << 32) + self.place[ref])
            total = np.bincount(gram >> 32, minlength=len(keys))
            for b in np.flatnonzero(total >= self.need[(keys >> 40)]).tolist():
                i = int(keys[b] >> 40)
                d = diagonal[which == b]
                e = int(self.edits[i])
                if i in out and out[i][1] == 0:
                    continue
                found, end = banded_distance(self.codes[i], codes, int(d.min()) - e, int(d.max()) + e, e)
                if found <= e and (i not in out or found < out[i][1]):
                    before = codes[max(0, end - len(self.codes[i]) - e) : end]
                    _, length = banded_distance(self.codes[i][::-1], before[::-1], -found, found, found, anchored=True)
                    out[i] = (self.ids[i], found, end - length, end)
        return sorted(out.values())


def _slices(benchmark: DataFrame, slice_chars: int) -> list[list[tuple[int, str]]]:
    """The items in slices of about ``slice_chars`` characters, fetched one after the other."""
    held: list[tuple[int, str]] = []
    n = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        n += len(r["text"])
        if n >= slice_chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, least_chars: int = LEAST_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``start``, ``end`` (in the normalised text) of every item found in every document."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start int, end int"
    parts = []
    for items in _slices(benchmark, slice_chars):
        index = spark.sparkContext.broadcast(ItemIndex(items, q, share, least_chars))

        def rows(batches, index=index):
            for b in batches:
                out = [(doc_id, *h) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)) for h in index.value.hits(text.as_py())]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "edits", "start", "end"])

        found = plain.mapInArrow(rows, schema)
        parts.append(saved(found, "leaks") if parts or len(items) > 100_000 else found)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = saved(hits(docs, benchmark).select("doc_id").distinct(), "leaking")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
