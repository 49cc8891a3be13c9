"""Source divergence audit: how far apart the term counts of groups are, by hash-consed segment trees.

Tasks count terms by (lang, source) and send sums.  The kept terms of a language are dealt into
blocks, in which rare terms lie side by side.  Within a block every group has a segment tree over
the term ids; subtrees with equal counts are one node, whichever group and place they come from.
Two trees are walked together from their roots: all places where the same two nodes meet become
one pair with a multiplicity, so it is opened and priced once.  A block's price of two groups is
a row; Spark sums them.

Defined cases: null text, lang and source are read as ''; groups without terms count as zero
everywhere; a language without kept terms prices every pair of its groups at 0; repeated rows
count as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .terms import WORDS, terms

#: Terms of a block (on average), distinct terms that a counting task holds, cells of one walk.
BLOCK_TERMS, HELD_TERMS, WALK_CELLS = 2048, 500_000, 1 << 21
SCALE, SMOOTH = 1_000_000_000, 5

_COUNTS = "lang string, source string, term string, n long, docs long"


def counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents that hold it); a null term for every group."""

    def flush(held):
        for (lang, source), (n, d) in held.items():
            found = [None, *n]
            text = pa.array(found, pa.binary()).cast(pa.string())
            same = lambda x: pa.array([x] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays([same(lang), same(source), text, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def count(batches):
        held: dict = {}
        size = 0
        for b in batches:
            for lang, source, data in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, source) not in held:
                    held[lang, source] = (Counter(), Counter())
                n, d = held[lang, source]
                found = terms(data, WORDS)
                size -= len(n)
                n.update(found)
                d.update(set(found))
                size += len(n)
                if size > HELD_TERMS:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return read.mapInArrow(count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), by long division, which stays within 64 bits."""
    divisor = total + SMOOTH * kept
    rest, out = count.astype(np.int64) + SMOOTH, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // divisor, rest % divisor
    return 1 + out


class Forest:
    """Segment trees of all rows of ``counts`` (groups by places, a power of two of these) with shared nodes.

    ``values`` are the distinct leaves; ``levels[k]`` holds the left and right child of each distinct
    node of height k + 1; ``roots`` are the rows' nodes at the top.  -1 marks places that no term has.
    """

    def __init__(self, counts: np.ndarray):
        self.values, node = np.unique(counts, return_inverse=True)
        node = node.reshape(counts.shape)
        self.levels, below = [], len(self.values)
        while node.shape[1] > 1:
            both, at = np.unique(node[:, 0::2] * below + node[:, 1::2], return_inverse=True)
            node = at.reshape(len(counts), -1)
            self.levels.append((both // below, both % below))
            below = len(both)
        self.roots = node[:, 0]

    def prices(self, totals: np.ndarray, kept: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
        """The sum over all places of the groups' difference in shares, for each pair (``a``, ``b``), and the node pairs met."""
        of = np.stack([np.where(self.values < 0, 0, shares(np.maximum(self.values, 0), int(t), kept)) for t in totals])
        pair, left, right, times, met = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64), len(a)
        for (lower_l, lower_r), nodes in zip(self.levels[::-1], [len(x[0]) for x in self.levels[-2::-1]] + [len(self.values)]):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            left, right = np.concatenate([lower_l[left], lower_r[left]]), np.concatenate([lower_l[right], lower_r[right]])
            key, at = np.unique((pair * nodes + left) * nodes + right, return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, at, times)
            pair, left, right, times = key // nodes // nodes, key // nodes % nodes, key % nodes, sums
            met += len(key)
        out = np.zeros(len(a), np.int64)
        np.add.at(out, pair, times * np.abs(of[a[pair], left] - of[b[pair], right]))
        return out, met


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    """Left: place, source, n of one block; right: source, total, kept, places of each group of its language."""
    right = right.sort_by("source")
    names = right.column("source").to_pylist()
    of = {s: i for i, s in enumerate(names)}
    places = right.column("places")[0].as_py() if names else 0
    out_a, out_b, out_v = [], [], []
    if places:
        counts = np.full((len(names), 1 << (places - 1).bit_length()), -1, np.int64)
        counts[:, :places] = 0
        counts[[of[s] for s in left.column("source").to_pylist()], left.column("place").to_numpy()] = left.column("n").to_numpy()
        forest, totals, kept = Forest(counts), right.column("total").to_numpy(), right.column("kept")[0].as_py()
        most = max(1, WALK_CELLS // counts.shape[1])
        for i in range(len(names) - 1):
            for first in range(i + 1, len(names), most):
                b = np.arange(first, min(first + most, len(names)))
                value, _ = forest.prices(totals, kept, np.full(len(b), i), b)
                out_a.append(np.full(len(b), i))
                out_b.append(b)
                out_v.append(value)
    cat = lambda x: np.concatenate(x) if x else np.array([], np.int64)
    text = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([right.column("lang")[0].as_py()] * len(cat(out_a)), pa.string()), "a": text.take(pa.array(cat(out_a))), "b": text.take(pa.array(cat(out_b))), "value": cat(out_v)})


def share(n: str, total: str, kept: str):
    """As ``shares``, in decimals, which no count overflows."""
    return F.expr(f"1 + cast((cast({SCALE} as decimal(10, 0)) * cast({n} + {SMOOTH} as decimal(20, 0))) div cast({total} + {SMOOTH} * {kept} as decimal(20, 0)) as bigint)")


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: each group's distance to the other sources of its
    language (``pair``), and the terms in which it most exceeds its language (``term``)."""
    counts = saved(counted(docs), "audit-counts")
    kept = saved(counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs), "audit-kept")
    blocks = max(1, kept.count() // BLOCK_TERMS)
    in_block = Window.partitionBy("lang", "block").orderBy(F.desc("docs"), "term")
    terms_ = saved(kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).withColumn("place", F.row_number().over(in_block) - 1).drop("docs"), "audit-terms")
    used = saved(counts.filter("n > 0").join(terms_, ["lang", "term"]).select("lang", "source", "term", "n", "block", "place"), "audit-used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms_.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "kept"])
    groups = saved(groups, "audit-groups")

    widths = terms_.groupBy(F.col("lang"), "block").agg(F.count("*").cast("int").alias("places"))
    forests = groups.join(widths, "lang").select("lang", "block", "source", "total", "kept", "places")
    halves = used.groupBy("lang", "block").cogroup(forests.groupBy("lang", "block")).applyInArrow(_priced, "lang string, a string, b string, value long")
    sums = saved(halves.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "audit-pairs")
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    # without kept terms there are no blocks: all pairs of such a language are 0 apart
    plain = groups.filter("kept = 0").select("lang", "source")
    both = both.union(plain.join(plain.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long")))

    whole = used.groupBy("lang", "term").agg(F.sum("n").alias("n_all"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total_all"))
    met = used.join(whole, ["lang", "term"]).join(groups, ["lang", "source"]).join(of_lang, "lang")
    p, q = share("n", "total", "kept"), share("n_all", "total_all", "kept")
    above = met.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(both, "pair").union(ranked(above, "term").filter(F.col("rank") <= top_terms))
