"""Near duplicates by order MinHash.

Exact copies become one class first.  Each hash function samples the few smallest
occurrence-labelled five-word shingles of a text and keeps them in text order; texts that share
such an ordered sample meet in a bucket.  A banded alignment of the labelled shingles checks
pairs: the shingles aligned in order, over all shingles of both, must reach the similarity.

No bucket is expanded into all its pairs.  First each text of a bucket meets the bucket's hub, its
most central text, and the most central one of about its length; the links found make components.
Where components share a bucket, each text is then told by its difference to the hub, and texts of
two components meet only where their differences share a seldom shingle among the first few: a
bound that no similar pair falls below.  So no two components that share a bucket stay apart while
a link exists there, but for texts that hold nearly the hub's shingles in another order.

Defined cases: null and empty texts are one class of exact copies; a text of fewer than five words
is one shingle; rows without ``doc_id`` are left out; rows with the same ``doc_id`` are one
document of the graph, whatever their texts; an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are ignored by ``classes`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import bucketed, saved
from .components import components

SAMPLES, PICKED, SHINGLE, SIMILARITY = 24, 4, 5, 0.8
_SEEDS = wordhash.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def order_minhash(s: np.ndarray) -> np.ndarray:
    """One value for each hash function: the picked shingles, in text order, hashed together."""
    if not len(s):
        return np.array([], np.uint64)
    labelled = _labels(s)
    pick = min(PICKED, len(s))
    out = np.empty(SAMPLES, np.uint64)
    rows = max(1, min(SAMPLES, (1 << 20) // len(s)))
    for a in range(0, SAMPLES, rows):
        h = wordhash.mix(labelled[None, :] ^ _SEEDS[a : a + rows, None])
        at = np.sort(np.argpartition(h, pick - 1, axis=1)[:, :pick], axis=1)
        v = np.zeros(len(h), np.uint64)
        for i in range(pick):
            v = v * np.uint64(0x100000001B3) + labelled[at[:, i]]
        out[a : a + rows] = wordhash.mix(v)
    return out


def _labels(s: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often they came before."""
    return wordhash.mix(s + wordhash.occurrences(s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _labelled(seq: bytes) -> np.ndarray:
    return _labels(wordhash.shingles(np.frombuffer(seq, np.uint32).astype(np.uint64), SHINGLE))


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles aligned in order within a diagonal band, over all of both; 0 if ``least`` is out of reach.

    Labelled shingles are unique in their text, so the longest common subsequence is the longest
    increasing run of matched places; an alignment that reaches ``least`` leaves the diagonal by at
    most the number of shingles it may drop.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    x, y = _labels(a), _labels(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if len(i) < need - 1e-9:
        return 0.0
    band = total - 2 * need
    close = np.abs(i - j) <= band + 1
    i, j = i[close], j[close]
    j = j[np.argsort(i)]
    if len(j) and (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for v in j.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        m = len(tails)
    return m / (total - m)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, digest of the text, number of shingles, order MinHash and the words' hashes."""

    def rows(batches):
        for b in batches:
            digest, n, sketch, seq = [], [], [], []
            for text in b.column(1):
                text = text.as_py() or ""
                w = wordhash.words(text)[0]
                s = wordhash.shingles(w, SHINGLE)
                digest.append(hashlib.md5(text.encode()).digest())
                n.append(len(s))
                sketch.append(order_minhash(s).view(np.int64))
                seq.append((w & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), pa.array(seq, pa.binary())], ["doc_id", "digest", "n", "sketch", "seq"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return plain.mapInArrow(rows, "doc_id long, digest binary, n int, sketch array<long>, seq binary")


def _verified(pairs: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) that are linked."""

    def check(batches):
        for b in batches:
            a, c = ([wordhash.shingles(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64), SHINGLE) for x in b.column(k)] for k in (2, 3))
            ok = pa.array([aligned_similarity(x, y, similarity) >= similarity for x, y in zip(a, c)], pa.bool_())
            yield b.select([0, 1]).filter(ok)

    met = pairs.join(seqs.select(F.col("doc_id").alias("a"), F.col("seq").alias("x")), "a").join(seqs.select(F.col("doc_id").alias("b"), F.col("seq").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _apart(bucket: DataFrame, comp: DataFrame, seqs: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (``a``, ``b``) between components that share a bucket, none of the similar ones left out.

    A text is told by its difference to the bucket's hub: the shingles of one of the two.  If two
    texts are similar and one of them is not near the hub, their differences share more than a
    given number of shingles, so each holds a shared one among its first few in any order; the
    order is by how many of the hub's bucket have the shingle, so that few texts meet.
    """
    slack = (1 - similarity) / (1 + similarity)  # of the shingles of both texts, those left out at most
    tagged = bucket.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # the star has met every pair of buckets of two
    per = tagged.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many"), F.min(F.struct((-F.col("degree")).alias("d"), F.col("doc_id").alias("hub"))).alias("m")).filter("lo < hi and many > 2")
    member = tagged.join(per.select("h", F.col("m.hub").alias("hub")), "h").filter("doc_id <> hub").select("hub", "doc_id", "component").distinct()
    two = saved(member, "omh-members").join(seqs, "doc_id").join(seqs.select(F.col("doc_id").alias("hub"), F.col("seq").alias("hub_seq")), "hub")

    def differences(batches):
        last = (None, None)
        for b in batches:
            out = []
            for hub, x, h in zip(b.column(0).to_pylist(), b.column(3), b.column(4)):
                x, h = x.as_py(), h.as_py()
                if last[0] != h:
                    last = (h, _labelled(h))
                mine = _labelled(x)
                delta = np.setxor1d(mine, last[1], assume_unique=True)
                n, nh, d = len(mine), len(last[1]), len(delta)
                odd = d > slack * (n + nh) + 1e-9
                least = np.ceil((d - n * (1 + 1 / similarity) * slack) / 2 - 1e-9) if odd else np.floor((d + (nh - n) * slack) / 2 + 1e-9) + 1
                salt = wordhash.mix(np.array([hub], np.int64).view(np.uint64))
                out.append((n, d, bool(odd), max(1, int(least)), wordhash.mix(delta ^ salt).view(np.int64)))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["hub", "doc_id", "component", "n", "d", "odd", "least", "keys"])

    told = saved(two.select("hub", "doc_id", "component", "seq", "hub_seq").mapInArrow(differences, "hub long, doc_id long, component long, n int, d int, odd boolean, least int, keys array<long>"), "omh-differences")
    each = told.select("hub", "doc_id", "component", "n", "d", "odd", "least", F.explode("keys").alias("key"))
    # shingles that no pair of two components shares link nothing: they stand first in every order
    several = each.groupBy("key").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("odd").alias("any_odd")).filter("lo < hi and any_odd").select("key", "f")
    shared = each.join(several, "key").groupBy("hub", "doc_id", "component", "n", "d", "odd", "least").agg(F.sort_array(F.collect_set(F.struct("f", "key"))).alias("keys"))
    first = shared.select("doc_id", "component", "n", "d", "odd", "least", (F.col("d") - F.size("keys")).alias("before"), F.posexplode("keys").alias("place", "k"))
    first = saved(first.select("doc_id", "component", "n", "d", "odd", "least", (F.col("before") + F.col("place")).alias("rank"), F.col("k.key").alias("key")).filter("rank <= d - least").drop("least"), "omh-first")
    far = first.filter("odd").select("key", F.col("doc_id").alias("o"), F.col("component").alias("oc"), F.col("n").alias("on"), F.col("d").alias("od"), F.col("rank").alias("orank"))
    both = F.greatest(F.ceil((F.col("d") + F.col("od") - (F.col("n") + F.col("on")) * slack) / 2 - 1e-9), F.lit(1))
    close = F.least("n", "on") >= similarity * F.greatest("n", "on")
    met = first.join(far, "key").filter((F.col("component") != F.col("oc")) & (~F.col("odd") | (F.col("doc_id") < F.col("o"))) & close & (F.col("rank") <= F.col("d") - both) & (F.col("orank") <= F.col("od") - both))
    return met.select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id`` (the smallest doc_id of its class) and ``n_in_class`` of every row."""
    return _classes(bucketed(sketches(docs), "doc_id", dealt=True), similarity)


def _classes(sk: DataFrame, similarity: float) -> DataFrame:
    first = sk.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # one row for each different text
    texts = saved(sk.join(first.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).select("doc_id", "n", "sketch").distinct(), "omh-texts")
    bucket = texts.filter("n > 0").select("doc_id", "n", F.posexplode("sketch").alias("j", "v")).select(F.xxhash64("j", "v").alias("h"), "doc_id", "n")
    shared = bucket.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    bucket = bucket.join(shared, "h")
    # texts that share buckets with many are central to their group, and serve it as hub
    central = bucket.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    bucket = saved(bucket.join(central, "doc_id").select("h", "doc_id", "n", "degree"), "omh-buckets")
    # the hub of the whole bucket, and that of its texts of about the same length
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity))).cast("int")
    hub = F.min(F.struct((-F.col("degree")).alias("d"), "doc_id", "n")).alias("hub")
    tagged = bucket.withColumn("step", step)
    met = tagged.join(bucket.groupBy("h").agg(hub), "h").select("doc_id", "n", "hub").unionByName(tagged.join(tagged.groupBy("h", "step").agg(hub), ["h", "step"]).select("doc_id", "n", "hub"))
    close = F.least("n", "hub.n") >= similarity * F.greatest("n", "hub.n")
    pairs = met.filter(close & (F.col("doc_id") != F.col("hub.doc_id"))).select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"))
    pairs = saved(pairs.distinct(), "omh-pairs")
    seqs = sk.select("doc_id", "seq")  # in buckets: only what meets it is shuffled
    # several texts under one id are one document
    mixed = sk.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("doc_id")
    reps = sk.join(mixed, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(first, "digest").select("doc_id", "rep")
    same = reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    links = saved(_verified(pairs, seqs, similarity).unionByName(same), "omh-links")
    comp = components(links)
    cross = _apart(bucket, comp, seqs, similarity).join(pairs, ["a", "b"], "left_anti")
    more = saved(_verified(saved(cross, "omh-cross"), seqs, similarity), "omh-links2")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    whole = sk.select("doc_id", "digest").join(first, "digest").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    sizes = whole.groupBy("class_id").agg(F.count("*").alias("n_in_class"))
    return whole.join(sizes, "class_id").select("doc_id", "class_id", "n_in_class")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near duplicates: of each class the row with the smallest ``doc_id`` stays; rows without ``doc_id`` stay.

    Of several rows with that ``doc_id`` the one whose text (then whose other columns) sorts first stays.
    """
    sk = bucketed(sketches(docs), "doc_id", dealt=True)
    found = _classes(sk, similarity).filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    again = saved(sk.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "omh-again")
    if again.isEmpty():
        return kept
    whole = F.struct(*docs.columns)
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row"))
    return kept.join(again, "doc_id", "left_anti").unionByName(one.select("row.*").select(*docs.columns))
