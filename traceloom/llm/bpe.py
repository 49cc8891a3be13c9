"""BPE encoding and decoding through a table of distinct words.

Tasks split whole documents into pre-tokenizer words and keep, per block of documents, the
distinct words and each document's word positions.  Every distinct word of the corpus is
encoded once; its ids meet the id-to-piece table in a join; ids and pieces come back to the
blocks by (block, position), where ids and decoded texts are put together in order.

Defined cases: a null or empty text has no ids and decodes to ''; repeated rows and equal
``doc_id`` each give a row of their own; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.  The string of a special token inside a text becomes
its id, as the library does by default.  A document is never split between tasks, so a task
holds at least one document and its positions in memory.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed

#: Characters for which the fast pattern below equals the tokenizer's own pre-tokenizer.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
_FAST = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
_TOKENIZERS: dict = {}

BLOCK_SCHEMA = "block long, words array<string>, doc_ids array<long>, positions array<binary>"


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _splitter(path: str):
    """A function text -> words whose ids, in order, are the ids of the text."""
    tokenizer = _tokenizer(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    pre = tokenizer.pre_tokenizer

    def words(text: str) -> list[str]:
        if not _OTHER.search(text):
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    def split(text: str | None) -> list[str]:
        if not text:
            return []
        if at_special is None or not any(s in text for s in special):
            return words(text)
        out: list[str] = []
        for i, part in enumerate(at_special.split(text)):
            out += [part] if i % 2 else words(part) if part else []
        return out

    return split


def _pack(a: np.ndarray) -> bytes:
    """Positions as four byte planes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(docs: DataFrame, path: str, block_chars: int = 1 << 25) -> DataFrame:
    """One row per block of about ``block_chars`` characters: distinct words, and each document's positions in them."""

    def split_blocks(batches):
        from pyspark import TaskContext

        split, part, n = _splitter(path), TaskContext.get().partitionId(), 0
        seen: dict[str, int] = {}
        ids, positions, chars = [], [], 0

        def out():
            # frequent words get small numbers, whose bytes compress well
            order = np.argsort(-np.bincount(np.concatenate([*positions, [0]]).astype(np.int64), minlength=len(seen)), kind="stable") if seen else np.array([], np.int64)
            new = np.empty(len(seen), np.int64)
            new[order] = np.arange(len(seen))
            words, packed = list(seen), [_pack(new[p] if len(p) else p) for p in positions]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n], pa.int64()), pa.array([[words[i] for i in order.tolist()]], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))],
                ["block", "words", "doc_ids", "positions"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words = split(text)
                ids.append(doc_id)
                positions.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.uint32))
                chars += len(text or "")
                if chars >= block_chars:
                    yield out()
                    n += 1
                    seen, ids, positions, chars = {}, [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split_blocks, BLOCK_SCHEMA)


def piece_table(spark: SparkSession, path: str):
    """Broadcast pieces (bytes) by id; as many as the vocabulary has, which is fixed."""
    tokenizer = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    found = {i: added[i].encode() if i in added else bytes(byte_of[c] for c in piece) for piece, i in tokenizer.get_vocab().items()}
    if len(found) > 1_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(pa.array([found.get(i, b"") for i in range(max(found) + 1)], pa.binary()))


def encode_words(path: str):
    """A function over rows (``block``, ``at``, ``word``) sorted by word: each distinct word is encoded
    once, where its rows begin; the ids leave in one compressed record for each block of a few million
    rows at most, as a single word's row is mostly overhead in a shuffle."""

    def packed(rows: pa.Table):
        rows = rows.sort_by([("block", "ascending"), ("at", "ascending")]).combine_chunks()
        homes, at = rows.column("block").to_numpy(), rows.column("at").to_numpy()
        lists = rows.column("ids").combine_chunks()
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        cuts = np.flatnonzero(np.diff(homes)) + 1
        squeeze = zstandard.ZstdCompressor(level=3).compress
        out = [(int(homes[a]), squeeze(np.diff(at[a:b], prepend=0).astype("<u4").tobytes()), squeeze(np.diff(off[a : b + 1]).astype("<u4").tobytes()), squeeze(flat[off[a] : off[b]].astype("<u4").tobytes())) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(homes)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["home", "at", "n", "ids"])

    def encode(batches):
        tokenizer, last, last_ids, held, n = _tokenizer(path), None, None, [], 0
        for b in batches:
            coded = b.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = words[1:] if words and words[0] == last else words
            found = [e.ids for e in tokenizer.encode_batch(fresh, add_special_tokens=False)]
            found = [last_ids, *found] if len(found) < len(words) else found
            if words:
                last, last_ids = words[-1], found[-1]
            ids = pa.array(found, pa.list_(pa.int32())).take(coded.indices)
            held.append(pa.table({"block": b.column(0), "at": b.column(1), "ids": ids}))
            n += b.num_rows
            if n >= 2_000_000:
                yield from packed(pa.concat_tables(held))
                held, n = [], 0
        if n:
            yield from packed(pa.concat_tables(held))

    return encode


def _decoded(ids: np.ndarray, pieces: pa.Array, cuts: np.ndarray) -> list[str]:
    """The texts of consecutive runs of ids: each id meets its piece."""
    met = pieces.take(pa.array(ids))
    at = np.frombuffer(met.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    data = memoryview(met.buffers()[2]) if len(ids) and met.buffers()[2] is not None else memoryview(b"")
    return [str(data[at[a] : at[b]], "utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def encode_decode(docs: DataFrame, path: str, block_chars: int = 1 << 25) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (string) of every document."""
    spark = docs.sparkSession
    held = bucketed(blocks(docs, path, block_chars), "block")
    uses = held.select("block", F.posexplode("words").alias("at", "word")).repartition("word").sortWithinPartitions("word")
    back = uses.mapInArrow(encode_words(path), "home long, at binary, n binary, ids binary")
    pieces = piece_table(spark, path)
    thaw = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), "<u4").astype(np.int64)

    def put_together(key, left: pa.Table, right: pa.Table) -> pa.Table:
        at, n, flat = ([thaw(x) for x in right.column(c)] for c in ("at", "n", "ids"))
        place = np.concatenate([*(np.cumsum(x) for x in at), np.array([], np.int64)])
        n, flat = np.concatenate([*n, np.array([], np.int64)]), np.concatenate([*flat, np.array([], np.int64)]).astype(np.int32)
        begin = np.empty(len(n), np.int64)
        begin[place] = np.cumsum(n) - n
        size = np.empty(len(n), np.int64)
        size[place] = n
        found = []
        for ids_, blobs in ((x.values, y.values) for x, y in zip(left.column("doc_ids"), left.column("positions"))):
            for first in range(0, len(ids_), 256):
                p = [_unpack(b.as_py()) for b in blobs[first : first + 256]]
                words = np.concatenate(p).astype(np.int64)
                many = size[words]
                ends = np.concatenate([[0], np.cumsum(many)])
                ids = flat[np.repeat(begin[words] - ends[:-1], many) + np.arange(ends[-1])]
                cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in p])])]
                found.append(pa.table({"doc_id": pa.array([x.as_py() for x in ids_[first : first + 256]], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), "decoded": pa.array(_decoded(ids, pieces.value, cuts), pa.string())}))
        return pa.concat_tables(found)

    return held.select("block", "doc_ids", "positions").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(put_together, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Count and digests of ``encode_decode``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
