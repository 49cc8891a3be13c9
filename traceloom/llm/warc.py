"""WARC archives: writing, and reading back by a verified chain of record boundaries.

The writer makes one record per page through Spark's text writer.  The reader lets Spark split
the archives at every occurrence of the version line.  Each task emits its candidate records with
the offset of their successor, and jumps along successors inside its own split; between splits,
pointer jumping from the start of each file finds where its chain of records enters every split.
Only candidates on the chain are records, so a version line inside a payload begins none.

Defined cases: a null payload is empty; of records with equal payloads of at least
``least_bytes``, those with the smallest page_id are responses and the others revisit it (rows
that repeat that page_id are responses each); a null page_id comes back as null and is a response
only where no other row has that payload; a null url is left out; line breaks in a url are
replaced by spaces; empty tables write and read as empty; columns other than ``page_id``,
``url`` and ``html`` are ignored.  A chain that breaks (a truncated or damaged file) ends there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Bare upper-case base32 of the 40 hexadecimal digits of a SHA-1."""
    parts = [F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    digit = lambda v, i: F.substr(F.lit(_ALPHABET), F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(v, i) for v in parts for i in range(8)])


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record per page: a response with the payload, or a revisit that refers to the response with the same payload."""
    digest = F.sha1(F.col("payload").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", digest).withColumn("bytes", F.octet_length("payload").cast("long"))
    # only payloads that come again; written first, so that its size decides how it is joined
    first = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = saved(first.filter("n > 1").select("digest", "first"), "warc-copies")
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Refers-To-Payload-Length", F.col("bytes").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_CANDIDATE = "file string, block long, at long, next long, exit long, header string, payload_at long, length long, digest binary, open boolean"
_SEP = len(MAGIC)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, in order within each split of each file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _candidates(pieces: DataFrame) -> DataFrame:
    """Per piece a candidate record; per split one more row with ``at`` -1 and its bytes in ``next``.

    Places count from where the split's first piece begins.  ``at`` is where the header begins,
    ``next`` where the successor's would, ``exit`` the first such place beyond the split (or where
    the chain breaks); ``open`` marks payloads that go on in the next split, which have no digest yet.
    """

    def emit(file, block, parts):
        at, n = [], 0
        for p in parts:
            at.append(n)
            n += len(p) + _SEP
        index, whole, rows = {a: i for i, a in enumerate(at)}, None, []
        for i, (a, p) in enumerate(zip(at, parts)):
            cut = p.find(b"\r\n\r\n")
            found = [x.split(b":", 1)[1].strip() for x in p[: max(cut, 0)].split(b"\r\n") if x[:15].lower() == b"content-length:"]
            if cut < 0 or not found or not found[0].isdigit() or len(found[0]) > 15 or (block == 0 and i == 0):
                rows.append([a, -1, -1, None, -1, -1, None, False])
                continue
            length, start = int(found[0]), a + cut + 4
            end, digest = start + length, None
            if end <= n - _SEP:
                if end <= a + len(p):
                    digest = hashlib.sha1(p[cut + 4 : cut + 4 + length]).digest()
                else:
                    whole = whole if whole is not None else MAGIC.encode().join(parts)
                    digest = hashlib.sha1(whole[start:end]).digest()
            rows.append([a, end + 4 + _SEP, end + 4 + _SEP, p[:cut].decode("utf-8", "replace"), start, length, digest, digest is None])
        for r in reversed(rows):  # jump along successors inside the split
            if r[1] in index:
                r[2] = rows[index[r[1]]][2]
        rows.append([-1, n, -1, None, -1, -1, None, False])
        cols = list(zip(*rows))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([block] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], ["file", "block", "at", "next", "exit", "header", "payload_at", "length", "digest", "open"])

    def run(batches):
        key, parts = None, []
        for b in batches:
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (file, block) != key:
                    if key is not None:
                        yield emit(*key, parts)
                    key, parts = (file, block), []
                parts.append(value.as_py())
        if key is not None:
            yield emit(*key, parts)

    return pieces.mapInArrow(run, _CANDIDATE)


def _reachable(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The (``file``, ``at``) that pointer jumping along ``exit`` reaches from ``starts``; as many rounds as the logarithm of the splits of a file."""
    reach, jump = saved(starts.join(nodes.select("file", "at"), ["file", "at"], "left_semi"), "warc-reach"), saved(nodes, "warc-jump")
    n = reach.count()
    while True:
        ahead = reach.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reach = saved(reach.union(ahead).distinct().join(nodes.select("file", "at"), ["file", "at"], "left_semi"), "warc-reach")
        if (m := reach.count()) == n:
            return reach
        n = m
        double = jump.join(jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further")), ["file", "exit"])
        jump = saved(double.select("file", "at", F.col("further").alias("exit")), "warc-jump")


def _on_chain(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidates of each split that the chain meets from the split's entries on."""

    def walk(key, left: pa.Table, right: pa.Table) -> pa.Table:
        at, after = left.column("at").to_pylist(), left.column("next").to_pylist()
        index, keep, todo = {a: i for i, a in enumerate(at)}, set(), right.column("entry").to_pylist()
        while todo:
            i = index.get(todo.pop())
            if i is not None and i not in keep and after[i] >= 0:
                keep.add(i)
                todo.append(after[i])
        return left.take(pa.array(sorted(keep), pa.int64()))

    return found.groupBy("file", "block").cogroup(entries.groupBy("file_", "block_")).applyInArrow(walk, found.schema)


def _beyond_split(spark: SparkSession, path: str, bases: DataFrame, opened: DataFrame) -> DataFrame:
    """Digests of records whose payload goes on in later splits: ``file``, ``place``, ``whole_digest``."""

    def placed(batches):
        key, at = None, 0
        for b in batches:
            out = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                value = value.as_py()
                at = at if (file, block) == key else 0
                key = (file, block)
                out.append((file, block, at, value))
                at += len(value) + _SEP
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.binary()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.binary())], ["file", "block", "at", "value"])

    pieces = _pieces(spark, path).join(opened.select("file").distinct(), "file", "left_semi")
    pieces = pieces.mapInArrow(placed, "file string, block long, at long, value binary").join(bases, ["file", "block"]).select(F.col("file").alias("file_"), (F.col("base") + F.col("at")).alias("from_"), "value")
    met = opened.join(pieces, (F.col("file") == F.col("file_")) & (F.col("from_") < F.col("start") + F.col("length")) & (F.col("from_") + F.octet_length("value") + _SEP > F.col("start")))

    def digest(table: pa.Table) -> pa.Table:
        rows = table.sort_by("from_").to_pylist()
        whole, r = MAGIC.encode().join([x["value"] for x in rows]), rows[0]
        a = r["start"] - r["from_"]
        body = whole[a : a + r["length"]]
        return pa.table({"file": [r["file"]], "place": [r["place"]], "whole_digest": pa.array([hashlib.sha1(body).digest() if len(body) == r["length"] else None], pa.binary())})

    return met.select("file", "place", "start", "length", "from_", "value").groupBy("file", "place").applyInArrow(digest, "file string, place long, whole_digest binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``place`` (of the header), ``header``, ``length`` and ``digest`` (raw SHA-1 of the payload) of every record of the archives under ``path``."""
    found = saved(_candidates(_pieces(spark, path)), "warc-candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(found.filter("at = -1").select("file", "block", F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base")), "warc-bases")
    placed = found.filter("at >= 0 and next >= 0").join(bases, ["file", "block"])
    nodes = placed.select("file", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("exit"), "block")
    starts = nodes.filter(F.col("at") == _SEP).select("file", "at")
    # only candidates that a chain can enter a split by
    entered = nodes.join(nodes.select("file", F.col("exit").alias("at")).union(starts).distinct(), ["file", "at"], "left_semi")
    entered = saved(entered, "warc-entries")
    reach = _reachable(entered.select("file", "at", "exit"), starts)
    entries = entered.join(reach, ["file", "at"]).join(bases, ["file", "block"]).select(F.col("file").alias("file_"), F.col("block").alias("block_"), (F.col("at") - F.col("base")).alias("entry"))
    kept = saved(_on_chain(found.filter("at >= 0 and next >= 0"), entries), "warc-records").join(bases, ["file", "block"])
    records = kept.select("file", (F.col("base") + F.col("at")).alias("place"), "header", "length", "digest", "open", (F.col("base") + F.col("payload_at")).alias("start"))
    opened = records.filter("open").select("file", "place", "start", "length")
    if not opened.isEmpty():
        more = _beyond_split(spark, path, bases, opened)
        records = records.join(more, ["file", "place"], "left").withColumn("digest", F.coalesce("digest", "whole_digest"))
    return records.filter("digest is not null").select("file", "place", "header", "length", "digest")


def field(name: str) -> Column:
    """A header's value, null where it is missing."""
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def parsed(records: DataFrame) -> DataFrame:
    """Per page: id, length and digest of the full payload, kind of record, and the page referred to."""
    page = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    kind = field("WARC-Type")
    return records.select(
        page(field("WARC-Record-ID")).alias("page_id"),
        F.when(kind == "revisit", field("WARC-Refers-To-Payload-Length").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")).otherwise(base32(F.lower(F.hex("digest")))).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", page(field("WARC-Refers-To"))).alias("refers_to"),
    )
