"""Incremental reading of growing transcripts, and micro-batch upkeep of derived tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE_SCHEMA = "path string, offset long, length int, text string, rewound boolean"
#: Bytes of a link of a file's chain of digests, and of one read.
CHUNK, PIECE = 8 << 20, 1 << 20


def file_system(uri: str):
    """The file system of a URI and the path in it: any that ``pyarrow.fs`` knows (local, HDFS, S3, GCS, ABFS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class Chain:
    """Digests of a file's chunks, each over the one before and the chunk's bytes: the last one stands for all.

    ``links`` are (end, digest), at every multiple of ``CHUNK`` and at the end.
    """

    def __init__(self, links: list, size: int, mtime: int):
        self.links, self.size, self.mtime = [tuple(x) for x in links], size, mtime

    @property
    def end(self) -> int:
        return self.links[-1][0] if self.links else 0

    def whole(self) -> list[tuple[int, str]]:
        return [x for x in self.links if x[0] % CHUNK == 0]

    def extended(self, file, end: int, size: int, mtime: int) -> Chain:
        """The chain up to ``end``; only the last, unfinished chunk is read again."""
        links = [x for x in self.whole() if x[0] <= end]
        return Chain([*links, *_links(file, links[-1] if links else (0, ""), end)], size, mtime)

    def holds(self, file) -> bool:
        """Whether the file still has these bytes; the first chunk that differs ends the reading."""
        found = _links(file, (0, ""), self.end)
        return all(next(found, None) == x for x in self.links)


def _links(file, start: tuple[int, str], end: int) -> Iterator[tuple[int, str]]:
    at, before = start
    while at < end:
        upto, found = min(end, at - at % CHUNK + CHUNK), hashlib.sha256(before.encode())
        file.seek(at)
        while at < upto and (piece := file.read(min(PIECE, upto - at))):
            found.update(piece)
            at += len(piece)
        if at < upto:  # the file is shorter than it was
            return
        before = found.hexdigest()
        yield at, before


def _line_start(file, at: int) -> int:
    """Where the line that goes on at ``at`` begins."""
    while at > 0:
        first = max(0, at - PIECE)
        file.seek(first)
        cut = file.read(at - first).rfind(b"\n")
        if cut >= 0:
            return first + cut + 1
        at = first
    return 0


def lines_ended(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every line whose LF lies from ``start`` to before ``end``."""
    at, held, first = start, None, start
    while at < end:
        file.seek(at)
        piece = file.read(min(PIECE, end - at))
        if not piece:
            return
        parts = piece.split(b"\n")
        if len(parts) > 1 and held is None:  # the first line may have begun long before
            first = _line_start(file, start)
            file.seek(first)
            held = [file.read(at - first)]
        for part in parts[:-1]:
            line = b"".join([*held, part])
            yield first, line
            first, held = first + len(line) + 1, []
        if held is not None:
            held.append(parts[-1])
        at += len(piece)


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, rewound: bool):
        super().__init__(None)
        self.path, self.start, self.end, self.rewound = path, start, end, rewound


class TranscriptReader(DataSourceStreamReader):
    """The offset maps each file to the bytes taken, its size and time then, and a generation.

    The driver lists sizes and times, and reads no file.  A batch takes ``maxBytesPerTrigger`` bytes in
    all, cut anywhere: a line belongs to the batch that holds its LF, so a long record just waits for it,
    and a torn tail gives no row.  The task of a file keeps a chain of chunk digests of what it has
    taken under ``progress`` (a folder that driver and tasks share).  When a file's size or time is not
    the one of its chain, the chunks are compared first; a file that has shrunk, was emptied or holds other
    bytes anywhere is read again from its start.  Its rows are ``rewound``, the first of them with offset -1
    and no text, so that a file without any line left is noticed too.  A deleted file keeps its place, and is
    compared when it comes back.  ``progress`` also keeps the offset planned last, so that the first batch
    after a restart is bounded like the others.  The engine plans a source of this kind only once for
    ``trigger(availableNow=True)``: leave the limit off for that trigger.
    """

    def __init__(self, options: dict):
        if "progress" not in options:
            raise ValueError("option progress must name a folder that driver and tasks share")
        self.fs, self.root = file_system(options["path"])
        self.kept, self.progress = file_system(options["progress"])
        self.most = int(options.get("maxbytespertrigger", 1 << 62))

    def initialOffset(self) -> dict:
        return {}

    def _write(self, name: str, what: dict) -> None:
        """Under another name first: a reader finds either the old file or the new one."""
        to = f"{self.progress}/{name}"
        self.kept.create_dir(to.rsplit("/", 1)[0], recursive=True)
        with self.kept.open_output_stream(part := f"{to}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(what).encode())
        self.kept.move(part, to)

    def _load(self, name: str) -> dict | None:
        try:
            with self.kept.open_input_stream(f"{self.progress}/{name}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def latestOffset(self) -> dict:
        from pyarrow import fs

        known = self._load("planned.json") or {}
        out = {path: seen | {"gone": True} for path, seen in known.items()}
        left = self.most
        for info in sorted(self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)), key=lambda x: x.path):
            if not info.is_file or not info.path.endswith(".jsonl"):
                continue
            seen = known.get(info.path, {"at": 0, "size": 0, "mtime": 0, "generation": 0})
            now = {"size": info.size, "mtime": info.mtime_ns}
            shrunk = info.size < seen["at"]
            start = 0 if shrunk else seen["at"]
            take = min(left, info.size - start)
            if not (shrunk or take or (start == info.size and (seen["size"], seen["mtime"]) != (info.size, info.mtime_ns))):
                if info.path in known:
                    out[info.path] = {k: v for k, v in seen.items() if k != "gone"}
                continue
            out[info.path] = now | {"at": start + take, "generation": seen["generation"] + shrunk}
            left -= take
        if out != known:
            self._write("planned.json", out)
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for path, e in end.items():
            s = start.get(path)
            if not e.get("gone") and (s is None or {k: v for k, v in s.items() if k != "gone"} != e or s.get("gone")):
                again = s is not None and e["generation"] != s["generation"]
                spans.append(Span(path, s["at"] if s and not again else 0, e["at"], again))
        return spans

    def _chain(self, path: str, end: int) -> str:
        return f"chains/{hashlib.sha256(path.encode()).hexdigest()}/{end}.json"

    def read(self, partition: Span) -> Iterator[tuple]:
        path, start = partition.path, partition.start
        info = self.fs.get_file_info(path)
        if not info.is_file:  # deleted since the batch was planned
            return
        end = min(partition.end, info.size)
        with self.fs.open_input_file(path) as file:
            kept = self._load(self._chain(path, start)) if start else None
            chain = Chain(**kept) if kept else Chain([], info.size, info.mtime_ns)
            same = start == 0 or (kept is not None and ((chain.size, chain.mtime) == (info.size, info.mtime_ns) or (info.size >= chain.end and chain.holds(file))))
            rewound = partition.rewound or not same
            if rewound:
                start, chain = 0, Chain([], info.size, info.mtime_ns)
                yield path, -1, 0, None, True
            for at, line in lines_ended(file, start, end):
                yield path, at, len(line), line.decode("utf-8", "replace"), rewound
            self._write(self._chain(path, partition.end), vars(chain.extended(file, end, info.size, info.mtime_ns)))


class TranscriptSource(DataSource):
    """``spark.readStream.format("transcripts").load(root)`` after ``spark.dataSource.register(TranscriptSource)``."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)


def unchanged_skip(listed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose size or time differ from the healthy rows on record."""
    same = recorded.filter("status = 'ok'").select("path", F.col("size").alias("length"), "mtime")
    return listed.join(same, ["path", "length", "mtime"], "left_anti")


class FactTable:
    """Facts in Parquet by session bucket; each batch replaces only the touched buckets.

    ``derive`` makes a table from all facts of the touched sessions; its rows are kept by session
    bucket and replaced alike, so late halves meet in any batch and the order of batches does not matter.

    Buckets grow by linear hashing: when they hold more than ``bucket_rows`` rows each on average, the next one is
    split in two (at most ``MOST_SPLITS`` of them in a batch), so a batch writes as much as the sessions it touches
    need, however large the table is.  The layout is written before rows move, with the buckets that are being
    split; a batch that finds such a note of one that died does its work again.
    """

    MOST_SPLITS = 4

    def __init__(self, spark: SparkSession, path: str, derive: dict[str, Callable[[DataFrame], DataFrame]], buckets: int = 16, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.derive, self.first, self.bucket_rows = spark, path, derive, buckets, bucket_rows
        self.fs, self.root = file_system(path)

    def layout(self) -> dict:
        """How many buckets and rows there are, and the buckets whose rows may lie in another one."""
        try:
            with self.fs.open_input_stream(f"{self.root}/_layout.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {"buckets": self.first, "rows": 0, "moving": []}

    def _keep(self, layout: dict) -> None:
        self.fs.create_dir(self.root, recursive=True)
        part = f"{self.root}/_layout.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(layout).encode())
        self.fs.move(part, f"{self.root}/_layout.json")

    @staticmethod
    def _bucket(n: int):
        """The bucket of a session among ``n``: those not split yet take what belongs to their later halves."""
        half = 1 << (n.bit_length() - 1)
        h = F.pmod(F.xxhash64("session_id"), F.lit(2 * half))
        return F.when(h < n, h).otherwise(h - half).cast("int")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _replace(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Rows of the given buckets, staged first, as a table cannot be overwritten while it is read."""
        staged = f"{self.path}/_staged/{name}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        df = self.spark.read.schema(rows.schema).parquet(staged)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        # overwriting leaves partitions alone that have no rows any more
        for bucket in {*buckets} - {r["bucket"] for r in df.select("bucket").distinct().collect()}:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={bucket}")
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def _grown(self, layout: dict, more: int) -> dict:
        """The layout with room for ``more`` rows, and the buckets that this moves rows between."""
        n, rows, moving = layout["buckets"], layout["rows"] + more, {*layout["moving"]}
        for _ in range(self.MOST_SPLITS):
            if rows <= n * self.bucket_rows:
                break
            moving |= {n - (1 << (n.bit_length() - 1)), n}
            n += 1
        return {"buckets": n, "rows": rows, "moving": sorted(moving)}

    def batch(self, rows: DataFrame, batch_id: int = 0, again: DataFrame | None = None) -> None:
        """For ``foreachBatch``: facts with path, offset, session_id and ``rewound``; ``again`` has the path of every file
        that is read anew, also of those without any fact left."""
        rows = rows.persist()
        try:
            layout = self._grown(self.layout(), rows.count())
            bucket = self._bucket(layout["buckets"])
            touched = {r[0] for r in rows.select(bucket).distinct().collect()} | {*layout["moving"]}  # as many as buckets, at most
            marked = rows.filter("rewound").select("path")
            again = (marked if again is None else marked.union(again.select("path"))).distinct()
            old = self._read("facts")
            new = rows.drop("rewound").withColumn("bucket", bucket)
            if old is not None:
                if not again.isEmpty():
                    touched |= {r["bucket"] for r in old.join(again, "path", "left_semi").select("bucket").distinct().collect()}
                kept = old.filter(F.col("bucket").isin(sorted(touched))).join(again, "path", "left_anti")
                new = kept.withColumn("bucket", bucket).select(*new.columns).unionByName(new)
            if not touched:
                return
            self._keep(layout)
            self._replace("facts", new.dropDuplicates(["path", "offset"]), sorted(touched))
            stored = self._read("facts")
            facts = (stored if stored is not None else new.limit(0)).filter(F.col("bucket").isin(sorted(touched)))
            for name, f in self.derive.items():
                self._replace(name, f(facts.drop("bucket")).withColumn("bucket", bucket), sorted(touched))
            self._keep(layout | {"moving": []})
        finally:
            rows.unpersist()

    def rebuild(self, rows: DataFrame) -> None:
        """Everything anew."""
        facts = rows.drop("rewound").dropDuplicates(["path", "offset"])
        n = facts.count()
        buckets = max(self.first, -(-n // self.bucket_rows))
        facts.withColumn("bucket", self._bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/facts")
        for name, f in self.derive.items():
            f(self._read("facts").drop("bucket")).withColumn("bucket", self._bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        self._keep({"buckets": buckets, "rows": n, "moving": []})


class PendingNames(StatefulProcessor):
    """Names of tool uses that wait for their result, the newest 256 of each transcript.

    Rows: path, offset, tool_use_id, name (null for a result).  Out: path, offset, tool_use_id, tool_name.
    """

    MOST = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pending", "pending string")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        kept = json.loads(self.state.get()[0]) if self.state.exists() else {}
        for pdf in rows:
            out = []
            for r in pdf.sort_values("offset").itertuples():
                if r.name is not None:
                    kept.pop(r.tool_use_id, None)
                    kept[r.tool_use_id] = r.name
                else:
                    out.append((key[0], r.offset, r.tool_use_id, kept.pop(r.tool_use_id, "generic")))
            yield pd.DataFrame(out, columns=["path", "offset", "tool_use_id", "tool_name"])
        self.state.update((json.dumps(dict(list(kept.items())[-self.MOST :])),))

    def close(self) -> None:
        pass


def with_pending_names(stream: DataFrame) -> DataFrame:
    return stream.groupBy("path").transformWithStateInPandas(PendingNames(), "path string, offset long, tool_use_id string, tool_name string", "Append", "None")


def trigger_policy(poll_seconds: int = 60, once: bool = False) -> dict:
    """Arguments of ``writeStream.trigger``: look for new bytes every ``poll_seconds``, or take what there is and end."""
    return {"availableNow": True} if once else {"processingTime": f"{poll_seconds} seconds"}


def run_summary(rows: DataFrame, name: str = "run") -> DataFrame:
    """Counts of a batch as observed metrics, without another pass."""
    return rows.observe(name, F.count("*").alias("lines"), F.count(F.when(F.col("rewound"), 1)).alias("rewound"), F.sum("length").alias("bytes"))
