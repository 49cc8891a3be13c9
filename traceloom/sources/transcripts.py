"""Transcripts: append-only JSONL files, read as lines with byte locators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.joins import _cut


def discover(spark: SparkSession, root: str) -> DataFrame:
    """A1: <project>/<session>.jsonl and <project>/<session>/subagents/agent-<id>.jsonl, with size and mtime; other paths are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return _located(files.select("path", "length", F.col("modificationTime").alias("mtime")), root)


def _located(files: DataFrame, root: str) -> DataFrame:
    tail = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1], -1), "^/", "")
    agent = F.nullif(F.regexp_extract(tail, r"^[^/]+/[^/]+/subagents/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    return files.withColumn("display_path", tail).withColumn("subagent_id", agent).filter(F.col("display_path").rlike(r"^[^/]+/[^/]+\.jsonl$") | agent.isNotNull())


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A2, A3: path, offset, length and text of every line that ends in LF; a torn last line is left out.

    Lines are read split by split; only their lengths are summed per file.  CR stays part of the line.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    return with_offsets(rows)


def with_offsets(rows: DataFrame) -> DataFrame:
    """Byte offsets from line lengths: running sums within a split, and of whole splits within a file."""
    size = F.octet_length("value") + 1
    inside = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("length", F.octet_length("value")).withColumn("at_", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("path", "block").agg(F.sum(size).alias("bytes")).withColumn("base_", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    out = placed.join(bases, ["path", "block"]).withColumn("offset", F.col("base_") + F.col("at_"))
    return out.filter(F.col("offset") + F.col("length") < F.col("size")).select("path", "offset", "length", F.col("value").alias("text"))


def text_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The same lines and offsets for files that are rows of a table.

    Offsets are sums in blocks of 256 lines, over sums of whole blocks: arrays that grow by a line at a time stay short.
    """
    parts = F.split(F.col(text), "\n", -1)
    whole = rows.select(key, F.slice(parts, 1, F.size(parts) - 1).alias("parts")).filter("size(parts) > 0")
    whole = whole.withColumn("sizes", F.expr("transform(parts, x -> octet_length(x) + 1)")).withColumn("blocks", F.expr("transform(sequence(0, (size(sizes) - 1) div 256), b -> slice(sizes, cast(b * 256 + 1 as int), 256))"))
    run = "aggregate({of}, array({first}), (a, x) -> concat(a, array(element_at(a, -1) + {x})))"
    whole = whole.withColumn("starts", F.expr(run.format(of="blocks", first="0L", x="aggregate(x, 0L, (s, y) -> s + y)")))
    inside = run.format(of="b", first="starts[i]", x="x")
    whole = whole.withColumn("offsets", F.expr(f"flatten(transform(blocks, (b, i) -> slice({inside}, 1, size(b))))"))
    return whole.select(key, F.posexplode(F.arrays_zip(F.col("parts").alias("text"), F.col("offsets").alias("offset"))).alias("line_no", "l")).select(key, "line_no", F.col("l.offset").alias("offset"), F.octet_length("l.text").alias("length"), F.col("l.text").alias("text"))


def parsed(rows: DataFrame) -> DataFrame:
    """Lines that are not blank, as VARIANT; ``bad`` marks text that is no JSON object."""
    v = F.try_parse_json("text")
    out = rows.filter(F.trim("text") != "").withColumn("v", v)
    return out.withColumn("malformed", F.col("v").isNull()).withColumn("bad", F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def permissive(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: good lines, and per file the malformed ones counted; JSON that is no object is skipped uncounted."""
    p = parsed(rows)
    return p.filter("not bad"), p.groupBy("path").agg(F.count("*").alias("lines"), F.count(F.when(F.col("malformed"), 1)).alias("malformed"))


def chunk_starts(lines: DataFrame, chunk_bytes: int, **limits) -> DataFrame:
    """``path``, ``line`` of every line that begins a chunk: a chunk takes the whole lines that end within ``chunk_bytes``
    of its start, or within twice as much, and so on, where its first line is longer.

    ``lines``: path, line (0, 1, ...), offset, length.  A line's chunk, if it began one, would end before the line whose
    number is a count of line ends, found by one scan; the lines that begin one are reached from the first line by
    pointers that double each round.
    """
    size = F.col("length") + 1
    window = F.lit(chunk_bytes) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(size / chunk_bytes)))).cast("long")
    ends = lines.select("path", (F.col("offset") + size).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("line"))
    asks = lines.select("path", (F.col("offset") + window).alias("at"), F.lit(1).alias("side"), F.col("line").cast("long").alias("line"))
    met = scan.running(ends.union(asks), ["path"], ["at", "side"], counts={"next": F.col("side") == 0}, **limits)
    step = _cut(met.filter("side = 1").select("path", "line", "next"))
    reached = step.filter("line = 0").select("path", "line")
    n = reached.count()
    while True:
        further = reached.join(step, ["path", "line"]).select("path", F.col("next").alias("line"))
        reached = _cut(reached.union(further.join(lines.select("path", "line"), ["path", "line"], "left_semi")).distinct())
        before, n = n, reached.count()
        if n == before:
            return reached
        over = step.select("path", F.col("line").alias("next"), F.col("next").alias("next_"))
        step = _cut(step.join(over, ["path", "next"]).select("path", "line", F.col("next_").alias("next")))


def quarantining(rows: DataFrame, chunk_bytes: int = 8 << 20, **limits) -> tuple[DataFrame, DataFrame]:
    """A5: lines of good files and of the chunks of bad ones before the first bad chunk; of each bad file
    ``first_bad_offset``, ``reason`` and ``kept_bytes``, where reading goes on once it is mended."""
    p = parsed(rows)
    bad = p.filter("bad").groupBy("path").agg(F.min("offset").alias("first_bad_offset"), F.min_by(F.when(F.col("malformed"), "malformed").otherwise("not an object"), "offset").alias("reason"))
    lines = scan.running(rows.join(bad, "path").select("path", "offset", "length"), ["path"], ["offset"], counts={"n": F.lit(True)}, **limits)
    lines = _cut(lines.withColumn("line", F.col("n") - 1).drop("n"))
    starts = chunk_starts(lines, chunk_bytes, **limits).join(lines, ["path", "line"])
    kept = starts.join(bad, "path").filter("offset <= first_bad_offset").groupBy("path").agg(F.max("offset").alias("kept_bytes"))
    bad = bad.join(kept, "path")
    met = p.join(bad.select(F.col("path").alias("path_"), "kept_bytes"), F.col("path") == F.col("path_"), "left")
    good = met.filter("kept_bytes is null or offset < kept_bytes").select(*p.columns)
    return good, bad


def read_back(locators: DataFrame, rows: DataFrame) -> DataFrame:
    """The line of each locator."""
    return locators.join(rows.select("path", "offset", "text"), ["path", "offset"])
