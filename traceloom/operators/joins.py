"""Joins of half-records, trees and dimensions."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint where the optimizer's size estimate stays within ``most_bytes``; the plain side beyond it."""
    return F.broadcast(df) if plan_bytes(df) <= most_bytes else df


#: Rows of a partition that ``dealt`` makes.
DEALT_ROWS = 50_000


def parts_of(df: DataFrame, each: int | None = None) -> int:
    """How many partitions of about ``each`` rows ``df`` fills, at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (each or DEALT_ROWS)))


def dealt(df: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """``df`` in partitions of about ``each`` rows: a file of few row groups gives few tasks, however many rows these have."""
    return df.repartition(parts_of(df, each), *keys)


def tool_names(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Each result's tool name: a use sets the name of its id, the next result of that id takes it, whatever follows is generic.

    Only keys are shuffled; the names are joined back on (path, offset, tool_use_id).
    """
    keys = ["path", "tool_use_id", "offset"]
    met = uses.select(*keys, F.lit(0).alias("side_"), "name").unionByName(results.select(*keys, F.lit(1).alias("side_"), F.lit(None).cast("string").alias("name")))
    before = F.lag("name").over(Window.partitionBy("path", "tool_use_id").orderBy("offset", "side_"))
    named = met.withColumn("tool_name", before).filter("side_ = 1").groupBy(*keys).agg(F.coalesce(F.max("tool_name"), F.lit("generic")).alias("tool_name"))
    # a result without an id has no name to wait for
    return results.join(named, keys, "left").select(*results.columns, F.coalesce("tool_name", F.lit("generic")).alias("tool_name"))


def merge_halves(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Half-records with the same key make one; only complete ones stay."""
    whole = rows.groupBy(key).agg(*[F.min_by(F.col(p), F.when(F.col(p).isNotNull(), F.struct("path", "offset"))).alias(p) for p in parts])
    return whole.dropna(subset=parts)


def upsert_missing(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Full outer join in which a value that is set in ``base`` stays."""
    m = more.select(F.col(key).alias("k_"), *[F.col(c).alias(f"{c}_") for c in more.columns if c != key])
    joined = base.join(m, F.col(key) == F.col("k_"), "full_outer")
    return joined.select(F.coalesce(key, "k_").alias(key), *[(F.coalesce(c, f"{c}_") if c in more.columns else F.col(c)).alias(c) for c in base.columns if c != key])


def merge_reconcile(prs: DataFrame, observations: DataFrame) -> DataFrame:
    """A pull request is merged at the earliest sighting with its number whose hint, if any, ends its repository's name."""
    # the earliest of each number and hint is enough, so that a number's sightings do not multiply
    o = observations.groupBy(F.col("number").alias("number_"), "repo_hint").agg(F.min("merged_at").alias("merged_at_"))
    met = prs.join(o, (F.col("number") == F.col("number_")) & (F.col("repo_hint").isNull() | F.lower("repo").endswith(F.concat(F.lit("/"), F.lower("repo_hint")))))
    at = met.groupBy("repo", "number").agg(F.min("merged_at_").alias("seen_at"))
    return prs.join(at, ["repo", "number"], "left").select(*[c for c in prs.columns if c not in ("state", "merged_at")], F.when(F.col("seen_at").isNotNull(), "merged").otherwise(F.col("state")).alias("state"), F.coalesce("seen_at", "merged_at").alias("merged_at"))


def subagent_ends(agents: DataFrame, sessions: DataFrame) -> DataFrame:
    """End time of the child session, and the agent whose child session dispatched this one."""
    ends = sessions.select(F.col("session_id").alias("child_session_id"), F.col("ended_at").alias("child_ended_at"))
    parents = agents.filter("child_session_id is not null").groupBy(F.col("child_session_id").alias("session_id")).agg(F.min("agent_ref").alias("parent_ref"))
    return agents.join(ends, "child_session_id", "left").join(parents, "session_id", "left")


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a round in ``spark.checkpoint.dir``; only a local session may do without that setting."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-rounds-"))
    return df.checkpoint()


def subagent_tree(spark: SparkSession, links: DataFrame, child: str = "id", parent: str = "parent") -> DataFrame:
    """Closure of parent links: depth, root and path of every node, at any depth.

    Each round doubles the way up that a node knows, so a chain of n nodes takes log2(n) rounds.
    Nodes on a cycle, and nodes under a parent that is not there, have no root and are left out.
    """
    root = F.col(parent).isNull()
    now = links.select(F.col(child).alias("id"), F.coalesce(parent, child).alias("at"), root.alias("done"), F.when(root, 0).otherwise(1).alias("depth"), F.col(child).cast("string").alias("path"))
    finished = -1
    while True:
        now = _cut(now)
        n = now.agg(F.count(F.when(F.col("done"), 1)).alias("done"), F.count("*").alias("all")).first()
        # every round reaches a root for some node that has one, else none is left
        if n["done"] in (n["all"], finished):
            return now.filter("done").select("id", F.col("at").alias("root"), "depth", "path")
        finished = n["done"]
        up = now.select(F.col("id").alias("at"), F.col("at").alias("at_"), F.col("done").alias("done_"), F.col("depth").alias("depth_"), F.col("path").alias("path_"))
        met = now.filter("not done").join(up, "at")
        now = now.filter("done").union(met.select("id", F.col("at_"), F.col("done_"), F.col("depth") + F.col("depth_"), F.concat("path_", F.lit("/"), "path")))


def enrich_unique(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Left join of a store in which a key that occurs more than once counts as unknown."""
    rest = [c for c in store.columns if c != key]
    one = store.groupBy(key).agg(F.count("*").alias("n_"), *[F.first(c).alias(c) for c in rest]).filter("n_ = 1").drop("n_")
    return rows.join(one, key, "left")


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, keys: list[str]) -> DataFrame:
    """The longest root that is the path or a folder above it; rows outside every root keep nulls.

    An equi-join on the path's own prefixes, so that neither side needs to be broadcast.
    """
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = rows.select(*keys, F.explode(prefixes).alias("root")).join(roots.select("root", "name").distinct(), "root")
    best = met.groupBy(*keys).agg(F.max_by(F.struct("root", "name"), F.length("root")).alias("b"))
    return rows.join(best, keys, "left").select(*rows.columns, "b.root", "b.name", F.when(F.col("b.root").isNotNull(), F.regexp_replace(F.expr(f"substring({path}, length(b.root) + 1)"), "^/", "")).alias("rest"))


def outside_roots(rows: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Rows whose path is under none of the roots."""
    inside = longest_prefix(rows.select(path).distinct(), path, roots.select("root", F.lit("").alias("name")), [path]).filter("root is not null").select(path)
    return rows.join(inside, path, "left_anti")


#: Bytes of words that tasks hold at once; more make several passes.
WORD_BYTES = 32 << 20


def occurring(rows: DataFrame, text: str, words: DataFrame, whole: bool = False, word_bytes: int | None = None) -> DataFrame:
    """``rows`` with ``word``: a row for each distinct word (``words``: word) that occurs in a text, whatever the case.

    An automaton of all words reads each text once, however long it is and however many words there are.  ``whole``:
    only where neither a letter nor a digit (of ASCII) stands beside.  Empty words occur nowhere.
    """
    low = words.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
    size = low.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    slices = max(1, -(-size // (word_bytes or WORD_BYTES)))
    keep, out = rows.columns, None
    spark, read = rows.sparkSession, rows.withColumn("low_", F.lower(text)).filter("low_ <> ''")
    schema = T.StructType([*read.drop("low_").schema.fields, T.StructField("word", T.StringType())])
    for s in range(slices):
        sent = spark.sparkContext.broadcast([r["word"] for r in low.filter(F.pmod(F.xxhash64("word"), F.lit(slices)) == s).toLocalIterator()])

        def find(batches, sent=sent):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in sent.value:
                machine.add_word(w, w)
            machine.make_automaton()
            beside = lambda c: c.isascii() and c.isalnum()
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(len(keep)).to_pylist() if len(machine) else []):
                    hits = {w for end, w in machine.iter(t) if not whole or not ((end + 1 < len(t) and beside(t[end + 1])) or (end >= len(w) and beside(t[end - len(w)])))}
                    at += [i] * len(hits)
                    found += sorted(hits)
                picked = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*picked.columns[: len(keep)], pa.array(found, pa.string())], [*keep, "word"])

        met = read.mapInArrow(find, schema)
        out = met if out is None else out.union(met)
    return out


def match_slugs(hits: DataFrame, slugs: DataFrame, key: str, texts: list[str], **limits) -> DataFrame:
    """The first slug, by ``place`` where there is one, that occurs in one of the texts, whatever the case."""
    order = ["place", "slug"] if "place" in slugs.columns else ["slug"]
    s = slugs.filter("slug <> ''").groupBy(F.lower("slug").alias("word")).agg(F.min(F.struct(*order)).alias("first_"))
    rows = hits.select(F.col(key), F.concat_ws("\n", *texts).alias("text_"))
    met = occurring(rows, "text_", s, **limits).select(key, "word").join(small(s), "word").groupBy(key).agg(F.min("first_")["slug"].alias("slug"))
    return hits.join(met, key, "left")


def dangling(edges: DataFrame, namespaces: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per namespace, edge endpoints and those without an entity row (endpoints count, not distinct ones)."""
    ends = edges.select(F.col("source_ref").alias("ref")).union(edges.select("target_ref"))
    ends = ends.groupBy("ref").agg(F.count("*").alias("n")).withColumn("namespace", F.substring_index("ref", ":", 1))
    known = None
    for name, (df, col) in namespaces.items():
        k = df.select(F.concat(F.lit(f"{name}:"), F.col(col).cast("string")).alias("ref"))
        known = k if known is None else known.union(k)
    met = ends.join(known.distinct().withColumn("known", F.lit(True)), "ref", "left")
    return met.groupBy("namespace").agg(F.sum("n").alias("edges"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("dangling"))


def references(ids: DataFrame, texts: DataFrame, **limits) -> DataFrame:
    """Every text (row_id, text) in which an id of any form stands by itself, whatever the case; the id's own row is left out."""
    met = occurring(texts, "text", ids.select(F.col("id").alias("word")), whole=True, **limits)
    return met.filter("row_id is null or lower(row_id) <> word").select(*texts.columns, F.upper("word").alias("id"))


def pr_sessions(links: DataFrame, prs: DataFrame, on_branch: DataFrame) -> DataFrame:
    """The sessions of each PR, by direct links and by work on its branch, each once.  ``links``: pr, session_id; ``prs``: pr, branch; ``on_branch``: branch, session_id."""
    by_branch = prs.select("pr", "branch").distinct().join(on_branch.select("branch", "session_id").distinct(), "branch")
    return links.select("pr", "session_id").union(by_branch.select("pr", "session_id")).filter("pr is not null and session_id is not null").distinct()
