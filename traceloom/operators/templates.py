"""Log templates: signatures, masks and online clustering by leaves."""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import scan
from .joins import _cut

ANY = "<*>"


def signatures(blobs: DataFrame) -> DataFrame:
    """K2 - K5: blobs (tool_type, raw_text, ...) with their signature, masked line, parameters and eligibility."""
    s = blobs.withColumn("sig", X.signature(F.col("tool_type"), F.col("raw_text")))
    return s.select("*", X.mask(F.col("sig.signature")).alias("masked"), X.mask_params(F.col("sig.signature")).alias("params"), (F.col("sig.anchored") | F.coalesce(F.col("is_error"), F.lit(False))).alias("eligible"))


class Cluster:
    """A template with the line that created it and how many lines it stands for."""

    __slots__ = ("id", "tokens", "created_by", "size", "touched", "leaf", "seat")

    def __init__(self, id: int, tokens: list[str], created_by: str, size: int, touched: int, leaf: Clusters | None = None):
        self.id, self.tokens, self.created_by, self.size, self.touched, self.leaf, self.seat = id, tokens, created_by, size, touched, leaf, -1

    @property
    def template(self) -> str:
        return " ".join(self.tokens)

    @property
    def slot(self) -> int:
        """Its place among the leaf's clusters, in the order of their creation."""
        return self.leaf.rows.index(self)


class Clusters:
    """K6, K7: the clusters of a leaf, all of lines with the same number of tokens; a wildcard of a template matches every token.

    Each place has the clusters of each token there, so a line meets only the clusters that share one of its tokens.
    Seats follow creation, which decides between equals; those of clusters that are gone stay until they are the most.
    """

    GONE = -(1 << 40)

    def __init__(self, least: float):
        self.least = least
        self.seats: list[Cluster | None] = []
        self.dead = 0
        self.wild = np.zeros(8, np.int64)
        self.places: list[dict[str, array]] = []

    @property
    def rows(self) -> list[Cluster]:
        return [c for c in self.seats if c is not None]

    def add(self, cluster: Cluster) -> None:
        if not self.places:
            self.places = [{} for _ in cluster.tokens]
        if len(self.seats) == len(self.wild):
            self.wild = np.concatenate([self.wild, np.zeros_like(self.wild)])
        cluster.seat = len(self.seats)
        self.seats.append(cluster)
        self.wild[cluster.seat] = cluster.tokens.count(ANY)
        for at, token in zip(self.places, cluster.tokens):
            if token != ANY:
                at.setdefault(token, array("i")).append(cluster.seat)

    def drop(self, cluster: Cluster) -> None:
        self.seats[cluster.seat] = None
        self.wild[cluster.seat] = self.GONE
        self.dead += 1
        if 2 * self.dead > len(self.seats) + 64:
            kept = self.rows
            self.seats, self.dead, self.places = [], 0, []
            for c in kept:
                self.add(c)

    def find(self, words: list[str]) -> Cluster | None:
        """The most similar cluster, the earliest of equals, generalised to hold ``words``; none if none is similar enough."""
        n = len(self.seats)
        if n == self.dead:
            return None
        equal = self.wild[:n]
        met = [np.frombuffer(at[w], np.int32) for at, w in zip(self.places, words) if w in at]
        if met:
            equal = equal + np.bincount(np.concatenate(met), minlength=n)
        del met  # as long as they are looked at, they can't grow
        best = int(equal.argmax())
        if words and equal[best] / len(words) < self.least:
            return None
        cluster = self.seats[best]
        if equal[best] < len(words):
            for k, (mine, word) in enumerate(zip(cluster.tokens, words)):
                if mine != word and mine != ANY:
                    cluster.tokens[k] = ANY
                    self.places[k][mine].remove(best)
                    if not self.places[k][mine]:
                        del self.places[k][mine]
                    self.wild[best] += 1
        return cluster


class Tree:
    """K6, K8, K9: leaves by number of tokens and first two tokens, with at most ``most`` clusters in all.

    Beyond ``most_children`` tokens under a node, further ones share the wildcard branch.  When there are too
    many clusters, the one that stands for the fewest lines goes, of equals the one not met for longest.
    """

    def __init__(self, least: float = 0.55, most: int = 5000, most_children: int = 100):
        self.least, self.most, self.most_children = least, most, most_children
        self.children: dict[tuple, set] = {}
        self.leaves: dict[tuple, Clusters] = {}
        self.alive: dict[int, Cluster] = {}
        self.by_size: list[tuple[int, int, int]] = []
        self.next_id, self.clock = 1, 0
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def _leaf(self, tokens: list[str]) -> Clusters:
        node: tuple = (len(tokens),)
        for token in tokens[:2]:
            under = self.children.setdefault(node, set())
            if token not in under and (len(under - {ANY}) >= self.most_children):
                token = ANY
            under.add(token)
            node = (*node, token)
        return self.leaves.setdefault(node, Clusters(self.least))

    def restore(self, clusters: list[Cluster]) -> None:
        """Clusters kept from before, with their ids; their order is that of their ids."""
        for c in sorted(clusters, key=lambda c: c.id):
            c.leaf = self._leaf(c.tokens)
            c.leaf.add(c)
            self.alive[c.id] = c
            heapq.heappush(self.by_size, (c.size, c.touched, c.id))
            self.next_id, self.clock = max(self.next_id, c.id + 1), max(self.clock, c.touched)

    def insert(self, words: list[str], times: int = 1, leaf: Clusters | None = None) -> Cluster:
        """The line's cluster; ``leaf`` is found by its tokens unless it is given."""
        self.clock += 1
        leaf = self._leaf(words) if leaf is None else leaf
        cluster = leaf.find(words)
        if cluster is None:
            cluster = Cluster(self.next_id, list(words), " ".join(words), 0, self.clock, leaf)
            self.next_id += 1
            leaf.add(cluster)
            self.alive[cluster.id] = cluster
        cluster.size += times
        cluster.touched = self.clock
        self.changed.add(cluster.id)
        heapq.heappush(self.by_size, (cluster.size, cluster.touched, cluster.id))
        if len(self.alive) > self.most:
            self._evict()
        if len(self.by_size) > 4 * self.most + 64:  # entries that are out of date
            self.by_size = [(c.size, c.touched, c.id) for c in self.alive.values()]
            heapq.heapify(self.by_size)
        return cluster

    def _evict(self) -> None:
        while True:
            size, touched, id = heapq.heappop(self.by_size)
            c = self.alive.get(id)
            if c is not None and (c.size, c.touched) == (size, touched):
                del self.alive[id]
                self.gone.add(id)
                c.leaf.drop(c)
                return


def overflow(rows: DataFrame, most: int = 100) -> DataFrame:
    """K8: first tokens beyond the ``most`` that came first under a node share the wildcard branch.

    ``rows``: tool_type, n_tokens, arrival, and the first two tokens ``t1`` and ``t2``, which become ``k1`` and ``k2``.
    """
    for level, node in ((1, ["tool_type", "n_tokens"]), (2, ["tool_type", "n_tokens", "k1"])):
        token = f"t{level}"
        first = rows.groupBy(*node, token).agg(F.min("arrival").alias("first_"))
        early = first.withColumn("r_", F.row_number().over(Window.partitionBy(*node).orderBy("first_"))).filter(F.col("r_") <= most)
        early = early.select(*[F.col(c).alias(f"{c}_") for c in [*node, token]])
        on = [rows[c].eqNullSafe(early[f"{c}_"]) for c in [*node, token]]
        rows = rows.join(early, on, "left").select(*[rows[c] for c in rows.columns], F.coalesce(f"{token}_", F.lit(ANY)).alias(f"k{level}"))
    return rows.drop("t1", "t2")


#: Distinct lines of a shard of leaves.
SHARD_LINES = 50_000


def drain(lines: DataFrame, least: float = 0.55, most_children: int = 100, most: int = 5000) -> DataFrame:
    """The template of every distinct masked line.

    ``lines``: tool_type, masked, arrival.  Only distinct lines are clustered, in the order of their first arrival
    and with the number of their repeats, each leaf (tool, number of tokens, first two tokens) on its own and with
    at most ``most`` clusters, so neither the memory of a leaf nor the comparisons of a line grow with the lines.
    """
    # distinct lines are written once; masks and shuffles of all lines would else run for each look at them
    distinct = _cut(lines.groupBy("tool_type", "masked").agg(F.min("arrival").alias("arrival"), F.count("*").alias("n")))
    tokens = X.tokens(F.col("masked"))
    token = lambda k: F.coalesce(F.get("tokens", F.lit(k)), F.lit(""))
    rows = distinct.withColumn("tokens", tokens).select("*", F.size("tokens").alias("n_tokens"), token(0).alias("t1"), token(1).alias("t2")).drop("tokens")
    rows = overflow(rows, most_children)

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival", kind="stable")
        words, times = [m.split() for m in pdf["masked"]], pdf["n"].tolist()
        members: dict[tuple, list[int]] = {}
        for i, (tool, n, k1, k2) in enumerate(zip(pdf["tool_type"], pdf["n_tokens"], pdf["k1"], pdf["k2"])):
            members.setdefault((tool, n, len(words[i]), k1, k2), []).append(i)
        created, template = [""] * len(words), [""] * len(words)
        for mine in members.values():  # one leaf after the other, so that only one is held
            if len(mine) == 1:
                created[mine[0]] = template[mine[0]] = " ".join(words[mine[0]])
                continue
            tree, leaf = Tree(least, most), Clusters(least)
            for i, c in zip(mine, [tree.insert(words[i], times[i], leaf) for i in mine]):
                created[i], template[i] = c.created_by, c.template
        return pd.DataFrame({"tool_type": pdf["tool_type"], "masked": pdf["masked"], "n": pdf["n"], "arrival": pdf["arrival"], "created_by": created, "template": template})

    arrival = dict(lines.dtypes)["arrival"]
    # leaves are small and many: a group holds several, of about ``SHARD_LINES`` lines in all
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // SHARD_LINES))
    shard = F.pmod(F.xxhash64("tool_type", "n_tokens", "k1", "k2"), F.lit(4 * parts)).alias("shard")
    found = rows.withColumn("shard", shard).repartition(parts, "shard").groupBy("shard").applyInPandas(leaves, f"tool_type string, masked string, n long, arrival {arrival}, created_by string, template string")
    return found.withColumn("template_id", X.template_id(F.col("tool_type"), F.col("created_by")))


def templates(assigned: DataFrame, most: int | None = None) -> DataFrame:
    """One row per template; ``most`` keeps the best supported per tool."""
    t = assigned.groupBy("template_id", "tool_type").agg(F.first("created_by").alias("masked_signature"), F.max_by("template", F.struct("arrival")).alias("template"), F.sum("n").alias("occurrence_count"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"))
    if most is None:
        return t
    w = Window.partitionBy("tool_type").orderBy(F.desc("occurrence_count"), F.desc("last_arrival"), "template_id")
    return t.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= most).drop("r_")


def warm_start(state: DataFrame, fresh: DataFrame, least: float = 0.55, most: int = 5000) -> DataFrame:
    """Clusters kept from before (leaf, cluster_id, tokens, created_by) take new lines (leaf, masked, tokens, arrival) first."""

    def go(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        tree, leaf = Tree(least, most), Clusters(least)
        for r in old.sort_values("cluster_id").itertuples():
            leaf.add(Cluster(r.cluster_id, list(r.tokens), r.created_by, 1, 0, leaf))
        tree.alive = {c.id: c for c in leaf.rows}
        tree.by_size = [(c.size, c.touched, c.id) for c in leaf.rows]
        tree.next_id = max([0, *tree.alive]) + 1
        new = new.sort_values("arrival", kind="stable")
        owners = [tree.insert(list(t), 1, leaf) for t in new["tokens"]]
        return pd.DataFrame({"leaf": new["leaf"], "masked": new["masked"], "created_by": [c.created_by for c in owners], "template": [c.template for c in owners]})

    return state.groupBy("leaf").cogroup(fresh.groupBy("leaf")).applyInPandas(go, "leaf string, masked string, created_by string, template string")


def occurrences(blobs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Template, locator, session, time and parameters of every blob."""
    ids = assigned.select("tool_type", "masked", "template_id")
    return blobs.join(ids, ["tool_type", "masked"]).select("template_id", *[c for c in ("locator", "session_id", "ts", "params") if c in blobs.columns])


def support(t: DataFrame) -> DataFrame:
    """How many templates occur once and how many again."""
    one = F.count(F.when(F.col("occurrence_count") == 1, 1))
    return t.agg(F.count("*").alias("templates"), one.alias("singletons"), (F.count("*") - one).alias("recurring"), F.round(F.try_divide(one, F.count("*")), 4).alias("singleton_rate"))


def growth_curve(first_seen: DataFrame, every: int, partition: str = "tool_type", **limits) -> DataFrame:
    """Templates so far by blobs seen, every ``every`` blobs.  ``first_seen``: partition, arrival, is_first."""
    rows = first_seen.select(partition, "arrival", "is_first")
    run = scan.running(rows, [partition], ["arrival"], counts={"blobs": F.lit(True), "templates": F.col("is_first")}, **limits)
    return run.select(partition, "blobs", "templates").filter(F.col("blobs") % every == 0)
