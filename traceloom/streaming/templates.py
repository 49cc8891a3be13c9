"""Template clustering of a stream: the clusters of each tool and line length are keyed state of bounded size."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import exprs as X
from ..operators.templates import Cluster, Tree

OUT = "tool_type string, masked string, arrival long, template_id string, template string, is_new boolean"


class TemplateState(StatefulProcessor):
    """A key's clusters are a map in the state store, at most ``most`` of them.

    A batch restores them with their ids and generalised tokens, takes its lines in order of arrival, evicts by
    support and then age, and writes back only the clusters that changed.
    """

    def __init__(self, least: float = 0.55, most: int = 5000):
        self.least, self.most = least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "id long", "created_by string, tokens array<string>, size long, touched long")
        self.counter = handle.getValueState("counter", "next_id long, clock long")

    def handleInputRows(self, key, rows, timer_values):
        tool = key[0]
        tree = Tree(self.least, self.most)
        kept = [Cluster(k[0], list(v[1]), v[0], v[2], v[3]) for k, v in self.clusters.iterator()] if self.clusters.exists() else []
        tree.restore(kept)
        if self.counter.exists():
            tree.next_id, tree.clock = self.counter.get()
        known, out = {c.id for c in kept}, []
        fresh = pd.concat(list(rows), ignore_index=True).sort_values("arrival", kind="stable")
        for masked, arrival in zip(fresh["masked"], fresh["arrival"]):
            first = tree.next_id
            c = tree.insert(masked.split())
            out.append((tool, masked, int(arrival), hashlib.sha256(f"{tool}\0{c.created_by}".encode()).hexdigest(), c, c.id == first))
        for id in tree.gone & known:
            self.clusters.removeKey((id,))
        for id in tree.changed - tree.gone:
            c = tree.alive[id]
            self.clusters.updateValue((id,), (c.created_by, c.tokens, c.size, c.touched))
        self.counter.update((tree.next_id, tree.clock))
        yield pd.DataFrame([(*r[:4], r[4].template, r[5]) for r in out], columns=["tool_type", "masked", "arrival", "template_id", "template", "is_new"])

    def close(self) -> None:
        pass


def with_templates(stream: DataFrame, least: float = 0.55, most: int = 5000) -> DataFrame:
    """The template of every line of a stream (tool_type, masked, arrival), as far as it has been learnt; needs the RocksDB state store."""
    lines = stream.select("tool_type", F.size(X.tokens(F.col("masked"))).alias("n_tokens"), "masked", F.col("arrival").cast("long").alias("arrival"))
    return lines.groupBy("tool_type", "n_tokens").transformWithStateInPandas(TemplateState(least, most), OUT, "Append", "None")
