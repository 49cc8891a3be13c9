"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .joins import _cut, dealt, parts_of, small

KINDS = ("input", "output", "cache_read", "cache_creation")


def priced(usage: DataFrame, prices: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Cost per row at the model's rates per million tokens, to six places; null where no rate is known."""
    rates = prices.select(F.col("model").alias("base_model"), *[F.col(k).alias(f"{k}_rate") for k in kinds])
    met = usage.withColumn("base_model", X.base_model(F.col("model"))).join(small(rates), "base_model", "left")
    total = sum((F.col(k) * F.col(f"{k}_rate") for k in kinds[1:]), F.col(kinds[0]) * F.col(f"{kinds[0]}_rate"))
    return met.withColumn("usd", F.round(total / 1e6, 6)).drop(*[f"{k}_rate" for k in kinds])


def unpriced(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Token sums of models without a rate."""
    return rows.filter("usd is null").groupBy("model").agg(*[F.sum(k).alias(k) for k in kinds], F.count("*").alias("n_rows"))


def per_session(rows: DataFrame, key: str = "session_id") -> DataFrame:
    return rows.groupBy(key).agg(F.round(F.sum("usd"), 6).alias("usd"))


def per_group(sessions: DataFrame, members: DataFrame, group: str, key: str = "session_id") -> DataFrame:
    """Cost of each group's distinct sessions; a session in two groups counts in both."""
    return members.select(group, key).distinct().join(sessions, key).groupBy(group).agg(F.round(F.sum("usd"), 6).alias("usd"), F.count("*").alias("sessions"))


#: Items of a block: a session of more of them is dealt out as pairs of blocks.
BLOCK_ITEMS = 1000
#: Rows that a task of the pairs takes in, so that its memory does not grow with the input.
TASK_ROWS = 500_000


def block_pairs(sets: DataFrame, session: str, item: str, block_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of a session's items: ``first_`` and ``second_`` block of a pair, and the item.

    A session of n items has n / ``block_items`` blocks, and each pair of blocks is a key of its own, so that no task has
    more than the pairs of two blocks.  Most sessions are one block, and each of their items stands once on either side.
    """
    most = block_items or BLOCK_ITEMS
    large = sets.groupBy(F.col(session).alias("large_")).agg(F.count("*").alias("n_")).filter(F.col("n_") > most)
    large = small(large.select("large_", F.ceil(F.col("n_") / most).cast("int").alias("blocks_")))
    met = sets.join(large, sets[session] == large["large_"], "left").select(session, item, F.coalesce("blocks_", F.lit(1)).alias("blocks_"))
    met = met.withColumn("own_", F.pmod(F.xxhash64(item), F.col("blocks_")).cast("int"))
    left = met.select(session, item, F.col("own_").alias("first_"), F.explode(F.sequence("own_", F.col("blocks_") - 1)).alias("second_"))
    right = met.select(session, item, F.explode(F.sequence(F.lit(0), "own_")).alias("first_"), F.col("own_").alias("second_"))
    return left, right


def co_change(touches: DataFrame, session: str, item: str, written: DataFrame | None = None, block_items: int | None = None) -> DataFrame:
    """Unordered pairs of items touched in the same session, and in how many; only of items in ``written``, if given."""
    sets = touches.select(session, item)
    parts = parts_of(sets, TASK_ROWS)
    sets = sets.repartition(parts, session, item).distinct()
    if written is not None:
        sets = sets.repartition(parts, item).join(written.select(item).repartition(parts, item).distinct(), item, "left_semi")
    sets = _cut(sets)
    x, y = (side.repartition(parts, session, "first_", "second_").alias(name) for side, name in zip(block_pairs(sets.repartition(parts, session), session, item, block_items), "xy"))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (session, "first_", "second_")]
    # items of two blocks meet once, in either order; within a block the smaller one comes first; null is no item in either
    met = x.join(y, [*on, (F.col(f"x.{item}") < F.col(f"y.{item}")) | ((F.col("x.first_") < F.col("x.second_")) & (F.col(f"x.{item}") > F.col(f"y.{item}")))])
    met = met.select(F.least(f"x.{item}", f"y.{item}").alias("a"), F.greatest(f"x.{item}", f"y.{item}").alias("b"))
    pairs = sets.groupBy(session).agg(F.count("*").alias("n_")).agg(F.sum(F.expr("n_ * (n_ - 1) div 2"))).first()[0] or 0
    items = sets.select(item).distinct().count()
    # few different pairs are counted before they are sent; many would fill a task's memory with what hardly repeats
    if min(pairs, items * (items - 1) // 2) > TASK_ROWS * sets.sparkSession.sparkContext.defaultParallelism:
        met = met.repartition(max(parts, pairs // TASK_ROWS), "a", "b")
    return met.groupBy("a", "b").agg(F.count("*").alias("sessions"))


def co_change_top(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Each item's partners by rank, the most frequent first; all of them, or ``k`` (the reference shows 6)."""
    sides = F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("other")), F.struct(F.col("b").alias("item"), F.col("a").alias("other")))
    both = dealt(_cut(pairs).select(F.explode(sides).alias("p"), "sessions").select("p.*", "sessions"), "item", each=TASK_ROWS)
    w = Window.partitionBy("item").orderBy(F.desc("sessions"), "other")
    ranked = both.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def file_activity(touches: DataFrame) -> DataFrame:
    """Per file reads, writes, edits, human edits, growth, sessions, branches and touch times.  ``touches``: path, kind, growth, session_id, branch, ts."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return touches.groupBy("path").agg(
        count("read").alias("reads"), count("write").alias("writes"), count("edit").alias("edits"), count("human").alias("human_edits"),
        F.coalesce(F.sum("growth"), F.lit(0)).alias("net_growth"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("branch").alias("branches"), F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"),
    )


def top_files(activity: DataFrame, n: int = 80) -> DataFrame:
    """F8."""
    return activity.withColumn("touches", F.col("reads") + F.col("writes") + F.col("edits")).orderBy(F.desc("touches"), "path").limit(n)


def latest_touches(touches: DataFrame, n: int = 40) -> DataFrame:
    """The latest locators of each file, one a session."""
    one = touches.groupBy("path", "session_id").agg(F.max(F.struct("ts", "transcript", "offset")).alias("t"))
    w = Window.partitionBy("path").orderBy(F.desc("t"))
    return one.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= n).select("path", "session_id", "t.*")


def session_signals(events: DataFrame) -> DataFrame:
    """Counters of each session, with a histogram of its tools.  ``events``: session_id, event_type, tool_name, thinking_ms."""
    kind = lambda *names: F.count(F.when(F.col("event_type").isin(*names), 1))
    tools = events.filter("tool_name is not null").groupBy("session_id", "tool_name").count().groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "count")))).alias("tools"))
    base = events.groupBy("session_id").agg(kind("user_prompt").alias("prompts"), kind("assistant_response", "tool_decision").alias("assistant_turns"), kind("tool_result", "tool_result_error").alias("results"), kind("tool_result_error").alias("errors"), kind("system_compact_boundary").alias("compactions"))
    return base.join(tools, "session_id", "left")


def index_by(rows: DataFrame, key: str, sets: list[str], sums: list[str] = ()) -> DataFrame:
    """Sets and sums per branch or task."""
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in sets], *[F.sum(c).alias(c) for c in sums])


def totals(usage: DataFrame, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Over all, and per model."""
    aggs = [F.sum(k).alias(k) for k in kinds]
    return usage.agg(*aggs), usage.groupBy("model").agg(*aggs)


def ranking(costs: DataFrame, key: str, value: str = "cost", most: int = 10) -> DataFrame:
    """the dearest keys with their place, ties to the smaller key; unpriced ones have none."""
    top = costs.filter(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(most)
    return top.select(key, value, F.row_number().over(Window.orderBy(F.desc(value), key)).cast("long").alias("place"))
