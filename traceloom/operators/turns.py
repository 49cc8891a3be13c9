"""Sessions and turns: window functions and grouped merges over facts.

``facts`` has session_id, ts (text, '' where missing), path, seq, event_type and prompt_id.  The
order of a session is (ts, path, seq); a session is one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import scan
from .joins import _cut, small


def first_set(c: str, *order: str) -> Column:
    """The earliest value that is not null, by ``order``."""
    return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order)))


def last_set(c: str, *order: str) -> Column:
    return F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*order)))


def ordered_facts(facts: DataFrame, more: dict[str, Column] | None = None, **limits) -> DataFrame:
    """Turn ordinal, previous event and its time; ``more`` names further values of the row before."""
    before = {"prev_type": F.col("event_type"), "prev_ts": F.col("ts")} | (more or {})
    return scan.running(facts, ["session_id"], ["ts", "path", "seq"], counts={"turn_no": F.col("event_type") == "user_prompt"}, lags=before, **limits)


def turn_rollup(facts: DataFrame, at: str | None = None) -> DataFrame:
    """One row per prompt; events before a session's first prompt belong to none.

    ``at`` names a timestamp column to measure with instead of parsing ``ts``.
    """
    now = F.col(at) if at else X.instant(F.col("ts"))
    # the previous event of a turn's rows is in the turn itself, but for its prompt, which needs none
    rows = ordered_facts(facts.withColumn("at_", now), {"prev_at_": F.col("at_")}).filter("turn_no > 0")
    thinks = F.col("event_type").isin("assistant_response", "tool_decision") & F.col("prev_type").isin("user_prompt", "tool_result", "tool_result_error")
    turns = rows.groupBy("session_id", "turn_no").agg(
        F.max(F.when(F.col("event_type") == "user_prompt", F.col("prompt_id"))).alias("prompt_id"),
        F.max(F.when(F.col("event_type") == "user_prompt", F.col("ts"))).alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.coalesce(X.ms_between(F.max("at_"), F.min("at_")), F.lit(0)).alias("duration_ms"),
        F.count(F.when(F.col("event_type") == "tool_decision", 1)).alias("tool_call_count"),
        F.coalesce(F.sum(F.when(thinks, X.ms_between(F.col("at_"), F.col("prev_at_")))), F.lit(0)).alias("thinking_ms"),
    )
    # a prompt that a resumed session replays counts once, under the smallest session id
    once = turns.filter("prompt_id is not null").groupBy("prompt_id").agg(
        F.min("session_id").alias("session_id"),
        F.min_by("started_at", F.struct("started_at", "session_id", "turn_no")).alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.max("duration_ms").alias("duration_ms"),
        F.max("tool_call_count").alias("tool_call_count"),
        F.max("thinking_ms").alias("thinking_ms"),
    )
    order = Window.partitionBy("session_id").orderBy("started_at", "prompt_id")
    return once.withColumn("turn_index", F.row_number().over(order) - 1)


def phase_collapse(rows: DataFrame, keys: list[str], order: list[str], value: str = "mode", start: str = "ts") -> DataFrame:
    """Changes of ``value`` per key, with the value before and the interval each held."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("before_", F.lag(value).over(w)).filter(~F.col("before_").eqNullSafe(F.col(value)))
    return changed.select(*keys, F.lag(value).over(w).alias("from_mode"), F.col(value).alias("to_mode"), F.col(start).alias("t_valid"), F.lead(start).over(w).alias("t_invalid"))


def transcript_sequence(facts: DataFrame, **limits) -> DataFrame:
    """E5: position of each fact in its transcript."""
    numbered = scan.running(facts.drop("seq"), ["path"], ["offset"], counts={"seq": F.lit(True)}, **limits)
    return numbered.withColumn("seq", F.col("seq") - 1)


def asof(rows: DataFrame, key: str, at: str, prices: DataFrame, effective: str, values: list[str], **limits) -> DataFrame:
    """C14: the latest row of ``prices`` at or before ``at``, by one scan of both sides instead of a range join."""
    types = dict(prices.dtypes)
    left = rows.select(F.col(key).alias("k_"), F.col(at).alias("t_"), F.lit(1).alias("side_"), F.struct(*rows.columns).alias("row_"), *[F.lit(None).cast(types[v]).alias(v) for v in values])
    right = prices.select(F.col(key).alias("k_"), F.col(effective).alias("t_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["row_"].dataType).alias("row_"), *values)
    price = F.when(F.col("side_") == 0, F.struct(*values))
    met = scan.running(left.union(right), ["k_"], ["t_", "side_"], last={"p_": price}, **limits)
    return met.filter("side_ = 1").select("row_.*", *[F.col(f"p_.{v}").alias(v) for v in values])


def session_merge(lines: DataFrame) -> DataFrame:
    """One row per session from its lines (session_id, ts, path, offset, branch, seed, title, cwd, version, entrypoint, is_assistant, commits, pushes)."""
    order = ("path", "offset")
    seen = F.nullif(F.col("ts"), F.lit(""))
    return lines.groupBy("session_id").agg(
        F.min(seen).alias("started_at"),
        F.max(seen).alias("ended_at"),
        first_set("branch", *order).alias("branch"),
        F.left(first_set("seed", *order), F.lit(240)).alias("seed_prompt"),
        last_set("title", *order).alias("title"),
        last_set("cwd", *order).alias("cwd"),
        last_set("version", *order).alias("version"),
        F.min_by("entrypoint", F.when(F.col("entrypoint").isNotNull() & seen.isNotNull(), F.struct("ts", *order))).alias("start_type"),
        F.sum(F.col("is_assistant").cast("long")).alias("turn_count"),
        F.sum("commits").alias("commit_count"),
        F.sum("pushes").alias("push_count"),
    )


def usage_by_model(usage: DataFrame) -> DataFrame:
    """D3: token counters per session and model."""
    kinds = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "thinking_tokens"]
    return usage.groupBy("session_id", "model").agg(*[F.sum(k).alias(k) for k in kinds], F.count("*").alias("request_count"))


def merge_assets(rows: DataFrame, key: str, first: list[str], lowest: list[str] = (), highest: list[str] = ()) -> DataFrame:
    """One row per asset; the first value set wins, or the lowest or highest."""
    order = [c for c in ("path", "offset") if c in rows.columns]
    return rows.groupBy(key).agg(*[first_set(c, *order).alias(c) for c in first], *[F.min(c).alias(c) for c in lowest], *[F.max(c).alias(c) for c in highest])


def dedupe_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first edge of each (source, relation, target)."""
    rest = [c for c in edges.columns if c not in ("source_ref", "relation", "target_ref")]
    kept = edges.groupBy("source_ref", "relation", "target_ref").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return kept.select("source_ref", "relation", "target_ref", "r.*")


def exact_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Column]], accuracy: int = 20_000) -> DataFrame:
    """Values at exact ranks, without a sort of all values: ``ranks`` names (share, rank from 0 as an expression of ``n_``).

    A sketch, merged from all tasks, bounds each rank from both sides by ten times its error.  A second pass
    counts what is below and meets only the values between the bounds, about a thousandth of the rows.
    """
    base = rows.select(*keys, value).filter(F.col(value).isNotNull())
    margin = 10 / accuracy
    shares = [x for p, _ in ranks.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    q = base.groupBy(*keys).agg(F.count("*").alias("n_"), F.percentile_approx(value, shares, accuracy).alias("q_"), F.min(value).alias("least_"), F.max(value).alias("most_"))
    few = F.col("n_") * margin < 2  # a rank more or less matters
    bounds = []
    for i, (name, (p, rank)) in enumerate(ranks.items()):
        low = F.col("least_") if p <= margin else F.when(few, F.col("least_")).otherwise(F.col("q_")[2 * i])
        high = F.col("most_") if p >= 1 - margin else F.when(few, F.col("most_")).otherwise(F.col("q_")[2 * i + 1])
        bounds.append(F.struct(F.lit(name).alias("name"), low.alias("low"), high.alias("high"), rank.cast("long").alias("rank")))
    cuts = _cut(q.select(*keys, "n_", F.array(*bounds).alias("cuts_")))
    right = small(cuts.select(*[F.col(k).alias(f"{k}_r") for k in keys], "cuts_"))
    on = F.lit(True)
    for k in keys:
        on = on & base[k].eqNullSafe(right[f"{k}_r"])
    met = base.join(right, on).select(*[base[k] for k in keys], base[value].alias("v_"), F.explode("cuts_").alias("c_")).filter(F.col("v_") <= F.col("c_.high"))
    # one row for all that is below a bound, and one for each value between the bounds
    inside = met.groupBy(*keys, F.col("c_.name").alias("name"), F.col("c_.rank").alias("rank"), F.when(F.col("v_") >= F.col("c_.low"), F.col("v_")).alias("v_")).agg(F.count("*").alias("k_"))
    w = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("v_")).rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("upto_", F.sum("k_").over(w)).filter("v_ is not null and upto_ > rank").groupBy(*keys, "name").agg(F.min("v_").alias("v_"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v_"))).alias(name) for name in ranks])


def percentile_nearest(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Lower nearest rank, the value at floor((n - 1) p)."""
    return exact_ranks(rows, keys, value, {name: (p, F.floor((F.col("n_") - 1) * p)) for name, p in ranks.items()})


def last_in_effect(rows: DataFrame, key: str, order: list[str], value: str, cleared: Column | None = None) -> DataFrame:
    """The last value set so far; ``cleared`` marks rows that unset it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.lit(False) if cleared is None else cleared, F.struct(F.lit(None).cast(rows.schema[value].dataType).alias("v"))).when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v")))
    return rows.withColumn("current", F.last_value(mark, True).over(w)["v"])


def dense_rerank(rows: DataFrame, key: str, rank: str, insert: tuple | None = None, **limits) -> DataFrame:
    """Ranks 1..n again, or shifted for an insertion ``(id, rank)``; only rows whose rank changes."""
    if insert is None:
        new = scan.running(rows.filter(F.col(rank).isNotNull()).select(key, rank), [], [rank, key], counts={"new_rank": F.lit(True)}, **limits)
        return new.select(key, F.col(rank).alias("old_rank"), F.col("new_rank").cast("int").alias("new_rank")).filter("not (old_rank <=> new_rank)")
    who, at = insert
    new = F.when(F.col(key) == who, F.lit(at)).when(F.col(rank) >= at, F.col(rank) + 1).otherwise(F.col(rank))
    return rows.select(key, F.col(rank).alias("old_rank"), new.alias("new_rank")).filter("not (old_rank <=> new_rank)")


def median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The mean of the middle two."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("by_")).agg(F.count("*").alias("n"))
    middle = exact_ranks(rows, [by], value, {"lower_": (0.5, F.floor((F.col("n_") - 1) / 2)), "upper_": (0.5, F.floor(F.col("n_") / 2))})
    return middle.join(n, middle[by].eqNullSafe(n["by_"])).select(by, ((F.col("lower_") + F.col("upper_")) / 2).cast("double").alias("median"), "n")
