"""Signals of sessions, files and branches, mined from the lines of all transcripts.

``rows`` is the result of ``events.base``.  A sub-agent's lines count for the session that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import events, scan
from .turns import first_set, last_set

KINDS = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}


def _histogram(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``key`` -> value -> how often."""
    counts = rows.select(key, value.alias("v_")).filter("v_ is not null").groupBy(key, "v_").agg(F.count("*").alias("n_"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v_", "n_")))).alias(name))


def owned(rows: DataFrame) -> DataFrame:
    """Lines under the session that they name themselves."""
    return rows.filter("own_session is not null").withColumn("session_id", F.col("own_session"))


def session_counters(rows: DataFrame, roots: DataFrame | None = None, repo: str | None = None, task_words: tuple[str, ...] = ()) -> DataFrame:
    """One row per session with all its counters; files, human edits and pull requests count within ``repo``, if given."""
    r = owned(rows)
    v = F.col("v")
    of = lambda kind: F.size(F.filter("blocks", lambda b: b["type"] == kind))
    uses_of = lambda name: F.size(F.filter("uses", lambda u: u["name"] == name))
    talk, says = F.col("type").isin("user", "assistant"), F.col("type") == "assistant"
    is_list = says & F.col("content_text").isNull() & F.coalesce(X.json_kind(v, "$.message.content").startswith("ARRAY"), F.lit(False))
    number = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    seen = F.when(talk, F.nullif("ts", F.lit("")))
    served = F.from_json(F.to_json(F.try_variant_get("v", "$.message.usage.server_tool_use", "variant")), "map<string, double>")
    thinking = F.aggregate(F.filter("blocks", lambda b: b["type"] == "thinking"), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(X.utf16_length(b["thinking"]), F.lit(0)))
    errors = F.size(F.filter("blocks", lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False))))
    order = ("path", "offset")
    marked = r.withColumn("title_", F.when(F.col("type") == "ai-title", X.json_str(v, "$.aiTitle"))).withColumn("seed_", F.when(F.col("type") == "last-prompt", X.utf16_left(X.json_str(v, "$.lastPrompt"), events.SEED_CAP))).withColumn("bridge_", F.when(F.col("type") == "bridge-session", X.json_str(v, "$.bridgeSessionId")))
    base = marked.groupBy("session_id").agg(
        F.min(seen).alias("first_ts"),
        F.max(seen).alias("last_ts"),
        last_set("title_", *order).alias("title"),
        first_set("seed_", *order).alias("seed_prompt"),
        last_set("bridge_", *order).alias("bridge_session_id"),
        last_set("version", *order).alias("version"),
        F.count(F.when(F.col("event_type") == "user_prompt", 1)).alias("prompts"),
        number(F.col("type") == "user", errors).alias("errors"),
        F.count(F.when(is_list, 1)).alias("turns"),
        *[number(is_list, X.json_num(v, f"$.message.usage.{field}")).alias(f"{kind}_tokens") for kind, field in KINDS.items()],
        number(is_list & served.isNotNull(), F.aggregate(F.map_values(served), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("server_tool_uses"),
        number(says, of("thinking")).alias("thinking_blocks"),
        number(says, thinking).alias("thinking_chars"),
        number(says, of("text")).alias("text_blocks"),
        number(says, uses_of("Agent")).alias("subagents"),
        number(says, uses_of("AskUserQuestion")).alias("decisions"),
        (number(says, uses_of("Artifact")) + F.count(F.when(F.col("type") == "frame-link", 1))).alias("artifacts"),
        F.count(F.when(F.col("event_type") == "system_compact_boundary", 1)).alias("compactions"),
        F.count(F.when((F.col("type") == "attachment") & (X.json_str(v, "$.attachment.type") == "max_turns_reached"), 1)).alias("max_turn_hits"),
    )
    uses = events.tool_uses(r)
    inside = (lambda df: df.filter(F.col("repo") == repo)) if repo else (lambda df: df)
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    commands = events.shell(uses, task_words, roots)
    acts = commands.groupBy("session_id").agg(number(F.col("intent.commit"), F.lit(1)).alias("commits"), number(F.col("intent.push"), F.lit(1)).alias("pushes"), F.array_sort(F.collect_set("task_id")).alias("tasks"))
    prs = events.pr_links(r)
    prs = prs.filter(F.col("repo").endswith(f"/{repo.split('/')[-1]}")) if repo else prs
    tier = F.when(is_list, X.json_str(v, "$.message.usage.service_tier"))
    parts = [
        count(inside(events.file_touches(uses, roots)), "file_touches"),
        count(inside(events.human_edits(r, roots)), "human_edits"),
        acts,
        prs.groupBy("session_id").agg(F.array_sort(F.collect_set("number")).alias("prs")),
        _histogram(uses, "session_id", F.col("name"), "tools"),
        _histogram(r, "session_id", tier, "service_tiers"),
        tokens_by_model(r.filter(is_list)),
    ]
    for part in parts:
        base = base.join(part, "session_id", "left")
    return base.fillna(0, ["file_touches", "human_edits", "commits", "pushes"])


def tokens_by_model(rows: DataFrame) -> DataFrame:
    """``session_id``, ``tokens_by_model``: model -> tokens of each kind."""
    v = F.col("v")
    sums = rows.filter("model is not null").groupBy("session_id", "model").agg(*[F.sum(X.json_num(v, f"$.message.usage.{field}")).alias(kind) for kind, field in KINDS.items()])
    return sums.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(*KINDS))))).alias("tokens_by_model"))


def turn_durations(rows: DataFrame) -> DataFrame:
    """Milliseconds of the turns that transcripts report."""
    v = F.col("v")
    return rows.filter("event_type = 'system_turn_duration'").select("path", "offset", "session_id", F.try_variant_get(v, "$.durationMs", "long").alias("duration_ms")).filter("duration_ms is not null")


def file_changes(uses: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Every use that reads or changes a file: ``kind``, and UTF-16 units added and removed."""
    i = F.col("input")
    file = F.coalesce(X.json_str(i, "$.file_path"), X.json_str(i, "$.notebook_path"))
    edit = "array<struct<old_string: string, new_string: string>>"
    one = F.array(F.struct(X.json_str(i, "$.old_string").alias("old_string"), X.json_str(i, "$.new_string").alias("new_string")))
    edits = F.when(F.col("name") == "MultiEdit", F.from_json(F.to_json(F.try_variant_get(i, "$.edits", "variant")), edit)).when(F.col("name") == "Edit", one)
    size = lambda x: F.coalesce(X.utf16_length(x), F.lit(0))
    grown = F.transform(edits, lambda e: size(e["new_string"]) - size(e["old_string"]))
    total = lambda up: F.coalesce(F.aggregate(grown, F.lit(0).cast("long"), lambda a, d: a + F.greatest(d if up else -d, F.lit(0))), F.lit(0))
    written = F.when(F.col("name") == "Write", size(X.json_str(i, "$.content"))).otherwise(0)
    kind = F.when(F.col("name") == "Read", "read").when(F.col("name") == "Write", "write").otherwise("edit")
    t = uses.filter(F.col("name").isin(*events.FILE_TOOLS)).select("path", "offset", "use_no", "session_id", "ts", kind.alias("kind"), file.alias("file"), (written + total(True)).alias("added"), total(False).alias("removed"))
    return events.in_repository(t.filter("file is not null"), "file", roots).filter(~F.col("file").rlike(X.IGNORED_PATH))


def branch_in_effect(commands: DataFrame, **limits) -> DataFrame:
    """``commands`` (``events.shell``) with ``branch``: the last branch switched to, unless it has been deleted since.

    One scan finds the last switch, another the last deletion of that very branch.
    """
    order = ["path", "offset", "use_no"]
    at = F.struct(*order)
    c = scan.running(commands, ["session_id"], order, last={"switch_": F.when(F.col("intent.set_branch").isNotNull(), F.struct(F.col("intent.set_branch").alias("name"), at.alias("at")))}, **limits)
    # a row asks for its switch, and one that deletes a branch also tells so
    sides = F.explode(F.when(F.col("intent.deleted_branch").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("side_")
    both = c.select("session_id", *order, "switch_", "intent", sides).withColumn("name_", F.when(F.col("side_") == 0, F.col("intent.deleted_branch")).otherwise(F.col("switch_.name")))
    met = scan.running(both, ["session_id", "name_"], [*order, "side_"], last={"gone_": F.when(F.col("side_") == 0, at)}, **limits)
    return met.filter("side_ = 1").select("session_id", *order, "intent", F.when(F.col("gone_").isNull() | (F.col("gone_") < F.col("switch_.at")), F.col("switch_.name")).alias("branch"))


def branch_stats(commands: DataFrame, **limits) -> DataFrame:
    """Commits and pushes of each branch by the branch in effect, and its sessions."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    at = branch_in_effect(commands, **limits).filter("branch is not null")
    return at.groupBy("branch").agg(n("intent.commit").alias("commits"), n("intent.push").alias("pushes"), F.array_sort(F.collect_set("session_id")).alias("sessions"))


def task_actions(commands: DataFrame, task_words: tuple[str, ...]) -> DataFrame:
    """Sessions of each task, and how often each action was taken on it."""
    words = F.split(X.real_command(F.col("command")), r"\s+")
    action = F.when(F.get(words, F.lit(1)) == "task", F.get(words, F.lit(2))).otherwise(F.get(words, F.lit(1)))
    named = commands.filter(F.col("task_id").isNotNull() & F.get(words, F.lit(0)).isin(*task_words)).withColumn("action", action)
    return named.groupBy("task_id").agg(F.array_sort(F.collect_set("session_id")).alias("sessions")).join(_histogram(named, "task_id", F.col("action"), "actions"), "task_id", "left")
