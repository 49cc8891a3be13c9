"""Rows and facts from transcript lines: every rule looks at one line alone.

``lines`` has path, offset, length and ``v`` (VARIANT), as ``sources.transcripts.parsed`` makes
them.  ``base`` resolves identity, time and type once; all tables select from its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .joins import longest_prefix

BLOCK = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: variant, tool_use_id: string, is_error: boolean, content: variant>>"
SPAN_CAP, SEED_CAP = 16_384, 240
#: Line types whose events are named with underscores; others keep their name.
KNOWN = ("pr-link", "ai-title", "last-prompt", "frame-link", "mode", "permission-mode", "attachment", "file-history-snapshot")
FILE_TOOLS = ("Read", "Write", "Edit", "MultiEdit")


def base(lines: DataFrame) -> DataFrame:
    """Identity, time, event type and branch of every line that has an identity."""
    v = F.col("v")
    s = lambda path: X.json_str(v, path)
    own = F.coalesce(s("$.sessionId"), F.nullif(F.regexp_extract("path", r"/subagents/agent-([^/]+)\.jsonl$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1), F.lit("")))
    agent = F.nullif(F.regexp_extract("path", r"/subagents/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    rows = lines.select("path", "offset", "length", "v", own.alias("own_session"), F.coalesce(agent, own).alias("session_id"), agent.alias("subagent_id"), F.coalesce(s("$.timestamp"), s("$.snapshot.timestamp"), F.lit("")).alias("ts"), F.coalesce(s("$.type"), F.lit("unknown")).alias("type"), s("$.cwd").alias("cwd"), F.nullif(s("$.gitBranch"), F.lit("HEAD")).alias("branch"), s("$.version").alias("version"), s("$.entrypoint").alias("entrypoint"), s("$.uuid").alias("uuid"), s("$.message.model").alias("model"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    is_text = X.json_kind(F.col("v"), "$.message.content") == "STRING"
    blocks = F.when(X.json_kind(F.col("v"), "$.message.content").startswith("ARRAY"), F.from_json(F.to_json(content), BLOCK))
    rows = rows.filter("session_id is not null").withColumn("content_text", F.when(is_text, F.try_variant_get("v", "$.message.content", "string"))).withColumn("blocks", F.coalesce(blocks, F.array().cast(BLOCK)))
    uses = F.filter("blocks", lambda b: b["type"] == "tool_use")
    prompt = F.col("content_text").isNotNull() | F.exists("blocks", lambda b: b["type"] == "text")
    failed = F.exists("blocks", lambda b: F.coalesce(b["is_error"], F.lit(False)))
    kind = (
        F.when(F.col("type") == "user", F.when(prompt, "user_prompt").when(failed, "tool_result_error").otherwise("tool_result"))
        .when(F.col("type") == "assistant", F.when(F.size(uses) > 0, "tool_decision").otherwise("assistant_response"))
        .when(F.col("type") == "system", F.concat(F.lit("system_"), F.coalesce(X.json_str(F.col("v"), "$.subtype"), F.lit("event"))))
        .when(F.col("type").isin(*KNOWN), F.translate("type", "-", "_"))
        .otherwise(F.col("type"))
    )
    return rows.withColumn("event_type", kind).withColumn("uses", uses)


def facts(rows: DataFrame) -> DataFrame:
    """One event per line; the id of the first tool use only, and a prompt id on prompts."""
    result_id = F.get(F.filter("blocks", lambda b: b["tool_use_id"].isNotNull()), F.lit(0))["tool_use_id"]
    return rows.select("path", "offset", "length", "session_id", "event_type", "ts", F.when(F.col("event_type") == "user_prompt", F.col("uuid")).alias("prompt_id"), F.coalesce(F.get("uses", F.lit(0))["id"], result_id).alias("tool_use_id")).dropDuplicates(["path", "offset"])


def session_lines(rows: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """What a session takes from each line."""
    v = F.col("v")
    out = rows.select("path", "offset", "session_id", "ts", "branch", F.when(F.col("type") == "last-prompt", X.json_str(v, "$.lastPrompt")).alias("seed"), F.when(F.col("type") == "ai-title", X.json_str(v, "$.aiTitle")).alias("title"), "cwd", "version", "entrypoint", (F.col("type") == "assistant").alias("is_assistant"))
    if intents is None:
        return out.withColumn("commits", F.lit(0)).withColumn("pushes", F.lit(0))
    n = intents.groupBy("path", "offset").agg(F.sum(F.col("intent.commit").cast("int")).alias("commits"), F.sum(F.col("intent.push").cast("int")).alias("pushes"))
    return out.join(n, ["path", "offset"], "left").fillna(0, ["commits", "pushes"])


def branch_rows(rows: DataFrame, intents: DataFrame) -> DataFrame:
    """Sightings and deletions of branches."""
    seen = rows.filter("branch is not null").select("path", "offset", "session_id", F.lit(None).cast("string").alias("repo"), F.col("branch").alias("name"), F.lit(None).cast("string").alias("base"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("deleted_at"))
    made = intents.filter("intent.set_branch is not null").select("path", "offset", "session_id", "repo", "intent.set_branch", "intent.branch_base", "ts", F.lit(None).cast("string"))
    gone = intents.filter("intent.deleted_branch is not null").select("path", "offset", "session_id", "repo", "intent.deleted_branch", F.lit(None).cast("string"), F.lit(None).cast("string"), "ts")
    return seen.union(made).union(gone).withColumn("branch_ref", X.branch_ref(F.col("repo"), F.col("name")))


def pr_links(rows: DataFrame) -> DataFrame:
    """B9."""
    v = F.col("v")
    p = rows.filter("type = 'pr-link'").select("path", "offset", "session_id", "ts", X.json_str(v, "$.prRepository").alias("repo"), X.json_num(v, "$.prNumber").alias("number"), X.json_str(v, "$.prUrl").alias("url"), X.json_str(v, "$.title").alias("title"))
    return p.filter("repo is not null and number > 0").withColumn("pr_ref", X.pr_ref(F.col("repo"), F.col("number")))


def frames(rows: DataFrame) -> DataFrame:
    """B10."""
    v = F.col("v")
    return rows.filter("type = 'frame-link'").select("path", "offset", "session_id", "ts", X.json_str(v, "$.frameUrl").alias("url"), X.json_str(v, "$.title").alias("title"), X.json_str(v, "$.path").alias("file"), F.lit("frame").alias("kind")).filter("url is not null").withColumn("artifact_ref", X.ref("artifact", F.col("url")))


def artifacts(uses: DataFrame) -> DataFrame:
    """Uses of the artifact tool, in the form of ``frames``."""
    i = F.col("input")
    made = uses.filter("name = 'Artifact' and tool_use_id is not null")
    return made.select("path", "offset", "session_id", "ts", F.lit(None).cast("string").alias("url"), X.json_str(i, "$.description").alias("title"), X.json_str(i, "$.file_path").alias("file"), F.lit("artifact").alias("kind"), X.ref("artifact", F.col("tool_use_id")).alias("artifact_ref"))


def in_repository(rows: DataFrame, column: str, roots: DataFrame | None) -> DataFrame:
    """``repo`` and ``column`` relative to the nearest working-tree root above it (``roots``: root, name).

    Relative paths, and paths outside every root, keep their form and have no repository.  Each path meets the roots once.
    """
    none = F.lit(None).cast("string")
    if roots is None:
        return rows.withColumn("repo", none)
    paths = rows.filter(F.col(column).startswith("/")).select(F.col(column).alias("whole_")).distinct().withColumn("normal_", X.normal_path(F.col("whole_")))
    found = longest_prefix(paths, "normal_", roots, ["whole_"]).filter("root is not null").select("whole_", F.col("name").alias("repo"), F.col("rest").alias("rest_"))
    met = rows.join(found, rows[column] == found["whole_"], "left")
    return met.select(*[F.coalesce("rest_", column).alias(column) if c == column else rows[c] for c in rows.columns], "repo")


def phases(rows: DataFrame) -> DataFrame:
    """Candidates for ``turns.phase_collapse``."""
    v = F.col("v")
    return rows.filter("type in ('mode', 'permission-mode')").select("path", "offset", "session_id", "ts", F.col("type").alias("trigger"), F.coalesce(X.json_str(v, "$.mode"), X.json_str(v, "$.permissionMode")).alias("mode")).filter("mode is not null")


def human_edits(rows: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """B12, B25, B26."""
    v = F.col("v")
    e = rows.filter("type = 'attachment'").filter(X.json_str(v, "$.attachment.type") == "edited_text_file").select("path", "offset", "session_id", "ts", X.json_str(v, "$.attachment.filename").alias("file"))
    return in_repository(e.filter("file is not null"), "file", roots).filter(~F.col("file").rlike(X.IGNORED_PATH))


def checkpoints(rows: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """One row per file and backup, without ignored paths."""
    backups = F.from_json(F.to_json(F.try_variant_get("v", "$.snapshot.trackedFileBackups", "variant")), "map<string, struct<backupFileName: string, version: long, backupTime: string>>")
    out = rows.filter("type = 'file-history-snapshot'").select("path", "offset", "session_id", "ts", F.explode(backups).alias("file", "b")).select("path", "offset", "session_id", "ts", "file", "b.*")
    out = in_repository(out.filter("backupFileName is not null and backupTime is not null"), "file", roots).drop("repo")
    return out.filter(~F.col("file").rlike(X.IGNORED_PATH)).dropDuplicates(["session_id", "file", "backupFileName"])


def turns(rows: DataFrame) -> DataFrame:
    """B14."""
    return rows.filter("event_type = 'user_prompt' and uuid is not null").select(F.col("uuid").alias("prompt_id"), "session_id", F.col("ts").alias("started_at"), "path", "offset")


def _chars(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(X.utf16_length(x), F.lit(0)))


def _of_blocks(kind: str, field: str) -> Column:
    return F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: b[field])


def usage(rows: DataFrame) -> DataFrame:
    """Token counters, with the share of output that went into thinking."""
    v = F.col("v")
    n = lambda k: X.json_num(v, f"$.message.usage.{k}")
    thinking, rest = _chars(_of_blocks("thinking", "thinking")), _chars(_of_blocks("text", "text")) + _chars(F.flatten(input_leaves()))
    out = n("output_tokens")
    estimate = F.when((out > 0) & (thinking > 0), F.least(out, F.round(out * thinking / (thinking + rest)).cast("long"))).otherwise(F.lit(0))
    has = F.coalesce(X.json_kind(v, "$.message.usage").startswith("OBJECT"), F.lit(False)) & F.col("model").isNotNull()
    return rows.filter((F.col("type") == "assistant") & has).select("path", "offset", "session_id", "ts", "model", n("input_tokens").alias("input_tokens"), out.alias("output_tokens"), n("cache_read_input_tokens").alias("cache_read_tokens"), n("cache_creation_input_tokens").alias("cache_creation_tokens"), estimate.alias("thinking_tokens"))


def tool_uses(rows: DataFrame) -> DataFrame:
    """One row per tool use."""
    u = rows.filter(F.size("uses") > 0).select("path", "offset", "session_id", "ts", "cwd", F.posexplode("uses").alias("use_no", "u"))
    return u.select("path", "offset", "session_id", "ts", "cwd", "use_no", F.col("u.id").alias("tool_use_id"), F.col("u.name").alias("name"), F.col("u.input").alias("input"))


def file_touches(uses: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """B17, B25, B26."""
    file = F.coalesce(X.json_str(F.col("input"), "$.file_path"), X.json_str(F.col("input"), "$.notebook_path"))
    t = uses.filter(F.col("name").isin(*FILE_TOOLS)).withColumn("file", file)
    t = in_repository(t.filter("file is not null").select("path", "offset", "session_id", "ts", "name", "file"), "file", roots)
    return t.filter(~F.col("file").rlike(X.IGNORED_PATH))


def agents(uses: DataFrame) -> DataFrame:
    """Dispatches of sub-agents."""
    i = F.col("input")
    return uses.filter("name in ('Agent', 'Task')").select("path", "offset", "session_id", "ts", X.ref("agent", F.col("tool_use_id")).alias("agent_ref"), "tool_use_id", X.json_str(i, "$.subagent_type").alias("agent_type"), X.json_str(i, "$.description").alias("description"))


def shell(uses: DataFrame, task_words: tuple[str, ...] = (), roots: DataFrame | None = None) -> DataFrame:
    """Commands with their git intent, pull request title and task; the repository is that of the command's own folder."""
    command = X.json_str(F.col("input"), "$.command")
    s = uses.filter("name = 'Bash'").withColumn("command", command).filter("command is not null")
    folder = X.command_dir(F.col("command"), F.col("cwd"))
    out = s.select("path", "offset", "use_no", "session_id", "ts", "tool_use_id", "command", folder.alias("folder"), folder.alias("at_"), X.git_intent(F.col("command")).alias("intent"), X.pr_title(F.col("command")).alias("pr_title"), (X.task_id(F.col("command"), task_words) if task_words else F.lit(None).cast("string")).alias("task_id"))
    return in_repository(out, "at_", roots).drop("at_")


def pr_halves(commands: DataFrame, rows: DataFrame) -> DataFrame:
    """Title halves from commands and number halves from results, for ``joins.merge_halves``."""
    v = F.col("v")
    pr = "$.toolUseResult.gitOperation.pr"
    result_id = F.get(F.filter("blocks", lambda b: b["tool_use_id"].isNotNull()), F.lit(0))["tool_use_id"]
    url = X.json_str(v, f"{pr}.url")
    made = rows.filter((X.json_str(v, f"{pr}.action") == "created") & url.rlike("github\\.com/[^/]+/[^/]+/pull/[0-9]+")).select("path", "offset", result_id.alias("tool_use_id"), F.lit(None).cast("string").alias("title"), F.regexp_extract(url, r"github\.com/([^/]+/[^/]+)/pull/", 1).alias("repo"), F.regexp_extract(url, "/pull/([0-9]+)", 1).cast("long").alias("number"))
    said = commands.filter("pr_title is not null").select("path", "offset", "tool_use_id", F.col("pr_title").alias("title"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("long").alias("number"))
    return said.unionByName(made)


def agent_links(rows: DataFrame) -> DataFrame:
    """Child sessions by their dispatch, and parents by the lines of a child's file."""
    result_id = F.get(F.filter("blocks", lambda b: b["tool_use_id"].isNotNull()), F.lit(0))["tool_use_id"]
    by_result = rows.withColumn("child", X.json_str(F.col("v"), "$.toolUseResult.agentId")).filter("child is not null").select(result_id.alias("tool_use_id"), F.col("session_id").alias("parent"), "child", "ts", "path", "offset")
    by_path = rows.filter("subagent_id is not null and own_session <> session_id").select(F.lit(None).cast("string").alias("tool_use_id"), F.col("own_session").alias("parent"), F.col("session_id").alias("child"), "ts", "path", "offset")
    at = F.struct("ts", "path", "offset")
    return by_result.union(by_path).groupBy("tool_use_id", "parent", "child").agg(F.min(at).alias("at_")).select("tool_use_id", "parent", "child", "at_.*")


def result_text(content: Column) -> Column:
    """H5: text of a tool result, whole or in blocks; blocks without text leave no line."""
    texts = F.transform(F.filter(F.from_json(F.to_json(content), "array<struct<type: string, text: string>>"), lambda b: b["text"] != ""), lambda b: b["text"])
    return F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(F.array_join(texts, "\n"), F.lit("")))


def blobs(rows: DataFrame) -> DataFrame:
    """The text of each failed tool result, and what successful commands printed; other results have no blob."""
    v = F.col("v")
    out, err = X.json_str(v, "$.toolUseResult.stdout"), X.json_str(v, "$.toolUseResult.stderr")
    printed = F.concat_ws("\n", F.when(F.trim(out) != "", out), F.when(F.trim(err) != "", err))
    own = X.json_str(v, "$.sessionId")
    r = rows.filter(own.isNotNull() & X.json_str(v, "$.timestamp").isNotNull()).select("path", "offset", own.alias("session_id"), "ts", printed.alias("printed"), F.explode(F.filter("blocks", lambda b: b["type"] == "tool_result")).alias("b"))
    failed = F.coalesce("b.is_error", F.lit(False))
    return r.select("path", "offset", "session_id", "ts", F.col("b.tool_use_id").alias("tool_use_id"), failed.alias("is_error"), F.when(failed, result_text(F.col("b.content"))).otherwise(F.col("printed")).alias("raw_text")).filter(F.trim("raw_text") != "")


def input_leaves() -> Column:
    """H6: the string leaves of a line's tool inputs, for each of its tool uses."""
    return F.transform("uses", lambda u: X.string_leaves(F.to_json(u["input"])))


def spans(rows: DataFrame) -> DataFrame:
    """Searchable text per line and field, for ``search.index_spans``."""
    said = lambda texts: F.array_join(F.filter(texts, lambda t: t != ""), "\n")  # noqa: E731  texts that are empty leave no line
    prompt = F.coalesce("content_text", said(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"])))
    results = F.coalesce("content_text", said(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: result_text(b["content"]))))
    # a line's inputs share one limit of leaves
    inputs = F.array_join(F.slice(F.flatten(input_leaves()), 1, 65), "\n")
    field = lambda cond, name, text: rows.filter(cond).select("path", "offset", F.lit(name).alias("field"), X.utf16_left(text, SPAN_CAP).alias("text"))
    out = field("event_type = 'user_prompt'", "prompt", prompt).union(field("type = 'assistant' and exists(blocks, b -> b.type = 'text')", "assistant_response", prompt)).union(field("event_type like 'tool_result%'", "tool_result", results)).union(field("event_type = 'tool_decision'", "tool_input", inputs))
    return out.filter(F.trim("text") != "").withColumn("span_id", F.sha2(F.concat_ws("\u0000", "path", F.col("offset").cast("string"), "field"), 256))


def edges(rows: DataFrame, touches: DataFrame, prs: DataFrame, branches: DataFrame, dispatched: DataFrame, edited: DataFrame, commands: DataFrame, made: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The edge list of all relations, before ``turns.dedupe_edges``; ``made``: frames and artifacts, ``links``: ``agent_links``."""
    s = X.ref("session", F.col("session_id"))
    e = lambda df, relation, target: df.select(s.alias("source_ref"), F.lit(relation).alias("relation"), target.alias("target_ref"), F.col("ts").alias("t_valid"), "path", "offset")
    file = lambda df: X.file_ref(F.col("repo") if "repo" in df.columns else F.lit(None).cast("string"), F.col("file"))
    parents = rows.filter("subagent_id is not null and own_session <> session_id").select(X.ref("session", F.col("own_session")), F.lit("spawned"), s, "ts", "path", "offset")
    worked = branches.select(s, F.lit("worked"), "branch_ref", F.coalesce("created_at", "deleted_at"), "path", "offset")
    out = e(touches, "touched", file(touches)).union(e(prs, "linked", F.col("pr_ref"))).union(worked).union(e(dispatched, "spawned", F.col("agent_ref"))).union(e(edited, "edited_by_human", file(edited))).union(e(commands.filter("task_id is not null"), "ran", X.ref("task", F.col("task_id")))).union(parents)
    if made is not None:
        out = out.union(e(made, "produced", F.col("artifact_ref")))
    if links is not None:
        out = out.union(links.filter("tool_use_id is not null").select(X.ref("agent", F.col("tool_use_id")), F.lit("transcribed_in"), X.ref("session", F.col("child")), "ts", "path", "offset"))
    return out
