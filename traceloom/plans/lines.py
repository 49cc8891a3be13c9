"""Rules of transcript lines over lines that Spark writes from ``events`` as JSON, sixteen kinds of them, and the same results in SQL.

The queries parse the JSON text again and apply the operators; the SQL works on the columns behind the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import events, joins, signals, turns
from ..sources import transcripts
from .queries import _t, query

_BASE = """b AS (SELECT event_id AS e, user_id AS u, event_id % 16 AS k, event_id // 16 AS q, CAST(floor(value) AS BIGINT) AS n, 'x/s' || user_id || '.jsonl' AS path, 's' || user_id AS session_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events)"""
_NAME = "CASE q % 5 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'Edit' WHEN 3 THEN 'MultiEdit' ELSE 'Grep' END"
_FILE = "CASE q % 4 WHEN 0 THEN '/w/r' || u % 7 || '/src/f' || e % 50 || '.ts' WHEN 1 THEN '/w/r1/node_modules/x' || e || '.js' WHEN 2 THEN 'rel/f' || e ELSE '/out/g' || e END"
_COMMAND = """CASE q % 6 WHEN 0 THEN 'git checkout -b feat/' || u || ' main' WHEN 1 THEN 'cd /w/r' || e % 7 || ' && git commit -m x' WHEN 2 THEN 'git push origin fix-' || u
WHEN 3 THEN 'git branch -D old' || u WHEN 4 THEN 'gh pr create --title "T ' || e || '" --base dev --head h' || u ELSE 'aw task done AB-' || u || ' z' END"""
_EDITED = "'/w/r' || u % 7 || CASE WHEN q % 2 = 0 THEN '/dist/' ELSE '/lib/' END || 'h' || e % 30 || '.py'"


def _json(fields: str) -> str:
    return f"to_json(named_struct({fields}))"


def _use(name: str, value: str) -> str:
    return f"named_struct('type', 'tool_use', 'id', 'u' || e, 'name', {name}, 'input', {value})"


def _kinds() -> dict[int, str]:
    head = "'sessionId', session_id, 'timestamp', ts, 'cwd', '/w/r' || u % 7 || '/src'"
    says = lambda content, more="": f"'type', 'assistant', {head}, 'message', named_struct({more}'content', array({content}))"
    result = lambda content, more: f"'type', 'user', {head}, 'message', named_struct('content', array(named_struct('type', 'tool_result', 'tool_use_id', 'u' || (e - 1), {content}))), 'toolUseResult', named_struct({more})"
    usage = "'model', 'm' || e % 3, 'usage', named_struct('input_tokens', n, 'output_tokens', e % 500, 'cache_read_input_tokens', e % 7), "
    first = f"named_struct('type', 'thinking', 'thinking', repeat('t', cast(q % 40 AS int))), named_struct('type', 'text', 'text', 'said ' || e), {_use(_NAME, f'named_struct({chr(39)}file_path{chr(39)}, {_FILE})')}"
    listed = "array(named_struct('type', 'text', 'text', 'Error: x' || e), named_struct('type', 'text', 'text', ''))"
    failed = "'is_error', q % 2 = 0, 'content', "
    out = "'stdout', CASE WHEN q % 4 = 1 THEN 'out ' || e ELSE '' END, 'stderr', ''"
    return {
        1: _blocks(says, usage, first),
        0: _json(f"'type', 'user', {head}, 'uuid', 'p' || e, 'gitBranch', 'b' || u % 3, 'message', named_struct('content', 'ask ' || e)"),
        2: f"CASE WHEN q % 3 = 0 THEN {_json(result(failed + chr(39) + 'fail ' + chr(39) + ' || e', out))} ELSE {_json(result(failed + listed, out))} END",
        3: _json(says(_use("'Bash'", f"named_struct('command', {_COMMAND})"))),
        4: _json(result("'content', 'done'", "'gitOperation', named_struct('pr', named_struct('action', CASE WHEN q % 2 = 0 THEN 'created' ELSE 'merged' END, 'number', e, 'url', 'https://github.com/o/r' || u % 5 || '/pull/' || e))")),
        5: _json(f"'type', 'frame-link', {head}, 'frameUrl', 'http://f/' || q % 9, 'title', 'F' || q % 9, 'path', 'p'"),
        6: _json(f"'type', 'pr-link', {head}, 'prRepository', 'o/r' || u % 5, 'prNumber', q % 11, 'prUrl', 'http://p/' || e, 'title', 'P' || e"),
        7: f"CASE WHEN q % 3 = 0 THEN {_json(f'{chr(39)}type{chr(39)}, {chr(39)}attachment{chr(39)}, {head}, {chr(39)}attachment{chr(39)}, named_struct({chr(39)}type{chr(39)}, {chr(39)}max_turns_reached{chr(39)})')} ELSE {_json(f'{chr(39)}type{chr(39)}, {chr(39)}attachment{chr(39)}, {head}, {chr(39)}attachment{chr(39)}, named_struct({chr(39)}type{chr(39)}, {chr(39)}edited_text_file{chr(39)}, {chr(39)}filename{chr(39)}, {_EDITED})')} END",
        8: _json("'type', 'file-history-snapshot', 'snapshot', named_struct('timestamp', ts, 'trackedFileBackups', map('/w/r' || u % 7 || '/a' || q % 5, named_struct('backupFileName', 'b' || q % 6, 'version', q % 4, 'backupTime', 't')))"),
        9: _json(f"'type', 'mode', {head}, 'mode', 'm' || q % 3"),
        10: _json(f"'type', 'permission-mode', {head}, 'permissionMode', 'p' || q % 3"),
        11: _json(says(_use("'Agent'", "named_struct('subagent_type', 'k' || q % 3, 'description', 'look ' || e)"))),
        12: _json(result("'content', 'started'", "'agentId', 'c' || e")),
        13: _json(says(_use("'Artifact'", "named_struct('description', 'Chart ' || e, 'file_path', 'c' || e)"))),
        14: _json(f"'type', 'system', {head}, 'subtype', CASE q % 3 WHEN 0 THEN 'compact_boundary' WHEN 1 THEN 'turn_duration' END, 'durationMs', n"),
        15: f"CASE WHEN q % 2 = 0 THEN {_json(f'{chr(39)}type{chr(39)}, {chr(39)}ai-title{chr(39)}, {head}, {chr(39)}aiTitle{chr(39)}, {chr(39)}Title {chr(39)} || q')} ELSE {_json(f'{chr(39)}type{chr(39)}, {chr(39)}last-prompt{chr(39)}, {head}, {chr(39)}lastPrompt{chr(39)}, {chr(39)}seed {chr(39)} || q')} END",
    }


def _blocks(says, usage: str, blocks: str) -> str:
    """A line whose blocks have different fields."""
    parts = [f"to_json({b})" for b in _split(blocks)]
    whole = _json(says("'@'", usage))
    return f"""replace({whole}, '["@"]', concat('[', concat_ws(',', {", ".join(parts)}), ']'))"""


def _split(text: str) -> list[str]:
    """Expressions separated by commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def _lines(spark, sf_dir: str) -> DataFrame:
    # making and parsing a line costs far more than reading its row
    b = joins.dealt(_t(spark, sf_dir, "events"), "event_id").selectExpr("event_id AS e", "user_id AS u", "event_id % 16 AS k", "event_id div 16 AS q", "cast(floor(value) AS bigint) AS n", "'x/s' || user_id || '.jsonl' AS path", "'s' || user_id AS session_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS ts")
    kinds = " ".join(f"WHEN {k} THEN {x}" for k, x in _kinds().items())
    return b.select("path", F.col("e").alias("offset"), F.expr(f"CASE k {kinds} END").alias("text")).withColumn("length", F.octet_length("text"))


def _rows(spark, sf_dir: str) -> DataFrame:
    # the lines, and their parsed rows, are written once, however many rules look at them
    return joins._cut(events.base(transcripts.parsed(joins._cut(_lines(spark, sf_dir))).filter("not bad")))


def _roots(spark, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").selectExpr("'/w/r' || user_id % 7 AS root", "'o/r' || user_id % 7 AS name").distinct()


@query("permissive_scan", """
WITH l AS (SELECT user_id AS path, CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN '{"k": ' WHEN 2 THEN '[' || event_id || ']' ELSE props END AS text FROM events)
SELECT path, count(*) AS lines, count(CASE WHEN NOT json_valid(text) THEN 1 END) AS malformed, count(CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN 1 END) AS good FROM l WHERE trim(text) <> '' GROUP BY path""")
def permissive_scan(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id AS path", """CASE event_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN '{"k": ' WHEN 2 THEN '[' || event_id || ']' ELSE props END AS text""")
    good, counts = transcripts.permissive(rows)
    return counts.join(good.groupBy("path").agg(F.count("*").alias("good")), "path", "left").fillna(0, ["good"])


@query("read_back", "SELECT user_id AS path, event_id AS \"offset\", props AS text FROM events WHERE event_type = 'error'")
def read_back(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return transcripts.read_back(e.filter("event_type = 'error'").selectExpr("user_id AS path", "event_id AS offset"), e.selectExpr("user_id AS path", "event_id AS offset", "props AS text"))


@query("line_facts", f"""
WITH {_BASE}
SELECT path, e AS "offset", session_id, CASE k WHEN 0 THEN 'user_prompt' WHEN 2 THEN CASE WHEN q % 2 = 0 THEN 'tool_result_error' ELSE 'tool_result' END WHEN 4 THEN 'tool_result' WHEN 12 THEN 'tool_result' WHEN 5 THEN 'frame_link' WHEN 6 THEN 'pr_link' WHEN 7 THEN 'attachment'
  WHEN 8 THEN 'file_history_snapshot' WHEN 9 THEN 'mode' WHEN 10 THEN 'permission_mode' WHEN 14 THEN CASE q % 3 WHEN 0 THEN 'system_compact_boundary' WHEN 1 THEN 'system_turn_duration' ELSE 'system_event' END WHEN 15 THEN CASE WHEN q % 2 = 0 THEN 'ai_title' ELSE 'last_prompt' END ELSE 'tool_decision' END AS event_type,
  ts, CASE WHEN k = 0 THEN 'p' || e END AS prompt_id, CASE WHEN k IN (1, 3, 11, 13) THEN 'u' || e WHEN k IN (2, 4, 12) THEN 'u' || (e - 1) END AS tool_use_id FROM b""")
def line_facts(spark, sf_dir):
    return events.facts(_rows(spark, sf_dir)).drop("length")


@query("line_usage", f"""
WITH {_BASE}, t AS (SELECT *, q % 40 AS th, q % 40 + length('said ' || e) + length({_FILE}) AS total, e % 500 AS o FROM b WHERE k = 1)
SELECT e AS "offset", session_id, 'm' || e % 3 AS model, n AS input_tokens, o AS output_tokens, e % 7 AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(CASE WHEN o > 0 AND th > 0 THEN least(o, round(o * th / total)) ELSE 0 END AS BIGINT) AS thinking_tokens FROM t""")
def line_usage(spark, sf_dir):
    return events.usage(_rows(spark, sf_dir)).drop("path", "ts")


@query("line_touches", f"""
WITH {_BASE}
SELECT e AS "offset", session_id, {_NAME} AS name, CASE WHEN q % 4 = 0 THEN 'o/r' || u % 7 END AS repo, CASE WHEN q % 4 = 0 THEN 'src/f' || e % 50 || '.ts' ELSE {_FILE} END AS file FROM b WHERE k = 1 AND q % 5 < 4 AND q % 4 <> 1""")
def line_touches(spark, sf_dir):
    return events.file_touches(events.tool_uses(_rows(spark, sf_dir)), _roots(spark, sf_dir)).drop("path", "ts")


@query("line_blobs", f"""
WITH {_BASE}
SELECT b.e AS "offset", b.session_id, 'u' || (b.e - 1) AS tool_use_id, b.q % 2 = 0 AS is_error, CASE WHEN b.q % 2 = 1 THEN 'out ' || b.e WHEN b.q % 3 = 0 THEN 'fail ' || b.e ELSE 'Error: x' || b.e END AS raw_text,
  CASE WHEN p.e IS NULL THEN 'generic' ELSE {_NAME.replace("q %", "b.q %")} END AS tool_name FROM b LEFT JOIN b p ON p.e = b.e - 1 AND p.path = b.path WHERE b.k = 2 AND (b.q % 2 = 0 OR b.q % 4 = 1)""")
def line_blobs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return joins.tool_names(events.blobs(rows), events.tool_uses(rows)).drop("path", "ts")


@query("line_commands", f"""
WITH {_BASE}
SELECT e AS "offset", session_id, CASE WHEN q % 6 = 1 THEN '/w/r' || e % 7 ELSE '/w/r' || u % 7 || '/src' END AS folder, CASE WHEN q % 6 = 1 THEN (SELECT any_value('o/r' || x.user_id % 7) FROM events x WHERE x.user_id % 7 = e % 7) ELSE 'o/r' || u % 7 END AS repo,
  CASE q % 6 WHEN 0 THEN 'feat/' || u WHEN 2 THEN 'fix-' || u WHEN 4 THEN 'h' || u END AS set_branch, CASE q % 6 WHEN 0 THEN 'main' WHEN 4 THEN 'dev' END AS branch_base, CASE WHEN q % 6 = 3 THEN 'old' || u END AS deleted_branch,
  CASE WHEN q % 6 < 5 THEN q % 6 = 1 END AS "commit", CASE WHEN q % 6 < 5 THEN q % 6 = 2 END AS push, CASE WHEN q % 6 = 4 THEN 'T ' || e END AS pr_title, CASE WHEN q % 6 = 5 THEN 'AB-' || u END AS task_id FROM b WHERE k = 3""")
def line_commands(spark, sf_dir):
    c = events.shell(events.tool_uses(_rows(spark, sf_dir)), ("aw",), _roots(spark, sf_dir))
    return c.select("offset", "session_id", "folder", "repo", "intent.set_branch", "intent.branch_base", "intent.deleted_branch", "intent.commit", "intent.push", "pr_title", "task_id")


@query("branch_sightings", f"""
WITH {_BASE}
SELECT 'branch:b' || u % 3 AS branch_ref, e AS "offset", CAST(NULL AS VARCHAR) AS base, ts AS created_at, CAST(NULL AS VARCHAR) AS deleted_at FROM b WHERE k = 0
UNION ALL SELECT 'branch:o/r' || u % 7 || '/' || CASE q % 6 WHEN 0 THEN 'feat/' || u WHEN 2 THEN 'fix-' || u ELSE 'h' || u END, e, CASE q % 6 WHEN 0 THEN 'main' WHEN 4 THEN 'dev' END, ts, NULL FROM b WHERE k = 3 AND q % 6 IN (0, 2, 4)
UNION ALL SELECT 'branch:o/r' || u % 7 || '/old' || u, e, NULL, NULL, ts FROM b WHERE k = 3 AND q % 6 = 3""")
def branch_sightings(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return events.branch_rows(rows, events.shell(events.tool_uses(rows), (), _roots(spark, sf_dir))).select("branch_ref", "offset", "base", "created_at", "deleted_at")


@query("pr_creates", f"""
WITH {_BASE}
SELECT 'u' || t.e AS tool_use_id, 'T ' || t.e AS title, 'o/r' || r.u % 5 AS repo, r.e AS number FROM b t JOIN b r ON r.e = t.e + 1 WHERE t.k = 3 AND t.q % 6 = 4""")
def pr_creates(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return joins.merge_halves(events.pr_halves(events.shell(events.tool_uses(rows)), rows), "tool_use_id", ["title", "repo", "number"])


@query("line_assets", f"""
WITH {_BASE}
SELECT e AS "offset", 'artifact:http://f/' || q % 9 AS ref, 'frame' AS kind, 'F' || q % 9 AS title FROM b WHERE k = 5
UNION ALL SELECT e, 'artifact:u' || e, 'artifact', 'Chart ' || e FROM b WHERE k = 13
UNION ALL SELECT e, 'pr:o/r' || u % 5 || '#' || q % 11, 'pr', 'P' || e FROM b WHERE k = 6 AND q % 11 > 0""")
def line_assets(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    made = events.frames(rows).unionByName(events.artifacts(events.tool_uses(rows)))
    return made.select("offset", F.col("artifact_ref").alias("ref"), "kind", "title").union(events.pr_links(rows).select("offset", "pr_ref", F.lit("pr"), "title"))


@query("line_edits", f"""
WITH {_BASE}, c AS (SELECT session_id, 'a' || q % 5 AS file, 'b' || q % 6 AS backup, any_value(q % 4) FILTER (WHERE true) AS v FROM b WHERE k = 8 GROUP BY ALL)
SELECT session_id, 'edit' AS kind, 'o/r' || u % 7 || '/lib/h' || e % 30 || '.py' AS what FROM b WHERE k = 7 AND q % 3 > 0 AND q % 2 = 1
UNION ALL SELECT session_id, 'checkpoint', file || ' ' || backup FROM c""")
def line_edits(spark, sf_dir):
    rows, roots = _rows(spark, sf_dir), _roots(spark, sf_dir)
    edits = events.human_edits(rows, roots).select("session_id", F.lit("edit").alias("kind"), F.concat("repo", F.lit("/"), "file").alias("what"))
    return edits.union(events.checkpoints(rows, roots).select("session_id", F.lit("checkpoint"), F.concat("file", F.lit(" "), "backupFileName")))


@query("line_phases", f"""
WITH {_BASE} SELECT e AS "offset", session_id, CASE WHEN k = 9 THEN 'mode' ELSE 'permission-mode' END AS trigger, CASE WHEN k = 9 THEN 'm' ELSE 'p' END || q % 3 AS mode FROM b WHERE k IN (9, 10)""")
def line_phases(spark, sf_dir):
    return events.phases(_rows(spark, sf_dir)).select("offset", "session_id", "trigger", "mode")


@query("line_agents", f"""
WITH {_BASE}
SELECT 'agent:u' || a.e AS agent_ref, a.session_id, 'k' || a.q % 3 AS agent_type, 'look ' || a.e AS description, r.session_id AS answered_in, CASE WHEN r.e IS NOT NULL THEN 'c' || r.e END AS child FROM b a LEFT JOIN b r ON r.e = a.e + 1 WHERE a.k = 11""")
def line_agents(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    links = events.agent_links(rows).select("tool_use_id", F.col("parent").alias("answered_in"), "child")
    return events.agents(events.tool_uses(rows)).join(links, "tool_use_id", "left").select("agent_ref", "session_id", "agent_type", "description", "answered_in", "child")


@query("line_turns", f"WITH {_BASE} SELECT 'p' || e AS prompt_id, session_id, ts AS started_at FROM b WHERE k = 0")
def line_turns(spark, sf_dir):
    return events.turns(_rows(spark, sf_dir)).select("prompt_id", "session_id", "started_at")


@query("line_sessions", f"""
WITH {_BASE}
SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, arg_min('b' || u % 3, e) FILTER (WHERE k = 0) AS branch, arg_min('seed ' || q, e) FILTER (WHERE k = 15 AND q % 2 = 1) AS seed_prompt, arg_max('Title ' || q, e) FILTER (WHERE k = 15 AND q % 2 = 0) AS title,
  arg_max('/w/r' || u % 7 || '/src', e) FILTER (WHERE k <> 8) AS cwd, count(*) FILTER (WHERE k IN (1, 3, 11, 13)) AS turn_count, count(*) FILTER (WHERE k = 3 AND q % 6 = 1) AS commit_count, count(*) FILTER (WHERE k = 3 AND q % 6 = 2) AS push_count FROM b GROUP BY session_id""")
def line_sessions(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return turns.session_merge(events.session_lines(rows, events.shell(events.tool_uses(rows)))).drop("version", "start_type")


@query("line_spans", f"""
WITH {_BASE}
SELECT e AS "offset", 'prompt' AS field, 'ask ' || e AS text FROM b WHERE k = 0 UNION ALL SELECT e, 'assistant_response', 'said ' || e FROM b WHERE k = 1 UNION ALL SELECT e, 'tool_input', {_FILE} FROM b WHERE k = 1 UNION ALL SELECT e, 'tool_input', {_COMMAND} FROM b WHERE k = 3
UNION ALL SELECT e, 'tool_input', 'look ' || e || chr(10) || 'k' || q % 3 FROM b WHERE k = 11 UNION ALL SELECT e, 'tool_input', 'Chart ' || e || chr(10) || 'c' || e FROM b WHERE k = 13
UNION ALL SELECT e, 'tool_result', CASE WHEN q % 3 = 0 THEN 'fail ' || e ELSE 'Error: x' || e END FROM b WHERE k = 2 UNION ALL SELECT e, 'tool_result', CASE k WHEN 4 THEN 'done' ELSE 'started' END FROM b WHERE k IN (4, 12)""")
def line_spans(spark, sf_dir):
    return events.spans(_rows(spark, sf_dir)).select("offset", "field", "text")


@query("line_edges", f"""
WITH {_BASE}, x AS (
SELECT 'session:' || session_id AS source_ref, 'touched' AS relation, 'file:' || CASE WHEN q % 4 = 0 THEN 'o/r' || u % 7 || '/src/f' || e % 50 || '.ts' ELSE {_FILE} END AS target_ref FROM b WHERE k = 1 AND q % 5 < 4 AND q % 4 <> 1
UNION SELECT 'session:' || session_id, 'linked', 'pr:o/r' || u % 5 || '#' || q % 11 FROM b WHERE k = 6 AND q % 11 > 0
UNION SELECT 'session:' || session_id, 'worked', 'branch:b' || u % 3 FROM b WHERE k = 0
UNION SELECT 'session:' || session_id, 'worked', 'branch:o/r' || u % 7 || '/' || CASE q % 6 WHEN 0 THEN 'feat/' || u WHEN 2 THEN 'fix-' || u WHEN 3 THEN 'old' || u ELSE 'h' || u END FROM b WHERE k = 3 AND q % 6 IN (0, 2, 3, 4)
UNION SELECT 'session:' || session_id, 'spawned', 'agent:u' || e FROM b WHERE k = 11
UNION SELECT 'session:' || session_id, 'edited_by_human', 'file:o/r' || u % 7 || '/lib/h' || e % 30 || '.py' FROM b WHERE k = 7 AND q % 3 > 0 AND q % 2 = 1
UNION SELECT 'session:' || session_id, 'ran', 'task:AB-' || u FROM b WHERE k = 3 AND q % 6 = 5
UNION SELECT 'session:' || session_id, 'produced', 'artifact:http://f/' || q % 9 FROM b WHERE k = 5 UNION SELECT 'session:' || session_id, 'produced', 'artifact:u' || e FROM b WHERE k = 13
UNION SELECT 'agent:u' || (e - 1), 'transcribed_in', 'session:c' || e FROM b WHERE k = 12)
SELECT * FROM x""")
def line_edges(spark, sf_dir):
    rows, roots = _rows(spark, sf_dir), _roots(spark, sf_dir)
    uses = events.tool_uses(rows)
    commands = events.shell(uses, ("aw",), roots)
    made = events.frames(rows).unionByName(events.artifacts(uses))
    e = events.edges(rows, events.file_touches(uses, roots), events.pr_links(rows), events.branch_rows(rows, commands), events.agents(uses), events.human_edits(rows, roots), commands, made, events.agent_links(rows))
    return turns.dedupe_edges(e, ["t_valid", "path", "offset"]).select("source_ref", "relation", "target_ref")


@query("line_signals", f"""
WITH {_BASE}
SELECT session_id, count(*) FILTER (WHERE k = 0) AS prompts, count(*) FILTER (WHERE k = 2 AND q % 2 = 0) AS errors, count(*) FILTER (WHERE k IN (1, 3, 11, 13)) AS turns, CAST(coalesce(sum(n) FILTER (WHERE k = 1), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(e % 500) FILTER (WHERE k = 1), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(q % 40) FILTER (WHERE k = 1), 0) AS BIGINT) AS thinking_chars, count(*) FILTER (WHERE k = 1) AS text_blocks, count(*) FILTER (WHERE k = 11) AS subagents, count(*) FILTER (WHERE k IN (5, 13)) AS artifacts, count(*) FILTER (WHERE k = 14 AND q % 3 = 0) AS compactions,
  count(*) FILTER (WHERE k = 7 AND q % 3 = 0) AS max_turn_hits, count(*) FILTER (WHERE k = 1 AND q % 5 < 4 AND q % 4 <> 1) AS file_touches, count(*) FILTER (WHERE k = 7 AND q % 3 > 0 AND q % 2 = 1) AS human_edits, count(*) FILTER (WHERE k = 3 AND q % 6 = 1) AS commits, count(*) FILTER (WHERE k = 3 AND q % 6 = 2) AS pushes FROM b WHERE k <> 8 GROUP BY session_id""")
def line_signals(spark, sf_dir):
    s = signals.session_counters(_rows(spark, sf_dir), _roots(spark, sf_dir))
    return s.select("session_id", "prompts", "errors", "turns", "input_tokens", "output_tokens", "thinking_chars", "text_blocks", "subagents", "artifacts", "compactions", "max_turn_hits", "file_touches", "human_edits", "commits", "pushes")


@query("branch_activity", """
WITH RECURSIVE c AS (SELECT event_id AS e, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t, 'b' || CAST(floor(value) AS BIGINT) % 3 AS name FROM events WHERE event_type IN ('signup', 'error', 'click')),
w AS (SELECT u, i, e, t, CASE WHEN t = 'signup' THEN name END AS cur FROM c WHERE i = 1 UNION ALL
  SELECT c.u, c.i, c.e, c.t, CASE WHEN c.t = 'signup' THEN c.name WHEN c.t = 'error' AND c.name = w.cur THEN NULL ELSE w.cur END FROM w JOIN c ON c.u = w.u AND c.i = w.i + 1)
SELECT cur AS branch, count(CASE WHEN t = 'click' THEN 1 END) AS commits, count(DISTINCT u) AS sessions FROM w WHERE cur IS NOT NULL GROUP BY cur""")
def branch_activity(spark, sf_dir):
    name = F.concat(F.lit("b"), (F.floor("value").cast("long") % 3).cast("string"))
    kind = F.col("event_type")
    command = F.when(kind == "signup", F.concat(F.lit("git switch "), name)).when(kind == "error", F.concat(F.lit("git branch -d "), name)).when(kind == "click", F.lit("git commit -m x"))
    c = joins.dealt(_t(spark, sf_dir, "events"), "event_id").filter(command.isNotNull()).select(F.col("user_id").alias("session_id"), F.lit("").alias("path"), F.col("event_id").alias("offset"), F.lit(0).alias("use_no"), X.git_intent(command).alias("intent"))
    s = signals.branch_stats(c)
    return s.select("branch", "commits", F.size("sessions").cast("long").alias("sessions"))
