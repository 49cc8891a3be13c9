"""Rules of lines, one fixture line each, with rows written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from traceloom.functions import exprs as X
from traceloom.operators import events, joins, turns
from traceloom.sources import transcripts

T = "2026-01-01T00:00:{:02d}Z"


def line(kind, n, **more):
    return {"type": kind, "sessionId": "s", "timestamp": T.format(n), "cwd": "/w/app/src", **more}


def tool(n, *uses):
    return line("assistant", n, message={"model": "m", "content": [{"type": "tool_use", "id": i, "name": name, "input": value} for i, name, value in uses]})


def result(n, id, content, is_error=False, **more):
    return line("user", n, message={"content": [{"type": "tool_result", "tool_use_id": id, "content": content, "is_error": is_error}]}, **more)


LINES = [
    line("user", 0, uuid="p1", gitBranch="main", message={"content": "hello"}),
    tool(1, ("t1", "Read", {"file_path": "/w/app/build/../src/a.ts"}), ("t2", "Edit", {"file_path": "/w/build/app/b.ts"}), ("t3", "Write", {"file_path": "rel/c.ts"}), ("t4", "Read", {"file_path": "/w/app/node_modules/x.js"}), ("t5", "Read", {"file_path": "/elsewhere/d.ts"})),
    result(2, "t1", "File read", toolUseResult={"file": "a.ts"}),
    result(3, "t2", [{"type": "text", "text": "Error: no"}, {"type": "text", "text": ""}, {"type": "image"}, {"type": "text", "text": "at all"}], True),
    tool(4, ("t1", "Bash", {"command": "cd /w/lib && git checkout -b feat/x main"})),
    result(5, "t1", "rendered", toolUseResult={"stdout": "out\n", "stderr": " "}),
    result(6, "t1", "again", True),
    tool(7, ("a1", "Agent", {"subagent_type": "tester", "description": "look"}), ("f1", "Artifact", {"description": "Chart", "file_path": "/w/app/c.html"})),
    result(8, "a1", "started", toolUseResult={"agentId": "child1"}),
    line("frame-link", 9, frameUrl="http://f/1", title="Frame", path="x.html"),
    line("pr-link", 10, prRepository="o/r", prNumber=7, prUrl="http://p/7", title="The change"),
    line("attachment", 11, attachment={"type": "edited_text_file", "filename": "/w/app/src/e.ts"}),
    line("attachment", 12, attachment={"type": "edited_text_file", "filename": "/w/app/dist/e.js"}),
    {"type": "file-history-snapshot", "snapshot": {"timestamp": T.format(13), "trackedFileBackups": {"/w/app/src/a.ts": {"backupFileName": "b1", "version": 2, "backupTime": "t"}, "/w/app/dist/o.js": {"backupFileName": "b2", "backupTime": "t"}}}},
    tool(14, ("t6", "Bash", {"command": "gh pr create --title \"A title\""}), ("t7", "Bash", {"command": "git branch -D old"})),
    result(15, "t6", "http", toolUseResult={"gitOperation": {"pr": {"action": "created", "number": 9, "url": "https://github.com/o/r/pull/9"}}}),
]
ROOTS = [("/w/app", "o/app"), ("/w/build/app", "o/built"), ("/w/lib", "o/lib"), ("/w", "o/outer")]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.createDataFrame([("x/s.jsonl", i, 1, json.dumps(x)) for i, x in enumerate(LINES)], "path string, offset long, length int, text string")
    return events.base(transcripts.parsed(made).filter("not bad")).persist()


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame(ROOTS, "root string, name string")


def listed(df, *columns):
    return [tuple(r) for r in df.orderBy("offset").select(*columns).collect()]


def test_touches_are_relative_to_their_repository(rows, roots):
    uses = events.tool_uses(rows)
    got = sorted(listed(events.file_touches(uses, roots), "name", "repo", "file"), key=str)
    assert got == sorted([("Read", "o/app", "src/a.ts"), ("Edit", "o/built", "b.ts"), ("Write", None, "rel/c.ts"), ("Read", None, "/elsewhere/d.ts")], key=str)
    assert sorted(r["file"] for r in events.file_touches(uses).collect()) == ["/elsewhere/d.ts", "rel/c.ts"]  # /w/build/ is ignored where no root is known


def test_blobs_are_errors_and_printed_output(rows):
    assert listed(events.blobs(rows), "offset", "is_error", "raw_text") == [(3, True, "Error: no\nat all"), (5, False, "out\n"), (6, True, "again")]


def test_a_used_up_id_is_generic_until_it_is_used_again(rows):
    named = joins.tool_names(events.blobs(rows), events.tool_uses(rows))
    assert listed(named, "offset", "tool_name") == [(3, "Edit"), (5, "Bash"), (6, "generic")]


def test_commands_know_the_repository_of_their_folder(rows, roots):
    got = listed(events.shell(events.tool_uses(rows), (), roots), "folder", "repo", "intent.set_branch", "intent.deleted_branch", "pr_title")
    assert got == [("/w/lib", "o/lib", "feat/x", None, None), ("/w/app/src", "o/app", None, None, "A title"), ("/w/app/src", "o/app", None, "old", None)]
    commands = events.shell(events.tool_uses(rows), (), roots)
    seen = {tuple(r) for r in events.branch_rows(rows, commands).select("branch_ref", "base", "deleted_at").collect()}
    assert seen == {("branch:main", None, None), ("branch:o/lib/feat/x", "main", None), ("branch:o/app/old", None, T.format(14))}


def test_halves_of_a_pull_request_meet(rows, roots):
    halves = events.pr_halves(events.shell(events.tool_uses(rows)), rows)
    assert [tuple(r) for r in joins.merge_halves(halves, "tool_use_id", ["title", "repo", "number"]).collect()] == [("t6", "A title", "o/r", 9)]


def test_assets_and_edits(rows, roots):
    assert listed(events.pr_links(rows), "pr_ref", "url", "title") == [("pr:o/r#7", "http://p/7", "The change")]
    assert listed(events.frames(rows), "artifact_ref", "kind", "title", "file") == [("artifact:http://f/1", "frame", "Frame", "x.html")]
    assert listed(events.artifacts(events.tool_uses(rows)), "artifact_ref", "kind", "title", "file") == [("artifact:f1", "artifact", "Chart", "/w/app/c.html")]
    assert listed(events.human_edits(rows, roots), "repo", "file") == [("o/app", "src/e.ts")]
    assert listed(events.checkpoints(rows, roots), "session_id", "file", "backupFileName", "version") == [("s", "src/a.ts", "b1", 2)]
    assert listed(events.agents(events.tool_uses(rows)), "agent_ref", "agent_type", "description") == [("agent:a1", "tester", "look")]
    assert listed(events.agent_links(rows), "tool_use_id", "parent", "child") == [("a1", "s", "child1")]
    assert listed(events.turns(rows), "prompt_id", "session_id") == [("p1", "s")]


def test_edges_of_all_relations(rows, roots):
    uses = events.tool_uses(rows)
    commands = events.shell(uses, (), roots)
    made = events.frames(rows).unionByName(events.artifacts(uses))
    e = events.edges(rows, events.file_touches(uses, roots), events.pr_links(rows), events.branch_rows(rows, commands), events.agents(uses), events.human_edits(rows, roots), commands, made, events.agent_links(rows))
    got = {(r["source_ref"], r["relation"], r["target_ref"]) for r in turns.dedupe_edges(e, ["t_valid", "path", "offset"]).collect()}
    s = "session:s"
    assert got == {
        (s, "touched", "file:o/app/src/a.ts"), (s, "touched", "file:o/built/b.ts"), (s, "touched", "file:rel/c.ts"), (s, "touched", "file:/elsewhere/d.ts"), (s, "linked", "pr:o/r#7"), (s, "worked", "branch:main"), (s, "worked", "branch:o/lib/feat/x"), (s, "worked", "branch:o/app/old"),
        (s, "spawned", "agent:a1"), (s, "edited_by_human", "file:o/app/src/e.ts"), (s, "produced", "artifact:http://f/1"), (s, "produced", "artifact:f1"), ("agent:a1", "transcribed_in", "session:child1"),
    }


def leaves(x, depth=0, out=None):
    out = [] if out is None else out
    if depth > 6 or len(out) > 64:
        return out
    if isinstance(x, str):
        out += [x] if x else []
    elif isinstance(x, (list, dict)):
        for y in x.values() if isinstance(x, dict) else x:
            leaves(y, depth + 1, out)
    return out


def test_string_leaves_of_json(spark):
    deep = "deep"
    for i in range(9):
        deep = {"k": deep, "a": f"at {i}"} if i % 2 else [deep, f"in {i}"]
    cases = ["plain", "", {"a": "x", "b": ["y", {"c": "z"}], "d": 3, "e": None, "f": True}, {"quo\"te:": "a\\\"b\": [c] {d}", "e": "\\", "n": "line\nline\té  🎉"}, ["", "]", "{", ":", "\":"], deep, [f"v{i}" for i in range(99)], {}, [], 7, None]
    df = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=i % 2 == 0, separators=(",", ":"))) for i, x in enumerate(cases)], "i int, j string")
    got = {r["i"]: r["x"] for r in df.select("i", X.string_leaves(F.col("j")).alias("x")).collect()}
    assert got == {i: leaves(x) for i, x in enumerate(cases)}


def test_lengths_and_cuts_in_utf16_units(spark):
    texts = ["", "abc", "é🎉x", "🎉" * 5, "a" * 9 + "🎉b", "a" * 8 + "🎉b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.utf16_length(F.col("t")).alias("n"), X.utf16_left(F.col("t"), 10).alias("cut"))
    for r in df.collect():
        if r["t"] is not None:
            units = r["t"].encode("utf-16-le")
            assert r["n"] == len(units) // 2
            assert r["cut"] == units[:20].decode("utf-16-le", "ignore")
        else:
            assert r["cut"] is None


def test_thinking_counts_utf16_units(spark):
    made = line("assistant", 1, message={"model": "m", "usage": {"output_tokens": 90}, "content": [{"type": "thinking", "thinking": "🎉" * 10}, {"type": "text", "text": "x" * 4}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "y" * 6}}]})
    df = spark.createDataFrame([("f.jsonl", 0, 1, json.dumps(made))], "path string, offset long, length int, text string")
    base = events.base(transcripts.parsed(df))
    assert events.usage(base).first()["thinking_tokens"] == 60  # 20 of 30 units
    spans = {r["field"]: r["text"] for r in events.spans(base).collect()}
    assert spans == {"assistant_response": "xxxx", "tool_input": "yyyyyy"}
