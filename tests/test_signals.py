"""Counters of sessions, files, branches and tasks on lines written by hand."""

import json

import pytest

from traceloom.operators import events, signals
from traceloom.sources import transcripts


def line(kind, n, session="s", **more):
    return {"type": kind, "sessionId": session, "timestamp": f"2026-01-01T00:00:{n:02d}Z", "cwd": "/w/app", "version": f"1.{n}", **more}


def says(n, content, usage=None, model="m1", session="s"):
    return line("assistant", n, session, message={"model": model, "usage": usage or {}, "content": content})


def use(id, name, **value):
    return {"type": "tool_use", "id": id, "name": name, "input": value}


def bash(id, command):
    return use(id, "Bash", command=command)


LINES = [
    line("user", 0, uuid="p", message={"content": "hi"}),
    says(1, [{"type": "thinking", "thinking": "ab🎉"}, {"type": "text", "text": "x"}, use("1", "Read", file_path="/w/app/a.py"), use("2", "Write", file_path="/w/app/b.py", content="12345")], {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 1, "cache_creation_input_tokens": 2, "service_tier": "standard", "server_tool_use": {"web_search_requests": 2, "other": 1}}),
    line("user", 2, message={"content": [{"type": "tool_result", "tool_use_id": "1", "content": "no", "is_error": True}, {"type": "tool_result", "tool_use_id": "2", "content": "ok"}]}),
    says(3, [use("3", "Edit", file_path="/w/app/a.py", old_string="long one", new_string="é"), use("4", "MultiEdit", file_path="/w/app/a.py", edits=[{"old_string": "", "new_string": "abc"}, {"old_string": "ab", "new_string": "a"}])], {"input_tokens": 1, "output_tokens": 1, "service_tier": "standard"}, "m2"),
    says(4, [bash("5", "git checkout -b feat/1 main"), bash("6", "git commit -m x"), use("7", "AskUserQuestion"), use("8", "Agent", description="d"), use("9", "Artifact", description="t")]),
    says(5, [bash("10", "git push origin feat/1"), bash("11", "git branch -D feat/1"), bash("12", "git commit -m y"), bash("13", "aw task done AB-12 app")]),
    line("frame-link", 6, frameUrl="u"),
    line("system", 7, subtype="compact_boundary"),
    line("system", 8, subtype="turn_duration", durationMs=1500),
    line("attachment", 9, attachment={"type": "max_turns_reached"}),
    line("attachment", 10, attachment={"type": "edited_text_file", "filename": "/w/app/c.py"}),
    line("attachment", 11, attachment={"type": "edited_text_file", "filename": "/w/other/c.py"}),
    line("pr-link", 12, prRepository="o/app", prNumber=3, prUrl="u"),
    line("pr-link", 13, prRepository="o/other", prNumber=4, prUrl="u"),
    line("ai-title", 14, aiTitle="First"),
    line("ai-title", 15, aiTitle="Second"),
    line("last-prompt", 16, lastPrompt="seed"),
    line("bridge-session", 17, bridgeSessionId="b1"),
    line("user", 18, "t", message={"content": "other session"}),
    says(19, [bash("20", "git checkout dev"), bash("21", "git branch -d elsewhere"), bash("22", "git commit -m z && git push")], session="t"),
]
ROOTS = [("/w/app", "o/app"), ("/w/other", "o/other")]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.createDataFrame([("x/s.jsonl", i * 10, 1, json.dumps(x)) for i, x in enumerate(LINES)], "path string, offset long, length int, text string")
    return events.base(transcripts.parsed(made).filter("not bad")).persist()


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame(ROOTS, "root string, name string")


def test_counters_of_sessions(spark, rows, roots):
    got = {r["session_id"]: r.asDict(recursive=True) for r in signals.session_counters(rows, roots, "o/app", ("aw",)).collect()}
    assert set(got) == {"s", "t"}
    want = dict(prompts=1, errors=1, turns=4, input_tokens=6, output_tokens=8, cache_read_tokens=1, cache_creation_tokens=2, server_tool_uses=3, thinking_blocks=1, thinking_chars=4, text_blocks=1, subagents=1, decisions=1, artifacts=2, compactions=1, max_turn_hits=1, file_touches=4, human_edits=1, commits=2, pushes=1, tasks=["AB-12"], prs=[3], title="Second", seed_prompt="seed", bridge_session_id="b1", service_tiers={"standard": 2}, first_ts="2026-01-01T00:00:00Z", last_ts="2026-01-01T00:00:05Z")
    assert {k: got["s"][k] for k in want} == want
    assert got["s"]["tools"] == {"Read": 1, "Write": 1, "Edit": 1, "MultiEdit": 1, "Bash": 6, "AskUserQuestion": 1, "Agent": 1, "Artifact": 1}
    assert got["s"]["tokens_by_model"]["m1"] == {"input": 5, "output": 7, "cache_read": 1, "cache_creation": 2} and got["s"]["tokens_by_model"]["m2"]["output"] == 1
    assert (got["t"]["commits"], got["t"]["pushes"], got["t"]["file_touches"], got["t"]["prs"]) == (1, 1, 0, None)
    assert [r["duration_ms"] for r in signals.turn_durations(rows).collect()] == [1500]


def test_changes_of_files(rows, roots):
    got = [tuple(r) for r in signals.file_changes(events.tool_uses(rows), roots).orderBy("offset", "use_no").select("kind", "repo", "file", "added", "removed").collect()]
    assert got == [("read", "o/app", "a.py", 0, 0), ("write", "o/app", "b.py", 5, 0), ("edit", "o/app", "a.py", 0, 7), ("edit", "o/app", "a.py", 3, 1)]


@pytest.mark.parametrize("limits", [{}, {"one_task_bytes": 0, "segment_rows": 2}])
def test_a_deleted_branch_is_no_longer_in_effect(rows, limits):
    commands = events.shell(events.tool_uses(rows), ("aw",))
    got = [tuple(r) for r in signals.branch_in_effect(commands, **limits).orderBy("offset", "use_no").select("session_id", "branch").collect()]
    assert got == [("s", "feat/1"), ("s", "feat/1"), ("s", "feat/1"), ("s", None), ("s", None), ("s", None), ("t", "dev"), ("t", "dev"), ("t", "dev")]
    stats = {r["branch"]: (r["commits"], r["pushes"], r["sessions"]) for r in signals.branch_stats(commands, **limits).collect()}
    assert stats == {"feat/1": (1, 1, ["s"]), "dev": (1, 1, ["t"])}
    assert [(r["task_id"], r["sessions"], r["actions"]) for r in signals.task_actions(commands, ("aw",)).collect()] == [("AB-12", ["s"], {"done": 1})]
