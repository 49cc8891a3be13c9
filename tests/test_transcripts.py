import json

from pyspark.sql import functions as F

from traceloom.functions import exprs as X
from traceloom.operators import events, joins, quality, search, templates, turns
from traceloom.sources import transcripts

USE = {"input_tokens": 10, "output_tokens": 100, "cache_read_input_tokens": 5, "cache_creation_input_tokens": 1}


def line(kind, t, **more):
    return {"type": kind, "sessionId": "s1", "timestamp": f"2026-05-01T00:00:{t:02d}Z", "cwd": "/w/app", "gitBranch": "main", **more}


LINES = [
    line("user", 4, uuid="p1", message={"role": "user", "content": "please fix AB-12"}),
    line("assistant", 6, message={"role": "assistant", "model": "m-1", "usage": USE, "content": [{"type": "thinking", "thinking": "x" * 30}, {"type": "text", "text": "y" * 10}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "cd /w/other && git checkout -b feat/x main"}}]}),
    line("user", 9, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "TypeError: no 1234567"}]}),
    line("assistant", 10, message={"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "Edit", "input": {"file_path": "/w/app/src/a.ts"}}]}),
    line("assistant", 18, message={"role": "assistant", "content": [{"type": "text", "text": "done"}]}),
    line("user", 19, uuid="p2", message={"role": "user", "content": "thanks é"}),
    {"type": "pr-link", "sessionId": "s1", "timestamp": "2026-05-01T00:00:20Z", "prNumber": 7, "prRepository": "o/r", "prUrl": "u"},
    {"type": "permission-mode", "sessionId": "s1", "permissionMode": "plan"},
]


def write(tmp_path, lines=LINES, tail=""):
    folder = tmp_path / "root" / "proj"
    folder.mkdir(parents=True)
    text = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines) + tail
    (folder / "s1.jsonl").write_text(text, encoding="utf-8")
    return str(tmp_path / "root"), text.encode()


def test_lines_have_byte_offsets_and_no_torn_tail(spark, tmp_path):
    root, raw = write(tmp_path, tail='{"torn"')
    got = transcripts.lines(spark, root).orderBy("offset").collect()
    assert len(got) == len(LINES)
    assert all(raw[r["offset"] : r["offset"] + r["length"]].decode() == r["text"] for r in got)
    assert transcripts.discover(spark, root).count() == 1


def test_facts_turns_and_tables(spark, tmp_path):
    root, _ = write(tmp_path)
    rows = events.base(transcripts.parsed(transcripts.lines(spark, root)).filter("not bad"))
    facts = turns.transcript_sequence(events.facts(rows))
    kinds = [r["event_type"] for r in facts.orderBy("offset").collect()]
    assert kinds == ["user_prompt", "tool_decision", "tool_result_error", "tool_decision", "assistant_response", "user_prompt", "pr_link", "permission_mode"]
    t = {r["prompt_id"]: r for r in turns.turn_rollup(facts).collect()}
    assert (t["p1"]["duration_ms"], t["p1"]["tool_call_count"], t["p1"]["thinking_ms"], t["p1"]["turn_index"]) == (14000, 2, 3000, 0)
    assert t["p2"]["turn_index"] == 1
    u = events.usage(rows).collect()
    assert len(u) == 1 and u[0]["output_tokens"] == 100 and 0 < u[0]["thinking_tokens"] < 100
    uses = events.tool_uses(rows)
    shell = events.shell(uses).collect()[0]
    assert shell["intent"]["set_branch"] == "feat/x" and shell["intent"]["branch_base"] == "main" and shell["folder"] == "/w/other"
    assert [r["file"] for r in events.file_touches(uses).collect()] == ["/w/app/src/a.ts"]
    blob = joins.tool_names(events.blobs(rows), uses).collect()
    assert blob[0]["tool_name"] == "Bash" and blob[0]["raw_text"].startswith("TypeError")
    assert events.pr_links(rows).collect()[0]["pr_ref"] == "pr:o/r#7"
    assert events.phases(rows).collect()[0]["mode"] == "plan"
    s = turns.session_merge(events.session_lines(rows)).collect()[0]
    assert s["branch"] == "main" and s["started_at"] == "2026-05-01T00:00:04Z" and s["turn_count"] == 3
    spans = events.spans(rows)
    hit = search.match(search.index_spans(spans), ["FIX", "ab"]).collect()
    assert len(hit) == 1


def test_masks_and_signature(spark):
    rows = spark.createDataFrame([("error TS2307: at src/a/b.ts:12:3 took 3.5 s id 1234567 [2-5]",)], "x string")
    assert rows.select(X.mask(F.col("x"))).first()[0] == "error TS<NUM>: at <PATH><LINENO> took <DURATION> id <SHA> [<NUM>-<NUM>]"
    blob = spark.createDataFrame([("Bash", "ok\n\nTypeError: boom\nmore", False)], "tool_type string, raw_text string, is_error boolean")
    s = templates.signatures(blob).first()
    assert s["sig"]["error_class"] == "TypeError" and s["sig"]["bucket"] == "2-5" and s["eligible"]


def test_drain_joins_similar_lines_and_keeps_others(spark):
    lines = [("Bash", "open file a now please", 0), ("Bash", "open file b now please", 1), ("Bash", "open file a now please", 2), ("Bash", "close the door at once", 3)]
    t = templates.templates(templates.drain(spark.createDataFrame(lines, "tool_type string, masked string, arrival long"))).collect()
    assert sorted((r["template"], r["occurrence_count"]) for r in t) == [("close the door at once", 1), ("open file <*> now please", 3)]


def test_git_expressions(spark):
    cases = [("git push -u origin fix-1", "fix-1", None), ("git worktree add ../w -b wt", "wt", None), ("gh pr create --head h --base dev --title \"a \\\"b\\\"\"", "h", "dev"), ("git checkout -- file", None, None), ("ls", None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "c string").select("c", X.git_intent(F.col("c")).alias("i"), X.pr_title(F.col("c")).alias("t")).collect()
    for r, (_, name, base) in zip(rows, cases):
        assert (r["i"]["set_branch"] if r["i"] else None, r["i"]["branch_base"] if r["i"] else None) == (name, base)
    assert rows[2]["t"] == 'a "b"'


def test_order_of_rows_changes_no_digest(spark):
    a = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    assert quality.digest_differences({"t": a}, {"t": a.orderBy(F.desc("k"))}, {"t": ["id", "k"]}) == []
    assert quality.digest_differences({"t": a}, {"t": a.limit(99)}, {"t": ["id", "k"]}) == ["t"]


def test_event_rules_by_hand(spark):
    big = {"type": "assistant", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"model": "m", "usage": {"output_tokens": 100}, "content": [{"type": "thinking", "thinking": "x" * 10}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "y" * 6, "opts": {"a": "zzzz", "n": 3, "e": ""}}}, {"type": "tool_use", "id": "t2", "name": "Bash", "input": {}}]}}
    made = [big, {"type": "system", "sessionId": "s"}, {"type": "system", "sessionId": "s", "subtype": "init"}, {"type": "foo-bar", "sessionId": "s"}, {"type": "ai-title", "sessionId": "s", "aiTitle": "T"}, {"type": "permission-mode", "sessionId": "s", "permissionMode": "plan"}, {"type": "frame-link", "sessionId": "s", "frameUrl": "u", "path": "p"}, {"type": "file-history-snapshot", "sessionId": "s", "snapshot": {"trackedFileBackups": {"a.py": {"backupFileName": "b1", "backupTime": "t"}, "node_modules/x.js": {"backupFileName": "b2", "backupTime": "t"}}}}]
    rows = spark.createDataFrame([("f.jsonl", i, 1, json.dumps(x)) for i, x in enumerate(made)], "path string, offset long, length int, text string")
    base = events.base(transcripts.parsed(rows).filter("not bad"))
    kinds = [r["event_type"] for r in events.facts(base).orderBy("offset").collect()]
    assert kinds == ["tool_decision", "system_event", "system_init", "foo-bar", "ai_title", "permission_mode", "frame_link", "file_history_snapshot"]
    assert [r["thinking_tokens"] for r in events.usage(base).collect()] == [50]
    assert [r["text"] for r in events.spans(base).filter("field = 'tool_input'").collect()] == ["y" * 6 + "\n" + "zzzz"]
    assert [r["file"] for r in events.checkpoints(base).collect()] == ["a.py"]
    assert [(r["url"], r["file"]) for r in events.frames(base).collect()] == [("u", "p")]


def test_elapsed_text(spark):
    for seconds, want in ((59 * 60, "just now"), (3600, "1 hour ago"), (23 * 3600, "23 hours ago"), (13 * 86400, "13 days ago"), (14 * 86400, "14 days ago — likely needs context refresher")):
        at = spark.range(1).select(X.elapsed_text(F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(seconds))).alias("t"))
        assert at.first()["t"] == want
