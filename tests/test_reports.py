"""Liveness, builds, sections, recent sessions, words in texts and pairs of blocks."""

import random
import re

import pytest

from traceloom.operators import cost, joins, ledger, quality
from traceloom.streaming import incremental


def test_liveness_tells_findings_from_what_is_expected(spark):
    edges = spark.createDataFrame([("session:s", "touched", "file:a", None, None), ("session:gone", "odd", "zone:9", None, None)], "source_ref string, relation string, target_ref string, t_invalid string, t_expired string")
    tables = {"edges": edges, "sessions": spark.createDataFrame([("s", None)], "session_id string, title string"), "files": spark.createDataFrame([("a",)], "path string"), "empty": spark.createDataFrame([], "x string")}
    got = {(r["finding"], r["subject"]): r["n"] for r in quality.liveness_report(tables, ["touched", "linked"], {"session": ("sessions", "session_id"), "file": ("files", "path")}).collect()}
    assert got == {("empty_column", "sessions.title"): 1, ("expected_empty", "edges.t_invalid"): 2, ("expected_empty", "edges.t_expired"): 2, ("dead_relation", "linked"): 0, ("undeclared_relation", "odd"): 1, ("dangling_ref", "session"): 1, ("unmapped_namespace", "zone"): 1}


def test_builds_agree_or_not(spark):
    a = spark.range(50).selectExpr("id", "id % 7 AS k")
    builds = {"full": {"t": a, "u": a}, "incremental": {"t": a.orderBy("k"), "u": a.limit(49)}, "rotated": {"t": a.repartition(3), "u": a}}
    got = {r["table_name"]: (r["builds"], r["digests"], r["equal"]) for r in quality.builds_agree(builds, {"t": ["id", "k"], "u": ["id", "k"]}).collect()}
    assert got == {"t": (3, 1, True), "u": (3, 2, False)}


def test_sections_have_their_own_order(spark):
    rows = [("b", "focused", 2, None, "3"), ("a", "focused", None, None, "9"), ("c", "focused", 1, None, "1"), ("d", "backburner", 9, None, "2"), ("e", "backburner", 1, None, "1"), ("f", "paused", None, "2026-02", "1"), ("g", "paused", None, None, "1"), ("h", "paused", None, "2026-01", "1"), ("i", "done", None, None, "2026-01"), ("j", "done", None, None, "2026-03"), ("k", "dropped", 1, None, None)]
    got = [tuple(r) for r in ledger.sections(spark.createDataFrame(rows, "slug string, state string, rank int, paused_since string, updated string")).orderBy("section", "place").select("heading", "slug").collect()]
    assert got == [("Focused", x) for x in "cba"] + [("Backburner", x) for x in "de"] + [("Paused", x) for x in "ghf"] + [("Done", x) for x in "ji"]


def test_recent_sessions(spark):
    listed = spark.createDataFrame([(f"p{i}", f"d/p{i}", f"2026-01-0{i}", i, None) for i in range(1, 6)] + [("sub", "d/sub", "2026-02-01", 1, "x")], "path string, display_path string, mtime string, length int, subagent_id string")
    lines = spark.createDataFrame([("p5", 9, "late", "user_prompt", "s5"), ("p5", 1, "first", "user_prompt", "s5"), ("p4", 1, "answer", "tool_result", "s4"), ("p1", 1, "old", "user_prompt", "s1")], "path string, offset int, content_text string, event_type string, session_id string")
    got = [tuple(r) for r in ledger.recent_sessions(listed, lines, 2).orderBy("display_path").select("display_path", "session_id", "first_prompt").collect()]
    assert got == [("d/p4", None, None), ("d/p5", "s5", "first")]


@pytest.mark.parametrize("word_bytes", [None, 40])
@pytest.mark.parametrize("whole", [False, True])
def test_words_in_texts(spark, whole, word_bytes):
    r = random.Random(9)
    words = ["ab", "ABC", "b-c", "abc1", "é", "x" * 30, "", None, "aba", "A"]
    texts = ["", None, "abab", "AB abc", "1abc", "abc1 b-C", "éab é", "ab.abc1;aba"] + ["".join(r.choice("abc1é -X") for _ in range(r.randint(0, 40))) for _ in range(200)] + ["ab " * 300_000 + "b-c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = sorted((x["i"], x["word"]) for x in joins.occurring(df, "text", spark.createDataFrame([(w,) for w in words], "word string"), whole, word_bytes).collect())
    edge = ("(?<![a-z0-9])", "(?![a-z0-9])") if whole else ("", "")
    want = sorted((i, w) for i, t in enumerate(texts) for w in {(w or "").lower() for w in words} - {""} if re.search(edge[0] + re.escape(w) + edge[1], (t or "").lower()))
    assert got == want


def test_ids_of_any_form_are_references(spark):
    ids = spark.createDataFrame([("AB-12",), ("task_9",), ("x/y#3",)], "id string")
    texts = spark.createDataFrame([("r1", "see ab-12, TASK_9 and X/Y#3!"), ("ab-12", "AB-12 itself and task_9"), ("r2", "AB-123 xtask_9"), (None, "ab-12")], "row_id string, text string")
    got = sorted(((r["row_id"], r["id"]) for r in joins.references(ids, texts).collect()), key=str)
    assert got == sorted([("r1", "AB-12"), ("r1", "TASK_9"), ("r1", "X/Y#3"), ("ab-12", "TASK_9"), (None, "AB-12")], key=str)


def test_pairs_of_blocks_are_all_pairs_once(spark):
    r = random.Random(2)
    rows = [("heavy", f"i{i}") for i in range(60)] + [(f"s{s}", f"i{r.randrange(60)}") for s in range(40) for _ in range(4)] * 2
    df = spark.createDataFrame(rows, "session string, item string")
    key = lambda x: sorted(map(tuple, x.collect()))
    sets = {}
    for s, i in rows:
        sets.setdefault(s, set()).add(i)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert key(cost.co_change(df, "session", "item", block_items=7)) == key(cost.co_change(df, "session", "item")) == sorted((a, b, n) for (a, b), n in want.items())


def test_a_heavy_session_is_dealt_out(spark):
    sets = spark.range(100_000).selectExpr("'heavy' AS session", "id AS item")
    left, right = cost.block_pairs(sets, "session", "item", 1000)
    sizes = left.groupBy("first_", "second_").count().join(right.groupBy("first_", "second_").agg({"*": "count"}), ["first_", "second_"]).collect()
    assert len(sizes) == 100 * 101 // 2 and max(r["count"] for r in sizes) < 1300 and max(r["count(1)"] for r in sizes) < 1300


def test_trigger_policy():
    assert incremental.trigger_policy() == {"processingTime": "60 seconds"} and incremental.trigger_policy(once=True) == {"availableNow": True}
