import datetime as dt

from pyspark.sql import functions as F

from traceloom.operators import cost, ledger, turns

D = dt.datetime
SCHEMA = "slug string, file string, session_id string, started timestamp, ended timestamp, track string, next_steps array<struct<id: string, text: string, kind: string, ref: string>>, resolves array<struct<ref: string, outcome: string, note: string>>, no_loops boolean, body string"


def sessions(spark):
    step = lambda i, kind="task", ref=None: (i, f"do {i}", kind, ref)
    rows = [
        ("a", "f1", "s1", D(2026, 1, 1), D(2026, 1, 1, 1), "canonical", [step("x"), step("y", "pr", "#57"), step("z", "task", "T-1"), step("w")], [], None, "one"),
        ("a", "f2", "s2", D(2026, 1, 2), D(2026, 1, 2, 1), "canonical", [step("v")], [("f1#x", "done", None), ("f9#q", "done", None), ("f2#v", "done", None)], None, "two"),
        ("a", "f3", "s3", D(2026, 1, 3), D(2026, 1, 3, 1), "parallel", [], [("f1#x", "abandoned", "why")], None, "three"),
        ("b", "g1", "s4", D(2026, 1, 3), D(2026, 1, 2), "canonical", [step("x"), step("x")], [("g0#x", "abandoned", None)], None, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_open_and_resolved_ledger(spark):
    s = sessions(spark)
    opened = ledger.loops(s)
    found = ledger.resolves(s, opened)
    assert {(r["ref"], r["problem"]) for r in found.filter("problem is not null").collect()} == {("f9#q", "missing"), ("f2#v", "self"), ("g0#x", "missing")}
    latest = ledger.latest_resolution(found)
    assert latest.collect()[0]["outcome"] == "abandoned"
    tasks = spark.createDataFrame([("a", "T-1", "done")], "slug string, id string, status string")
    merged = spark.createDataFrame([("https://x/pull/57",)], "ref string")
    now = F.lit("2026-02-15").cast("timestamp")
    out = ledger.open_ledger(opened.filter("slug = 'a'"), latest, now, tasks, merged)
    assert [r["ref"] for r in out.collect()] == ["f1#w", "f2#v"]
    assert out.first()["age_days"] == 44 and ledger.stale_loops(out).count() == 2
    assert {r["file"] for r in ledger.narrative(s).collect()} == {"f2", "g1"}
    assert [r["file"] for r in ledger.parallel_sessions(s).collect()] == ["f3"]
    bad = {r["file"]: r["problems"] for r in ledger.session_problems(s).collect()}
    assert bad["g1"] == ["ended before started", "step ids repeat", "abandoned without a note"] and bad["f1"] == []


def test_cost_rounds_and_reports_unpriced(spark):
    use = spark.createDataFrame([("s1", "m-1-20260101", 1000, 10, 0, 0), ("s1", "other", 5, 5, 0, 0)], "session_id string, model string, input long, output long, cache_read long, cache_creation long")
    prices = spark.createDataFrame([("m-1", 3.0, 15.0, 0.3, 3.75)], "model string, input double, output double, cache_read double, cache_creation double")
    rows = cost.priced(use, prices)
    assert cost.per_session(rows).first()["usd"] == 0.00315
    assert [r["model"] for r in cost.unpriced(rows).collect()] == ["other"]


def test_percentile_and_rerank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 10)], "k string, v double")
    p = turns.percentile_nearest(rows, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (p["p50"], p["p99"]) == (3.0, 4.0)
    r = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "id string, rank int")
    assert {(x["id"], x["new_rank"]) for x in turns.dense_rerank(r, "id", "rank").collect()} == {("b", 2), ("c", 3)}
