"""Scans and ranks of keys that are cut into segments, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import scan, templates, turns

FORCED = {"one_task_bytes": 0, "segment_rows": 50}


def table(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([None, r.randint(-5, 50)]), r.choice("xy")) for i in range(n)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "k string, t long, v long, e string").repartition(7)


def scanned(rows, key):
    out, seen = {}, {}
    for k, t, v, e in rows:
        n, total, last, before = seen.get(key(k), (0, None, None, None))
        n += e == "x"
        total = total if v is None else (total or 0) + v
        last = v if v is not None else last
        out[t] = (n, total, last, before)
        seen[key(k)] = (n, total, last, v)
    return out


@pytest.mark.parametrize("limits", [{}, FORCED])
@pytest.mark.parametrize("keys", [["k"], []])
def test_scan_with_a_hot_key(spark, keys, limits):
    rows, df = table(spark)
    got = scan.running(df, keys, ["t"], counts={"n": F.col("e") == "x"}, sums={"total": F.col("v")}, last={"last": F.col("v")}, lags={"before": F.col("v")}, **limits)
    assert got.columns == ["k", "t", "v", "e", "n", "total", "last", "before"]
    assert {r["t"]: (r["n"], r["total"], r["last"], r["before"]) for r in got.collect()} == scanned(rows, (lambda k: k) if keys else (lambda k: 0))


def test_a_hot_key_is_cut_evenly(spark):
    _, df = table(spark)
    sizes = [r["n"] for r in scan.segments(df, ["k"], ["t"], 50).filter("k = 'hot'").groupBy("seg_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 300


def test_equal_orders_stay_together(spark):
    df = spark.range(2000).selectExpr("'h' AS k", "0L AS t", "id AS v")
    assert scan.running(df, ["k"], ["t"], counts={"n": F.lit(True)}, **FORCED).agg(F.max("n")).first()[0] == 2000


def test_scan_of_an_empty_table(spark):
    _, df = table(spark)
    assert scan.running(df.limit(0), ["k"], ["t"], counts={"n": F.lit(True)}, **FORCED).count() == 0


def test_operators_give_the_same_with_segments(spark):
    rows, df = table(spark)
    facts = df.select(F.coalesce("k", F.lit("none")).alias("session_id"), F.format_string("2026-01-01T%02d:%02d:%02dZ", F.floor(F.col("t") / 3600).cast("int"), F.floor(F.col("t") / 60 % 60).cast("int"), (F.col("t") % 60).cast("int")).alias("ts"), F.lit("p").alias("path"), F.col("t").alias("seq"), F.when(F.col("e") == "x", "user_prompt").otherwise("tool_result").alias("event_type"), F.col("t").alias("prompt_id"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(turns.ordered_facts(facts)) == key(turns.ordered_facts(facts, **FORCED))
    prices = df.filter("v is not null").selectExpr("k", "t - t % 10 AS d", "v AS price").groupBy("k", "d").agg(F.max("price").alias("price"))
    assert key(turns.asof(df, "k", "t", prices, "d", ["price"])) == key(turns.asof(df, "k", "t", prices, "d", ["price"], **FORCED))
    ranks = df.select("t", (F.col("t") * 2 + 5).cast("int").alias("rank"))
    got = turns.dense_rerank(ranks, "t", "rank", **FORCED)
    assert key(got) == sorted(((t, 2 * t + 5, t + 1) for _, t, _, _ in rows), key=str)
    curve = templates.growth_curve(df.select(F.lit("Bash").alias("tool_type"), F.col("t").alias("arrival"), (F.col("e") == "x").alias("is_first")), 500, **FORCED)
    n = scanned(rows, lambda k: 0)
    assert [tuple(r) for r in curve.orderBy("blobs").collect()] == [("Bash", b, n[b - 1][0]) for b in range(500, 3001, 500)]


@pytest.mark.parametrize("shape", ["smooth", "steep", "equal", "few"])
def test_exact_ranks_of_one_key_with_all_rows(spark, shape):
    r = random.Random(3)
    value = {"smooth": lambda i: r.random(), "steep": lambda i: r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300), "equal": lambda i: 7.0, "few": lambda i: float(r.randint(0, 3))}[shape]
    rows = [("hot", value(i)) for i in range(9000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {x["k"]: x for x in turns.percentile_nearest(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    assert set(got) == set(want)
    for k, vs in want.items():
        vs.sort()
        assert [got[k][f"p{p}"] for p in (0, 50, 99, 100)] == [vs[int((len(vs) - 1) * p / 100)] for p in (0, 50, 99, 100)]
    medians = {x["k"]: (x["median"], x["n"]) for x in turns.median(df, "k", "v").collect()}
    assert medians == {k: ((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2, len(vs)) for k, vs in want.items()}


def test_between_the_bounds_are_few_rows(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("1 AS k", "cast(id * 7919 % 200000 AS double) AS v")
    assert turns.percentile_nearest(df, ["k"], "v", {"p50": 0.5}).first()["p50"] == 99_999.0


def test_what_makes_the_rows_of_a_scan_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(2000, numPartitions=4).mapInArrow(count, "id long").selectExpr("id % 10 AS k", "id AS t")
    for limits in ({"one_task_bytes": 0}, FORCED):  # no key is large enough to be cut; all keys are
        seen.value = 0
        assert scan.running(df, ["k"], ["t"], counts={"n": F.lit(True)}, **limits).agg(F.sum("n")).first()[0] == 10 * 200 * 201 // 2
        assert seen.value == 2000
