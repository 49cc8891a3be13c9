from pyspark.sql import functions as F

from traceloom.operators import cost, joins
from traceloom.plans import lines


def test_tree_of_a_long_chain_with_a_cycle_and_an_orphan(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    links = spark.createDataFrame([*chain, (1000, 1001), (1001, 1000), (2000, 1999), (3000, None)], "id long, parent long")
    got = {r["id"]: r for r in joins.subagent_tree(spark, links).collect()}
    assert set(got) == {*range(300), 3000}
    assert all(got[i]["depth"] == i and got[i]["root"] == 0 for i in range(300)) and got[3000]["depth"] == 0
    assert got[299]["path"] == "/".join(map(str, range(300))) and got[3000]["path"] == "3000"


def test_tree_of_no_links(spark):
    assert joins.subagent_tree(spark, spark.createDataFrame([], "id long, parent long")).count() == 0


def test_slugs_by_place_whatever_the_case_and_length(spark):
    hits = spark.createDataFrame([("r1", "w/Alpha-beta/x"), ("r2", "none"), ("r3", None), ("x9", "q"), ("r5", "")], "ref string, cwd string")
    slugs = spark.createDataFrame([("beta", 2), ("ALPHA", 3), ("x", 9), ("", 0), (None, 1)], "slug string, place int")
    got = {r["ref"]: r["slug"] for r in joins.match_slugs(hits, slugs, "ref", ["ref", "cwd"]).collect()}
    assert got == {"r1": "beta", "r2": None, "r3": None, "x9": "x", "r5": None}
    by_name = {r["ref"]: r["slug"] for r in joins.match_slugs(hits, slugs.drop("place"), "ref", ["ref", "cwd"]).collect()}
    assert by_name["r1"] == "ALPHA"


def test_merge_reconcile_takes_the_earliest_fitting_sighting(spark):
    prs = spark.createDataFrame([("Org/app", 1, "open", None), ("Org/web", 1, "open", None), ("Org/app", 2, "open", None)], "repo string, number long, state string, merged_at string")
    seen = spark.createDataFrame([(1, "app", "2026-01-03"), (1, "APP", "2026-01-02"), (1, "pp", "2026-01-01"), (1, None, "2026-01-04"), (3, None, "2026-01-01")], "number long, repo_hint string, merged_at string")
    got = {(r["repo"], r["number"]): (r["state"], r["merged_at"]) for r in joins.merge_reconcile(prs, seen).collect()}
    assert got == {("Org/app", 1): ("merged", "2026-01-02"), ("Org/web", 1): ("merged", "2026-01-04"), ("Org/app", 2): ("open", None)}


def test_co_change_counts_only_written_items(spark):
    touched = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "a"), ("t", "b"), ("t", "b")], "session string, item string")
    written = spark.createDataFrame([("a",), ("b",), ("b",)], "item string")
    assert [tuple(r) for r in cost.co_change(touched, "session", "item", written).collect()] == [("a", "b", 2)]
    assert cost.co_change(touched, "session", "item").count() == 3


def test_halves_and_unique_stores(spark):
    rows = spark.createDataFrame([("k", "p", 1, "t", None), ("k", "p", 2, "u", 7), ("l", "p", 3, "v", None)], "key string, path string, offset long, title string, number long")
    assert [tuple(r) for r in joins.merge_halves(rows, "key", ["title", "number"]).collect()] == [("k", "t", 7)]
    store = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "key string, v long")
    assert {r["key"]: r["v"] for r in joins.enrich_unique(rows.select("key").distinct().withColumn("n", F.lit(1)), store, "key").collect()} == {"k": None, "l": 3}


def test_rows_of_one_row_group_are_dealt_evenly(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id AS event_id", "id % 7 AS user_id", "double(id) AS value", "timestamp'2026-01-01' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(joins, "DEALT_ROWS", 400)
    made = lines._lines(spark, str(tmp_path))
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert made.count() == made.select("offset").distinct().count() == 4000 and len(sizes) == 10 and max(sizes) < 600


def test_co_change_deals_its_rows_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(cost, "TASK_ROWS", 100)
    touched = spark.range(2000).selectExpr("id div 4 AS session", "id * 7 % 1999 AS item")
    pairs = cost.co_change(touched, "session", "item")
    assert "hashpartitioning(a#" in (plan := pairs._jdf.queryExecution().toString()) and ", 30), REPARTITION_BY_NUM" in plan
    items = {}
    for r in touched.collect():
        items.setdefault(r["session"], set()).add(r["item"])
    want = {}
    for own in items.values():
        for a, b in ((a, b) for a in own for b in own if a < b):
            want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["sessions"] for r in pairs.collect()} == want


def test_all_partners_are_ranked(spark):
    """Each of twelve items has eleven partners, more than the six that the reference shows."""
    touched = spark.range(12).crossJoin(spark.range(12).withColumnRenamed("id", "session")).filter("id = 0 or id <= session").selectExpr("session", "id AS item")
    ranked = [tuple(r) for r in cost.co_change_top(cost.co_change(touched, "session", "item")).collect()]
    assert len(ranked) == 12 * 11 and sorted(r for r in ranked if r[0] == 0) == sorted((0, i, 12 - i, i) for i in range(1, 12))
    assert sum(r[3] <= 6 for r in ranked) == 72 == cost.co_change_top(cost.co_change(touched, "session", "item"), 6).count()


def test_null_is_no_item_of_a_heavy_session(spark):
    touched = spark.range(60).selectExpr("'s' AS session", "nullif(id, 7) AS item")
    pairs = cost.co_change(touched, "session", "item", block_items=7)
    assert pairs.count() == 59 * 58 // 2 and pairs.filter("a is null or b is null or a >= b").count() == 0
