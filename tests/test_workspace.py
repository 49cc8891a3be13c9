"""Workspace sources and sinks, the written token index, pending names and run summaries."""

import json
import os

from pyspark.sql import functions as F

from traceloom.operators import search
from traceloom.sources import workspace
from traceloom.streaming import incremental


def test_documents_with_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\n{"title": "A", "rank": 2, "tags": ["x", "y"]}\n---\nbody\nmore\n')
    (tmp_path / "b.md").write_text("---\n[1, 2]\n---\nlist\n")
    (tmp_path / "d.md").write_text("---\ntitle: D\ntags:\n  - z\n---\n")
    (tmp_path / "c.md").write_text('---\n{"title": \n---\nbroken\n')
    (tmp_path / "skip.txt").write_text("no")
    good, bad = workspace.documents(spark, str(tmp_path), "title string, rank int, tags array<string>")
    assert [tuple(r) for r in good.orderBy("file").select("file", "title", "rank", "tags", "body").collect()] == [("a", "A", 2, ["x", "y"], "body\nmore\n"), ("d", "D", None, ["z"], "")]
    assert sorted(os.path.basename(r["path"]) for r in bad.collect()) == ["b.md", "c.md"]


def test_prices_and_triage_logs(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"version": "2", "models": {"m": {"in": 1.5, "out": 2, "cacheRead": 0.1, "cacheCreation": 0.2}}}))
    assert [tuple(r) for r in workspace.prices(spark, str(tmp_path / "p.json")).collect()] == [("2", "m", 1.5, 2.0, 0.1, 0.2)]
    (tmp_path / "t.tsv").write_text("1\tdismiss\tpr:1\t\n2\taccept\tpr:2\tx\n3\tdismiss\tpr:1\t\n")
    assert sorted(r["ref"] for r in workspace.triaged(spark, str(tmp_path / "t.tsv")).collect()) == ["pr:1", "pr:2"]


def test_sinks(spark, tmp_path):
    rows = spark.range(5).selectExpr("id", "id % 2 AS k")
    workspace.write_tables({"facts": rows, "edges": rows.limit(0)}, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/facts")).count() == 5 and spark.read.parquet(str(tmp_path / "index/edges")).count() == 0
    log = str(tmp_path / "log")
    workspace.append_occurrences(rows, log)
    workspace.append_occurrences(rows, log)
    assert spark.read.json(log).count() == 10
    assert workspace.compact(spark, log, str(tmp_path / "compact"), "id long, k long", ["id"]).count() == 5


def test_export_of_snapshots(spark, tmp_path):
    initiatives = spark.createDataFrame([("a", "A"), ("b", "B")], "slug string, title string")
    tasks = spark.createDataFrame([("a", 2, "t2", "second", "open"), ("a", 1, "t1", "first", "done")], "slug string, priority int, id string, title string, status string")
    sessions = spark.createDataFrame([("a", f"2026-01-0{i}", f"f{i}", "\n".join(map(str, range(60)))) for i in range(1, 8)], "slug string, ended string, file string, body string")
    workspace.export_snapshot(initiatives, tasks, sessions, str(tmp_path / "out"), latest=2, lines=3)
    got = {r["slug"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [t["id"] for t in got["a"]["tasks"]] == ["t1", "t2"] and [(s["file"], s["body"]) for s in got["a"]["sessions"]] == [("f7", "0\n1\n2"), ("f6", "0\n1\n2")]
    assert got["b"]["tasks"] is None and got["b"]["sessions"] is None


def test_a_written_index_is_looked_up_by_bucket(spark, tmp_path, capsys):
    spans = spark.range(40).selectExpr("id AS span_id", "'f' AS field", "concat('word', id % 5, ' all') AS text")
    search.write_index(search.index_spans(spans), "spans_by_token", str(tmp_path / "index"), buckets=4)
    try:
        tokens = spark.table("spans_by_token")
        assert sorted(r["span_id"] for r in search.match(tokens, ["word3", "ALL"]).collect()) == list(range(3, 40, 5))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets
        tokens.filter("token = 'word3'").explain("formatted")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 4" in capsys.readouterr().out
        assert search.orphans(tokens, spans.filter("span_id < 38")).count() == 2
    finally:
        spark.sql("DROP TABLE spans_by_token")


def test_pending_names_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    slices = [[("a", 1, "x", "Bash"), ("a", 2, "y", "Read"), ("b", 1, "x", "Edit")], [("a", 5, "x", None), ("a", 6, "x", None), ("b", 4, "y", None)], [("a", 7, "x", "Write"), ("a", 8, "x", None), ("a", 9, "y", None), ("b", 9, "x", None)]]
    for i, rows in enumerate(slices):
        (source / f"{i}.json").write_text("".join(json.dumps(dict(zip(("path", "offset", "tool_use_id", "name"), r))) + "\n" for r in rows))
        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("path string, offset long, tool_use_id string, name string").option("maxFilesPerTrigger", 1).json(str(source))
    q = incremental.with_pending_names(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = sorted((r["path"], r["offset"], r["tool_name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 5, "Bash"), ("a", 6, "generic"), ("a", 8, "Write"), ("a", 9, "Read"), ("b", 4, "generic"), ("b", 9, "Edit")]


def test_run_summary_observes_a_batch(spark):
    from pyspark.sql import Observation

    seen = Observation("run")
    rows = spark.createDataFrame([("a", 3, False), ("a", 4, True)], "path string, length int, rewound boolean")
    summed = rows.observe(seen, F.count("*").alias("lines"), F.count(F.when(F.col("rewound"), 1)).alias("rewound"), F.sum("length").alias("bytes"))
    assert summed.count() == 2 and seen.get == {"lines": 2, "rewound": 1, "bytes": 7}
    assert incremental.run_summary(rows).count() == 2
