import json
import os

from pyspark.sql import functions as F

from traceloom.operators import events, quality, turns
from traceloom.sources import transcripts
from traceloom.streaming import incremental


def lines(n, session="s1", start=0):
    return [json.dumps({"type": "user" if i % 3 == 0 else "assistant", "sessionId": session, "uuid": f"{session}-{i}", "timestamp": f"2026-05-01T00:00:{i:02d}Z", "message": {"content": "hi" if i % 3 == 0 else [{"type": "text", "text": "x"}]}}) + "\n" for i in range(start, n)]


def facts_of(rows):
    return turns.transcript_sequence(events.facts(events.base(transcripts.parsed(rows).filter("not bad"))))


def run(spark, root, out, ckpt):
    table = incremental.FactTable(spark, out, {"turns": lambda f: turns.turn_rollup(f)}, buckets=4)

    def batch(rows, i):
        rows.persist()
        marks = rows.groupBy("path").agg(F.max("rewound").alias("rewound"))
        if not rows.isEmpty():
            table.batch(facts_of(rows.filter("offset >= 0")).join(marks, "path"), i, marks.filter("rewound"))
        rows.unpersist()

    spark.dataSource.register(incremental.TranscriptSource)
    q = spark.readStream.format("transcripts").option("maxBytesPerTrigger", "900").option("progress", ckpt + "-progress").load(root).writeStream.foreachBatch(batch).option("checkpointLocation", ckpt).start()
    q.processAllAvailable()
    q.stop()


def test_stream_gives_the_tables_of_a_batch(spark, tmp_path):
    folder = tmp_path / "root" / "p"
    folder.mkdir(parents=True)
    file = folder / "s1.jsonl"
    text = "".join(lines(12))
    file.write_text(text[: len(text) // 2])  # torn in the middle of a line
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run(spark, str(tmp_path / "root"), out, ckpt)
    file.write_text(text)
    (folder / "s2.jsonl").write_text("".join(lines(6, "s2")))
    run(spark, str(tmp_path / "root"), out, ckpt)
    whole = turns.turn_rollup(facts_of(transcripts.lines(spark, str(tmp_path / "root"))))
    cols = [c for c in whole.columns]
    got = spark.read.parquet(f"{out}/turns")
    assert quality.table_digest(got, cols).first() == quality.table_digest(whole, cols).first()
    assert got.count() == 6


def reader(tmp_path, most=1 << 20):
    return incremental.TranscriptReader({"path": str(tmp_path / "root"), "progress": str(tmp_path / "progress"), "maxbytespertrigger": str(most)})


def batches(tmp_path, start, most=1 << 20, many=200):
    """Batches until nothing is new: the rows of each, and the last offset."""
    out = []
    for _ in range(many):
        r = reader(tmp_path, most)  # a new one each time, as after a restart
        end = r.latestOffset()
        spans = r.partitions(start, end)
        if not spans:
            break
        out.append([row for s in spans for row in r.read(s)])
        start = end
    return out, start


def put(file, text, time):
    file.parent.mkdir(exist_ok=True)
    file.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(file, ns=(time, time))


def test_batches_are_bounded_from_the_first_and_whole(tmp_path):
    file = tmp_path / "root" / "a.jsonl"
    text = "".join(lines(50)) + "é" * 5000 + "\nlast\ntorn"
    put(file, text, 1)
    out, end = batches(tmp_path, {}, most=100)
    data = text.encode()
    assert [b for rows in out for _, at, n, b, _ in rows] == text.split("\n")[:-1]
    assert all(data[at : at + n].decode() == b for rows in out for _, at, n, b, _ in rows)
    assert len(out) == -(-len(data) // 100) and max(len(rows) for rows in out) <= 2
    put(file, text + " mended\n", 2)
    more, end = batches(tmp_path, end, most=100)
    assert [r[3:] for rows in more for r in rows] == [("torn mended", False)]
    assert batches(tmp_path, end) == ([], end)


def test_any_changed_byte_is_seen(tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "CHUNK", 64)
    file = tmp_path / "root" / "a.jsonl"
    text = "".join(f"line {i}\n" for i in range(40)).encode()
    put(file, text, 1)
    _, end = batches(tmp_path, {})
    for time, at in enumerate([0, 63, 64, 65, len(text) // 2, len(text) - 2], 2):
        text = text[:at] + b"#" + text[at + 1 :]
        put(file, text, time)
        out, end = batches(tmp_path, end)
        assert len(out) == 1 and out[0][0][1] == -1 and all(r[4] for r in out[0])
        assert b"".join(r[3].encode() + b"\n" for r in out[0][1:]) == text


def test_emptied_torn_and_deleted_files(tmp_path):
    file, other = tmp_path / "root" / "a.jsonl", tmp_path / "root" / "b.jsonl"
    put(file, "one\ntwo\n", 1)
    put(other, "o\n", 1)
    _, end = batches(tmp_path, {})
    put(file, "", 2)
    out, end = batches(tmp_path, end)
    assert out == [[(str(file), -1, 0, None, True)]]
    put(file, "three\n", 3)
    out, end = batches(tmp_path, end)
    assert [r[3:] for r in out[0]] == [("three", False)]
    put(file, "torn", 4)  # shorter, and no line
    out, end = batches(tmp_path, end)
    assert out == [[(str(file), -1, 0, None, True)]]
    put(file, "torn no more\n", 5)
    out, end = batches(tmp_path, end)
    assert [r[3:] for r in out[0]] == [("torn no more", False)]
    file.unlink()
    assert batches(tmp_path, end)[0] == []
    end = reader(tmp_path).latestOffset()
    put(file, "another one, longer\n", 6)
    out, end = batches(tmp_path, end)
    assert [r[3:] for r in out[0]] == [(None, True), ("another one, longer", True)]
    file.unlink()
    end = reader(tmp_path).latestOffset()
    put(file, "another one, longer\n", 7)  # back as it was
    assert [r for rows in batches(tmp_path, end)[0] for r in rows] == []


def test_an_unchanged_file_is_not_compared_again(tmp_path, monkeypatch):
    put(tmp_path / "root" / "a.jsonl", "".join(lines(30)), 1)
    seen = []
    monkeypatch.setattr(incremental.Chain, "holds", lambda self, file: seen.append(self.end) or True)
    batches(tmp_path, {}, most=200)
    assert not seen


def test_a_replayed_batch_gives_the_same_rows(tmp_path):
    file = tmp_path / "root" / "a.jsonl"
    put(file, "".join(lines(5)), 1)
    _, start = batches(tmp_path, {})
    put(file, "".join(lines(9)), 2)
    r = reader(tmp_path)
    end = r.latestOffset()
    first, again = ([row for s in r.partitions(start, end) for row in r.read(s)] for _ in range(2))
    assert first == again and len(first) == 4


def test_an_emptied_file_leaves_no_facts(spark, tmp_path):
    file = tmp_path / "root" / "s1.jsonl"
    put(file, "".join(lines(6)), 1)
    put(tmp_path / "root" / "s2.jsonl", "".join(lines(6, "s2")), 1)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run(spark, str(tmp_path / "root"), out, ckpt)
    put(file, "", 2)
    run(spark, str(tmp_path / "root"), out, ckpt)
    for t in ("facts", "turns"):
        assert {r["session_id"] for r in spark.read.parquet(f"{out}/{t}").select("session_id").collect()} == {"s2"}


def test_a_session_that_vanishes_leaves_no_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    table = incremental.FactTable(spark, out, {"turns": lambda f: turns.turn_rollup(f)}, buckets=8)
    names = [f"s{i}" for i in range(1, 6)]

    def put(session, rewound):
        rows = spark.createDataFrame([("f", i, len(t), t) for i, t in enumerate(lines(4, session))], "path string, offset long, length int, text string")
        table.batch(facts_of(rows).withColumn("rewound", F.lit(rewound)))

    for k, name in enumerate(names):  # the file is rewritten for another session each time
        put(name, k > 0)
        for t in ("facts", "turns"):
            assert {r["session_id"] for r in spark.read.parquet(f"{out}/{t}").select("session_id").collect()} == {name}


def facts_frame(spark, sessions, n=20):
    rows = [(f"{s}.jsonl", i, len(t), t) for s in sessions for i, t in enumerate(lines(n, s))]
    return facts_of(spark.createDataFrame(rows, "path string, offset long, length int, text string")).withColumn("rewound", F.lit(False))


def written(out):
    """Files and bytes by the time of their last change."""
    return {f: f.stat().st_mtime_ns for f in out.rglob("*.parquet") if "_staged" not in str(f)}


def test_a_batch_writes_as_much_while_the_table_grows(spark, tmp_path):
    out = tmp_path / "out"
    table = incremental.FactTable(spark, str(out), {"turns": lambda f: turns.turn_rollup(f)}, buckets=2, bucket_rows=60)
    before, sizes = {}, []
    for k in range(12):
        table.batch(facts_frame(spark, [f"s{k}-{i}" for i in range(4)]), k)
        now = written(out)
        fresh = [f for f in now if f not in before and "/facts/" in str(f)]
        sizes.append(spark.read.parquet(*map(str, fresh)).count())
        before = now
    rows = spark.read.parquet(f"{out}/facts")
    assert rows.count() == 12 * 4 * 20 and table.layout() == {"buckets": 16, "rows": 960, "moving": []}
    # the table is twelve times as large as after the first batch, which wrote 80 rows
    assert max(sizes[6:]) <= 600 and sum(sizes[8:]) < 0.5 * 4 * 960
    assert rows.filter(F.col("bucket") != table._bucket(16)).count() == 0
    whole = turns.turn_rollup(rows.drop("bucket"))
    assert quality.table_digest(spark.read.parquet(f"{out}/turns"), whole.columns).first() == quality.table_digest(whole, whole.columns).first()


def test_a_batch_that_died_while_splitting_is_mended(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    table = incremental.FactTable(spark, out, {"turns": lambda f: turns.turn_rollup(f)}, buckets=1, bucket_rows=30)
    table.batch(facts_frame(spark, ["a", "b"]), 0)
    replace = table._replace

    def dies(name, rows, buckets):
        if name == "turns":
            raise RuntimeError("lost")
        replace(name, rows, buckets)

    monkeypatch.setattr(table, "_replace", dies)
    fresh = facts_frame(spark, ["c", "d", "e"])
    try:
        table.batch(fresh, 1)
        raise AssertionError
    except RuntimeError:
        assert table.layout()["moving"]
    monkeypatch.setattr(table, "_replace", replace)
    table.batch(fresh, 1)
    facts, got = spark.read.parquet(f"{out}/facts"), spark.read.parquet(f"{out}/turns")
    whole = turns.turn_rollup(facts.drop("bucket"))
    assert facts.count() == 100 and table.layout()["moving"] == []
    assert quality.table_digest(got, whole.columns).first() == quality.table_digest(whole, whole.columns).first()
