"""Clustering against a sequential version that compares every line with every cluster."""

import json
import os
import random

from pyspark.sql import functions as F

from traceloom.operators import templates
from traceloom.streaming.templates import with_templates


def sequential(lines, least=0.55):
    clusters, owner = [], []
    for words in lines:
        best, at = least, None
        for i, (t, _) in enumerate(clusters):
            s = sum(x in ("<*>", y) for x, y in zip(t, words)) / len(t)
            if s > best or (s == best and at is None):
                best, at = s, i
        if at is None:
            at = len(clusters)
            clusters.append([list(words), " ".join(words)])
        clusters[at][0] = [x if x == y else "<*>" for x, y in zip(clusters[at][0], words)]
        owner.append(at)
    return [(clusters[o][1], " ".join(clusters[o][0])) for o in owner]


def test_wildcards_match():
    t = templates.Tree()
    lines = ["read a b c d e f g", "read a b c X Y Z g", "read a b c P Q R g", "read a b H P Q R g"]
    assert [t.insert(x.split()).id for x in lines] == [1, 1, 1, 1] and t.alive[1].tokens == "read a b <*> <*> <*> <*> g".split()


def test_clusters_equal_sequential():
    r = random.Random(1)
    for n in (1, 2, 5, 9):
        lines = [[r.choice("abcde") for _ in range(n)] for _ in range(400)]
        t, leaf = templates.Tree(), templates.Clusters(0.55)
        owner = [t.insert(x, 1, leaf) for x in lines]
        assert [(c.created_by, c.template) for c in owner] == sequential(lines)


def test_capacity_keeps_what_is_supported():
    t = templates.Tree(most=3)
    for line in ["seen often one", "other thing two", "third kind three", "seen often one", "other thing two"]:
        t.insert(line.split())
    t.insert("a fourth kind".split())  # the only one seen once is the oldest of them
    assert sorted(c.template for c in t.alive.values()) == ["a fourth kind", "other thing two", "seen often one"]
    for line in ["a fourth kind", "seen often one", "fifth of all", "sixth of all them"]:
        t.insert(line.split())
    assert len(t.alive) == 3 and max(t.alive.values(), key=lambda c: c.size).template == "seen often one"
    # all have the same support: the one not met for longest goes
    t = templates.Tree(most=2)
    for line in ["aa bb cc", "dd ee ff", "gg hh ii"]:
        t.insert(line.split())
    assert sorted(c.template for c in t.alive.values()) == ["dd ee ff", "gg hh ii"] and t.gone == {1}


def test_a_hot_leaf_stays_bounded():
    r = random.Random(3)
    t = templates.Tree(most=40)
    for _ in range(3000):
        t.insert(["same", "start", *[r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)]])
    (leaf,) = t.leaves.values()
    assert t.gone and len(t.alive) == len(leaf.rows) <= 40 and len(t.by_size) <= 4 * 40 + 64
    assert [c.slot for c in leaf.rows] == list(range(len(leaf.rows))) and sorted(t.alive) == [c.id for c in leaf.rows]


def test_drain_with_many_children(spark):
    r = random.Random(2)
    rows = [("t", f"head{i % 130} mid{i % 3} " + " ".join(r.choice("xyz") for _ in range(4)), i) for i in range(600)]
    got = {x["masked"]: (x["created_by"], x["template"]) for x in templates.drain(spark.createDataFrame(rows, "tool_type string, masked string, arrival long")).collect()}
    leaves, seen = {}, []
    for _, line, _ in rows:
        if line not in seen:
            seen.append(line)
            w = line.split()
            k1 = w[0] if int(w[0][4:]) < 100 else "<*>"
            leaves.setdefault((k1, w[1]), []).append(w)
    want = {" ".join(w): x for ws in leaves.values() for w, x in zip(ws, sequential(ws))}
    assert got == want


def test_warm_start_takes_old_clusters_first(spark):
    old = spark.createDataFrame([("l", 0, ["a", "<*>", "c"], "a b c")], "leaf string, cluster_id int, tokens array<string>, created_by string")
    new = spark.createDataFrame([("l", "a z c", ["a", "z", "c"], 1), ("l", "q r s", ["q", "r", "s"], 2)], "leaf string, masked string, tokens array<string>, arrival int")
    assert {(x["masked"], x["created_by"], x["template"]) for x in templates.warm_start(old, new).collect()} == {("a z c", "a b c", "a <*> c"), ("q r s", "q r s", "q r s")}


def log_lines(n, seed):
    r = random.Random(seed)
    shapes = ["open file {} now", "error {} at line {} of {}", "user {} logged in from {}", "{} tests passed and {} failed", "done in {} ms"]
    return [("Bash" if i % 3 else "Edit", r.choice(shapes).format(*[f"v{r.randint(0, 30)}" for _ in range(3)]), i) for i in range(n)]


def streamed(spark, tmp_path, lines, slices, **limits):
    """Runs the lines through a stream in so many batches; all rows that came out."""
    source, out = tmp_path / f"in{slices}", tmp_path / f"out{slices}"
    source.mkdir()
    schema = "tool_type string, masked string, arrival long"
    size = -(-len(lines) // slices)
    for i in range(slices):
        file = source / f"{i}.json"
        file.write_text("".join(json.dumps(dict(zip(("tool_type", "masked", "arrival"), x))) + "\n" for x in lines[i * size : (i + 1) * size]))
        os.utime(file, (1_000_000 + i, 1_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = with_templates(stream, **limits).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"ckpt{slices}")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.read.parquet(str(out)).collect()


def test_slices_of_a_stream_equal_one_pass(spark, tmp_path):
    lines = log_lines(400, 5)
    one, four = (streamed(spark, tmp_path, lines, n) for n in (1, 4))
    ids = lambda rows: {r["arrival"]: r["template_id"] for r in rows}
    assert len(one) == len(four) == 400 and ids(one) == ids(four)  # divergence 0
    assert sum(r["is_new"] for r in one) == sum(r["is_new"] for r in four)
    batch = {(r["tool_type"], r["masked"]): r["template_id"] for r in templates.drain(spark.createDataFrame(lines, "tool_type string, masked string, arrival long")).collect()}
    assert all(batch[r["tool_type"], r["masked"]] == r["template_id"] for r in four)


def test_state_of_a_stream_is_bounded(spark, tmp_path):
    r = random.Random(6)
    lines = [("Bash", " ".join(r.choice("abcdefgh") for _ in range(5)) if i % 2 else "kept all along for ever", i) for i in range(200)]
    rows = streamed(spark, tmp_path, lines, 4, most=4)
    often = [x for x in rows if x["masked"].startswith("kept")]
    assert sum(x["is_new"] for x in often) == 1 and len({x["template_id"] for x in often}) == 1
    assert sum(x["is_new"] for x in rows) > 40


def test_clusters_that_go_equal_a_plain_list():
    r = random.Random(5)
    lines = [[r.choice("abcdefgh") for _ in range(4)] for _ in range(3000)]
    plain, clock, got = [], 0, templates.Tree(least=0.8, most=20)
    leaf = templates.Clusters(0.8)
    for words in lines:
        clock += 1
        best = max(plain, key=lambda c: (sum(x in ("<*>", y) for x, y in zip(c["t"], words)), -c["id"]), default=None)
        if best is None or sum(x in ("<*>", y) for x, y in zip(best["t"], words)) / 4 < 0.8:
            best = {"id": clock, "t": list(words), "by": " ".join(words), "size": 0}
            plain.append(best)
        best["t"] = [x if x == y else "<*>" for x, y in zip(best["t"], words)]
        best["size"], best["touched"] = best["size"] + 1, clock
        if len(plain) > 20:
            plain.remove(min(plain, key=lambda c: (c["size"], c["touched"])))
        c = got.insert(words, 1, leaf)
        assert (c.created_by, c.template) == (best["by"], " ".join(best["t"]))
    assert len(leaf.rows) == 20 and len(leaf.seats) < 2 * 20 + 64 + 2 and sum(len(at) for at in leaf.places) < 1000


def test_lines_are_masked_once_and_lines_without_a_tool_stay(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = spark.range(300, numPartitions=3).mapInArrow(count, "id long").selectExpr("IF(id % 3 = 0, NULL, 'Bash') AS tool_type", "concat('line w', id % 50, ' of x', id % 7) AS masked", "id AS arrival")
    assert templates.drain(lines).agg(F.sum("n")).first()[0] == 300
    assert seen.value == 300
