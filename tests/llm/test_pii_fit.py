"""Trees and thresholds of personal data learn from every candidate of every document."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from traceloom.llm import pii
from traceloom.llm.trees import Trees, grow


def texts(n, pad=""):
    r, out = random.Random(8), []
    for i in range(n):
        digits = "".join(r.choice("0123456789") for _ in range(10))
        phone = f"call +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}" if i % 3 else f"order {digits} of {r.randint(1, 99)}"
        mail = f"write {r.choice('abcdef') * r.randint(1, 5)}{i}@mail{i % 7}.org" if i % 2 else "ask bob (at) home (dot) net"
        out.append(f"some plain words {r.choice('xyz') * r.randint(1, 9)} {phone} and {mail} {pad}")
    return out


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_all_candidates_teach(spark, monkeypatch):
    rows = [*texts(400), *texts(150, "word " * 5000), None, "", "short"]  # texts of over 20,000 characters, too
    monkeypatch.setattr(pii, "TASK_ROWS", 60)  # several tasks
    d = frame(spark, rows)
    got = pii.fit(d).models
    half = [r[0] for r in d.orderBy("doc_id").select(F.pmod(F.xxhash64("text"), F.lit(2))).collect()]
    found = [(k, y, x, h) for t, h in zip(rows, half) if t is not None for k, y, x in pii.examples(t)]
    assert set(got) == {"email", "phone"}
    for kind, (trees, least) in got.items():
        x, y, h = (np.array([f[i] for f in found if f[0] == kind]) for i in (2, 1, 3))
        assert len(y) > 400
        whole, halves = Trees().fit(x, y), []
        for part in (0, 1):
            t = Trees().begin(whole.cuts, int((h == part).sum()), int(y[h == part].sum()))
            halves.append(t)
            mine = x[h == part], y[h == part]
            grow({0: t}, lambda now: {0: now[0].sums(t.binned(mine[0]), np.ones(len(mine[1]), np.int64), mine[1])})
        assert np.array_equal(trees.feature, whole.feature) and np.array_equal(trees.cut, whole.cut) and np.allclose(trees.predict(x), whole.predict(x), atol=1e-12)
        held_out = np.where(h == 0, halves[1].predict(x), halves[0].predict(x))
        assert np.isclose(least, pii.threshold(held_out, y.astype(float))) or least == pii.threshold(held_out, y.astype(float))
    again = pii.fit(d.orderBy(F.desc("text")).repartition(7)).models
    assert all(np.array_equal(got[k][0].value, again[k][0].value) and got[k][1] == again[k][1] for k in got)


def test_long_texts_alone_teach(spark):
    rows = [*texts(60, "word " * 5000)]
    assert set(pii.fit(frame(spark, rows)).models) == {"email", "phone"}


def test_thresholds_of_counted_scores(spark):
    v, y = [0.9, 0.8, 0.8, 0.7, 0.6, 0.2], [1, 1, 1, 1, 0, 0]
    rows = [("a", s, 1, t) for s, t in zip(v, y)] + [("b", s, 1, 1 - t) for s, t in zip(v, y)]
    scores = spark.createDataFrame(rows, "kind string, v double, n long, y long").groupBy("kind", "v").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    assert np.isclose(pii.thresholds(scores)["a"], 0.65) and "b" not in pii.thresholds(scores) and np.isclose(pii.thresholds(scores, 0.8)["a"], 0.4)


def test_examples_take_time_in_proportion():
    began = time.time()
    for t in ("a" * 1_000_000, "a@b.cc +12 345 678 90 " * 10_000, "ab " * 300_000):
        sum(1 for _ in pii.examples(t))
    assert time.time() - began < 60
