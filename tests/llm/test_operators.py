"""Each operator against a brute-force version or the defined result of odd inputs."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import ann, bpe, decontam, lm, neardup, pii, quality, substring, toxicity, warc, wordhash
from traceloom.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, ids string, key string"
R = random.Random(4)
WORDS = list(dict.fromkeys("".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(3, 9))) for _ in range(900)))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one"), (6, "x " * 3000), (None, "no id here"), (7, "日本語 🎉 é\x1c.")]


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def key(x):
    return (x[0] is None, x[0] or 0, *map(str, x[1:]))


def test_bpe_equals_the_library(spark):
    path, t = tokenizer()
    rows = [*ODD, (8, "a<|endoftext|>b  \n\n c² don't I'LL 12½ \t"), (9, prose(400, 1)), (10, "aé" * 3000)]
    out = bpe.encode_decode(docs(spark, rows), path, block_chars=5000).collect()
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in out), key=key) == sorted(want, key=key)
    assert all(t.decode(list(r["ids"]), skip_special_tokens=False) == r["decoded"] for r in out)
    got = {r["doc_id"]: r for r in bpe.digests(bpe.encode_decode(docs(spark, [(1, "ab c")]), path)).collect()}[1]
    ids = t.encode("ab c", add_special_tokens=False).ids
    assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_decode(docs(spark, []), path).count() == 0


def test_warc_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", None), (2, "u", ""), (3, "a\r\nb", "é" + fake * 2), (4, None, "é" + fake * 2), (5, "u", "WARC/1.0\r\n"), (None, "u", "n"), (6, "u", ("q" * 300 + fake) * 30), (7, "u", "p" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    for split in ("1m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            path = new_path(spark, "t")
            warc.write(pages, path)
            out = warc.parsed(warc.read(spark, path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", 99), i)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            other = first.get(h or "", i) != i
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other else "response", first[h or ""] if other else None))
        assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    path = new_path(spark, "t")
    warc.write(pages.limit(0), path)
    assert warc.parsed(warc.read(spark, path)).count() == 0


def test_neardup_classes_equal_brute_force(spark):
    r = random.Random(9)
    base = [prose(r.randint(30, 160), 100 + i) for i in range(40)]
    rows = []
    for i, t in enumerate(base):
        rows.append((10 * i, t))
        for k in range(r.randint(0, 5)):
            w = t.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((10 * i + k + 1, " ".join(w)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in sets}


def test_neardup_large_buckets(spark):
    t = prose(120, 5).split()
    rows = []
    for i in range(30):
        w, r = list(t), random.Random(i)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    test = {i: set(zip(*[x.split()[k:] for k in range(5)])) for i, x in rows}
    linked = {i for i in test for j in test if i != j and len(test[i] & test[j]) >= 0.8 * len(test[i] | test[j])}
    got = {x["doc_id"]: x["n_in_class"] for x in neardup.classes(docs(spark, rows)).collect()}
    assert {i for i, n in got.items() if n > 1} == linked


@pytest.mark.parametrize("kind", ["replaced", "cut", "mixed"])
def test_neardup_links_between_components_of_a_bucket(spark, kind):
    """Texts far from the hub are found through each other, in groups whose texts differ by much more than is allowed."""
    base = prose(100, 15).split()
    rows = []
    for i in range(90):
        w, r = list(base), random.Random(1000 + i)
        if kind == "cut":
            w = w[i // 2 : len(w) - r.randint(0, i // 3)]
        else:
            near = random.Random(i // 3)  # three texts share most of their edits
            for _ in range(near.randint(0, 8)):
                w[near.randrange(len(w))] = f"new{near.randint(0, 30)}"
            if kind == "mixed" and i % 2:
                del w[near.randrange(60) : near.randrange(60, 100) - 20]
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    seqs = {i: neardup._labelled((wordhash.words(t)[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()) for i, t in rows}
    parent = {i: i for i in seqs}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in seqs:
        for b in seqs:
            if a < b and len(set(seqs[a]) & set(seqs[b])) / len(set(seqs[a]) | set(seqs[b])) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in seqs}


def test_neardup_rows_of_one_document(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (1, a), (2, a), (3, b), (4, b), (4, a), (5, prose(60, 3)), (5, prose(60, 3)), (None, a), (None, a)]
    assert {x["doc_id"]: x["class_id"] for x in neardup.classes(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert sorted((str(r["doc_id"]), r["text"]) for r in neardup.keep_first(docs(spark, rows)).collect()) == sorted([("1", a), ("5", prose(60, 3)), ("None", a), ("None", a)])


def test_neardup_odd_rows(spark):
    got = {x["doc_id"]: x["class_id"] for x in neardup.classes(docs(spark, ODD)).collect()}
    assert (got[1], got[2], got[4], got[5]) == (1, 1, 4, 4) and None not in got
    assert neardup.classes(docs(spark, [])).count() == 0
    kept = neardup.keep_first(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 6, 7, None}


def test_passages_that_repeat(spark):
    shared = prose(70, 77)
    rows = [(i, f"{prose(60 + i, i)} {shared} {prose(40, 1000 + i)}") for i in range(8)] + [(20, prose(200, 20)), (21, prose(200, 20)), (30, prose(150, 30)), *[(i and i + 50, t) for i, t in ODD]]
    out = substring.passages(docs(spark, rows)).collect()
    found = {r["doc_id"] for r in out} | {r["other_id"] for r in out}
    assert found == {*range(8), 20, 21} or found == {*range(8), 20, 21, 56}
    text = dict(r for r in rows if r[0] is not None)
    one = next(r for r in out if (r["doc_id"], r["other_id"]) == (3, 0))
    assert text[3].split()[one["start"] : one["end"]] == text[0].split()[one["other_start"] : one["other_end"]] and one["end"] - one["start"] >= 70
    assert substring.passages(docs(spark, [])).count() == 0


@pytest.mark.parametrize("values", [1 << 60, 12])
def test_compact_windows_cover_every_passage(values):
    h = np.random.default_rng(1).integers(0, values, 200).astype(np.uint64)
    cells = collections.Counter()
    for a, c, z in substring.compact_windows(h, 20):
        for i in range(a, c + 1):
            for j in range(c, z + 1):
                if j - i + 1 >= 20:
                    cells[i, j] += 1
                    assert h[i : j + 1].argmin() + i == c
    assert set(cells.values()) == {1} and len(cells) == sum(200 - n + 1 for n in range(20, 201))


@pytest.mark.parametrize("where", [0, 3, 9, 25, 49, 58, 59])
def test_best_passage_has_an_edit_anywhere(where):
    rng = np.random.default_rng(where)
    p = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    q = p.copy()
    q[where] = 1
    a, b = (wordhash.shingles(np.concatenate([rng.integers(0, 1 << 62, 30).astype(np.uint64), x, rng.integers(0, 1 << 62, 30).astype(np.uint64)])) for x in (p, q))
    s, e, s2, e2, sim = substring.best_passage(a, b, 46)
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    want = max(y - x for x, _ in pairs for y, _ in pairs if y - x >= 45 and 1.8 * sum(x <= i <= y for i, _ in pairs) >= 1.6 * (y - x + 1))
    assert e - s - 1 == want and sim >= 0.8 and (s, e) == (s2, e2)


def test_passages_with_edits_and_partial_copies(spark):
    """Passages of 60 words with one changed word; the first text holds only a part of the last ones' passage."""
    rows = []
    for i in range(60):
        p = prose(60, 500 + i).split()
        q = list(p)
        q[i] = "changed"
        rows += [(1000 + 2 * i, f"{prose(40, 3000 + i)} {' '.join(p)} {prose(40, 4000 + i)}"), (1001 + 2 * i, f"{prose(40, 5000 + i)} {' '.join(q)} {prose(40, 6000 + i)}")]
    shared = prose(80, 7).split()
    rows += [(i, f"{prose(70, 8000 + i)} {' '.join(shared[:30])} {prose(70, 8100 + i)}") for i in range(5)] + [(i, f"{prose(70, 8000 + i)} {' '.join(shared)} {prose(70, 8100 + i)}") for i in (10, 11, 12)]
    out = substring.passages(docs(spark, rows)).collect()
    met = {(r["doc_id"], r["other_id"]) for r in out} | {(r["other_id"], r["doc_id"]) for r in out}
    assert sum((1000 + 2 * i, 1001 + 2 * i) in met for i in range(60)) >= 57
    assert {a for a, _ in met if a < 1000} == {10, 11, 12} and all((a < 1000) == (b < 1000) and abs(a - b) < 3 for a, b in met)


def test_passages_that_the_first_texts_hold_in_parts(spark):
    """Earlier texts hold 40 words of a passage each, wherever one looks; only the last two hold all 60."""
    rows, pairs = [], set()
    for k in range(4):
        p = prose(60, 700 + k).split()
        rows += [(100 * k + i, f"{prose(60, 9000 + 50 * k + i)} {' '.join(p[i : i + 40])} {prose(60, 10000 + 50 * k + i)}") for i in range(0, 21, 2)]
        rows += [(100 * k + i, f"{prose(60, 12000 + 50 * k + i)} {' '.join(p)} {prose(60, 13000 + 50 * k + i)}") for i in (30, 31)]
        pairs.add((100 * k + 30, 100 * k + 31))
    out = substring.passages(docs(spark, rows)).collect()
    assert pairs <= {tuple(sorted((r["doc_id"], r["other_id"]))) for r in out}


def test_passages_of_repeated_lines_and_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 4)
    line = prose(60, 1)
    rows = [(i, f"{prose(30, 100 + i)} {line} {prose(30, 200 + i)}") for i in range(40)] + [(100, f"{line}\n" * 200), (101, "same " * 50000), (102, "same " * 60000), (103, prose(90, 9)), (103, prose(90, 9)), (104, prose(90, 10)), (104, prose(95, 11))]
    out = substring.passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in out} | {r["other_id"] for r in out} == {*range(40), 100, 101, 102, 103}


def test_similar_passages_share_enough_minima():
    rng = np.random.default_rng(7)
    least, met = substring.LEAST_WORDS - substring.SHINGLE + 1, 0
    for _ in range(1000):
        p = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        q = p.copy()
        q[10 + rng.integers(0, 30)] = rng.integers(0, 1 << 62)
        a, b = (wordhash.shingles(np.concatenate([rng.integers(0, 1 << 62, 40).astype(np.uint64), x, rng.integers(0, 1 << 62, 40).astype(np.uint64)])) for x in (p, q))
        keys = [[{int(h[c]) for _, c, _ in substring.compact_windows(h, least)} for h in (wordhash.mix(a ^ s), wordhash.mix(b ^ s))] for s in substring._SEEDS]
        met += sum(bool(x & y) for x, y in keys) >= substring.ENOUGH
    assert met >= 999


def test_decontamination_equals_brute_force(spark):
    items = [(1, prose(20, 1)), (2, prose(25, 2)), (3, None), (4, "short"), (5, prose(30, 5))]
    damaged = list(decontam.normalise(items[1][1]))
    for p in range(5, len(damaged), 30):
        damaged[p] = "#"
    rows = [(10, f"{prose(30, 10)} {items[0][1].upper()} {prose(30, 11)}"), (11, f"{prose(30, 12)}\n{''.join(damaged)}"), (12, prose(300, 13)), *ODD]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.hits(docs(spark, rows), bench).collect()}

    def sellers(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    want = {}
    for i, t in rows[:3]:
        for k, x in items:
            p = decontam.normalise(x)
            if len(p) >= decontam.LEAST_CHARS and (e := sellers(p, decontam.normalise(t))) <= int(len(p) * decontam.EDIT_SHARE):
                want[i, k] = e
    assert got == want and set(want) == {(10, 1), (11, 2)}
    assert decontam.hits(docs(spark, rows), bench, slice_chars=50).count() == 2
    assert {r["doc_id"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()} == {12, 1, 2, 3, 4, 5, 6, 7, None}
    assert decontam.hits(docs(spark, rows), bench.limit(0)).count() == 0


def test_banded_alignment_equals_the_whole_matrix():
    def edits(p, t, free):
        row = [0 if free else j for j in range(len(t) + 1)]
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row) if free else row[-1]

    r = random.Random(8)
    for _ in range(400):
        p = "".join(r.choice("abcd") for _ in range(r.randint(8, 40)))
        e, changed = len(p) // 5, list(p)
        for _ in range(r.randint(0, e)):
            at = r.randrange(len(changed))
            changed[at : at + 1] = r.choice(["x", "", "y" + changed[at]])
        before = "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
        t = before + "".join(changed) + "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))
        code = decontam._codes
        assert decontam.banded_distance(code(p), code(t), -len(p), len(t), len(p))[0] == edits(p, t, True)
        found, end = decontam.banded_distance(code(p), code(t), len(before) - 2 * e, len(before) + 2 * e, e)
        assert found <= e
        part = t[max(0, end - len(p) - e) : end]
        back, length = decontam.banded_distance(code(p[::-1]), code(part[::-1]), -found, found, found, anchored=True)
        assert back == found == edits(p, t[end - length : end], False)


def test_ann_recall_and_odd_vectors(spark):
    x = np.random.default_rng(2).normal(size=(1500, 16)).astype("float32")
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [1.0, None] + [0.0] * 14, 0), (5300, [float("nan")] * 16, 0), (5400, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    out = ann.search(v).collect()
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10].tolist()
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(g[2] - d[g[1]]) < 1e-12 for g in got)
        hit, total = hit + len({g[1] for g in got} & set(want)), total + 10
        if q == 100:
            assert [g[1] for g in got] == want
    assert hit / total >= 0.9 and {r["query_id"] for r in out} == set(range(0, 1500, 100))
    assert ann.search(v.limit(0)).count() == 0


def test_ann_of_two_lengths_and_repeated_ids(spark):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(1, 40)] + [(100, [7.2, 0.0, 1.0]), (100, [9.2, 0.0, 1.0]), (200, [1.0, 2.0]), (201, [1.0, 3.0]), (202, [1.0, 9.0]), (202, [1.0, 2.5])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect())
    assert [(q, n, i) for q, n, i, _ in got] == [(100, 1, 7), (100, 2, 8), (100, 3, 6), (200, 1, 202), (200, 2, 201), (200, 3, 202)]


def test_toxicity_learns_words_and_index_is_exact(spark):
    r = random.Random(3)
    bad = ["awfulword", "nastything", "meanies"]
    rows, labels = [], []
    for i in range(400):
        t, y = prose(40, i), int(i % 5 == 1 or i % 7 == 1)
        rows.append((i, f"{t} {r.choice(bad)} {r.choice(bad)}" if y else t))
        labels.append((i, 1, y))
    lab = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.classify(docs(spark, [*rows, (900, None), (901, "")]), lab).collect()}
    assert all(out[i]["predicted"] == y for i, _, y in labels) and out[900]["predicted"] == out[901]["predicted"] == 0
    assert all(0 <= x["score"] <= 1 for x in out.values()) and 0 < sum(x["held_out"] for x in out.values()) < 402
    idf = {w: 1.0 + k / 7 for k, w in enumerate(WORDS[:60])}
    ex = [(i, i % 2, toxicity.terms_of(" ".join(r.choice(WORDS[:60]) for _ in range(9)))) for i in range(300)]
    index = toxicity.Index(idf, ex, block=16)

    def dense(tf):
        v = np.zeros(60)
        for k, w in enumerate(WORDS[:60]):
            v[k] = (1 + math.log(tf[w])) * idf[w] if w in tf else 0
        return v / (np.linalg.norm(v) or 1)

    m = np.array([dense(e[2]) for e in ex])
    for q in range(20):
        tf = toxicity.terms_of(" ".join(r.choice(WORDS[:60]) for _ in range(6)))
        c = m @ dense(tf)
        assert np.allclose([x[2] for x in index.nearest(tf)], np.sort(c[c > 0])[::-1][:15])
    assert toxicity.classify(docs(spark, rows[:3]), lab.limit(0)).filter("score > 0").count() == 0
    assert toxicity.classify(docs(spark, []), lab).count() == 0


def test_toxicity_of_clashing_labels_and_repeated_rows(spark):
    rows = [(i, f"{prose(30, i)} awfulword nastything" if i % 4 == 1 else prose(30, i)) for i in range(200)]
    schema = "doc_id long, quality int, toxic int, text string, score double, y int"
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1), "clash", 0.5, 3) for i in range(200)] + [(1, 1, 0, "again", 0.1, 0), (2, 1, 7, None, None, None)], schema)
    d = docs(spark, [*rows, rows[1], (2, "zzz another text of this id"), (500, "awfulword nastything " * 5000)])
    out = toxicity.classify(d, labels).collect()
    again = toxicity.classify(d.orderBy(F.desc("text")), labels).collect()
    key = lambda x: (x["doc_id"], x["score"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == 203
    assert {x["predicted"] for x in out if x["doc_id"] in (1, 500)} == {1} and len({x["score"] for x in out if x["doc_id"] == 1}) == 1


def test_pii_base_spans_and_redaction(spark):
    text = "é write a.b@x.org or 10.0.0.1, 300.1.1.1, card 4111 1111 1111 1111 / 4111-1111-1111-1112, call +1 (743) 555-3824 or +1 2"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    d = docs(spark, [(50, text), *ODD])
    finder = pii.fit(d)
    out = {r["doc_id"]: r for r in pii.digests(pii.find(d, finder)).collect()}
    assert out[50]["n_card"] == 1 and out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[50]["spans"].startswith("email:8:17,ip:21:29")
    red = {r["doc_id"]: r for r in pii.redact(d, finder).collect()}
    assert "<email>" in red[50]["text"] and "4111 1111" not in red[50]["text"] and red[50]["n_chars"] == len(red[50]["text"]) and red[7]["text"] == dict(ODD)[7]
    assert pii.find(docs(spark, []), pii.fit(docs(spark, []))).count() == 0


def test_pii_next_to_other_digits():
    class Shape:  # stands for trees that have learnt the usual forms
        def predict(self, x):
            return np.array([0.9 if (f[0], f[1]) in ((11, 4), (16, 1)) else 0.1 for f in x])

    phone, card = "+1 (826) 555-4081", "4111111111111111"
    text = f"call {phone} 190.137.223.204 or {card} 1234567812345678 end"
    found = pii.Finder({"phone": (Shape(), 0.5), "card": (Shape(), 0.95)}).added(text, pii.base_spans(text))
    assert [(k, text[a:b]) for k, a, b in found] == [("phone", phone), ("card", card)]
    assert max(b - a for _, a, b in pii.candidates("12 " * 5000)) <= 30


def test_pii_base_spans_equal_the_patterns_and_are_linear():
    import re
    import time

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice("a1.@-+ 25é") for _ in range(r.randint(0, 40)))
        assert [(m.start(), m.end()) for m in email.finditer(t)] == list(pii._emails(t)), t
        assert [(m.start(), m.end()) for m in ip.finditer(t)] == [x[:2] for x in pii._addresses(t)], t
    began = time.time()
    for t in ("a" * 1_000_000 + " @b.c", "1" * 1_000_000 + " 1.2", "1." * 500_000, "@" * 1_000_000, "+1 " * 300_000, "a@b.c " * 100_000):
        base = pii.base_spans(t)
        pii.Finder({}).added(t, base)
    assert time.time() - began < 60 and len(base) == 100_000


def test_pii_threshold_follows_precision():
    v, y = np.array([0.9, 0.8, 0.8, 0.7, 0.6, 0.2]), np.array([1, 1, 1, 1, 0, 0.0])
    assert math.isclose(pii.threshold(v, y, 0.95), 0.65) and math.isclose(pii.threshold(v, y, 0.8), 0.4) and pii.threshold(v, 1 - y, 0.95) == float("inf")


def test_trees_learn_a_rule():
    x = np.random.default_rng(0).normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    assert ((pii.Trees().fit(x[:1500], y[:1500]).predict(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


def test_quality_estimates_labellers_and_keeps_prose(spark):
    rng = np.random.default_rng(0)
    y, acc = rng.random(4000) < 0.7, [0.9, 0.8, 0.75, 0.6]
    pats = collections.Counter("".join("+" if (rng.random() < a) == g else "-" for a in acc) for g in y)
    prior, theta, post = quality.estimate(dict(pats))
    assert abs(prior - 0.7) < 0.12 and all(abs(theta[1, k, 2] - a) < 0.08 for k, a in enumerate(acc[:3])) and post["++++"] > 0.9 > 0.5 > post["----"]
    rows = [(i, prose(80, i).capitalize() + ".") for i in range(60)] + [(100 + i, "BUY!!! NOW### &&& " * 40 + str(i)) for i in range(20)] + [(200 + i, "a | b | c | " * 40 + str(i)) for i in range(20)] + [(300, None)]
    out = {r["doc_id"]: r["keep"] for r in quality.classify(docs(spark, rows)).collect()}
    assert all(out[i] for i in range(60)) and sum(out[i] for i in range(100, 120)) + sum(out[i] for i in range(200, 220)) <= 4
    assert quality.classify(docs(spark, [])).count() == 0


def test_lm_prefers_what_the_corpus_says(spark):
    rows = [(i, "the cat sat on the mat and the dog lay on the rug " * 5) for i in range(30)] + [(100, "mat the on on rug dog the and lay cat sat the " * 5), (101, None), (101, "")]
    d = docs(spark, rows)
    out = collections.defaultdict(list)
    for r in lm.score_own(lm.fit(d)).collect():
        out[r["doc_id"]].append(r)
    assert out[0][0]["per_token"] > out[100][0]["per_token"] and out[0][0]["n_tokens"] == 65
    assert [(r["n_tokens"], r["log_prob"], r["per_token"]) for r in out[101]] == [(0, 0.0, None)] * 2
    assert lm.score_own(lm.fit(docs(spark, []))).count() == 0 and lm.score(docs(spark, []), lm.fit(docs(spark, []))).count() == 0


def test_lm_counts_every_word_and_window(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 300)
    rare = [f"rare{i}" for i in range(150)]
    rows = [(i, f"{rare[i]} before middle{i} after{i} " * 2) for i in range(150)] * 2 + [(200 + i, f"{rare[i]} before middle{i + 1} after{i}") for i in range(100)] + [(400, f"{prose(300, 1)} once")]
    d = docs(spark, rows)
    model = lm.fit(d)
    texts = [t.split() for _, t in rows]
    word = collections.Counter(w for t in texts for w in t)
    windows = [list(zip([None, *t[:-1]], t, [*t[1:], None])) for t in texts]
    full, pair = collections.Counter(x for t in windows for x in t), collections.Counter((a, c) for t in windows for a, _, c in t)
    cls = {w: int(lm._classes(wordhash.words(w)[0], model.own)[0]) for w in word}
    cls[None] = lm.EDGE
    total = collections.Counter()
    for w, n in word.items():
        total[cls[w]] += n
    p = np.exp(model.logp)

    def log_prob(t, less):
        out = 0.0
        for a, w, c in t:
            net = p[(cls[a] * (lm.CLASSES + 1) + cls[c]) * lm.CLASSES + cls[w]] * word[w] / (total[cls[w]] + 1)
            out += math.log((full[a, w, c] - less + lm.SMOOTH * net) / (pair[a, c] - less + lm.SMOOTH))
        return out

    got = sorted((r["doc_id"], r["log_prob"]) for r in lm.score_own(model).collect())
    assert sorted((r["doc_id"], r["log_prob"]) for r in lm.score(d, model).collect()) == sorted((r["doc_id"], r["log_prob"]) for r in lm.score(d.select("*"), model).collect())
    want = sorted((i, log_prob(t, 1)) for (i, _), t in zip(rows, windows))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    other = {r["doc_id"]: r for r in lm.score(docs(spark, [rows[3], (900, "never seen"), (901, None)]), model).collect()}
    assert math.isclose(other[3]["log_prob"], log_prob(windows[3], 0)) and other[900]["log_prob"] < 0 and other[901]["per_token"] is None


def test_word_hashes_depend_on_the_word_alone():
    a, s, e = wordhash.words("éa bb  éa\nbb c")
    assert a[0] == a[2] and a[1] == a[3] and len({*a.tolist()}) == 3 and (s[1], e[1]) == (4, 6)
    assert len(wordhash.words(None)[0]) == 0 and wordhash.occurrences(np.array([5, 7, 5, 5])).tolist() == [0, 0, 1, 2]
