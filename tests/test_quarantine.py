"""Chunks of bad files and offsets of very long texts, against plain Python."""

import random

import pytest

from traceloom.sources import transcripts

FORCED = {"one_task_bytes": 0, "segment_rows": 20}


def chunked(lines, chunk):
    """Offsets at which chunks begin."""
    starts, at, i = [], 0, 0
    while i < len(lines):
        starts.append(at)
        window = chunk
        while len(lines[i]) + 1 > window:
            window *= 2
        end = at
        while i < len(lines) and end + len(lines[i]) + 1 <= at + window:
            end += len(lines[i]) + 1
            i += 1
        at = end
    return starts


@pytest.mark.parametrize("limits", [{}, FORCED])
def test_good_chunks_before_the_first_bad_one_stay(spark, limits):
    r = random.Random(7)
    files, rows, want, bads = {}, [], {}, {}
    for f in range(12):
        lines = ['{"a": "' + "x" * r.choice([0, 3, 20, 90, 400]) + '"}' for _ in range(r.randint(1, 60))]
        if f % 3:
            lines[r.randrange(len(lines))] = r.choice(["{broken", "[1]", "7"])
        if f == 10:
            lines[0] = "{"
        files[f"f{f}"] = lines
    for path, lines in files.items():
        at, offsets = 0, []
        for x in lines:
            offsets.append(at)
            rows.append((path, at, len(x), x))
            at += len(x) + 1
        bad = [o for o, x in zip(offsets, lines) if not x.endswith("}")]
        keep = max(s for s in chunked(lines, 64) if s <= bad[0]) if bad else at
        want[path] = [o for o in offsets if o < keep]
        if bad:
            bads[path] = (bad[0], keep)
    good, bad = transcripts.quarantining(spark.createDataFrame(rows, "path string, offset long, length int, text string"), 64, **limits)
    got = {}
    for x in good.select("path", "offset").collect():
        got.setdefault(x["path"], []).append(x["offset"])
    assert {p: sorted(o) for p, o in got.items()} == {p: o for p, o in want.items() if o}
    assert {x["path"]: (x["first_bad_offset"], x["kept_bytes"]) for x in bad.collect()} == bads


def test_offsets_of_many_lines_in_one_text(spark):
    r = random.Random(8)
    texts = ["\n".join("é" * r.randint(0, 3) for _ in range(n)) for n in (1, 2, 256, 257, 258, 1000)] + ["", "\n", "x" * 1_000_000 + "\ny\n", "\n".join(map(str, range(80_000)))]
    got = {}
    for x in transcripts.text_lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect():
        got.setdefault(x["k"], []).append((x["line_no"], x["offset"], x["length"], x["text"]))
    for k, t in enumerate(texts):
        want, at = [], 0
        for i, line in enumerate(t.split("\n")[:-1]):
            n = len(line.encode())
            want.append((i, at, n, line))
            at += n + 1
        assert sorted(got.get(k, [])) == want
