"""Personal data: base patterns, and more spans by boosted trees over high-recall candidates.

Generators propose overlapping spans: anything around an at sign or a spelt-out one, and every run
of groups of digits with separators that is no longer than its kind.  Candidates that pass the strict base patterns of their kind are
positives, all others (for e-mail also spans of plain prose) unlabelled negatives; boosted trees learn the format
and context of real ones from features that do not see the strict test itself.  All candidates of all documents are
grown on: Spark counts equal ones, finds the bins, and sums each level of the trees over them.  A threshold for each
kind is calibrated on the precision of all candidates against the positives, each scored by trees that were grown on
the other half of the texts; those that reach it are added, and for cards a passed checksum counts
besides.  Base spans always stay.

Defined cases: null and empty texts have no spans; spans of one kind never overlap, a base span
wins over an added one and a more probable (then longer, then earlier) one over another; repeated rows give a row each; an
empty table gives an empty result, and with fewer than 20 positives or 20 negatives of a
kind nothing is added for it; very long texts take time in proportion to their length; columns other than ``doc_id`` and ``text`` are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import saved
from .trees import Growing, Trees, grow

KINDS = ("email", "ip", "card", "phone")
#: Different candidates that a task of a level sums up, and that a task that counts them holds.
TASK_ROWS, HELD_ROWS = 500_000, 8_192

#: E-mail: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, found from its at sign in both directions.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: IP: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), found in whole runs of dotted numbers.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: High-recall generators.
LOOSE_EMAIL = re.compile(r"[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,4}", re.I)
LOOSE_DIGITS = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_GROUP = re.compile(r"[+(]?[0-9]+")
MOST_DIGITS = 19
#: Share of labelled positives among the held-out candidates that reach a threshold.
PRECISION = 0.95
_AT, _DOT = re.compile(r" ?(?:\(at\)|\[at\]) ?", re.I), re.compile(r" ?(?:\(dot\)|\[dot\]) ?", re.I)
#: Three words from the start of one; a word is read once, however long.
_PROSE = re.compile(r"(?<!\w)\w++ \w++ \w++")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def checked(span: str) -> bool:
    digits = "".join(_DIGIT.findall(span))
    return 16 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str):
    """Leftmost non-overlapping e-mails, in time proportional to the text."""
    free, at = 0, text.find("@")  # what comes before ``free`` belongs to a match or holds another at sign
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            local = NOT_LOCAL.search(text[free:at][::-1])
            start = at - local.start() if local else free
            if start < at:
                yield start, domain.end()
                free = domain.end()
        free = max(free, at + 1)
        at = text.find("@", at + 1)


def _addresses(text: str):
    """Leftmost non-overlapping groups of four dotted numbers."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            parts, at = run[0].split("."), run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                yield at, end, four
                at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, in order of kind and start; linear in the text's length."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b, four in _addresses(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Taken:
    """Disjoint spans in order; those that overlap become one."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def candidates(text: str):
    """Spans of high recall, one after the other; the digits ones are offered for every kind of digits."""
    low = text.lower() if "t)" in text.lower() or "t]" in text.lower() else ""
    if "@" in text or "(at)" in low or "[at]" in low:
        yield from (("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text))
    if not _DIGIT.search(text):
        return
    for m in LOOSE_DIGITS.finditer(text):
        groups = [(g.start(), g.end(), g.end() - g.start() - (g[0][0] in "+(")) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):  # every run of groups, as long as the digits may be of one kind
                _, end, k = groups[j]
                n += k
                if n > MOST_DIGITS:
                    break
                if 7 <= n <= 12 and text.count(".", start, end) == 3:
                    yield "ip", start, end
                if n >= 12:
                    yield "card", start, end
                if 7 <= n <= 15:
                    yield "phone", start, end


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span, without the strict tests (checksum, leading plus, octets)."""
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 24]
    if kind == "email":  # spelt-out signs look as the signs themselves
        s = _DOT.sub(".", _AT.sub("@", s))
    body = s.lstrip("+(")
    groups = re.findall(r"[0-9]+", body)
    digits = sum(map(len, groups))
    left, right = before[-1:] or " ", after[:1] or " "
    words = re.findall(r"[^\W\d_]+", before)
    last = words[-1].lower() if words else ""
    return [
        digits, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        body.count(" "), body.count("-"), body.count("."), body.count("(") + s.count(")"), s.count("@"), sum(c.isalpha() for c in s), len(s),
        float(left.isalnum()), float(left in "([{<\"':,;=#/&$"), float(left.isspace()), float(right.isalnum()), float(right in ")]}>\"':,;.=#/&$"), float(right.isspace()),
        sum(c.isdigit() for c in before) / 24, sum(c.isdigit() for c in after) / 24, sum(c.isalpha() for c in before) / 24, sum(c.isalpha() for c in after) / 24,
        float(last in ("tel", "phone", "call", "mobile", "fax", "cell", "telefon")), float(last in ("card", "visa", "mastercard", "payment", "karte")), float(last in ("mail", "email", "contact", "write")), float(last in ("ip", "host", "server", "address", "from")),
        float(s[-4:].lower() in (".com", ".org", ".net")),
    ]


class Finder:
    def __init__(self, models: dict[str, tuple[Trees, float]]):
        self.models = models

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        taken = Taken((a, b) for _, a, b in base)
        likely: dict[str, list] = {}
        # what a base span of any kind covers is found already
        free = (c for c in candidates(text) if c[0] in self.models and not taken.meets(c[1], c[2]))
        while some := list(islice(free, 4096)):  # a few at a time, of which those that reach their threshold stay
            for kind in dict.fromkeys(c[0] for c in some):
                found = [c for c in some if c[0] == kind]
                model, least = self.models[kind]
                p = model.predict(np.array([features(text, *c) for c in found]))
                if kind == "card":  # the features don't see the checksum; one number in ten passes it by chance
                    p = np.array([10 * v / (9 * v + 1) if checked(text[a:b]) else v for (_, a, b), v in zip(found, p)])
                likely.setdefault(kind, []).extend((c, v) for c, v in zip(found, p.tolist()) if v >= least)
        out = []
        for kind, found in likely.items():
            kept, chosen = [], Taken()
            for c, _ in sorted(found, key=lambda x: (-x[1], x[0][1] - x[0][2], x[0][1])):
                if not chosen.meets(c[1], c[2]):
                    chosen.add(c[1], c[2])
                    kept.append(c)
            out += sorted(kept, key=lambda c: c[1])
        return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def threshold(held_out: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """Of the held-out candidates that reach it, the labelled ones are the asked share: halfway from the least such score to the next below; infinite if none is."""
    order = np.argsort(-held_out, kind="stable")
    v, share = held_out[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(v[1:] != v[:-1], True)  # candidates of one score pass together
    good = np.flatnonzero(last & (share >= precision))
    if not len(good):
        return float("inf")
    at = good[-1]
    return float((v[at] + v[at + 1]) / 2) if at + 1 < len(v) else float(v[at])


def examples(text: str):
    """Kind, label and features of the candidates of a text that teach, one after the other."""
    spans = base_spans(text)
    covered, exact, emails = Taken((a, e) for _, a, e in spans), set(spans), Taken((a, e) for k, a, e in spans if k == "email")
    for k, a, e in candidates(text):
        touched = covered.meets(a, e)
        # runs of digits that are a part of a base span or more than it teach nothing
        hit = touched and (emails.meets(a, e) if k == "email" else (k, a, e) in exact or (k, a + 1, e) in exact)
        if hit or not touched:
            yield k, int(hit), features(text, k, a, e)
    prose = _PROSE.search(text)
    if prose and "@" not in prose[0]:
        yield "email", 0, features(text, "email", prose.start(), prose.end())


_COUNTS = ("n0", "p0", "n1", "p1")


def counted(docs: DataFrame) -> DataFrame:
    """Different candidates of all documents: ``kind``, ``x`` (features as bytes), and for both halves of the texts how many they are and how many positive."""

    def rows(batches):
        seen: dict[tuple[str, bytes], list[int]] = {}

        def out():
            columns = [[k for k, _ in seen], [x for _, x in seen], *zip(*seen.values())]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.binary(), *[pa.int64()] * 4])], ["kind", "x", *_COUNTS])

        for b in batches:
            for half, text in zip(b.column(0).to_pylist(), b.column(1)):
                for k, y, x in examples(text.as_py()):
                    n = seen.setdefault((k, np.array(x).tobytes()), [0] * 4)
                    n[2 * half] += 1
                    n[2 * half + 1] += y
                    if len(seen) >= HELD_ROWS:
                        yield out()
        if seen:
            yield out()

    texts = _plain(docs).filter("text is not null").select(F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    each = texts.mapInArrow(rows, "kind string, x binary, n0 long, p0 long, n1 long, p1 long")
    return each.groupBy("kind", "x").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _by_kind(batch: pa.RecordBatch):
    """Kind, features and counts (as ``_COUNTS``) of the rows of a batch, kind by kind."""
    kinds, n = np.array(batch.column(0).to_pylist()), np.stack([batch.column(i).to_numpy() for i in range(2, 6)], axis=1)
    x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(len(n), -1) if len(n) else n
    for k in np.unique(kinds):
        yield str(k), x[kinds == k], n[kinds == k]


def _cuts(different: DataFrame) -> dict[str, list[np.ndarray]]:
    """The bounds of the bins of each kind's features: quantiles of all candidates."""

    def values(batches):
        for b in batches:
            for kind, x, n in _by_kind(b):
                for j, c in enumerate(x.T):
                    v, at = np.unique(c, return_inverse=True)
                    many = np.bincount(at, n[:, 0] + n[:, 2]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(v)), pa.array([j] * len(v), pa.int32()), pa.array(v), pa.array(many)], ["kind", "j", "v", "n"])

    found = different.mapInArrow(values, "kind string, j int, v double, n long").groupBy("kind", "j").agg(F.percentile("v", Trees().quantiles(), F.col("n")).alias("q")).collect()
    return {k: [np.unique(r["q"]) for r in sorted((r for r in found if r["kind"] == k), key=lambda r: r["j"])] for k in {r["kind"] for r in found}}


def _level(blocks: RDD, now: dict[tuple[str, int], Growing]) -> dict[tuple[str, int], np.ndarray]:
    """The sums of a level of all models over all blocks; the tasks' sums are added by tasks, so what reaches the driver is small."""

    def sums(rows):
        total = {}
        for kind, x, n in rows:
            n = np.frombuffer(n, np.int64).reshape(-1, 4)
            x = np.frombuffer(x, np.uint8).reshape(len(n), -1)
            for (k, part), g in now.items():
                if k == kind:
                    mine = n[:, :2] + n[:, 2:] if part == 2 else n[:, 2 * part : 2 * part + 2]
                    total[k, part] = total.get((k, part), 0) + g.sums(x, mine[:, 0], mine[:, 1])
        yield total

    return blocks.mapPartitions(sums).treeReduce(lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a | b})


def thresholds(scores: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """``threshold`` of each kind, from how many candidates of each score there are: ``kind``, ``v``, ``n``, ``y``."""
    scores = saved(scores.select("kind", (-F.col("v")).alias("u"), "n", "y"), "pii-scores")
    upto = running(scores, ["kind"], ["u"], sums={"all_n": F.col("n"), "all_y": F.col("y")})
    last = {r["kind"]: r["u"] for r in upto.filter(F.col("all_y") / F.col("all_n") >= precision).groupBy("kind").agg(F.max("u").alias("u")).collect()}
    if not last:
        return {}
    at = F.create_map(*[F.lit(x) for item in last.items() for x in item])[F.col("kind")]
    below = {r["kind"]: r["u"] for r in scores.filter(F.col("u") > at).groupBy("kind").agg(F.min("u").alias("u")).collect()}
    return {k: -(u + below.get(k, u)) / 2 for k, u in last.items()}


def fit(docs: DataFrame) -> Finder:
    """Trees and thresholds from the candidates of all documents: trees of all, and of either half for the threshold."""
    different = saved(counted(docs), "pii-candidates")
    of_kind = {r["kind"]: r for r in different.groupBy("kind").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in _COUNTS]).collect()}
    kinds = [k for k in KINDS if k in of_kind and (r := of_kind[k])["p0"] + r["p1"] >= 20 and r["n0"] + r["n1"] - r["p0"] - r["p1"] >= 20]
    if not kinds:
        return Finder({})
    different = different.filter(F.col("kind").isin(kinds))
    cuts = _cuts(different)
    models = {}
    for k in kinds:
        n0, p0, n1, p1 = (of_kind[k][c] for c in _COUNTS)
        for part, (n, p) in enumerate(((n0, p0), (n1, p1), (n0 + n1, p0 + p1))):
            models[k, part] = Trees().begin(cuts[k], n, p)
    bins = {k: models[k, 2] for k in kinds}

    def packed(batches):
        for b in batches:
            found = [(k, bins[k].binned(x).tobytes(), n.tobytes()) for k, x, n in _by_kind(b)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.binary(), pa.binary()))], ["kind", "x", "n"])

    tasks = -(-sum(of_kind[k]["rows"] for k in kinds) // TASK_ROWS)
    blocks = saved(different.coalesce(tasks).mapInArrow(packed, "kind string, x binary, n binary"), "pii-binned")
    few = blocks.coalesce(tasks).rdd
    grow(models, lambda now: _level(few, now))

    def scored(batches):
        for b in batches:
            for kind, x, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                n = np.frombuffer(n.as_py(), np.int64).reshape(-1, 4)
                x = np.frombuffer(x.as_py(), np.uint8).reshape(len(n), -1)
                for half in (0, 1):
                    mine = n[:, 2 * half] > 0
                    v = models[kind, 1 - half].of_binned(x[mine])
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(v), pa.string()), pa.array(v), *(pa.array(n[mine, 2 * half + i]) for i in (0, 1))], ["kind", "v", "n", "y"])

    least = thresholds(blocks.mapInArrow(scored, "kind string, v double, n long, y long").groupBy("kind", "v").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    return Finder({k: (models[k, 2], least.get(k, float("inf"))) for k in kinds})


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, finder: Finder) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (all of them), each by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(finder)

    def rows(batches):
        order = {k: i for i, k in enumerate(KINDS)}
        as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            base, spans = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append(as_dicts(found))
                spans.append(as_dicts(sorted(found + sent.value.added(text, found), key=lambda s: (order[s[0]], s[1]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, SPAN), pa.array(spans, SPAN)], ["doc_id", "base", "spans"])

    return _plain(docs).mapInArrow(rows, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; ``n_chars``, if there, follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(finder)

    def clean(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        spans = sorted(base + sent.value.added(text, base), key=lambda s: (s[1], -s[2])) if text else []
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join(out) + text[at:] if spans else text

    def rows(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array([clean(x.as_py()) for x in b.column(i)], pa.string()))

    out = docs.mapInArrow(rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: lambda s: s["kind"] == kind
    return found.select("doc_id", *[F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
