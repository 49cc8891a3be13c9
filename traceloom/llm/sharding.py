"""Balanced label propagation: linked documents move towards their neighbours' shards.

Documents that share a key (equal texts in the query) are linked.  Linked rows are dealt out
round robin and then move in rounds of joins: each row counts its neighbours by shard and asks
for the shard that holds most of them.  How many rows may go from one shard to another is a
quota: as many as others hand on in a ring of shards, and what the target has room for below its
exact share of all rows.  Small groups go first, so that a group too large for any shard takes the room that is
left.  Rows without links fill every shard up to its share, so counts differ by one at most and
only groups larger than a shard's room are cut.

Nothing is gathered by key, shard or document: numbers within a shard come from counts of hash
buckets, votes of very common keys (fewer than 1,000 of them, by their definition) are broadcast,
and the driver sees one number for each pair of shards.

Defined cases: a null text has no bytes and counts as equal to the empty one; repeated rows and
repeated or null ``doc_id`` are rows of their own; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows of a hash bucket in which numbers are given out.
BUCKET_ROWS = 20_000


def _kept(df: DataFrame, name: str, n: int) -> DataFrame:
    """As ``saved``, in few files where there are few rows."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.coalesce(min(most, max(8, n // BUCKET_ROWS))), name, "snappy")


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, buckets: int) -> DataFrame:
    """``name``: 0, 1, 2, ... within ``by``, by ``order`` and then by the hash of ``id``, through counts of buckets."""
    orders = {f"o{i}_": c for i, c in enumerate(order)}
    r = rows.withColumns(orders | {"b_": F.pmod(F.xxhash64("id"), F.lit(buckets))})
    keys = [*by, *orders, "b_"]
    before = Window.partitionBy(*by).orderBy(*orders, "b_").rowsBetween(Window.unboundedPreceding, -1)
    firsts = r.groupBy(*keys).agg(F.count("*").alias("n_")).withColumn("first_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    inside = Window.partitionBy(*keys).orderBy("id")
    return r.join(firsts, keys).withColumn(name, F.col("first_") + F.row_number().over(inside) - 1).select(*rows.columns, name)


def by_number(number: str, sizes: list[int]) -> Column:
    """0 for the first ``sizes[0]`` numbers, 1 for the next ``sizes[1]``, and so on."""
    out, end = F.lit(len(sizes) - 1), sum(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        out, end = F.when(F.col(number) < end, k).otherwise(out), end - sizes[k]
    return out.cast("int")


def _cycle(left: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Steps of ``left`` that lead from a shard back to it; none if there are no such steps."""
    ahead: dict[int, list[int]] = {}
    for i, j in sorted(left, key=lambda k: (-left[k], k)):
        ahead.setdefault(i, []).append(j)
    done: set[int] = set()
    for start in sorted(ahead):
        path, tries = [start], [iter(ahead[start])]
        while path and start not in done:
            j = next(tries[-1], None)
            if j is None:
                done.add(path.pop())
                tries.pop()
            elif j in path:
                ring = [*path[path.index(j) :], j]
                return list(zip(ring, ring[1:]))
            elif j not in done and j in ahead:
                path.append(j)
                tries.append(iter(ahead[j]))
    return []


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from one shard to another: as many as others hand on in a ring, and a share of the target's room."""
    left, q = {k: n for k, n in asked.items() if n}, dict.fromkeys(asked, 0)
    while ring := _cycle(left):
        n = min(left[step] for step in ring)
        for step in ring:
            q[step] += n
            left[step] -= n
            if not left[step]:
                del left[step]
    for j, free in enumerate(room):
        rest = {i: n for (i, to), n in left.items() if to == j}
        total = sum(rest.values())
        for i, n in sorted(rest.items(), key=lambda x: (-x[1], x[0])):
            share = min(n, -(-free * n // total))
            q[i, j] += share
            free, total = free - share, total - n
    return q


def memberships(rows: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """``id``, ``key``, ``degree``, ``common``: the keys that a row shares with another row."""
    all_ = rows.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("value")) for i, k in enumerate(keys)])).alias("key")).filter("key.value is not null")
    degrees = _kept(all_.groupBy("key").agg(F.count("*").alias("degree")).filter("degree > 1"), "shard-degrees", n_rows)
    least = max(2, n_rows * len(keys) // 1000 + 1)  # so fewer than 1,000 keys are common
    common = F.broadcast(degrees.filter(F.col("degree") >= least))
    hot = all_.join(common, "key").withColumn("common", F.lit(True))
    rest = all_.join(common.select("key"), "key", "left_anti").join(degrees.filter(F.col("degree") < least), "key").withColumn("common", F.lit(False))
    return hot.unionByName(rest).select("id", "key", "degree", "common")


def votes(links: DataFrame, placed: DataFrame, n: int, round_no: int, open_shards: list[int]) -> DataFrame:
    """``id``, ``shard``, ``target``, ``size_class``: rows that would rather be in another shard, of those open to them."""
    at = links.join(placed, "id")
    tally = _kept(at.groupBy("key", "common", F.col("shard").alias("to")).agg(F.count("*").alias("n")), "shard-tally", n)
    hot = at.filter("common").join(F.broadcast(tally.filter("common").drop("common")), "key")
    rest = at.filter("not common").join(tally.filter("not common").drop("common"), "key")
    met = hot.unionByName(rest).filter(F.col("to").isin(open_shards) | (F.col("to") == F.col("shard")))
    each = met.groupBy("id", "shard", "to").agg(F.sum("n").alias("n"), F.min(F.struct("degree", "key")).alias("near"))
    tie = F.xxhash64("near.key", "to", F.lit(round_no))
    best = each.groupBy("id", "shard").agg(F.max(F.struct("n", tie.alias("tie"), "to")).alias("best"), F.min("near").alias("near"))
    return best.select("id", "shard", F.col("best.to").alias("target"), F.floor(F.log2("near.degree")).cast("int").alias("size_class"), F.pmod(F.xxhash64("near.key"), F.lit(64)).alias("key_part")).filter("target <> shard")


def propagate(links: DataFrame, shares: list[int], rounds: int = 16, report: dict | None = None) -> tuple[DataFrame, list[int]]:
    """``id``, ``shard`` of every linked row, and how many each shard holds: never more than its share."""
    shards = len(shares)
    ids = links.select("id").distinct()
    n = ids.count()
    buckets = max(16, n // BUCKET_ROWS)
    placed = _kept(numbered(ids, [], [], "number", buckets).select("id", F.pmod("number", F.lit(shards)).cast("int").alias("shard")), "shard-placed", n)
    load = [n // shards + (j < n % shards) for j in range(shards)]
    idle, moved = 0, []
    for round_no in range(rounds if n else 0):
        room = [share - held for share, held in zip(shares, load)]
        # by turns any shard may be asked for, which lets full ones exchange rows, or those with room (where all are full, half of them)
        some = [j for j in range(shards) if room[j] > 0] or [(j + round_no // 2) % shards for j in range(shards // 2)]
        open_shards = some if round_no % 2 else list(range(shards))
        asks = _kept(votes(links, placed, n, round_no, open_shards), "shard-asks", n)
        asked = {(r["shard"], r["target"]): r["n"] for r in asks.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        quota = {k: q for k, q in quotas(asked, room).items() if q}
        moved.append(sum(quota.values()))
        idle = 0 if quota else idle + 1
        if idle == 2:
            break
        if not quota:
            continue
        may = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for (i, j), q in sorted(quota.items()) for x in (i * shards + j, q)]), F.col("shard") * shards + F.col("target")), F.lit(0))
        goes = numbered(asks, ["shard", "target"], [F.col("size_class"), F.col("key_part")], "number", buckets).filter(F.col("number") < may).select("id", "target")
        placed = _kept(placed.join(goes, "id", "left").select("id", F.coalesce("target", "shard").alias("shard")), "shard-placed", n)
        for (i, j), q in quota.items():
            load[i] -= q
            load[j] += q
    if report is not None:
        report |= {"linked": n, "moved": moved, "load": load}
    return placed, load


def assign(rows: DataFrame, keys: list[str], shards: int = 8, rounds: int = 16, report: dict | None = None) -> DataFrame:
    """``rows`` (with a unique ``id``) and ``shard``, ``slot``; rows that share one of ``keys`` are linked.

    Shards hold as many rows as each other, or one more; slots of a shard are 0, 1, 2, ...
    ``report``, if given, receives the rows moved in each round and the linked rows of each shard.
    """
    n = rows.count()
    shares = [n // shards + (j < n % shards) for j in range(shards)]
    links = _kept(memberships(rows, keys, n), "shard-links", n)
    placed, load = propagate(links, shares, rounds, report)
    buckets = max(16, n // BUCKET_ROWS)
    free = numbered(rows.select("id").join(placed.select("id"), "id", "left_anti"), [], [], "number", buckets)
    filled = free.select("id", by_number("number", [share - held for share, held in zip(shares, load)]).alias("shard"))
    whole = _kept(rows.join(placed.unionByName(filled), "id"), "shard-rows", n)
    return numbered(whole, ["shard"], [], "slot", buckets)


def shard_documents(docs: DataFrame, shards: int = 8, report: dict | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``: documents of equal text are kept together."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("same_text"))
    rows = saved(rows.withColumn("id", F.monotonically_increasing_id()), "shard-ids", "snappy")
    return assign(rows, ["same_text"], shards, report=report).select("doc_id", "size", "text_crc32", "shard", "slot")
