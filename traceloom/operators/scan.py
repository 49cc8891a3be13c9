"""Segmented prefix scans: running counts, sums and last values of any key, however many rows it has.

A window function needs all rows of a key in one task.  Here the rows of a key that holds more than
``SEGMENT_ROWS`` are cut into segments along their order; each segment is folded to one small row,
those rows are scanned per key and handed on, and every segment finishes by itself.  The keys that
are cut are fewer than ``MOST_KEYS`` by their definition, and each has at most ``MOST_SEGMENTS``
segments, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import _cut, plan_bytes

SEGMENT_ROWS, MOST_KEYS, MOST_SEGMENTS = 1_000_000, 1000, 200
#: Input of at most so many bytes is one task's work, whatever its keys.
ONE_TASK_BYTES = 64 << 20


def _equal(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[f"{c}_r"])
    return on


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_r") for c in columns], *[c for c in df.columns if c not in columns])


def segments(rows: DataFrame, keys: list[str], order: list[str], segment_rows: int | None = None) -> DataFrame | None:
    """``rows`` with ``seg_``: 0, 1, ... along the order of each key that is cut, null for the others; None if no key is cut.

    Rows of equal order stay in one segment, so the order should be total.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    total, largest = n.agg(F.sum("n_"), F.max("n_")).first()
    least = max(segment_rows or SEGMENT_ROWS, (total or 0) // MOST_KEYS)
    if (largest or 0) <= least:
        return None
    large = F.broadcast(_renamed(n.filter(F.col("n_") > least), keys))
    # some 20 sampled rows a segment give even bounds; what they are does not change any result
    parts = F.least(F.lit(MOST_SEGMENTS), F.ceil(F.col("n_") / least))
    some = rows.join(large, _equal(rows, large, keys)).filter(F.rand(7) < parts * 20 / F.col("n_"))
    sampled = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s_"), F.first(parts).alias("parts_"))
    bounds = sampled.select(*keys, F.expr("array_distinct(transform(sequence(1, greatest(1, cast(parts_ as int) - 1)), i -> s_[cast(floor(i * size(s_) / parts_) as int)]))").alias("bounds_"))
    bounds = F.broadcast(_renamed(_cut(bounds), keys))
    met = rows.join(bounds, _equal(rows, bounds, keys), "left")
    at = F.size(F.filter("bounds_", lambda b: b <= F.struct(*order)))
    return met.select(*[rows[c] for c in rows.columns], F.when(F.col("bounds_").isNotNull(), at).alias("seg_"))


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    counts: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    one_task_bytes: int | None = None,
    segment_rows: int | None = None,
) -> DataFrame:
    """``rows`` with, along ``order`` within ``keys``: how many rows so far meet a condition (``counts``), sums so far,
    the last value that is not null (``last``) and the value of the row before (``lags``).  No keys: one order of all rows."""
    counts, sums, last, lags = counts or {}, sums or {}, last or {}, lags or {}
    kept, inputs = rows.columns, {}
    for kind, named in (("c", counts), ("s", sums), ("l", last), ("g", lags)):
        for name, column in named.items():
            boxed = F.struct(column.alias("v"))
            inputs[f"{kind}_{name}"] = {"c": column.cast("boolean"), "s": column, "l": F.when(column.isNotNull(), boxed), "g": boxed}[kind]
    rows = rows.withColumns(inputs)
    if not keys:
        rows, keys = rows.withColumn("one_", F.lit(1)), ["one_"]
    cut = plan_bytes(rows) > (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes)
    if cut:  # what makes the rows runs once, not for each look at them
        rows = _cut(rows)
        met = segments(rows, keys, order, segment_rows)
        rows, cut = (met, True) if met is not None else (rows, False)
    if not cut:
        rows = rows.withColumn("seg_", F.lit(None).cast("int"))
    each = Window.partitionBy(*keys, "seg_").orderBy(*order)
    upto = each.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"at_{name}": F.count(F.when(F.col(f"c_{name}"), 1)).over(upto) for name in counts}
    local |= {f"at_{name}": F.sum(f"s_{name}").over(upto) for name in sums}
    local |= {f"at_{name}": F.last_value(F.col(f"l_{name}"), True).over(upto) for name in last}
    local |= {f"at_{name}": F.lag(f"g_{name}").over(each) for name in lags}
    done = rows.withColumns(local)
    if not cut:
        return done.select(*kept, *[F.col(f"at_{x}").alias(x) for x in [*counts, *sums]], *[F.col(f"at_{x}")["v"].alias(x) for x in [*last, *lags]])
    at = F.struct(*order)
    folded = rows.filter("seg_ is not null").groupBy(*keys, "seg_").agg(
        *[F.count(F.when(F.col(f"c_{x}"), 1)).alias(f"at_{x}") for x in counts],
        *[F.sum(f"s_{x}").alias(f"at_{x}") for x in sums],
        *[F.max_by(f"l_{x}", F.when(F.col(f"l_{x}").isNotNull(), at)).alias(f"at_{x}") for x in last],
        *[F.max_by(f"g_{x}", at).alias(f"at_{x}") for x in lags],
    )
    before = Window.partitionBy(*keys).orderBy("seg_").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(*keys, "seg_", *[F.sum(f"at_{x}").over(before).alias(f"to_{x}") for x in [*counts, *sums]], *[F.last_value(F.col(f"at_{x}"), True).over(before).alias(f"to_{x}") for x in [*last, *lags]])
    carried = F.broadcast(_renamed(carried, [*keys, "seg_"]))
    on = _equal(done, carried, keys) & (done["seg_"] == carried["seg__r"])
    met = done.join(carried, on, "left")
    added = [F.when(F.col(f"to_{x}").isNull(), F.col(f"at_{x}")).when(F.col(f"at_{x}").isNull(), F.col(f"to_{x}")).otherwise(F.col(f"at_{x}") + F.col(f"to_{x}")).alias(x) for x in [*counts, *sums]]
    return met.select(*[done[c] for c in kept], *added, *[F.coalesce(f"at_{x}", f"to_{x}")["v"].alias(x) for x in [*last, *lags]])
