"""Evaluation and data quality as single passes over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import dangling


def precision_coverage(reported: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Share of reported that is true and share of truth that is reported; an empty side gives 1."""
    r, t = reported.select(key).distinct().withColumn("r", F.lit(1)), truth.select(key).distinct().withColumn("t", F.lit(1))
    both = r.join(t, key, "full_outer")
    n = both.agg(F.count("r").alias("reported"), F.count("t").alias("truth"), F.count(F.when(F.col("r").isNotNull() & F.col("t").isNotNull(), 1)).alias("hits"))
    return n.select("reported", "truth", "hits", F.round(F.coalesce(F.try_divide("hits", "reported"), F.lit(1.0)), 4).alias("precision"), F.round(F.coalesce(F.try_divide("hits", "truth"), F.lit(1.0)), 4).alias("coverage"))


def attribute_accuracy(claims: DataFrame, truth: DataFrame, key: str, attributes: list[str], asserted_only: bool = False) -> DataFrame:
    """Q2, Q3: share of joined rows whose attributes all match; or, of the attributes that are asserted, the share that match."""
    t = truth.select(key, *[F.col(a).alias(f"{a}_t") for a in attributes])
    met = claims.join(t, key)
    same = [F.col(a).eqNullSafe(F.col(f"{a}_t")) for a in attributes]
    if not asserted_only:
        ok = reduce(lambda x, y: x & y, same)
        return met.agg(F.count("*").alias("graded"), F.count(F.when(ok, 1)).alias("right"), F.round(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)), 4).alias("accuracy"))
    graded = sum((F.col(a).isNotNull().cast("long") for a in attributes[1:]), F.col(attributes[0]).isNotNull().cast("long"))
    right = reduce(lambda x, y: x + y, [(F.col(a).isNotNull() & s).cast("long") for a, s in zip(attributes, same)])
    n = met.agg(F.coalesce(F.sum(graded), F.lit(0)).alias("graded"), F.coalesce(F.sum(right), F.lit(0)).alias("right"))
    return n.withColumn("accuracy", F.round(F.coalesce(F.try_divide("right", "graded"), F.lit(1.0)), 4))


def row_digest(df: DataFrame, columns: list[str]):
    """SHA-256 of a row's columns as text; nulls are told from empty text."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *cells), 256)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q4: a digest that no order of rows changes: count, and sums of the four quarters of each row's digest."""
    d = df.select(row_digest(df, columns).alias("d"))
    part = lambda i: F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    return d.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])


def digest_differences(a: dict[str, DataFrame], b: dict[str, DataFrame], columns: dict[str, list[str]]) -> list[str]:
    """Names of tables whose digests differ (one row of digest a table comes to the driver)."""
    return sorted(n for n in {*a, *b} if n not in a or n not in b or table_digest(a[n], columns[n]).first() != table_digest(b[n], columns[n]).first())


def set_divergence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Size of the symmetric difference over the size of both sets."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    n = x.join(y, key, "full_outer").agg(F.count("x").alias("size_a"), F.count("y").alias("size_b"), F.count(F.when(F.col("x").isNull() | F.col("y").isNull(), 1)).alias("differ"))
    return n.withColumn("divergence", F.round(F.coalesce(F.try_divide("differ", F.col("size_a") + F.col("size_b")), F.lit(0.0)), 6))


def union_truth(*tables: DataFrame) -> DataFrame:
    """G3."""
    return reduce(DataFrame.unionByName, tables).distinct()


def column_liveness(df: DataFrame, name: str) -> DataFrame:
    """Rows and non-null values of every column in one scan."""
    one = df.agg(F.count("*").alias("rows"), F.array(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null")) for c in df.columns]).alias("cols"))
    return one.select(F.lit(name).alias("table_name"), "rows", F.inline("cols"))


def relation_liveness(spark: SparkSession, edges: DataFrame, declared: list[str]) -> DataFrame:
    """Observed relations against the declared ones."""
    words = spark.createDataFrame([(r,) for r in declared], "relation string").withColumn("declared", F.lit(True))
    seen = edges.groupBy("relation").agg(F.count("*").alias("n"))
    return seen.join(words, "relation", "full_outer").select("relation", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("declared", F.lit(False)).alias("declared"))


#: table.column -> why it may be empty
EXPECTED_EMPTY = {
    "session_model_usage.cost_usd": "costs come from joining prices, so that changes of prices apply to the past",
    "edges.t_invalid": "null means current; no edge is ever replaced in place",
    "edges.t_expired": "null means current",
}


def liveness_report(tables: dict[str, DataFrame], relations: list[str], namespaces: dict[str, tuple[str, str]], expected: dict[str, str] | None = None) -> DataFrame:
    """Q11: findings about an index: ``finding``, ``subject``, ``n`` and ``reason``.

    empty_column and expected_empty (every row's value is null; ``expected`` has the reasons; columns of empty tables
    say nothing), dead_relation (declared, without an edge) and undeclared_relation, dangling_ref (``n`` endpoints of a
    namespace without an entity) and unmapped_namespace.  ``tables`` has edges and the entity tables; ``namespaces``
    maps a prefix to the (table, column) of its bare ids.  Each table is scanned once for its columns.
    """
    spark = tables["edges"].sparkSession
    expected = EXPECTED_EMPTY if expected is None else expected
    columns = reduce(DataFrame.union, [column_liveness(df, name) for name, df in sorted(tables.items())]).filter("non_null = 0 and rows > 0")
    reasons = spark.createDataFrame([*expected.items(), (None, None)], "subject string, reason string")
    empty = columns.select(F.concat_ws(".", "table_name", "column").alias("subject"), F.col("rows").alias("n")).join(F.broadcast(reasons), "subject", "left")
    found = empty.select(F.when(F.col("reason").isNull(), "empty_column").otherwise("expected_empty").alias("finding"), "subject", "n", "reason")
    none = F.lit(None).cast("string")
    r = relation_liveness(spark, tables["edges"], relations)
    found = found.union(r.filter("n = 0 or not declared").select(F.when(F.col("declared"), "dead_relation").otherwise("undeclared_relation"), "relation", "n", none))
    known = {name: (tables[t].filter(F.col(c).isNotNull()), c) for name, (t, c) in namespaces.items()}
    ends = dangling(tables["edges"], known)
    mapped = F.col("namespace").isin(*namespaces)
    found = found.union(ends.filter(~mapped | (F.col("dangling") > 0)).select(F.when(mapped, "dangling_ref").otherwise("unmapped_namespace"), "namespace", F.when(mapped, F.col("dangling")).otherwise(F.col("edges")), none))
    return found


def builds_agree(builds: dict[str, dict[str, DataFrame]], columns: dict[str, list[str]]) -> DataFrame:
    """Q5: digests of each table of several builds (full, incremental, rotated) side by side: ``table_name``, ``builds``
    that were compared, how many different ``digests`` they have, and ``equal``."""
    rows = None
    for build, tables in builds.items():
        for name, df in tables.items():
            d = table_digest(df, columns[name])
            one = d.select(F.lit(name).alias("table_name"), F.lit(build).alias("build"), F.to_json(F.struct(*d.columns)).alias("digest"))
            rows = one if rows is None else rows.union(one)
    return rows.groupBy("table_name").agg(F.count("*").alias("builds"), F.countDistinct("digest").alias("digests")).withColumn("equal", (F.col("digests") == 1) & (F.col("builds") == len(builds)))


def freshness(transcripts: DataFrame) -> DataFrame:
    """Transcripts by status, bytes still to read and the latest indexing."""
    return transcripts.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("size") - F.col("offset"), F.lit(0))).alias("lag_bytes"), F.max("indexed_at").alias("indexed_at"))


def missing_sources(recorded: DataFrame, listed: DataFrame) -> DataFrame:
    """Transcripts on record whose file is gone; their facts stay."""
    return recorded.filter("status = 'ok'").join(listed.select("path").distinct(), "path", "left_anti").withColumn("status", F.lit("missing"))


def funnel(counts: DataFrame, steps: list[str]) -> DataFrame:
    """Q8: each step's share of the step before it."""
    return counts.select("*", *[F.round(F.coalesce(F.try_divide(F.col(b), F.col(a)), F.lit(1.0)), 4).alias(f"{b}_share") for a, b in zip(steps, steps[1:])])


def stability(samples: DataFrame) -> DataFrame:
    """Q9: rate of new templates in the second half of a growth curve against the first, before eviction."""
    s = samples.filter("not evicting")
    half = s.agg(F.max("blobs").alias("end"), F.max("templates").alias("all_templates"))
    mid = s.join(F.broadcast(half), F.col("blobs") <= F.col("end") / 2).agg(F.max("blobs").alias("mid"), F.max("templates").alias("mid_templates"))
    both = half.join(F.broadcast(mid))
    first, second = F.try_divide("mid_templates", "mid"), F.try_divide(F.col("all_templates") - F.col("mid_templates"), F.col("end") - F.col("mid"))
    return both.select(F.round(first, 6).alias("first_rate"), F.round(second, 6).alias("second_rate"), F.round(F.try_divide(second, first), 4).alias("ratio"))


def false_merges(members: DataFrame, clusters: int = 40, each: int = 25) -> DataFrame:
    """Of the largest clusters, those whose first members hold more than one error class."""
    from pyspark.sql import Window

    top = members.groupBy("template_id").count().orderBy(F.desc("count"), "template_id").limit(clusters).select("template_id")
    w = Window.partitionBy("template_id").orderBy("arrival")
    some = members.join(F.broadcast(top), "template_id").withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= each)
    return some.groupBy("template_id").agg(F.countDistinct("error_class").alias("classes")).withColumn("false_merge", F.col("classes") > 1)


def gates(spark: SparkSession, rows: list[tuple[str, float, float, bool]]) -> DataFrame:
    """Q12: name, value, threshold and whether it passes (``at_least`` or else at most)."""
    df = spark.createDataFrame(rows, "name string, value double, threshold double, at_least boolean")
    return df.withColumn("pass", F.when(F.col("at_least"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold")))
