"""Workspace documents, prices, triage logs, and the sinks of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str, schema: str, glob: str = "*.md") -> tuple[DataFrame, DataFrame]:
    """Front matter (or a whole YAML file) by ``schema`` with ``body``, and the files that do not parse.

    Front matter is read by PyYAML, which the driver and every worker must have; values go through Spark's own JSON reader.
    """
    import yaml  # noqa: F401  missing here, it is missing before any task starts

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", F.col("content").cast("string").alias("text"))

    def parse(batches):
        import json

        import yaml

        for pdf in batches:
            out = []
            for p, text in zip(pdf["path"], pdf["text"]):
                head, body = text, ""
                if text.startswith("---\n"):
                    head, _, body = text[4:].partition("\n---")
                    body = body.partition("\n")[2]
                try:
                    value = yaml.safe_load(head)
                    out.append((p, json.dumps(value, default=str) if isinstance(value, dict) else None, body, None if isinstance(value, dict) else "not a mapping"))
                except Exception as e:  # noqa: BLE001  every unreadable file is reported
                    out.append((p, None, body, str(e)[:200]))
            yield type(pdf)(out, columns=["path", "json", "body", "error"])

    rows = files.mapInPandas(parse, "path string, json string, body string, error string")
    good = rows.filter("error is null").select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("file"), F.from_json("json", schema).alias("d"), "body").select("path", "file", "d.*", "body")
    return good, rows.filter("error is not null").select("path", "error")


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Model -> rates of a versioned JSON price map."""
    raw = spark.read.schema("version string, models map<string, struct<in: double, out: double, cacheRead: double, cacheCreation: double>>").option("multiLine", "true").json(path)
    return raw.select("version", F.explode("models").alias("model", "r")).select("version", "model", F.col("r.in").alias("input"), F.col("r.out").alias("output"), F.col("r.cacheRead").alias("cache_read"), F.col("r.cacheCreation").alias("cache_creation"))


def triaged(spark: SparkSession, path: str) -> DataFrame:
    """A10."""
    return spark.read.csv(path, sep="\t", schema="at string, action string, ref string, extra string").select("ref").distinct()


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each table as Parquet under ``path``; a rebuild overwrites."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def append_occurrences(rows: DataFrame, path: str) -> None:
    """JSON lines; ``compact`` writes them anew."""
    rows.write.mode("append").json(path)


def compact(spark: SparkSession, path: str, to: str, schema: str, keys: list[str]) -> DataFrame:
    rows = spark.read.schema(schema).json(path).dropDuplicates(keys)
    rows.write.mode("overwrite").json(to)
    return spark.read.schema(schema).json(to)


def clip(body, lines: int):
    return F.array_join(F.slice(F.split(body, "\n"), 1, lines), "\n")


def export_snapshot(initiatives: DataFrame, tasks: DataFrame, sessions: DataFrame, path: str, latest: int = 5, lines: int = 40) -> None:
    """One JSON document per initiative with its tasks and the clipped bodies of its latest sessions."""
    from pyspark.sql import Window

    w = Window.partitionBy("slug").orderBy(F.desc("ended"), "file")
    some = sessions.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= latest).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("n_", "file", clip(F.col("body"), lines).alias("body")))).alias("sessions"))
    t = tasks.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("priority", "id", "title", "status"))).alias("tasks"))
    initiatives.join(t, "slug", "left").join(some, "slug", "left").write.mode("overwrite").json(path)
