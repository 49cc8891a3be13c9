"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); set here only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/traceloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """As ``saved``, in buckets of ``key``: grouping by it needs no shuffle of these rows; ``dealt`` brings each bucket's rows together before (one file each)."""
    spark = df.sparkSession
    name = f"traceloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(buckets, key) if dealt else df
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is among the ``n`` that hash lowest: one number is found first, and filters the scan."""
    h = F.xxhash64(key)
    last = df.filter(F.col(key).isNotNull()).select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(F.col(key).isNotNull() & (h <= F.lit(last))) if last is not None else df.limit(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
