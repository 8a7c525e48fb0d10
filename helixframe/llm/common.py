"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, one of our own in the warehouse, which is shared as well."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/helixframe-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs start from files, not from its lineage.

    release: have the driver collect its garbage, with which the files of shuffles no longer referred to go; with a large heap
    that may be never. To be asked for after steps that shuffle much.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe_hash(seed: int, *cols: Column) -> Column:
    """64-bit hash that tells null from any value in each position."""
    parts = [F.lit(seed)]
    for c in cols:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)
