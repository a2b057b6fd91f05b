"""Exact-duplicate, type and age clusters, and what is kept of them.

Members are rows, not arrays: a cluster may hold a tenth of all files. The first file of a cluster by seq stays; sizes and firsts
are aggregations with map-side combine, so a hot hash costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.tables import shuffled


def current(files: DataFrame) -> DataFrame:
    """The row of the highest seq of each id."""
    cols = [c for c in files.columns if c != "id"]
    last = files.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), "seq").alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def members(rows: DataFrame, key: str, least: int = 1) -> DataFrame:
    """rows of the keys with at least so many rows, with the key's n and its first seq; null keys are dropped."""
    group = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where(F.col("n") >= least)
    return rows.join(shuffled(group), key)


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(hash, id, seq, path, size, n, first_seq, is_first) of every file whose content hash another file has too."""
    return members(files, "hash", 2).select("hash", "id", "seq", "path", "size", "n", "first_seq", (F.col("seq") == F.col("first_seq")).alias("is_first"))


def type_clusters(files: DataFrame) -> DataFrame:
    """(bucket, n, bytes, first_seq) of the buckets that hold files."""
    rows = files.select(tx.bucket("type").alias("bucket"), "size", "seq")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"))


def age_clusters(files: DataFrame, now: float) -> DataFrame:
    """(age, n, bytes): all three bands, empty ones too."""
    bands = files.sparkSession.createDataFrame([(a,) for a in tx.AGES], "age string")
    rows = files.select(tx.age_band("mtime", now).alias("age"), "size").groupBy("age").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return bands.join(rows, "age", "left").select("age", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def first_rows(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key, with their place pos from 1; a hot key is cut down within each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def dominant_extension(rows: DataFrame, key: str) -> DataFrame:
    """(key, ext, n): the most frequent extension of each key, the first seen (by seq) of equals."""
    count = rows.groupBy(key, "ext").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = count.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("low"), "ext")).alias("t"))
    return top.select(key, F.col("t.ext").alias("ext"), F.col("t.n").alias("n"))
