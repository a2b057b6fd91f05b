"""Files rows as they land in a folder, with their derived columns.

The engine itself is a batch; this is the entry for rows that keep arriving. A watermark over seen_at bounds the state that drops
rows delivered twice (same id, scan and seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.functions import text as tx

SCHEMA = "seq long, id string, path string, size long, mtime double, type string, hash string, scan_id int, seen_at timestamp"


def derived(files: DataFrame) -> DataFrame:
    """files with name, ext, bucket and whether the id is that of the path; works on batches and streams."""
    name = tx.basename("path")
    return files.select("*", name.alias("name"), tx.suffix(name).alias("ext"), tx.bucket("type").alias("bucket"), (F.md5(F.encode("path", "UTF-8")) == F.col("id")).alias("id_ok"))


def landing(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """A stream over parquet files that land in a folder."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return derived(rows.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["id", "scan_id", "seq"]))
