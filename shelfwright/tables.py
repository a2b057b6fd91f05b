"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests, one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shelfwright-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as a table to the shared folder and read back: short lineage, no recomputation, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shelfwright_path = path
    return back


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns of df, by their exact names, whatever other columns there are (also ones that differ in case only)."""
    places = []
    for n in names:
        same = [i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not same:
            raise ValueError(f"no column {n} among {df.columns}")
        places.append(same[0])
    bare = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return bare.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names)])


def forget(*dfs: DataFrame | None) -> None:
    """Delete tables of cut() that no later step reads."""
    for df in dfs:
        path = getattr(df, "_shelfwright_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: not for the size of its files, nor for a measured size that a session's threshold allows."""
    return df.hint("merge")


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with its 0-based place in the order of the given columns, without one task that sees all rows.

    Rows are range-partitioned and sorted; a partition's rows start after all rows of the partitions before it. What reaches the
    driver is one count for each partition.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = cut(parts, "numbered")
    part = F.shiftright("_at", 33)
    start, offset = {}, 0
    for r in parts.groupBy(part.alias("p")).count().orderBy("p").collect():
        start[r["p"]], offset = offset, offset + r["count"]
    if not start:
        return parts.withColumn(name, F.col("_at")).drop("_at")
    offsets = df.sparkSession.createDataFrame(list(start.items()), "_p long, _o long")
    own = parts.withColumn("_p", part.cast("long")).withColumn("_r", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return own.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_r")).drop("_p", "_o", "_r", "_at")
