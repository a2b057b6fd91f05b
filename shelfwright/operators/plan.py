"""The plan of a scan: deletes, moves, costs and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.operators.clusters import exact_duplicates
from shelfwright.tables import shuffled


def deletes(files: DataFrame, near_text: DataFrame, near_image: DataFrame | None = None) -> DataFrame:
    """(branch, id, path, reason, confidence): all but the first of each cluster, then scratch files; a file may be listed again."""
    path = files.select("id", "path")
    dup = exact_duplicates(files).where("not is_first").select(F.lit(0).alias("branch"), "id", "path", F.lit("exact_duplicate").alias("reason"), F.lit(0.99).alias("confidence"))

    def later(near: DataFrame, branch: int, name: str) -> DataFrame:
        rows = near.where("seq <> leader_seq").join(shuffled(path), "id", "left")
        return rows.select(F.lit(branch).alias("branch"), "id", "path", F.concat(F.lit(f"{name}:"), F.col("cluster_idx").cast("string")).alias("reason"), F.lit(0.7).alias("confidence"))

    temp = files.where(tx.is_temp(tx.basename("path"))).select(F.lit(3).alias("branch"), "id", "path", F.lit("temp_suffix").alias("reason"), F.lit(0.6).alias("confidence"))
    out = dup.union(later(near_text, 1, "near_duplicate_text"))
    if near_image is not None:
        out = out.union(later(near_image, 2, "near_duplicate_image"))
    return out.union(temp)


def moves(files: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, from_path, to_dir, reason) of every categorized file."""
    rows = categories.select("id", "bucket", "label").join(shuffled(files.select("id", "path")), "id", "left")
    return rows.select("id", F.col("path").alias("from_path"), F.concat("bucket", F.lit("/"), tx.slug("label"), F.lit("/")).alias("to_dir"), tx.cluster_key("bucket", "label").alias("reason"))


def summary(files: DataFrame, planned_deletes: DataFrame, planned_moves: DataFrame, near_text: DataFrame, near_image: DataFrame | None, rate: float) -> DataFrame:
    """One row of counts; deletes and moves count rows, not files."""
    n = lambda df, c, name: df.agg(F.count(c).alias(name))
    dup = files.where("hash is not null").groupBy("hash").count().where("count > 1")
    one = n(files, "*", "files_scanned")
    parts = [n(dup, "*", "duplicate_clusters"), near_text.agg(F.count_distinct("cluster_idx").alias("near_duplicate_clusters"))]
    if near_image is None:
        one = one.withColumn("image_similarity_clusters", F.lit(0).cast("long"))
    else:
        parts.append(near_image.agg(F.count_distinct("cluster_idx").alias("image_similarity_clusters")))
    parts += [n(planned_deletes, "*", "suggested_deletions"), n(planned_moves, "*", "suggested_moves")]
    for p in parts:  # rows of one
        one = one.withColumn("_k", F.lit(1)).join(p.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("storage_rate_per_gb", F.lit(float(rate)))


def audit(planned_moves: DataFrame, planned_deletes: DataFrame, present: DataFrame, root: str, quarantine: str) -> DataFrame:
    """(step, op, status, src, dst, reason): what a dry run would log for each entry; present (path) are the files there are.

    Entries without a path are not found; nothing else is done with them.
    """
    here = present.select(F.col("path").alias("src")).where("src is not null").distinct().withColumn("found", F.lit(True))
    base = root.rstrip("/")
    mv = planned_moves.select(F.lit(1).alias("step"), F.lit("move").alias("op"), F.col("from_path").alias("src"), F.concat(F.lit(base + "/"), F.regexp_replace("to_dir", r"^[/\\]+|[/\\]+$", ""), F.lit("/"), tx.basename("from_path")).alias("dst"), "reason")
    de = planned_deletes.select(F.lit(2).alias("step"), F.lit("delete").alias("op"), F.col("path").alias("src"), F.concat(F.lit(quarantine.rstrip("/") + "/"), tx.basename("path")).alias("dst"), "reason")
    rows = mv.union(de).join(here, "src", "left")
    ok = F.coalesce("found", F.lit(False))
    return rows.select("step", "op", F.when(ok, "dry_run").otherwise("skip_not_found").alias("status"), F.coalesce("src", F.lit("")).alias("src"), F.when(ok, F.col("dst")).alias("dst"), "reason")
