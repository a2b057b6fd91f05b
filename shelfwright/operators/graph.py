"""Nodes and edges of a scan, with membership as rows of its own.

membership (kind, node_id, seq, id) is what all nodes are made of; a node's file_ids array exists only in the JSON document of a
small scan (sources/documents.py).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.operators.clusters import exact_duplicates, first_rows
from shelfwright.tables import shuffled

SAMPLE, LEAVES = 50, 200


def membership(files: DataFrame, categories: DataFrame, near: DataFrame, now: float) -> DataFrame:
    """(kind, node_id, seq, id) of subcategories, duplicates, types, ages and near duplicates (leader_clusters)."""
    dup = exact_duplicates(files).select(F.lit("duplicate_cluster").alias("kind"), F.concat(F.lit("dup:"), F.substring("hash", 1, 8)).alias("node_id"), "seq", "id")
    sub = categories.select(F.lit("subcategory").alias("kind"), F.concat(F.lit("sub:"), "bucket", F.lit(":"), "label").alias("node_id"), "seq", "id")
    typ = files.select(F.lit("type_cluster").alias("kind"), F.concat(F.lit("type:"), tx.bucket("type")).alias("node_id"), "seq", "id")
    age = files.select(F.lit("age_bucket").alias("kind"), F.concat(F.lit("age:"), tx.age_band("mtime", now)).alias("node_id"), "seq", "id").where("node_id is not null")
    txt = near.select(F.lit("near_duplicate_text").alias("kind"), F.concat(F.lit("neardup:"), F.col("cluster_idx").cast("string")).alias("node_id"), "seq", "id")
    return reduce(DataFrame.unionByName, [sub, dup, typ, age, txt])


def _node(kind: str, id_: Column, label: Column, why: Column, **meta: Column) -> list[Column]:
    kinds = {"hash": "string", "bucket": "string", "n_files": "long", "subcount": "long", "size": "long", "mtime": "double", "type": "string"}
    return [id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), *[meta.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()], why["rationale"].alias("rationale"), why["confidence"].cast("double").alias("confidence")]


def _why(text: Column | str, confidence: float) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("rationale"), F.lit(confidence).alias("confidence"))


def nodes(files: DataFrame, categories: DataFrame, near: DataFrame, summaries: DataFrame, now: float) -> DataFrame:
    """(id, kind, label, hash, bucket, n_files, subcount, size, mtime, type, rationale, confidence, summary) of all nodes."""
    spark = files.sparkSession
    dup = exact_duplicates(files).groupBy("hash").agg(F.count("*").alias("n"))
    typ = files.groupBy(tx.bucket("type").alias("b")).agg(F.count("*").alias("n"))
    age = files.groupBy(tx.age_band("mtime", now).alias("a")).agg(F.count("*").alias("n"))
    age = spark.createDataFrame([(a,) for a in tx.AGES], "a string").join(age, "a", "left").fillna(0, ["n"])
    cat = categories.select("bucket", "label").distinct().groupBy("bucket").agg(F.count("*").alias("n"))
    sub = categories.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    txt = near.groupBy("cluster_idx").agg(F.count("*").alias("n"))
    c = F.col
    blocks = [
        spark.range(1).select(*_node("root", F.lit("root"), F.lit("Scan Root"), _why("Where the scan begins.", 1.0))),
        cat.select(*_node("category", F.concat(F.lit("cat:"), "bucket"), c("bucket"), _why("All files of one bucket.", 0.8), subcount=c("n"))),
        sub.select(*_node("subcategory", F.concat(F.lit("sub:"), "bucket", F.lit(":"), "label"), F.concat("bucket", F.lit(" → "), "label"), _why(F.concat(F.lit("Files of "), "bucket", F.lit(" under "), "label"), 0.75), bucket=c("bucket"), n_files=c("n"))),
        dup.select(*_node("duplicate_cluster", F.concat(F.lit("dup:"), F.substring("hash", 1, 8)), F.concat(F.lit("Duplicates "), F.substring("hash", 1, 8)), tx.rationale(F.lit("duplicate_cluster"), "n"), hash=c("hash"), n_files=c("n"))),
        typ.select(*_node("type_cluster", F.concat(F.lit("type:"), "b"), F.concat(F.lit("Type: "), "b"), tx.rationale(F.lit("type_cluster"), "n"), bucket=c("b"), n_files=c("n"))),
        age.select(*_node("age_bucket", F.concat(F.lit("age:"), "a"), F.concat(F.lit("Age: "), "a"), tx.rationale(F.lit("age_bucket"), "n"), n_files=c("n"))),
        txt.select(*_node("near_duplicate_text", F.concat(F.lit("neardup:"), c("cluster_idx").cast("string")), F.concat(F.lit("Near-duplicates #"), c("cluster_idx").cast("string")), tx.rationale(F.lit("duplicate_cluster"), "n"), n_files=c("n"))),
        files.orderBy("seq").limit(LEAVES).select(*_node("file", c("id"), c("path"), _why("A scanned file.", 1.0), size=c("size"), mtime=c("mtime"), type=c("type"), hash=c("hash"))),
    ]
    one = reduce(DataFrame.unionByName, blocks)
    notes = summaries.groupBy(F.col("node_id").alias("id")).agg(F.max("summary").alias("summary"))
    has = F.col("kind").isin("subcategory", "duplicate_cluster", "type_cluster", "age_bucket", "near_duplicate_text")
    return one.join(shuffled(notes), "id", "left").withColumn("summary", F.when(has, F.coalesce("summary", F.lit(""))))


def edges(members: DataFrame, categories: DataFrame, ordered: bool = False) -> DataFrame:
    """(id, source, target, kind): root to clusters, categories to subcategories, and clusters to files.

    All files of exact duplicates, the first 50 of every other cluster. With ordered, also ord: the order of the edges of a source to files.
    """
    e = lambda s, t, k, o=None: [F.concat(F.lit("e-"), s, F.lit("-"), t).alias("id"), s.alias("source"), t.alias("target"), F.lit(k).alias("kind"), *([(F.lit(0) if o is None else F.col(o)).cast("long").alias("ord")] if ordered else [])]
    root = F.lit("root")
    heads = members.where("kind <> 'subcategory'").select("node_id").distinct().select(*e(root, F.col("node_id"), "contains"))
    bands = members.sparkSession.createDataFrame([(f"age:{a}",) for a in tx.AGES], "n string").select(*e(root, F.col("n"), "contains"))
    cats = categories.select(F.concat(F.lit("cat:"), "bucket").alias("c"), F.concat(F.lit("sub:"), "bucket", F.lit(":"), "label").alias("s")).distinct()
    up = cats.select("c").distinct().select(*e(root, F.col("c"), "contains"))
    down = cats.select(*e(F.col("c"), F.col("s"), "contains"))
    whole = members.where("kind = 'duplicate_cluster'").select(*e(F.col("node_id"), F.col("id"), "contains", "seq"))
    some = first_rows(members.where("kind <> 'duplicate_cluster'"), "node_id", "seq", SAMPLE).select(*e(F.col("node_id"), F.col("id"), "contains_sample", "seq"))
    return heads.union(bands).distinct().union(up).union(down).union(whole).union(some)
