"""Queries over a graph and a plan: filters, layout, inspection and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.operators.clusters import first_rows
from shelfwright.tables import numbered, shuffled

#: Kinds of nodes in the order of their rows. Fixed values.
ROWS = ("root", "category", "subcategory", "type_cluster", "duplicate_cluster", "near_duplicate_text", "age_bucket", "file")
GROUP, LINKED = 500, 40


def filter_nodes(nodes: DataFrame, confidence: Column | str, kind: str = "all", min_confidence: float = 0.0, search: str = "") -> DataFrame:
    """Nodes of a kind, of a confidence (1 where there is none) and with a text in their label, whatever its case."""
    conf = F.col(confidence) if isinstance(confidence, str) else confidence
    out = nodes.where(F.coalesce(conf, F.lit(1.0)) >= min_confidence)
    if kind != "all":
        out = out.where(F.col("kind") == kind)
    return out.where(F.contains(F.lower("label"), F.lit(search.lower()))) if search else out


def visible_edges(edges: DataFrame, shown: DataFrame, mode: str = "none", selected: str | None = None) -> DataFrame:
    """Edges whose ends are both shown: none of them, all, or those at the selected node."""
    if mode == "none" or (mode == "selected" and selected is None):
        return edges.limit(0)
    ids = shown.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return both if mode == "all" else both.where((F.col("source") == selected) | (F.col("target") == selected))


def layout(nodes: DataFrame, order: str, *within: str) -> DataFrame:
    """nodes with x and y: kinds are rows 160 apart, nodes of a row 284 apart in the given order; unknown kinds stand with files."""
    row = F.lit(len(ROWS) - 1)
    for i, k in enumerate(ROWS[:-1]):
        row = F.when(F.col("kind") == k, i).otherwise(row)
    place = F.row_number().over(Window.partitionBy(*within, "row").orderBy(order)) - 1
    return nodes.withColumn("row", row).withColumn("x", 40 + place * 284).withColumn("y", 40 + F.col("row") * 160).drop("row")


def linked_files(edges: DataFrame, nodes: DataFrame, most: int = LINKED) -> DataFrame:
    """(source, pos, id, label): of each node the first so many file nodes (id, kind, label) that its edges (with ord, their order) lead to."""
    out = edges.select("source", F.col("target").alias("id"), "ord").join(shuffled(nodes.where("kind = 'file'").select("id", "label")), "id")
    return first_rows(out, "source", "ord", most).select("source", "pos", "id", "label")


def inspect(nodes: DataFrame, members: DataFrame, edges: DataFrame, planned_moves: DataFrame, planned_deletes: DataFrame, most: int = LINKED) -> DataFrame:
    """(id, kind, label, confidence, summary, rationale, hash, n_files, in_deletes, in_moves, files) of each node.

    files: the labels of its first linked files. n_files and hits are null for nodes that have no members by kind; an empty summary,
    rationale or hash is null.
    """
    hits = planned_hits(members.select("node_id", "id"), planned_moves, planned_deletes).withColumnRenamed("node_id", "id")
    linked = linked_files(edges, nodes, most).groupBy(F.col("source").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("files"))  # most at most
    has = F.col("n_files").isNotNull()
    full = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    count = lambda c: F.when(has, F.coalesce(c, F.lit(0))).alias(c)
    out = nodes.join(shuffled(hits), "id", "left").join(shuffled(linked), "id", "left")
    return out.select("id", "kind", "label", "confidence", full("summary"), full("rationale"), full("hash"), "n_files", count("in_deletes"), count("in_moves"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def planned_hits(members: DataFrame, planned_moves: DataFrame, planned_deletes: DataFrame) -> DataFrame:
    """(node_id, members, in_moves, in_deletes) for members (node_id, id), which keep their multiplicity."""
    mv = planned_moves.select("id").where("id is not null").distinct().withColumn("m", F.lit(1))
    de = planned_deletes.select("id").where("id is not null").distinct().withColumn("d", F.lit(1))
    rows = members.join(shuffled(mv), "id", "left").join(shuffled(de), "id", "left")
    return rows.groupBy("node_id").agg(F.count("*").alias("members"), F.sum(F.coalesce("m", F.lit(0))).alias("in_moves"), F.sum(F.coalesce("d", F.lit(0))).alias("in_deletes"))


def grouped(rows: DataFrame, key: Column, order: str, most: int = GROUP) -> DataFrame:
    """rows of each key with key, group_pos (of the key among the sorted keys, from 0), n (rows of the key) and pos (from 1): the first so many in the given order."""
    keyed = rows.withColumn("key", key)
    groups = numbered(keyed.groupBy("key").agg(F.count("*").alias("n")), "key", name="group_pos")
    return first_rows(keyed, "key", order, most).join(groups, "key")


def moves_by_destination(moves: DataFrame, order: str, most: int = GROUP) -> DataFrame:
    """(to_dir, group_pos, n, pos, shown, reason): destinations in their order, and of each the first moves as 'name  →  destination'."""
    name = F.coalesce(tx.basename("from_path"), F.lit(""))
    rows = grouped(moves, F.coalesce("to_dir", F.lit("")), order, most)
    return rows.select(F.col("key").alias("to_dir"), "group_pos", "n", "pos", F.concat(name, F.lit("  →  "), "key").alias("shown"), F.coalesce("reason", F.lit("")).alias("reason"))


def deletes_by_reason(deletes: DataFrame, order: str, most: int = GROUP) -> DataFrame:
    """(reason, group_pos, n, pos, shown, confidence): reasons in their order, and of each the first deletes by name, with two decimals of confidence."""
    rows = grouped(deletes, F.coalesce("reason", F.lit("unknown")), order, most)
    return rows.select(F.col("key").alias("reason"), "group_pos", "n", "pos", F.coalesce(tx.basename("path"), F.lit("")).alias("shown"), F.format_string("%.2f", F.bround(F.coalesce("confidence", F.lit(0.0)), 2)).alias("confidence"))


def cluster_overview(members: DataFrame, planned_deletes: DataFrame, costs: DataFrame) -> DataFrame:
    """(cluster_key, size, hits, ratio, status, gb, monthly_cost) of clusters with members (node_id: the cluster key, id); costs default to 0."""
    rows = junk_status(members, planned_deletes).withColumnRenamed("node_id", "cluster_key").join(costs.select("cluster_key", "gb", "monthly_cost"), "cluster_key", "left")
    return rows.fillna(0.0, ["gb", "monthly_cost"])


def junk_status(members: DataFrame, planned_deletes: DataFrame) -> DataFrame:
    """(node_id, size, hits, ratio, status) for members (node_id, id): distinct planned deletes over distinct members."""
    de = planned_deletes.select("id").where("id is not null").distinct().withColumn("d", F.lit(1))
    rows = members.select("node_id", "id").distinct().join(de, "id", "left").groupBy("node_id").agg(F.count("id").alias("size"), F.sum(F.coalesce("d", F.lit(0))).alias("hits"))
    ratio = F.coalesce(F.try_divide(F.col("hits"), F.col("size")), F.lit(0.0))
    status = F.when(ratio >= 0.5, "JUNK").when(ratio >= 0.2, "REVIEW").otherwise("NOT JUNK")
    return rows.select("node_id", "size", "hits", F.round(ratio, 6).alias("ratio"), status.alias("status"))


def total_cost(costs: DataFrame, rate: float) -> DataFrame:
    """(total_gb, total_cost): the sum of the rounded gigabytes, and that times the rate; zero where there are no costs."""
    gb = F.coalesce(F.sum("gb"), F.lit(0.0))
    return costs.agg(F.round(gb, 4).alias("total_gb"), F.round(gb * float(rate), 4).alias("total_cost"))
