"""The three JSON documents of a small scan, read and written. Larger scans stay tables (parquet or JSON lines)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright import schema as sc

META = ("subcount", "hash", "file_ids", "bucket", "summary", "size", "mtime", "type")


def graph_document(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> dict:
    """{nodes, edges} with file_ids in each cluster's meta, and only the fields that a kind has."""
    ids = {r["node_id"]: [x["id"] for x in r["a"]] for r in members.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("a")).collect()}
    out = []
    for n in nodes.collect():
        meta = {}
        for k in META:
            if k == "file_ids":
                if n["kind"] not in ("root", "category", "file"):
                    meta[k] = ids.get(n["id"], [])
            elif n[k] is not None or (n["kind"] == "file" and k == "hash"):
                meta[k] = n[k]
        out.append({"id": n["id"], "kind": n["kind"], "label": n["label"], "meta": meta, "reasoning": {"rationale": n["rationale"], "confidence": n["confidence"]}})
    return {"nodes": out, "edges": [r.asDict() for r in edges.select("id", "source", "target", "kind").collect()]}


def plan_document(summary: DataFrame, moves: DataFrame, deletes: DataFrame, costs: DataFrame, elapsed: float) -> dict:
    head = summary.first().asDict() | {"elapsed_sec": round(elapsed, 2)}
    mv = [{"id": r["id"], "from": r["from_path"], "to": r["to_dir"], "reason": r["reason"]} for r in moves.collect()]
    de = [{k: r[k] for k in ("id", "path", "reason", "confidence")} for r in deletes.orderBy("branch").collect()]
    return {"summary": head, "moves": mv, "deletes": de, "cluster_costs": {r["cluster_key"]: {"bytes": r["bytes"], "gb": r["gb"], "monthly_cost": r["monthly_cost"]} for r in costs.collect()}}


def write_json(path: str, value) -> None:
    """Indented by two, characters beyond ASCII escaped."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.PLAN).json(path, multiLine=True)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    doc = spark.read.schema(f"nodes array<struct<{_fields(sc.NODES)}>>, edges array<struct<{_fields(sc.EDGES)}>>").json(path, multiLine=True)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, summary)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("node_id", "summary"))


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def kind_of_file(name: str) -> str | None:
    """Which of the three documents a file is, by its name."""
    return next((k for k in ("graph", "summaries", "plan") if k in name.lower()), None)
