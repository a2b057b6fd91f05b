"""From files and texts to graph, summaries and plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.fingerprint import with_simhash
from shelfwright.operators import categorize, clusters, graph, leader, plan, summarize
from shelfwright.sources import documents
from shelfwright.tables import cut, forget

TEXT_DISTANCE, IMAGE_DISTANCE, SNIPPET = 8, 12, 2000
DOCUMENT_ROWS = 200_000  # of a table that still becomes a JSON document on the driver


@dataclass
class Organized:
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    summaries: DataFrame
    deletes: DataFrame
    moves: DataFrame
    costs: DataFrame
    summary: DataFrame


def near_texts(files: DataFrame, texts: DataFrame, distance: int = TEXT_DISTANCE) -> DataFrame:
    """Leader clusters of the SimHashes of all texts that aren't empty (white space alone is a text)."""
    one = texts.where("text <> ''").groupBy("id").agg(F.min("text").alias("text"))
    words = cut(with_simhash(one, "text").select("id", "fp"), "words")  # texts aren't sent on
    return leader.leader_clusters(files.select("seq", "id").join(words.hint("merge"), "id"), distance)  # never broadcast for the size of a file


def organize(files: DataFrame, texts: DataFrame, now: float, rate: float = 0.0, chat: Callable | None = None, images: DataFrame | None = None) -> Organized:
    """files: one row an id. texts: id, text. images: seq, id, fp of images that could be read. chat: a model, or none."""
    near = cut(near_texts(files, texts), "near")
    like = cut(leader.leader_clusters(images, IMAGE_DISTANCE), "images") if images is not None else None
    snippets = texts.where("text <> ''").select("id", F.substring("text", 1, SNIPPET).alias("text"))
    if chat is None:
        cats = categorize.fallback(files)
        notes = categorize.fallback_summaries(cats)
    else:
        cats, notes = categorize.discovered(files, snippets, chat)
    members = graph.membership(files, cats, near, now)
    bands = files.sparkSession.createDataFrame([(f"age:{a}",) for a in clusters.tx.AGES], "node_id string")
    lines = summarize.summaries(members.where("kind <> 'subcategory'"), files, snippets)
    empty = bands.join(lines, "node_id", "left_anti").select("node_id", F.lit("Files: 0, Total bytes: 0").alias("summary"))
    lines = lines.union(empty).union(notes)
    de, mv = plan.deletes(files, near, like), plan.moves(files, cats)
    return Organized(graph.nodes(files, cats, near, lines, now), graph.edges(members, cats), members, lines, de, mv, categorize.costs(cats, rate), plan.summary(files, de, mv, near, like, rate))


def write_documents(found: Organized, out: str, began: float | None = None, most: int = DOCUMENT_ROWS) -> dict:
    """graph.json, summaries.json and plan.json of a small scan; of one with more than so many rows in a table, tables in their place.

    Tables are parquet folders in out, named as the fields of Organized; only plan.json with its summary is written beside them then.
    """
    own = Organized(*[cut(getattr(found, f.name), f.name) for f in fields(Organized)])
    elapsed = time.time() - began if began else 0.0
    if any(getattr(own, f.name).count() > most for f in fields(Organized)):
        for f in fields(Organized):
            getattr(own, f.name).write.mode("overwrite").parquet(f"{out}/{f.name}")
        plan_ = {"summary": own.summary.first().asDict() | {"elapsed_sec": round(elapsed, 2)}}
        documents.write_json(f"{out}/plan.json", plan_)
        docs = {"plan": plan_}
    else:
        docs = {
            "graph": documents.graph_document(own.nodes, own.members, own.edges),
            "summaries": {r["node_id"]: r["summary"] for r in own.summaries.collect()},
            "plan": documents.plan_document(own.summary, own.moves, own.deletes, own.costs, elapsed),
        }
        for name, doc in docs.items():
            documents.write_json(f"{out}/{name}.json", doc)
    forget(*[getattr(own, f.name) for f in fields(Organized)])
    return docs
