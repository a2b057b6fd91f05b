"""Categories of files: by bucket alone, or from a chat model's answers.

The model is an injected callable, list of inventory rows -> answer text. Its answers are written to the shared folder before any
later step reads them, so that recomputation never asks twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.functions.json_recovery import recover
from shelfwright.operators.clusters import first_rows
from shelfwright.session import ship
from shelfwright.tables import cut, numbered

INVENTORY, BATCH = 500, 400
ATTEMPTS = 3


def inventory(files: DataFrame, snippets: DataFrame, most: int = INVENTORY, batch: int = BATCH) -> DataFrame:
    """(bucket, batch, pos, id, name, path, ext, mime, size, snippet): the first files of each bucket, in batches."""
    rows = files.withColumn("bucket", tx.bucket("type"))
    top = first_rows(rows, "bucket", "seq", most)
    texts = snippets.groupBy("id").agg(F.min("text").alias("text"))
    name = tx.basename("path")
    return top.join(texts, "id", "left").select("bucket", F.floor((F.col("pos") - 1) / batch).cast("int").alias("batch"), "pos", "id", name.alias("name"), "path", tx.suffix(name).alias("ext"), F.col("type").alias("mime"), "size", F.substring("text", 1, 1000).alias("snippet"))


def fallback(files: DataFrame) -> DataFrame:
    """(bucket, label, seq, id, size): every file under 'All <bucket>'."""
    b = tx.bucket("type")
    return files.select(b.alias("bucket"), F.concat(F.lit("All "), b).alias("label"), "seq", "id", "size")


def fallback_summaries(categories: DataFrame) -> DataFrame:
    """(node_id, summary)."""
    n = categories.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("sub:"), "bucket", F.lit(":"), "label").alias("node_id"), F.concat(F.col("n").cast("string"), F.lit(" files (fallback).")).alias("summary"))


def ask(items: DataFrame, chat: Callable[[str, list[dict]], str], wait: float = 1.0) -> DataFrame:
    """(bucket, batch, answer, error) of each batch of an inventory; a failed call is tried again after 1 and 2 waits."""
    ship(items.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, batch = key
        rows = pdf.sort_values("pos").drop(columns=["bucket", "batch", "pos"]).to_dict("records")
        error = None
        for attempt in range(ATTEMPTS):
            try:
                return pd.DataFrame([[bucket, batch, chat(bucket, rows), None]], columns=["bucket", "batch", "answer", "error"])
            except Exception as e:  # noqa: BLE001 - whatever the client raises
                error = str(e)
                if attempt < ATTEMPTS - 1:
                    time.sleep(wait * (attempt + 1))
        return pd.DataFrame([[bucket, batch, None, error]], columns=["bucket", "batch", "answer", "error"])

    return cut(items.groupBy("bucket", "batch").applyInPandas(run, "bucket string, batch int, answer string, error string"), "answers")


def parsed(answers: DataFrame) -> DataFrame:
    """(bucket, batch, ord, label, key, file_ids, rationale, confidence, error) of the categories in answers.

    A missing label, list or confidence has its default (Cluster, none, 0.5); one that can't be read makes the row an error.
    key is the label without regard to case.
    """
    ship(answers.sparkSession)
    schema = "bucket string, batch int, ord int, label string, key string, file_ids array<string>, rationale string, confidence double, error string"

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.error is not None and r.error == r.error:
                    out.append([r.bucket, r.batch, -1, None, None, None, None, None, r.error])
                    continue
                try:
                    found = recover(r.answer)
                    for i, c in enumerate(found.get("categories", [])):
                        label = str(c.get("label", "Cluster")).strip()
                        out.append([r.bucket, r.batch, i, label, label.casefold(), [str(x) for x in c.get("file_ids", [])], str(c.get("rationale", "")).strip(), float(c.get("confidence", 0.5)), None])
                except (TypeError, ValueError, AttributeError) as e:
                    out.append([r.bucket, r.batch, -1, None, None, None, None, None, f"unreadable answer: {e}"])
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return answers.mapInPandas(run, schema)


def merged(rows: DataFrame) -> DataFrame:
    """(bucket, idx, label, rationale, confidence, first) of categories by key over all batches.

    Label and confidence are those of the first occurrence; the rationale is that of the first of the highest confidence.
    """
    at = F.struct("batch", "ord")
    low = F.struct((-F.col("batch")).alias("b"), (-F.col("ord")).alias("o"))
    g = rows.groupBy("bucket", "key").agg(F.min(F.struct(at.alias("at"), "label", "confidence")).alias("f"), F.max_by("rationale", F.struct("confidence", low.alias("low"))).alias("rationale"))
    flat = g.select("bucket", "key", F.col("f.at.batch").alias("batch"), F.col("f.at.ord").alias("ord"), F.col("f.label").alias("label"), "rationale", F.col("f.confidence").alias("confidence"))
    all_ = numbered(flat, "bucket", "batch", "ord", "key", name="_place")
    first = all_.groupBy("bucket").agg(F.min("_place").alias("_first"))  # a row a bucket
    return all_.join(first, "bucket").select("bucket", "key", (F.col("_place") - F.col("_first")).cast("int").alias("idx"), "label", "rationale", "confidence")


def assigned(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(bucket, idx, label, confidence, rationale, id): each inventoried id in the category of the highest confidence, ties to the first."""
    cats = merged(rows)
    ids = rows.select("bucket", "key", F.explode("file_ids").alias("id")).join(cats, ["bucket", "key"])
    own = ids.join(items.select("bucket", "id").distinct(), ["bucket", "id"], "left_semi")
    best = own.groupBy("bucket", "id").agg(F.max(F.struct("confidence", (-F.col("idx")).alias("low"))).alias("b"))
    return best.select("bucket", "id", (-F.col("b.low")).alias("idx")).join(cats, ["bucket", "idx"]).select("bucket", "idx", "label", "confidence", "rationale", "id")


def uncategorized(items: DataFrame, won: DataFrame) -> DataFrame:
    """(bucket, id) of the inventoried ids in no category."""
    return items.select("bucket", "id").distinct().join(won.select("bucket", "id"), ["bucket", "id"], "left_anti")


def discovered(files: DataFrame, snippets: DataFrame, chat: Callable[[str, list[dict]], str], wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(categories: bucket, label, seq, id, size; summaries: node_id, summary) from a chat model.

    Where any call of a bucket fails, all files of that bucket are Uncategorized. Labels are cut to 80 characters, equal ones merge.
    """
    items = cut(inventory(files, snippets), "inventory")
    rows = cut(parsed(ask(items, chat, wait)), "parsed")
    bad = rows.where("error is not null").groupBy("bucket").agg(F.min("error").alias("error"))
    good = rows.where("error is null").join(bad, "bucket", "left_anti")
    won = assigned(good, items)
    rest = uncategorized(items, won).join(bad, "bucket", "left_anti").select("bucket", F.lit(1 << 30).alias("idx"), F.lit("Uncategorized").alias("label"), F.lit(0.5).alias("confidence"), F.lit("Not matched to any category.").alias("rationale"), "id")
    failed = files.select(tx.bucket("type").alias("bucket"), "id").join(bad, "bucket").select("bucket", F.lit(0).alias("idx"), F.lit("Uncategorized").alias("label"), F.lit(0.5).alias("confidence"), F.concat(F.lit("LLM discovery failed: "), "error").alias("rationale"), "id")
    all_ = won.unionByName(rest).unionByName(failed)
    label = F.substring(F.when(F.coalesce("label", F.lit("")) == "", "Uncategorized").otherwise(F.col("label")), 1, 80)
    all_ = cut(all_.withColumn("label", label), "categories")
    text = F.when(F.col("rationale").startswith("LLM discovery failed"), F.col("rationale")).otherwise(F.concat("rationale", F.lit(" (conf "), F.bround("confidence", 2).cast("string"), F.lit(")")))
    notes = all_.groupBy("bucket", "label").agg(F.max_by(text, "idx").alias("summary"))
    notes = notes.select(F.concat(F.lit("sub:"), "bucket", F.lit(":"), "label").alias("node_id"), "summary")
    return all_.select("bucket", "label", "id").join(files.select("id", "seq", "size"), "id").select("bucket", "label", "seq", "id", "size"), notes


def costs(categories: DataFrame, rate: float) -> DataFrame:
    """(cluster_key, bytes, gb, monthly_cost) of each category; none for a rate of 0."""
    size = categories.groupBy(tx.cluster_key("bucket", "label").alias("cluster_key")).agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))
    return size.where(F.lit(rate > 0)).select("cluster_key", "bytes", tx.gigabytes("bytes").alias("gb"), tx.monthly_cost("bytes", rate).alias("monthly_cost"))


def request_body(model: str, bucket: str, rows: list[dict]) -> dict:
    """The body of a chat-completions request for one batch."""
    keys = ("id", "name", "path", "ext", "mime", "size", "snippet")
    ask_for = 'Group the files below, all of the bucket "{}", into a few categories by subject. Answer with one JSON object {{"categories": [{{"label", "file_ids", "rationale", "confidence"}}], "uncategorized": []}} and nothing else; use only the ids given, each at most once; confidence is between 0 and 1.'
    files = json.dumps([{k: r.get(k) for k in keys} for r in rows], default=str)
    return {"model": model, "messages": [{"role": "system", "content": ask_for.format(bucket)}, {"role": "user", "content": files}], "temperature": 0.2, "max_tokens": 1800, "response_format": {"type": "json_object"}}


def http_chat(endpoint: str, model: str, api_key: str | None = None, timeout: float = 180.0) -> Callable[[str, list[dict]], str]:
    """A client for servers of the chat-completions protocol."""
    url = tx.chat_endpoint(endpoint)

    def chat(bucket: str, rows: list[dict]) -> str:
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        req = urllib.request.Request(url, json.dumps(request_body(model, bucket, rows)).encode(), head)
        with urllib.request.urlopen(req, timeout=timeout) as r:
            choices = json.load(r).get("choices", [{}])
            return ((choices[0] or {}).get("message") or {}).get("content") or ""  # no choice at all is an error

    return chat
