"""Query bindings of the core operators over the given tables, each over whole tables.

The catalogue is the row of the highest seq of each id in files; texts are the snippets of its ids.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.functions import fingerprint as fpr
from shelfwright.functions import text as tx
from shelfwright.functions.json_recovery import recover
from shelfwright.operators import autocat, categorize, clusters, graph, leader, plan, summarize, views
from shelfwright.plans.oracles import ORACLE
from shelfwright.plans.pipeline import near_texts
from shelfwright.session import ship, table
from shelfwright.streaming.landing import derived
from shelfwright.tables import cut

__all__ = ["ORACLE", "QUERIES"]

NOW = 1722470400.0  # 2024-08-01, UTC
RATE = 0.023
ROOT, QUARANTINE = "/corpus", "/corpus/.quarantine/run"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def catalogue(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """seq, id and the given columns, or path, size, mtime, type and hash; only these are read."""
    return clusters.current(table(spark, sf, "files").select("seq", "id", *(cols or ("path", "size", "mtime", "type", "hash"))))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "snippets").where("text <> ''").groupBy("id").agg(F.min("text").alias("text"))


_NEAR: dict[tuple[str, str], DataFrame] = {}


def near(spark: SparkSession, sf: str) -> DataFrame:
    """The near-duplicate clusters of a folder's texts: one table for all queries of a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _NEAR:
        _NEAR[key] = _near(spark, sf)
    return _NEAR[key]


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return cut(near_texts(table(spark, sf, "files").where("id is not null").groupBy("id").agg(F.max("seq").alias("seq")), texts(spark, sf)), "near")


def images(files: DataFrame) -> DataFrame:
    """(seq, id, fp) of image files. There are no pixels here, so words that are alike within a folder stand in for perceptual hashes."""
    folder = F.conv(F.substring(F.md5(F.coalesce(tx.parent("path"), F.lit(""))), 1, 14), 16, 10).cast("long")
    return files.where(tx.suffix(tx.basename("path")).isin(*tx.IMAGE_EXTENSIONS)).select("seq", "id", (folder * 16 + F.pmod("seq", F.lit(16))).alias("fp"))


def planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(catalogue, near duplicates of texts and of images, deletes, moves) of the catalogue."""
    files, like = cut(catalogue(spark, sf), "catalogue"), near(spark, sf)
    seen = cut(leader.leader_clusters(images(files), 12), "images")
    return files, like, seen, plan.deletes(files, like, seen), plan.moves(files, categorize.fallback(files))


# Files


@query
def file_identity(spark, sf):
    return derived(table(spark, sf, "files")).select("seq", "id", "id_ok", "name", tx.parent("path").alias("folder"), "ext", "bucket")


@query
def content_gate(spark, sf):
    """Files whose content may be hashed and whose text may be read, by size."""
    rows = table(spark, sf, "files")
    return rows.select("seq", (F.col("size") <= 5_000_000).alias("hashed"), (F.col("size") <= 3_000_000).alias("readable"), F.when(F.col("size") <= 5_000_000, F.lower("hash")).alias("hash"), tx.suffix(tx.basename("path")).isin(*tx.IMAGE_EXTENSIONS).alias("is_image"), tx.suffix(tx.basename("path")).isin(*tx.TEXT_EXTENSIONS).alias("is_text"))


@query
def human_sizes(spark, sf):
    return table(spark, sf, "files").select("seq", tx.human_bytes("size").alias("shown"))


@query
def exact_duplicate_clusters(spark, sf):
    return clusters.exact_duplicates(catalogue(spark, sf, "path", "size", "hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum("size").alias("bytes"))


@query
def exact_duplicate_members(spark, sf):
    return clusters.exact_duplicates(catalogue(spark, sf, "path", "size", "hash")).select("hash", "id", "seq", "n", "is_first")


@query
def exact_duplicate_deletes(spark, sf):
    return clusters.exact_duplicates(catalogue(spark, sf, "path", "size", "hash")).where("not is_first").select("id", "path", F.lit("exact_duplicate").alias("reason"), F.lit(0.99).alias("confidence"))


@query
def type_clusters(spark, sf):
    return clusters.type_clusters(catalogue(spark, sf, "type", "size"))


@query
def age_clusters(spark, sf):
    return clusters.age_clusters(catalogue(spark, sf, "mtime", "size"), NOW)


@query
def order_age_clusters(spark, sf):
    """The same bands over the dates of orders."""
    rows = table(spark, sf, "orders").select((F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("mtime"), F.lit(1).alias("size"))
    return clusters.age_clusters(rows, 902_000_000.0).select("age", "n")


@query
def temp_suffix_deletes(spark, sf):
    rows = catalogue(spark, sf, "path").where(tx.is_temp(tx.basename("path")))
    return rows.select("id", "path", F.lit("temp_suffix").alias("reason"), F.lit(0.6).alias("confidence"))


@query
def dominant_extension(spark, sf):
    rows = catalogue(spark, sf, "type", "path").select(tx.bucket("type").alias("bucket"), tx.suffix(tx.basename("path")).alias("ext"), "seq")
    return clusters.dominant_extension(rows, "bucket")


# Texts and fingerprints


@query
def tokens_shingles(spark, sf):
    w = tx.words("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(w).alias("n_words"), F.size(tx.shingles(w)).alias("n_shingles"), F.md5(F.array_join(tx.shingles(w), "|")).alias("shingles_md5"))


@query
def fnv1a_hash(spark, sf):
    w = tx.words("top_terms")
    terms = table(spark, sf, "cluster_results").select(F.explode("top_terms").alias("top_terms")).where("top_terms is not null").select(F.array_join(w, " ").alias("term")).distinct()
    return terms.select("term", fpr.fnv1a("term").alias("fnv"))


@query
def simhash64(spark, sf):
    return fpr.with_simhash(texts(spark, sf), "text").select("id", "fp")


@query
def hamming_pairs(spark, sf):
    return leader.hamming_pairs(cut(simhash64(spark, sf), "fps"), 8)


@query
def near_duplicate_clusters(spark, sf):
    return near(spark, sf).select("cluster_idx", "id", "seq", "leader_seq", "n")


@query
def near_duplicate_deletes(spark, sf):
    rows = near(spark, sf).where("seq <> leader_seq").join(catalogue(spark, sf, "path").select("id", "path"), "id", "left")
    return rows.select("id", "path", F.concat(F.lit("near_duplicate_text:"), F.col("cluster_idx").cast("string")).alias("reason"), F.lit(0.7).alias("confidence"))


@query
def sign_bit_similarity(spark, sf):
    # Each vector and three copies of it, with 3, 6 and 9 signs turned.
    bits = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", fpr.sign_bits("embedding").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    turned = F.array(*[F.lit(((1 << (3 * j)) - 1) << 5).cast("long") for j in range(4)])[F.col("j")]
    rows = bits.select((F.col("vec_id") * 4 + F.col("j")).alias("seq"), F.concat_ws("-", "vec_id", "j").alias("id"), F.col("fp").bitwiseXOR(turned).alias("fp"))
    return leader.leader_clusters(rows, 12).select("cluster_idx", "id", "seq", "leader_seq", "n")


@query
def dct_phash(spark, sf):
    """Perceptual hashes of images painted from embeddings, which stand in for images."""
    px = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lit(128.0) + 100.0 * F.col("embedding")[F.pmod(F.floor(i / 32) * 7 + F.pmod(i, F.lit(32)) * 3, F.lit(64)).cast("int")].cast("double"))
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", px.alias("pixels"))
    return fpr.with_phash(rows, "pixels").select("vec_id", "fp")


@query
def html_tag_strip(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null")
    marked = F.concat(F.lit("<p class='a'>"), "text", F.lit("</p>\n<br/>  <i>"), "source", F.lit("</i>"))
    return rows.where("source is not null").select("doc_id", tx.strip_tags(marked).alias("plain"))


# Summaries and categories


@query
def cluster_summaries(spark, sf):
    files = catalogue(spark, sf, "path", "size", "type", "hash")
    members = clusters.exact_duplicates(files).select(F.concat(F.lit("dup:"), F.substring("hash", 1, 8)).alias("node_id"), "seq", "id")
    types = files.select(F.concat(F.lit("type:"), tx.bucket("type")).alias("node_id"), "seq", "id")
    return summarize.summaries(members.union(types), files, texts(spark, sf))


@query
def fallback_categories(spark, sf):
    cats = categorize.fallback(catalogue(spark, sf, "type", "size"))
    return categorize.fallback_summaries(cats)


@query
def cluster_costs(spark, sf):
    return categorize.costs(categorize.fallback(catalogue(spark, sf, "type", "size")), RATE)


@query
def total_cost(spark, sf):
    return views.total_cost(cluster_costs(spark, sf), RATE)


@query
def inventory_batches(spark, sf):
    rows = categorize.inventory(catalogue(spark, sf, "path", "size", "type"), texts(spark, sf))
    return rows.select("bucket", "batch", "pos", "id", "name", "ext", "mime", "size", F.md5(F.coalesce("snippet", F.lit(""))).alias("snippet_md5"))


def answers(spark, sf) -> DataFrame:
    """The rows of cluster_results in the part of a model's parsed answers: batches of 100, confidence where it is one."""
    label = F.col("label")
    kind = F.lower(F.substring_index(label, " ", 1))  # labels begin with the members' commonest extension
    bucket = F.when(kind.isin(*tx.IMAGE_EXTENSIONS), "Images").when(kind.isin("mp3", "wav", "flac", "ogg", "m4a"), "Audio").when(kind.isin("mp4", "mov", "avi", "mkv", "webm"), "Video").otherwise("Documents")
    conf = F.when(~F.isnan("score") & (F.col("score") >= 0) & (F.col("score") <= 1), F.col("score")).otherwise(0.5)
    return table(spark, sf, "cluster_results").select(bucket.alias("bucket"), F.floor((F.col("result_id") - 1) / 100).cast("int").alias("batch"), F.pmod(F.col("result_id") - 1, F.lit(100)).cast("int").alias("ord"), label.alias("label"), F.lower(label).alias("key"), F.coalesce("file_ids", F.array().cast("array<string>")).alias("file_ids"), F.coalesce(F.array_join("top_terms", " "), F.lit("")).alias("rationale"), F.coalesce(conf, F.lit(0.5)).alias("confidence"))


def offered(spark, sf) -> DataFrame:
    return catalogue(spark, sf, "type").select(tx.bucket("type").alias("bucket"), "id")


@query
def category_merge(spark, sf):
    return categorize.merged(answers(spark, sf)).select("bucket", "key", "idx", "label", "rationale", "confidence")


@query
def category_unique(spark, sf):
    return categorize.assigned(cut(answers(spark, sf), "answers"), offered(spark, sf)).select("bucket", "id", "idx", "label", "confidence")


@query
def uncategorized(spark, sf):
    items = cut(offered(spark, sf), "offered")
    return categorize.uncategorized(items, categorize.assigned(cut(answers(spark, sf), "answers"), items)).select("bucket", "id")


@query
def json_recovery(spark, sf):
    """Categories found again in prose wrapped around JSON."""
    ship(spark)
    rows = table(spark, sf, "documents").where("text is not null")
    body = F.to_json(F.struct(F.array(F.struct(F.coalesce("folder", F.lit("")).alias("label"), F.array(F.col("doc_id").cast("string")).alias("file_ids"))).alias("categories")))
    wrapped = rows.select("doc_id", F.concat(F.regexp_replace("text", '[{}"\\\\]', " "), F.lit(" {} "), body, F.lit(" done")).alias("answer"))

    def run(parts):
        for pdf in parts:
            found = [recover(a).get("categories", []) for a in pdf["answer"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "recovered": [json.dumps(c, ensure_ascii=False) for c in found]})

    return wrapped.mapInPandas(run, "doc_id long, recovered string")


@query
def descriptor(spark, sf):
    name = tx.basename("path")
    rows = catalogue(spark, sf, "path", "type").join(texts(spark, sf), "id", "left")
    return rows.select("id", tx.descriptor(name, tx.parent("path"), "type", tx.suffix(name), "text").alias("descriptor"))


@query
def tfidf_weights(spark, sf):
    return autocat.tfidf(cut(descriptor(spark, sf), "descriptors"), "id", "descriptor").select("id", "term", F.round("weight", 6).alias("weight"))


@query
def autocat_clusters(spark, sf):
    """Topics of every bucket of the catalogue, with the number of files in each."""
    name = tx.basename("path")
    rows = catalogue(spark, sf, "path", "type").join(texts(spark, sf), "id", "left")
    items = cut(rows.select(tx.bucket("type").alias("bucket"), "seq", "id", tx.suffix(name).alias("ext"), tx.descriptor(name, tx.parent("path"), "type", tx.suffix(name), "text").alias("d")), "described")
    return autocat.described_topics(items, weigh=autocat.weigher(items), last=True)[0]


# Graph and plan


@query
def graph_nodes(spark, sf):
    files, like = cut(catalogue(spark, sf), "catalogue"), near(spark, sf)
    cats = categorize.fallback(files)
    members = graph.membership(files, cats, like, NOW)
    notes = summarize.summaries(members.where("kind <> 'subcategory'"), files, texts(spark, sf)).union(categorize.fallback_summaries(cats))
    return graph.nodes(files, cats, like, notes, NOW).select("id", "kind", "label", "hash", "bucket", "n_files", "subcount", "size", "mtime", "type", "rationale", "confidence", F.md5("summary").alias("summary_md5"))


@query
def graph_edges(spark, sf):
    files, like = cut(catalogue(spark, sf), "catalogue"), near(spark, sf)
    cats = categorize.fallback(files)
    return graph.edges(graph.membership(files, cats, like, NOW), cats)


@query
def planned_deletes(spark, sf):
    return planned(spark, sf)[3].select("id", "path", "reason", "confidence")


@query
def planned_moves(spark, sf):
    files = catalogue(spark, sf)
    return plan.moves(files, categorize.fallback(files))


@query
def plan_summary(spark, sf):
    files, like, seen, de, mv = planned(spark, sf)
    return plan.summary(files, cut(de, "deletes"), cut(mv, "moves"), like, seen, RATE)


@query
def audit_dry_run(spark, sf):
    return plan.audit(table(spark, sf, "plan_moves"), table(spark, sf, "plan_deletes"), catalogue(spark, sf, "path"), ROOT, QUARANTINE)


# Views


@query
def viewer_filter(spark, sf):
    return views.filter_nodes(table(spark, sf, "graph_nodes"), "reasoning.confidence", "type_cluster", 0.6, "DO").select("node_seq", "id", "label")


@query
def viewer_layout(spark, sf):
    return views.layout(table(spark, sf, "graph_nodes"), "node_seq", "graph_id").select("node_seq", "graph_id", "kind", "x", "y", tx.tidy_label("label").alias("shown"))


@query
def viewer_edges(spark, sf):
    files, like = cut(catalogue(spark, sf), "catalogue"), near(spark, sf)
    cats = categorize.fallback(files)
    found = cut(graph.edges(graph.membership(files, cats, like, NOW), cats), "edges")
    shown = files.orderBy("seq").limit(graph.LEAVES).select("id").union(found.select("source"))
    return views.visible_edges(found, shown, "all")


@query
def label_split(spark, sf):
    rows = table(spark, sf, "graph_nodes")
    return rows.select("node_seq", tx.split_label("label", "meta.bucket").alias("s")).select("node_seq", "s.top", "s.sub")


@query
def node_hits(spark, sf):
    """Of every node that has files: members, and how many of them are planned to be moved or deleted."""
    rows = table(spark, sf, "graph_nodes").where("meta.file_ids is not null")
    members = rows.select(F.col("node_seq").alias("node_id"), F.explode("meta.file_ids").alias("id"))
    return views.planned_hits(members, table(spark, sf, "plan_moves"), table(spark, sf, "plan_deletes"))


def _drawn(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(catalogue, categories, members, ordered edges) of the catalogue's own graph."""
    files = cut(catalogue(spark, sf), "catalogue")
    cats = categorize.fallback(files)
    members = cut(graph.membership(files, cats, near(spark, sf), NOW), "members")
    return files, cats, members, graph.edges(members, cats, ordered=True)


@query
def node_inspector(spark, sf):
    """The first 40 file nodes behind each node of the catalogue's own graph, in the order of its edges."""
    files, _, _, edges = _drawn(spark, sf)
    leaves = files.orderBy("seq").limit(graph.LEAVES).select("id", F.lit("file").alias("kind"), F.col("path").alias("label"))
    return views.linked_files(edges, leaves).select("source", "pos", "id", "label")


@query
def node_record(spark, sf):
    """What the inspector shows of each node of the catalogue's own graph."""
    files, cats, members, edges = _drawn(spark, sf)
    notes = summarize.summaries(members.where("kind <> 'subcategory'"), files, texts(spark, sf)).union(categorize.fallback_summaries(cats))
    nodes = cut(graph.nodes(files, cats, near(spark, sf), notes, NOW), "nodes")
    found = views.inspect(nodes, members, edges, table(spark, sf, "plan_moves"), table(spark, sf, "plan_deletes"))
    return found.select("id", "kind", "label", "confidence", F.md5("summary").alias("summary_md5"), "rationale", "hash", "n_files", "in_deletes", "in_moves", F.md5(F.array_join("files", "\n")).alias("files_md5"))


@query
def moves_by_destination(spark, sf):
    return views.moves_by_destination(table(spark, sf, "plan_moves"), "plan_seq")


@query
def deletes_by_reason(spark, sf):
    return views.deletes_by_reason(table(spark, sf, "plan_deletes"), "plan_seq")


@query
def cluster_overview(spark, sf):
    """Subcategories of the graphs, the last of equal names, with what the plan deletes of them and what their moved files cost."""
    nodes = table(spark, sf, "graph_nodes").where("kind = 'subcategory'").select("node_seq", tx.split_label("label", "meta.bucket").alias("s"), "meta.file_ids")
    last = nodes.groupBy(tx.cluster_key("s.top", "s.sub").alias("node_id")).agg(F.max_by("file_ids", "node_seq").alias("ids"))
    moved = table(spark, sf, "plan_moves").where("reason is not null").select("id", F.col("reason").alias("cluster_key")).distinct()
    sized = moved.join(catalogue(spark, sf, "size"), "id").select(F.substring_index("cluster_key", ":", 1).alias("bucket"), F.expr("substring(cluster_key, instr(cluster_key, ':') + 1)").alias("label"), "size")
    return views.cluster_overview(last.select("node_id", F.explode_outer("ids").alias("id")), table(spark, sf, "plan_deletes"), categorize.costs(sized, RATE))


@query
def junk_status(spark, sf):
    members = table(spark, sf, "cluster_results").select(F.col("result_id").alias("node_id"), F.explode_outer("file_ids").alias("id"))
    return views.junk_status(members, table(spark, sf, "plan_deletes"))
