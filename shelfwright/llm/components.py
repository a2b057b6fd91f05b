"""Problem 3: consolidating pairwise matches into groups.

Method: the giant component is peeled off by breadth-first frontier joins from the vertex of the highest degree and anti-joined
away; the small components that remain are labelled by minimum propagation.

Ids are numbered in their own order first (range-partitioned, sorted, numbered within partitions), so that all rounds move pairs of
longs and the smallest number is the smallest id. A frontier meets the edges under SALTS keys a vertex, since the first vertex may
hold a third of all edges. After a level that adds much, edges that can lead to nothing new are dropped. The search ends when a level adds less than a TAIL of what has been reached, or at MAX_DEPTH: what it
has reached is contracted to one vertex then, and the thin rest is left to minimum propagation; the result is the same.

In a round of minimum propagation every vertex takes the smallest number among its neighbours and itself, then labels are followed,
twice as far each time, to a vertex without a smaller neighbour, and the edges are contracted to labels. At most half of the vertices
stay, so the rounds grow with the logarithm of the vertices and their work shrinks. The rounds' labels are composed at the end, from
the last round back. Every round is cut by tables in the shared folder.

Defined results: links with a null side or twice the same side link nothing; repeated and reversed links count once; an id in no
link is in no row; the group's identifier is its smallest id; no links give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import cut, forget, pick

SALTS = 8
MAX_DEPTH = 24
TAIL = 0.02
DROP = 0.1  # a level that adds this share of what has been reached is followed by a rewriting of the edges


def star_links(df: DataFrame, ids_col: str) -> DataFrame:
    """(a, b): links from the smallest id of each array to its others; nulls and repeats link nothing."""
    ids = F.array_distinct(F.filter(F.col(ids_col), lambda x: x.isNotNull()))
    return df.select(ids.alias("_ids")).where("size(_ids) > 1").select(F.array_min("_ids").alias("a"), F.explode("_ids").alias("b")).where("a <> b")


def connected(links: DataFrame, max_depth: int = MAX_DEPTH, tail: float = TAIL) -> DataFrame:
    """(id, group_id) of each id in links (two columns)."""
    spark = links.sparkSession
    one = links.select(links.columns[0], links.columns[1]).toDF("a", "b").where("a is not null and b is not null and a <> b")
    one = cut(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ids = one.select(F.col("a").alias("id")).union(one.select("b")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    ids = cut(ids.withColumn("v", F.monotonically_increasing_id()), "ids")
    pairs = one.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    edges = cut(pairs.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("e")).select("e.src", "e.dst"), "edges")
    forget(one)
    start = edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select("src").collect()
    if not start:
        return ids.select("id", F.col("id").alias("group_id"))

    # Breadth first from the vertex of the highest degree.
    frontier = cut(spark.range(start[0][0], start[0][0] + 1).select(F.col("id").alias("v")), "frontier")
    visited, reached, ended = [frontier], 1, False
    for depth in range(max_depth):
        spread = frontier.select(F.col("v").alias("src"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
        salted = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
        beside = spread.join(salted, ["src", "salt"]).select(F.col("dst").alias("v")).distinct()
        new_ones = cut(beside.join(reduce(DataFrame.union, visited), "v", "left_anti"), "frontier")
        new = new_ones.count()
        ended = new == 0
        if ended:
            break
        if new >= DROP * reached:  # a large level: what leads away from expanded vertices, or to visited ones, is done with
            expanded = reduce(DataFrame.union, visited)
            rest = edges.join(expanded.withColumnRenamed("v", "src"), "src", "left_anti").join(expanded.union(new_ones).withColumnRenamed("v", "dst"), "dst", "left_anti")
            rest = cut(rest.select("src", "dst"), "edges")
            forget(edges)
            edges = rest
        frontier, reached = new_ones, reached + new
        visited.append(new_ones)
        if depth >= 3 and new < tail * reached:
            break
    all_ = cut(reduce(DataFrame.union, visited), "visited")
    forget(*visited)
    low = all_.agg(F.min("v")).first()[0]
    if ended:
        rest = cut(edges.join(all_.select(F.col("v").alias("src")), "src", "left_anti"), "edges")
    else:  # contracted, not finished; edges between visited vertices and others may be left in one direction
        at = all_.withColumn("at", F.lit(low))
        rest = edges.join(at.toDF("src", "x"), "src", "left").join(at.toDF("dst", "y"), "dst", "left")
        rest = rest.select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst")).where("src <> dst")
        rest = cut(rest.union(rest.select("dst", "src")).distinct(), "edges")
    forget(edges)
    labels = _propagate(rest)
    if not ended:
        hub = labels.where(F.col("v") == F.lit(low)).select("label").collect()
        labels, low = labels.where(F.col("v") != F.lit(low)), hub[0][0] if hub else low
    name = ids.where(F.col("v") == F.lit(low)).select("id").collect()[0][0]
    giant = ids.join(all_, "v", "left_semi").select("id", F.lit(name).alias("group_id"))
    inside = F.col("label") == F.lit(low)  # of the giant after all: its label is a literal, not a hot join key
    far = labels.where(inside).join(ids, "v").select("id", F.lit(name).alias("group_id"))
    small = labels.where(~inside).join(ids, "v").select("id", "label").join(ids.toDF("group_id", "label"), "label").select("id", "group_id")
    return giant.union(far).union(small)


def _propagate(edges: DataFrame) -> DataFrame:
    """(v, label) of each vertex of edges (src, dst), given in both directions; label is the smallest of its component."""
    rounds = []
    while True:  # at least half of the vertices go in a round
        near = cut(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("v"), F.least("src", "m").alias("label")), "labels")
        while True:  # labels of labels, twice as far each time, down to vertices without a smaller neighbour
            once = near.join(near.toDF("label", "up"), "label").select("v", "label", "up")
            twice = once.join(once.select(F.col("v").alias("up"), F.col("up").alias("top")), "up").select("v", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved"))
            two = cut(twice, "labels")
            forget(near)
            near = two.select("v", "label")
            near._shelfwright_path = two._shelfwright_path
            if two.where("moved").isEmpty():
                break
        two = near
        rounds.append(two)
        x, y = two.toDF("src", "x"), two.toDF("dst", "y")
        rest = cut(edges.join(x, "src").join(y, "dst").select(F.col("x").alias("src"), F.col("y").alias("dst")).where("src <> dst").distinct(), "edges")
        forget(edges)
        edges = rest
        if edges.isEmpty():
            break
    out = rounds[-1]
    for near in reversed(rounds[:-1]):
        out = cut(near.join(out.toDF("label", "up"), "label", "left").select("v", F.coalesce("up", "label").alias("label")), "labels")
    return out


def file_links(match_pairs: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """(a, b): links between files from true matches, and from nodes of kind duplicate_cluster or near_duplicate_text."""
    match_pairs, graph_nodes = pick(match_pairs, "id_a", "id_b", "is_match"), pick(graph_nodes, "kind", "meta")
    pairs = match_pairs.where("is_match").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    nodes = graph_nodes.where(F.col("kind").isin("duplicate_cluster", "near_duplicate_text"))
    return pairs.union(star_links(nodes, "meta.file_ids"))
