"""Problem 5: similarity clusters by reciprocal nearest neighbours.

Method: average linkage on a sparse graph; in each round all mutual best pairs merge at once, until no pair is as similar as the
threshold.

The similarity of two clusters is the mean cosine of their members' sets, by files or by terms, whichever is higher. Average linkage
is reducible: a merged cluster is to a third at most as similar as the better of its halves. Two things follow, and both are exact:

* The graph of the pairs that are as similar as the threshold is all that merges can follow, so its connected components are
  clustered on their own, each in one task, with all similarities inside the component, those below the threshold included.
* Only clusters whose best neighbour merged look for a new one; everyone else's stays the best.

Pairs of the graph are found by BANDS min-hash keys of ROWS values for either side of a set (sets of cosine 0.6 share a key with a
probability of 0.98) and verified exactly within the key's bucket. A component needs no more than its connection, so a bucket hands on
links that span its pairs, not the pairs: members are compared with the bucket's first, and only those unlike it with the others.
Buckets over CHUNK members are split into pairs of chunks, each a task.

A component of more than LOCAL points is too much for one task. Its rounds are Spark jobs over a graph that is kept from round to
round: edges without a merged end stay as they are, edges of merged ends are renamed, weighed again from the clusters' sum vectors
and dropped below the threshold. Linkage and order of merges are the same there; rounds go on until nothing merges.

Defined results: rows with equal files and equal terms are one point of their number's weight; null, blank and repeated entries
don't count, letter case, underscores and blanks don't either; a row without files is compared by terms, without terms by files,
with neither it is in no cluster; null, NaN and out-of-scale scores are left out of a cluster's mean score. Ties go to the smallest
id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.common import cut, forget, pick, ship
from shelfwright.llm.components import _propagate
from shelfwright.llm.runs import whole_runs
from shelfwright.llm.shingles import U, mix

BANDS, ROWS = 20, 2
THRESHOLD = 0.5
CHUNK = 1024  # members of a bucket that a task compares with each other
FEW = 48  # buckets up to here are compared many at a time
LOCAL = 2048  # points of a component that one task clusters


def clean_set(col: Column, words: bool) -> Column:
    """Sorted distinct hashes of an array's entries, null entries and blanks left out."""
    norm = (lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)[\W_]+", " "))) if words else (lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    kept = F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), norm), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x))))


def points(df: DataFrame, id_col: str, files_col: str, terms_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, c; points: c, n, files, terms): rows with equal sets are one point, named by the smallest id."""
    df = pick(df, id_col, files_col, terms_col).toDF("id", "files", "terms")
    rows = df.select("id", clean_set(F.col("files"), False).alias("files"), clean_set(F.col("terms"), True).alias("terms"))
    rows = cut(rows.where("id is not null and (size(files) > 0 or size(terms) > 0)").withColumn("h", F.xxhash64("files", "terms")).withColumn("h2", F.xxhash64(F.lit(1), "terms", "files")), "rows")
    one = rows.groupBy("h", "h2").agg(F.min(F.struct("id", "files", "terms")).alias("m"), F.count("*").alias("n")).select("h", "h2", F.col("m.id").alias("c"), "n", F.col("m.files").alias("files"), F.col("m.terms").alias("terms"))
    one = cut(one, "points")
    members = cut(rows.select("id", "h", "h2").join(one.select("h", "h2", "c"), ["h", "h2"]).select("id", "c").distinct(), "members")
    forget(rows)
    return members, one


# --- The graph -------------------------------------------------------------------------------------------------------------------


def _keys(pts: DataFrame) -> DataFrame:
    """(c, side, key): min-hash keys of files (side 0) and of terms (1)."""
    ship(pts.sparkSession)
    rng = np.random.default_rng(5)
    seeds = rng.integers(1 << 62, size=(2, BANDS * ROWS)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for side in (0, 1):
                lens = b.column(1 + side).value_lengths().to_numpy(zero_copy_only=False)
                full = np.flatnonzero(lens > 0)
                if not len(full):
                    continue
                h = b.column(1 + side).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.append(0, np.cumsum(lens[full]))
                at = 0
                while at < len(full):
                    to = max(at + 1, int(np.searchsorted(starts, starts[at] + 20_000, "right")) - 1)
                    x = mix(h[starts[at] : starts[to], None] ^ seeds[side][None, :])
                    low = np.minimum.reduceat(x, starts[at:to] - starts[at], axis=0).reshape(to - at, BANDS, ROWS)
                    key = np.zeros((to - at, BANDS), np.uint64)
                    for r in range(ROWS):
                        key = mix(key * U(31) + low[:, :, r])
                    key = mix(key ^ (np.arange(BANDS, dtype=np.uint64) + U(side * BANDS)))
                    n = (to - at) * BANDS
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(full[at:to], BANDS))), pa.array(np.full(n, side, np.int32)), pa.array(key.ravel().view(np.int64))], names=["c", "side", "key"])
                    at = to

    return pts.select("c", "files", "terms").mapInArrow(run, "c long, side int, key long")


def _csr(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of a column of lists of longs."""
    col = col.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    lens = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lens))


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of lens[i] each, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def _cosines(v: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the sets of rows a[i] and b[i]; rows' sorted 64-bit tokens are v[at[i] : at[i + 1]]."""
    lens = np.diff(at)
    out = np.empty(len(a))
    every = np.sort((np.repeat(np.arange(len(lens), dtype=np.uint64), lens) << U(40)) | (v.view(np.uint64) >> U(24)))
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        x, y = np.where(lens[x] <= lens[y], x, y), np.where(lens[x] <= lens[y], y, x)
        n = lens[x]
        q = (np.repeat(y.astype(np.uint64), n) << U(40)) | (v[_spans(at[x], n)].view(np.uint64) >> U(24))
        hit = every[np.minimum(np.searchsorted(every, q), len(every) - 1)] == q
        out[i : i + (1 << 16)] = np.bincount(np.repeat(np.arange(len(x)), n), hit, minlength=len(x)) / np.sqrt(lens[x] * lens[y])
    return np.round(out, 9)


def _dots(v: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products of all pairs of rows, whose tokens weigh w[row] each; tokens of one row only are left out."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    _, place, count = np.unique(v, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    row, place = row[keep], number[place[keep]]
    out = np.zeros((n, n))
    for lo in range(0, int(shared.sum()), 2048):
        here = (place >= lo) & (place < lo + 2048)
        x = np.zeros((n, min(2048, int(shared.sum()) - lo)))
        x[row[here], place[here] - lo] = w[row[here]]
        out += x @ x.T
    return out


def _linked(same: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    n = len(same)
    label = np.arange(n)
    near = same.copy()
    np.fill_diagonal(near, True)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(pts: DataFrame, keys: DataFrame, threshold: float, spanning: bool = True) -> DataFrame:
    """(a, b) of points that share a key and are as similar as the threshold: links that connect what all such pairs connect, or all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, 3):
            c = t.column("c").to_numpy()
            v, at = _csr(t.column("tokens"))
            size = np.diff(np.append(starts, t.num_rows))
            left, right = [], []
            small = (size > 1) & (size <= FEW)
            s, n = starts[small], size[small]
            if len(s):
                rest, first = _spans(s + 1, n - 1), np.repeat(s, n - 1)
                like = _cosines(v, at, first, rest) >= threshold
                left.append(first[like]), right.append(rest[like])
                if spanning:
                    odd = np.zeros(t.num_rows, bool)
                    odd[rest[~like]] = True
                    x, xs, xn = rest[~like], first[~like], np.repeat(n, n - 1)[~like]
                else:
                    odd = np.ones(t.num_rows, bool)
                    x, xs, xn = rest, first, np.repeat(n, n - 1)
                one, two = np.repeat(x, xn - 1), _spans(xs + 1, xn - 1)  # with the others of the bucket, each pair once
                keep = (one != two) & (~odd[two] | (two < one))
                one, two = one[keep], two[keep]
                like = _cosines(v, at, one, two) >= threshold if len(one) else np.zeros(0, bool)
                left.append(one[like]), right.append(two[like])
            for i in np.flatnonzero(size > FEW):
                lo, hi = starts[i], starts[i] + size[i]
                lens = np.diff(at[lo : hi + 1])
                same = np.round(_dots(v[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], 1 / np.sqrt(lens)), 9) >= threshold
                if spanning:
                    label = _linked(same)
                    two = np.flatnonzero(label != np.arange(len(label)))
                    left.append(lo + label[two]), right.append(lo + two)
                else:
                    one, two = np.nonzero(np.triu(same, 1))
                    left.append(lo + one), right.append(lo + two)
            if left:
                a, b = c[np.concatenate(left)], c[np.concatenate(right)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    size = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = keys.join(size, "key").withColumn("parts", F.ceil(F.col("m") / CHUNK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "c", "side")
    rows = rows.join(pts.select("c", "files", "terms"), "c").select("key", "i", "j", "c", F.when(F.col("side") == 0, F.col("files")).otherwise(F.col("terms")).alias("tokens"))
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


# --- Rounds ----------------------------------------------------------------------------------------------------------------------


def merge_rounds(dots: list[np.ndarray], sizes: list[np.ndarray], threshold: float) -> np.ndarray:
    """The cluster (its first member) of each point of one component.

    dots: sums of cosines for files and for terms of each pair of points, sizes: the rows with files, with terms, of each point.
    """
    n = len(sizes[0])
    root = np.arange(n)
    alive = np.ones(n, bool)

    def similar(rows: np.ndarray) -> np.ndarray:
        each = [d[rows] / np.maximum(s[rows, None] * s[None, :], 1) for d, s in zip(dots, sizes)]
        out = np.round(np.maximum(*each), 9)
        out[:, ~alive] = -1
        out[np.arange(len(rows)), rows] = -1
        return out

    best, sim = np.zeros(n, np.int64), np.full(n, -1.0)
    look = np.arange(n)
    while True:
        for i in range(0, len(look), 256):
            part = look[i : i + 256]
            s = similar(part)
            best[part] = s.argmax(1)
            sim[part] = s[np.arange(len(part)), best[part]]
        mutual = np.flatnonzero(alive & (sim >= threshold) & (best[best] == np.arange(n)) & (np.arange(n) < best))
        if not len(mutual):
            return root
        gone = best[mutual]
        for d in dots:
            d[mutual] += d[gone]
            d[:, mutual] += d[:, gone]
        for s in sizes:
            s[mutual] += s[gone]
        alive[gone] = False
        sim[gone] = -1
        to = np.arange(n)
        to[gone] = mutual
        root = to[root]
        moved = np.zeros(n, bool)
        moved[mutual] = moved[gone] = True
        look = np.flatnonzero(alive & (moved | (moved[best] & (sim >= threshold))))


def _local(pts: DataFrame, threshold: float) -> DataFrame:
    """(c, root) of points (g, c, n, files, terms), component by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, 1):
            c, n = t.column("c").to_numpy(), t.column("n").to_numpy()
            sides = [_csr(t.column(k)) for k in ("files", "terms")]
            root = c.copy()
            for lo, hi in zip(starts, np.append(starts[1:], t.num_rows)):
                dots, sizes = [], []
                for v, at in sides:
                    lens = np.diff(at[lo : hi + 1])
                    dots.append(_dots(v[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n[lo:hi] / np.sqrt(np.maximum(lens, 1))))
                    sizes.append(np.where(lens > 0, n[lo:hi], 0).astype(np.float64))
                root[lo:hi] = c[lo + merge_rounds(dots, sizes, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(root)], names=["c", "root"])

    return pts.select("g", "c", "n", "files", "terms").repartition("g").sortWithinPartitions("g", "c").mapInArrow(run, "c long, root long")


def cluster(members: DataFrame, pts: DataFrame, threshold: float = THRESHOLD, local: int = LOCAL) -> DataFrame:
    """(id, root) of every member: root is its cluster's first point."""
    keys = cut(_keys(pts), "keys")
    near = cut(links(pts, keys, threshold), "links")
    both = cut(near.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst"), "edges")
    if both.isEmpty():
        return members.select("id", F.col("c").alias("root"))
    of = cut(_propagate(both).select(F.col("v").alias("c"), F.col("label").alias("g")), "components")
    sizes = of.groupBy("g").agg(F.count("*").alias("m"))
    large = cut(sizes.where(F.col("m") > local).select("g"), "large")
    some = not large.isEmpty()
    small = of.join(large, "g", "left_anti") if some else of
    label = cut(_local(small.join(pts, "c"), threshold), "labels")
    if some:
        own = cut(of.join(large, "g", "left_semi").join(pts, "c").select("c", "n", "files", "terms"), "large")
        edges = links(own, keys.join(own.select("c"), "c", "left_semi"), threshold, spanning=False)
        label = label.union(_distributed(own, edges, threshold))
    forget(keys, near)
    return members.join(label, "c", "left").select("id", F.coalesce("root", "c").alias("root"))


def vectors_of(pts: DataFrame) -> DataFrame:
    """(c, side, n, token, w) of each point: rows with that side, and the sum of their unit vectors."""
    side = lambda s, col: pts.where(F.size(col) > 0).select("c", F.lit(s).alias("side"), "n", F.explode(col).alias("token"), (F.col("n") / F.sqrt(F.size(col))).alias("w"))
    return side(0, "files").union(side(1, "terms"))


def _distributed(pts: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(c, root) of points whose components are too large for a task; edges (a, b) are all pairs as similar as the threshold."""
    vectors = cut(vectors_of(pts), "vectors")
    label = cut(pts.select("c", F.col("c").alias("root")), "labels")
    graph = cut(_sims(edges, vectors, threshold), "graph")
    while True:
        best = cut(_best(graph), "best")
        back = best.select(F.col("c").alias("other"), F.col("other").alias("back"))
        parent = cut(best.join(back, "other").where("back = c and other < c").select("c", F.col("other").alias("root")), "parents")
        if parent.isEmpty():
            return label
        new = cut(label.withColumnRenamed("root", "was").join(parent.withColumnRenamed("c", "was"), "was", "left").select("c", F.coalesce("root", "was").alias("root")), "labels")
        merged = vectors.join(parent, "c", "left").select(F.coalesce("root", "c").alias("c"), "side", "token", "w", F.col("c").alias("part"), "n")
        sizes = merged.select("c", "side", "part", "n").distinct().groupBy("c", "side").agg(F.sum("n").alias("n"))
        sums = cut(merged.groupBy("c", "side", "token").agg(F.sum("w").alias("w")).join(sizes, ["c", "side"]).select("c", "side", "n", "token", "w"), "vectors")
        to = parent.select("c", "root").union(parent.select("root", "root"))  # both ends of a merge
        x, y = to.toDF("a", "x"), to.toDF("b", "y")
        renamed = graph.join(x, "a", "left").join(y, "b", "left")
        calm = renamed.where("x is null and y is null").select("a", "b", "sim")
        touched = renamed.where("x is not null or y is not null").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        touched = touched.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        kept = cut(calm.union(_sims(touched, sums, threshold)), "graph")
        forget(label, vectors, graph, best, parent)
        label, vectors, graph = new, sums, kept


def _sims(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs that are at least as similar as the threshold."""
    a = vectors.select(F.col("c").alias("a"), "side", "token", F.col("w").alias("wa"), F.col("n").alias("na"))
    b = vectors.select(F.col("c").alias("b"), "side", "token", F.col("w").alias("wb"), F.col("n").alias("nb"))
    dots = pairs.join(a, "a").join(b, ["b", "side", "token"]).groupBy("a", "b", "side").agg((F.sum(F.col("wa") * F.col("wb")) / F.first("na") / F.first("nb")).alias("sim"))
    return dots.groupBy("a", "b").agg(F.round(F.max("sim"), 9).alias("sim")).where(F.col("sim") >= threshold)


def _best(sims: DataFrame) -> DataFrame:
    """(c, other): each cluster's best neighbour, ties to the smallest."""
    both = sims.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("p"), "sim")
    return both.groupBy("p.c").agg(F.max(F.struct("sim", (-F.col("p.other")).alias("low"))).alias("t")).select("c", (-F.col("t.low")).alias("other"))


def found(df: DataFrame, id_col: str = "result_id", files_col: str = "file_ids", terms_col: str = "top_terms", threshold: float = THRESHOLD, local: int = LOCAL) -> DataFrame:
    """(id_col, cluster_id): one row for each member of a cluster of at least two rows; cluster_id is its smallest id."""
    members, pts = points(df, id_col, files_col, terms_col)
    labels = cut(cluster(members, pts, threshold, local), "final")
    size = labels.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
    return labels.join(size, "root").select(F.col("id").alias(id_col), F.col("low").alias("cluster_id"))


def described(df: DataFrame, id_col: str = "result_id", files_col: str = "file_ids", terms_col: str = "top_terms", score_col: str = "score", typical: int = 3) -> DataFrame:
    """(cluster_id, size, mean_score, typical): of each cluster of two or more, with the ids of its most typical results."""
    members, pts = points(df, id_col, files_col, terms_col)
    labels = cut(cluster(members, pts), "final")
    size = cut(labels.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1"), "sizes")
    of = members.join(labels, "id").join(size.select("root"), "root", "left_semi").select("c", "root").distinct()
    own = cut(vectors_of(pts).join(of, "c"), "vectors")
    sums = own.groupBy("root", "side", "token").agg(F.sum("w").alias("total"))
    near = own.join(sums, ["root", "side", "token"]).groupBy("c", "root", "side").agg((F.sum(F.col("w") * F.col("total")) / F.first("n")).alias("s"))
    full = own.select("root", "c", "side", "n").distinct().groupBy("root", "side").agg(F.sum("n").alias("full"))
    near = near.join(full, ["root", "side"]).groupBy("c", "root").agg(F.max(F.col("s") / F.col("full")).alias("sim"))
    ranked = members.join(near, "c").withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.round("sim", 9)), "id"))).where(F.col("k") <= typical)
    top = ranked.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("typical"))  # typical rows at most
    score = pick(df, id_col, score_col).toDF("id", "s").select("id", F.when((F.col("s") >= 0) & (F.col("s") <= 1), F.col("s")).alias("s")).join(labels, "id").groupBy("root").agg(F.round(F.avg("s"), 6).alias("mean_score"))
    return size.join(top, "root").join(score, "root", "left").select(F.col("low").alias("cluster_id"), "size", "mean_score", "typical")
