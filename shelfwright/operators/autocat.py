"""Topics without a model: TF-IDF of descriptors, k-means with a chosen number of clusters, and their terms.

Weights are aggregations over all files, of a bucket or of the corpus. Topics count terms by themselves within each batch of
descriptors, so that only sums for each term travel; the weights of a file are worked out beside it. Centres, their number and its score
are fitted on all files of a bucket: a bucket of at most FIT files by one task, a larger one in rounds over all of its files (rounds).
Members are rows; labels, terms and counts come from all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.operators import rounds
from shelfwright.operators.clusters import dominant_extension
from shelfwright.session import ship
from shelfwright.tables import cut, forget

FEATURES = 6000
TOP = 8
COUNTED = 400_000  # terms that a task counts before it hands the counts on
FIT = 500  # files of a bucket that one task fits by itself


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\b(\w\w+)\b"), F.lit(1))


def ngrams(df: DataFrame, id_col: str, text_col: str, *by: str) -> DataFrame:
    """(*by, id, term) with multiplicity: words of two characters or more, and pairs of neighbours among them."""
    rows = df.select(*by, F.col(id_col).alias("id"), _words(text_col).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return rows.select(*by, "id", F.explode(F.concat("w", pairs)).alias("term"))


def tfidf(df: DataFrame, id_col: str, text_col: str, *by: str, features: int = FEATURES) -> DataFrame:
    """(*by, id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1) over the most frequent terms, of length 1 for each id; by itself within each value of by."""
    tf = ngrams(df, id_col, text_col, *by).groupBy(*by, "id", "term").agg(F.count("*").alias("tf"))
    vocab = tf.groupBy(*by, "term").agg(F.sum("tf").alias("all"), F.count("*").alias("df"))
    if by:
        top = vocab.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("all"), "term"))).where(F.col("pos") <= features)
        terms = top.join(df.groupBy(*by).agg(F.count_distinct(id_col).alias("n")), [*by]).select(*by, "term", "df", "n")
        raw = tf.join(terms, [*by, "term"])
    else:
        terms = vocab.orderBy(F.desc("all"), "term").limit(features).withColumn("n", F.lit(df.select(id_col).distinct().count()))
        raw = tf.join(F.broadcast(terms.select("term", "df", "n")), "term")  # features rows at most
    raw = raw.select(*by, "id", "term", (F.col("tf") * (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1)).alias("x"))
    norm = raw.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, [*by, "id"]).select(*by, "id", "term", (F.col("x") / F.col("norm")).alias("weight"))


def _terms(joined: str | None) -> Counter:
    """The terms of ngrams() of one descriptor and how often each is in it; joined: its words with a blank between."""
    w = joined.split(" ") if joined else []
    c = Counter(w)
    c.update(map(" ".join, zip(w, w[1:])))
    return c


def weigher(items: DataFrame, text_col: str = "d", features: int = FEATURES) -> Callable[[DataFrame], DataFrame]:
    """What gives rows of items, one row an id, their terms and weights in the place of the text: tfidf() within each bucket, as arrays.

    What reaches the driver is the vocabulary, features terms a bucket at most.
    """
    spark = items.sparkSession
    ship(spark)
    words = lambda df: df.select(*[c for c in df.columns if c != text_col], F.array_join(_words(text_col), " ").alias("_w"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for b, (all_, df) in held.items():
                terms = list(all_)
                for lo in range(0, len(terms), 50_000):
                    part = terms[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([all_[t] for t in part], pa.int64()), pa.array([df[t] for t in part], pa.int64())], names=["bucket", "term", "all", "df"])
            held.clear()

        for batch in batches:
            for b, w in zip(batch["bucket"].to_pylist(), batch["_w"].to_pylist()):
                if w:
                    all_, df = held.setdefault(b, (Counter(), Counter()))
                    c = _terms(w)
                    all_.update(c)
                    df.update(c.keys())
            if sum(len(x[0]) for x in held.values()) > COUNTED:
                yield from out()
        yield from out()

    vocab = words(items).select("bucket", "_w").mapInArrow(count, "bucket string, term string, all long, df long").groupBy("bucket", "term").agg(F.sum("all").alias("all"), F.sum("df").alias("df"))
    top = vocab.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("all"), "term"))).where(F.col("pos") <= features)
    n = {r["bucket"]: r["n"] for r in items.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    idf: dict[str | None, dict[str, float]] = {}
    for r in top.select("bucket", "term", "df").collect():  # features rows a bucket
        idf.setdefault(r["bucket"], {})[r["term"]] = float(np.log((1.0 + n[r["bucket"]]) / (1.0 + r["df"])) + 1)
    shared = spark.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights = [], []
            for b, w in zip(batch["bucket"].to_pylist(), batch["_w"].to_pylist()):
                own = shared.value.get(b, {})
                x = {t: k * own[t] for t, k in _terms(w).items() if t in own}
                norm = sum(v * v for v in x.values()) ** 0.5
                terms.append(list(x))
                weights.append([v / norm for v in x.values()])
            keep = [c for c in batch.schema.names if c != "_w"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], names=[*keep, "terms", "weights"])

    def out_of(df: DataFrame) -> DataFrame:
        kinds = [f"`{c}` {k}" for c, k in df.dtypes if c != text_col]
        return words(df).mapInArrow(weigh, ", ".join([*kinds, "terms array<string>", "weights array<double>"]))

    def packed(df: DataFrame) -> DataFrame:
        """As rounds.packed(), without rows of terms between."""
        at = spark.sparkContext.broadcast({b: {t: i for i, t in enumerate(v)} for b, v in out_of.terms.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in weigh(batches):
                place = [at.value[b] for b in batch["bucket"].to_pylist()]
                keep = [c for c in batch.schema.names if c not in ("terms", "weights")]
                terms = [np.array([p[t] for t in v], np.int32).tobytes() for p, v in zip(place, batch["terms"].to_pylist())]
                weights = [np.array(v, np.float32).tobytes() for v in batch["weights"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(terms, pa.binary()), pa.array(weights, pa.binary())], names=[*keep, "at", "w"])

        return words(df).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes if c != text_col), "at binary", "w binary"]))

    out_of.terms = {b: sorted(idf.get(b, ())) for b in n}
    out_of.packed = packed
    return out_of


def weighed(items: DataFrame, text_col: str = "d", features: int = FEATURES) -> DataFrame:
    """items with the terms and weights of weigher()."""
    return weigher(items, text_col, features)(items)


def k_candidates(n: int) -> list[int]:
    """Numbers of clusters to try for n items."""
    return sorted({k for k in (2, 3, 4, 5, 6, 8, 10, n // 6, n // 4, n // 3) if 2 <= k < n})


def kmeans(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) by k-means++ and Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    labels = np.zeros(len(x), int)
    for i in range(rounds):
        dist = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
        new = dist.argmin(1)
        if i and (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                c[j] = x[labels == j].mean(0)
    return labels, c


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances, over all rows."""
    names, inv = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(names) >= len(x):
        return -1.0
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] - 2 * x @ x.T + sq[None, :], 0))
    size = np.bincount(inv)
    to = np.stack([d[:, inv == j].sum(1) for j in range(len(names))], 1)
    own = to[np.arange(len(x)), inv] / np.maximum(size[inv] - 1, 1)
    mean = to / size[None, :]
    mean[np.arange(len(x)), inv] = np.inf
    other = mean.min(1)
    s = np.where(size[inv] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0.0)
    return float(s.mean())


def _fit(files: list[str], rows: pd.DataFrame) -> tuple[float, list[str], np.ndarray]:
    """(score, terms, centres) for files and their rows (id, term, weight): the number of clusters with the best silhouette."""
    terms = sorted(rows["term"].unique())
    at, of = {t: i for i, t in enumerate(terms)}, {f: i for i, f in enumerate(files)}
    x = np.zeros((len(files), max(1, len(terms))))
    x[rows["id"].map(of).to_numpy(int), rows["term"].map(at).to_numpy(int)] = rows["weight"]
    best = (-2.0, x.mean(0, keepdims=True))
    for k in k_candidates(len(files)):
        labels, c = kmeans(x, k)
        s = silhouette(x, labels)
        if s > best[0]:
            best = (s, c)
    return best[0], terms, best[1]


def topics(items: DataFrame, weights: DataFrame, fit: int = FIT) -> tuple[DataFrame, DataFrame]:
    """described_topics of items (bucket, seq, id, ext) and their weights (bucket, id, term, weight)."""
    of = weights.groupBy("bucket", "id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))  # terms of one descriptor
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    items = items.select("bucket", "seq", "id", "ext").join(of, ["bucket", "id"], "left")
    return described_topics(cut(items.select("bucket", "seq", "id", "ext", none("terms", "string"), none("weights", "double")), "items"), fit)


def _vocabulary(items: DataFrame) -> dict[str, list[str]]:
    """The terms of each bucket of items, features terms at most."""
    rows = items.select("bucket", F.explode_outer("terms").alias("term")).groupBy("bucket").agg(F.collect_set("term").alias("terms"))
    return {r["bucket"]: sorted(r["terms"]) for r in rows.collect()}


def described_topics(items: DataFrame, fit: int = FIT, weigh: Callable[[DataFrame], DataFrame] | None = None, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clusters: bucket, cluster, label, top_terms, score, n_files; members: bucket, cluster, id) of items (bucket, seq, id, ext, terms, weights).

    A bucket of fewer than three files is one cluster 'all' of score 1. Every file of a bucket takes part in its fit; fit: files of a bucket
    that one task fits by itself. weigh: a weigher(), where items don't have terms and weights. last: items is a table of cut() that nobody else reads.
    """
    vocabulary = weigh.terms if weigh else _vocabulary(items)
    packed = weigh.packed if weigh else (lambda df: rounds.packed(df, vocabulary))
    weigh = weigh or (lambda df: df)
    spark = items.sparkSession
    ship(spark)
    n = {r["bucket"]: r["n"] for r in items.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    large = {b: k for b, k in n.items() if k > max(fit, rounds.LEAST)}
    few = items.where(~F.col("bucket").isin(list(large)))
    some = weigh(few.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))).drop("seq", "ext"))  # fit rows a bucket
    some = some.select("bucket", "pos", "id", F.explode_outer(F.arrays_zip("terms", "weights")).alias("t")).select("bucket", "pos", "id", F.col("t.terms").alias("term"), F.col("t.weights").alias("weight"))
    schema = "bucket string, cluster int, score double, terms array<string>, centre array<double>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        files = pdf.drop_duplicates("id").sort_values("pos")["id"].tolist()
        if len(files) < 3:
            return pd.DataFrame([[key[0], 0, 1.0, [], []]], columns=[c.split()[0] for c in schema.split(", ")])
        score, terms, centres = _fit(files, pdf.dropna(subset=["term"]))
        out = [[key[0], j, score, [terms[i] for i in np.flatnonzero(c)] if terms else [], [float(v) for v in c[c != 0]]] for j, c in enumerate(centres)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    fitted = some.groupBy("bucket").applyInPandas(run, schema).collect()  # at most fit / 3 centres a bucket, of at most FEATURES numbers
    centres: dict[str, tuple[dict[str, int], np.ndarray]] = {}
    for b in {r["bucket"] for r in fitted}:
        own = sorted((r for r in fitted if r["bucket"] == b), key=lambda r: r["cluster"])
        at = {t: i for i, t in enumerate(sorted({t for r in own for t in r["terms"]}))}
        c = np.zeros((len(own), max(1, len(at))), np.float32)
        for r in own:
            c[r["cluster"], [at[t] for t in r["terms"]]] = r["centre"]
        centres[b] = (at, c)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = np.zeros(len(pdf), np.int32)
            for b, rows in pdf.groupby("bucket").indices.items():
                at, c = shared.value[b]
                for lo in range(0, len(rows), 256):
                    part = rows[lo : lo + 256]
                    x = np.zeros((len(part), c.shape[1]), np.float32)
                    for i, n in enumerate(part):
                        for t, w in zip(pdf["terms"].iat[n], pdf["weights"].iat[n]):
                            if t in at:
                                x[i, at[t]] = w
                    got[part] = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            yield pd.DataFrame({"bucket": pdf["bucket"], "cluster": got, "id": pdf["id"], "seq": pdf["seq"], "ext": pdf["ext"]})

    kind = dict(items.dtypes)["seq"]
    members = cut(weigh(few).mapInPandas(place, f"bucket string, cluster int, id string, seq {kind}, ext string"), "members")
    known = []
    for r in fitted:
        order = sorted(zip(r["centre"], r["terms"]), key=lambda p: (-p[0], p[1]))
        rest = sorted(set(centres[r["bucket"]][0]) - set(r["terms"]))
        known.append([r["bucket"], r["cluster"], r["score"], ([t for _, t in order] + rest)[:TOP], not centres[r["bucket"]][0] and r["score"] == 1.0])
    known = spark.createDataFrame(known, "bucket string, cluster int, score double, top_terms array<string>, whole boolean")
    if large:
        found, of = rounds.whole(packed(items.where(F.col("bucket").isin(list(large)))), vocabulary, large, k_candidates, fit, TOP, lambda: forget(items) if last else None)
        known, members = known.unionByName(found.withColumn("whole", F.lit(False))), cut(members.unionByName(of), "members")
    ext = dominant_extension(members.select(F.struct("bucket", "cluster").alias("k"), F.coalesce("ext", F.lit("")).alias("ext"), "seq"), "k").select("k.bucket", "k.cluster", "ext")
    size = members.groupBy("bucket", "cluster").agg(F.count("*").alias("n_files"))
    text = F.regexp_replace(F.concat_ws(" ", F.nullif("ext", F.lit("")), F.array_join(F.slice("top_terms", 1, 4), ", ")), r"^[, ]+|[, ]+$", "")
    label = F.when(F.col("whole"), "all").otherwise(F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("cluster_"), "cluster")))
    return known.join(size, ["bucket", "cluster"]).join(ext, ["bucket", "cluster"]).select("bucket", "cluster", label.alias("label"), "top_terms", "score", "n_files"), members.select("bucket", "cluster", "id")


def top_terms(weights: DataFrame, n: int = TOP) -> DataFrame:
    """The n heaviest terms of each id."""
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return weights.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
