"""Similarity of 64-bit fingerprints: Hamming pairs and greedy leader clusters, exact at any partitioning.

Pairs within distance t are found by blocks: 64 bits are cut into t + m blocks; two words within t differ in at most t of them, so at
least m blocks are equal. Every choice of m blocks is a join key. More equal blocks asked for make keys longer and candidates
fewer, at the price of more keys; m is the first for which the measured sizes of keys keep candidates in proportion to the words.
A pair belongs to the key of its first m equal blocks alone. Only the first d of them travel: a word is sent to C(t + d, d) places (9
for t = 8 and d = 1), where all the keys that begin so are sorted in memory; so neither shuffle nor any join holds a row for each key.

In leader clustering, the first unassigned item (by seq) leads and takes every later unassigned item within t of itself. It is the
lexicographically first maximal independent set of the pair graph: a word is a leader once no earlier neighbour is undecided or a
leader, and a member once an earlier neighbour leads. Rounds end with the longest chain of waiting neighbours. Equal words
are one vertex.

Tables of words, items and edges are joined by shuffles: such columns of numbers are small as files and many times as large in a
driver that would build a broadcast of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.session import ship
from shelfwright.tables import cut, forget, numbered, shuffled

BLOCKS = (2, 3, 4)  # equal blocks to ask for, from short keys to long ones
LOOKED_AT = 4  # keys of a word whose sizes are measured
ALONE = 4096  # words that one task compares without sending them anywhere
TOGETHER = 1 << 19  # words of one key sent to one place, where m blocks can do that
HELD = 1 << 19  # words that a task is sent, hot keys aside
AT_ONCE = 1 << 20  # candidates compared at once


def block_masks(t: int, m: int) -> list[int]:
    """The bits of each of the t + m blocks."""
    k = t + m
    edges = [64 * i // k for i in range(k + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def choices(t: int, m: int, d: int) -> list[tuple[int, ...]]:
    """The first d of every choice of m of t + m blocks."""
    return sorted({c[:d] for c in combinations(range(t + m), m)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(words: DataFrame, t: int, m: int, chosen: list[tuple[int, ...]]) -> DataFrame:
    """(fp, choice, value) of each word and each choice of blocks; value: the bits of the word in these blocks."""
    masks = block_masks(t, m)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[j] for j in c)))).alias("value")) for i, c in enumerate(chosen)])
    return words.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.value")


def pairs_within(words: np.ndarray, t: int, m: int, first: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of distinct words within t whose first m equal blocks begin with the blocks first."""
    masks = block_masks(t, m)
    u = np.uint64
    for choice in (c for c in combinations(range(t + m), m) if c[: len(first)] == first):
        key = words & u(sum(masks[j] for j in choice))
        order = np.argsort(key, kind="stable")
        key, w = key[order], words[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.repeat(np.append(new[1:], len(w)), np.diff(np.append(new, len(w))))
        left = np.flatnonzero(end - np.arange(len(w)) > 1)
        upto = np.cumsum(end[left] - left - 1)
        at = 0
        while at < len(left):  # candidates: each word with the later ones of its key
            done = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            i, many = left[at:to], np.diff(np.append(done, upto[at:to]))
            a = np.repeat(w[i], many)
            b = w[np.arange(upto[to - 1] - done) - np.repeat(upto[at:to] - many - done - i - 1, many)]
            x = a ^ b
            ok = np.flatnonzero(np.bitwise_count(x) <= t)
            for j in range(choice[-1]):  # no other block before the last is equal: else the pair is that of another key
                if j not in choice:
                    ok = ok[(x[ok] & u(masks[j])) != 0]
            a, b = a[ok].view(np.int64), b[ok].view(np.int64)
            yield np.minimum(a, b), np.maximum(a, b)
            at = to


def hamming_pairs(words: DataFrame, t: int, fp: str = "fp") -> DataFrame:
    """(fp_a, fp_b, distance), fp_a < fp_b: all pairs of distinct words within distance t."""
    spark = words.sparkSession
    ship(spark)
    distinct = words.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct()
    distinct = cut(distinct, "fps")
    n = distinct.count()
    m, d, places = BLOCKS[0], 0, 1
    if n > ALONE:
        for m in BLOCKS:  # the sizes of some of the keys tell how many pairs all of them bring together
            every = choices(t, m, m)
            some = every[:: max(1, len(every) // LOOKED_AT)][:LOOKED_AT]
            found = _keyed(distinct, t, m, some).groupBy("choice", "value").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
            if found / len(some) * len(every) <= 4 * comb(t + m + 1, m + 1) * n:  # longer keys would cost more than they save
                break
        for d in range(1, m + 1):
            top = _keyed(distinct, t, m, choices(t, m, d)).groupBy("choice", "value").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
            if top <= TOGETHER:
                break
        places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(choices(t, m, d)) * n // HELD + 1)
    chosen = choices(t, m, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            choice, word = batch["choice"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            for c in np.unique(choice):
                held.setdefault(int(c), []).append(word[choice == c])
        for c in sorted(held):
            for a, b in pairs_within(np.concatenate(held.pop(c)), t, m, chosen[c]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32))], names=["fp_a", "fp_b", "distance"])

    sent = _keyed(distinct, t, m, chosen)
    sent = sent.repartition(places, "choice", "value") if n > ALONE else sent.coalesce(1)
    return sent.select("choice", "fp").mapInArrow(run, "fp_a long, fp_b long, distance int")


def leader_clusters(items: DataFrame, t: int, fp: str = "fp") -> DataFrame:
    """(cluster_idx, seq, id, leader_seq, n): members of the clusters of two or more; clusters are numbered by their leaders' seq."""
    items = cut(items.where(F.col(fp).isNotNull()).select("seq", "id", F.col(fp).alias("fp")), "items")
    words = cut(items.groupBy("fp").agg(F.min("seq").alias("rank")), "words")
    near = hamming_pairs(words, t)
    ranked = near.join(shuffled(words.toDF("fp_a", "ra")), "fp_a").join(shuffled(words.toDF("fp_b", "rb")), "fp_b")
    edges = cut(ranked.select(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")), "edges")

    decided: DataFrame | None = None
    left, rounds = edges, 0
    while True:
        # left: edges whose later end v is undecided, and whose earlier end u may still lead it
        waiting = left.select("v").distinct()
        lead = left.select(F.col("u").alias("v")).distinct().join(shuffled(waiting), "v", "left_anti")
        taken = left.join(shuffled(lead.withColumnRenamed("v", "u")), "u", "left_semi").groupBy("v").agg(F.min("u").alias("leader"))
        new = cut(taken.select("v", "leader"), "taken")
        if new.isEmpty():
            break
        decided = new if decided is None else decided.unionByName(new)
        gone = new.select("v")
        rest = left.join(shuffled(gone), "v", "left_anti").join(shuffled(gone.withColumnRenamed("v", "u")), "u", "left_anti")
        rest = cut(rest, "left")
        if rounds:
            forget(left)
        left, rounds = rest, rounds + 1
    # A member belongs to the earliest of its neighbours that lead.
    if decided is None:
        owner = words.select("fp", F.col("rank").alias("leader_seq"))
    else:
        led = cut(decided.select(F.col("v")), "led")
        first = edges.join(shuffled(led.withColumnRenamed("v", "u")), "u", "left_anti").groupBy("v").agg(F.min("u").alias("leader"))
        of = shuffled(led).join(first, "v").select(F.col("v").alias("rank"), "leader")
        owner = words.join(shuffled(of), "rank", "left").select("fp", F.coalesce("leader", "rank").alias("leader_seq"))
    placed = shuffled(items).join(shuffled(owner), "fp")
    size = placed.groupBy("leader_seq").agg(F.count("*").alias("n")).where("n > 1")
    index = numbered(size, "leader_seq", name="cluster_idx")
    return shuffled(placed).join(index, "leader_seq").select("cluster_idx", "seq", "id", "leader_seq", "n")
