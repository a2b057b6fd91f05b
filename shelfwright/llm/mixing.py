"""Problem 7: mixing sources to target weights, in tokens of a public tokenizer.

Method: a multivariate hypergeometric splitting tree. Each source is cut into blocks of documents by a hash, at most MAX_BLOCKS of
about BLOCK_TOKENS tokens. A source's quota is a number of draws of blocks: whole passes over the source, then the first blocks of
a random order, and of one block more the documents that fill the rest. The tree halves the output shards again and again; at each
node the draws of all sources that the left half gets are one multivariate hypergeometric draw without replacement, so that every
draw goes to exactly one shard and each shard is a fair sample of the mix. The leaves give each shard a range of each source's
draws; documents find their shard by their block's rank, and each shard is shuffled by a hash on its own.

Only figures of (mix, source) and of (mix, source, shard) are on the driver: rows of the targets times at most MAX_SHARDS, however
much data; there is a shard for SHARD_TOKENS of the largest mix. Beyond MAX_SHARDS, the leaves of the tree are cut further, each draw
of a leaf going to one of its parts by a hash. Shards are looked up by block and pass, documents
then join their block; what is shuffled is block sizes, that join, and the result by shard.

Quotas: a mix has total_tokens tokens, by default as many as its sources with a positive weight have. Each gets its weight's share,
but at most max_repeats times what it has; what is cut off goes to the others in proportion to their weights, as far as theirs allow.

Defined results: sources are compared without regard to letter case and blanks around them; a null or zero weight, or a zero cap,
means no documents of the source; a null cap means once; several rows of one source in a mix add their weights up under the
smallest cap; a source without documents gets nothing, and the others its share; documents without tokens or source are never
drawn; equal ids count as one document each row. The same seed gives the same mix. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm import tree_tokens
from shelfwright.llm.common import cut, pick

MIN_SHARDS, MAX_SHARDS, SHARD_TOKENS = 16, 4096, 2_000_000
BLOCK_TOKENS = 20_000
MAX_BLOCKS = 1 << 15


def source_name(col: Column | str) -> Column:
    """A source's name without regard to case and blanks; blank is null."""
    name = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def quotas(weights: dict, caps: dict, have: dict, total: float) -> dict:
    """Tokens of each source: shares of total by weight, at most caps * have; what caps cut off goes to the others."""
    most = {s: caps[s] * have.get(s, 0) for s in weights}
    open_, out, left = {s for s in weights if weights[s] > 0 and most[s] > 0}, dict.fromkeys(weights, 0.0), float(total)
    while open_ and left > 1e-9:
        whole = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] / whole * left >= most[s]}
        if not full:
            for s in open_:
                out[s] = weights[s] / whole * left
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
        open_ -= full
    return out


def split(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many of each source's draws each shard gets; columns sum to counts exactly."""
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray, path: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(round(int(have.sum()) * (mid - lo) / (hi - lo)))
        rng = np.random.default_rng([seed, path])
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if have.sum() else have * 0
        node(lo, mid, left, 2 * path)
        node(mid, hi, have - left, 2 * path + 1)

    node(0, shards, np.asarray(counts, np.int64), 1)
    return out


def targets(mix_targets: DataFrame) -> DataFrame:
    """(mix_id, source, weight, cap): one row for each source of a mix."""
    w = F.when(~F.isnan("weight") & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)
    mix_targets = pick(mix_targets, "mix_id", "source", "weight", "max_repeats")
    rows = mix_targets.where("mix_id is not null").select("mix_id", source_name("source").alias("source"), w.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap")).where("source is not null")
    return rows.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.min("cap").alias("cap"))


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None, shards: int | None = None, seed: int = 17, block_tokens: int = BLOCK_TOKENS, vocab_path: str = tree_tokens.VOCAB, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(draws: mix_id, shard, order_key, source, doc_id, epoch, n_tokens; wanted: mix_id, source, weight, cap, quota, have)."""
    spark = documents.sparkSession
    named = pick(documents, id_col, source_col, text_col).toDF("doc_id", "source", "text").select(F.struct("doc_id", source_name("source").alias("source")).alias("d"), "text")
    sizes = tree_tokens.count_tokens(named, "d", "text", vocab_path)
    goals = targets(mix_targets)
    sizes = cut(sizes.select("d.doc_id", "d.source", "n_tokens").where("source is not null and n_tokens > 0"), "sizes")
    have = {r["source"]: (int(r["t"]), int(r["n"])) for r in sizes.join(F.broadcast(goals.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}

    goal_rows, plan = goals.collect(), []  # rows of the targets' table
    n_blocks = {s: max(1, min(MAX_BLOCKS, n, -(-t // block_tokens))) for s, (t, n) in have.items()}
    for m in sorted({r["mix_id"] for r in goal_rows}):
        own = sorted((r for r in goal_rows if r["mix_id"] == m), key=lambda r: r["source"])
        tokens = {r["source"]: have.get(r["source"], (0, 0))[0] for r in own}
        total = total_tokens if total_tokens is not None else sum(tokens[r["source"]] for r in own if r["weight"] > 0)
        q = quotas({r["source"]: r["weight"] for r in own}, {r["source"]: r["cap"] for r in own}, tokens, total)
        for r in own:
            s = r["source"]
            passes = int(q[s] // tokens[s] + 1e-9) if tokens[s] else 0
            plan.append([m, s, float(r["weight"]), int(r["cap"]), float(q[s]), tokens[s], n_blocks.get(s, 1), passes, max(0.0, q[s] - passes * tokens[s]) if passes < r["cap"] else 0.0])
    names = "mix_id int, source string, weight double, cap int, quota double, have long, blocks long, passes int, rest double"
    wanted = spark.createDataFrame(plan, names)
    if shards is None:
        largest = max((sum(p[4] for p in plan if p[0] == m) for m in {p[0] for p in plan}), default=0)
        shards = int(max(MIN_SHARDS, -(-largest // SHARD_TOKENS)))
    parts = -(-shards // MAX_SHARDS)  # of a leaf
    shards = -(-shards // parts)

    # Blocks in random order, and where each mix's last, partial pass ends in it.
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))
    docs = sizes.join(F.broadcast(wanted.where("quota > 0").select("source", "blocks").distinct()), "source").withColumn("block", block)
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")  # MAX_BLOCKS rows a source
    blocks = cut(docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")).withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("size").over(order)), "blocks")
    live = wanted.where("quota > 0").select("mix_id", "source", "passes", "rest")
    at = blocks.join(F.broadcast(live), "source").where(F.col("upto") - F.col("size") < F.col("rest")).groupBy("mix_id", "source").agg(F.max("rank").alias("last"))
    ends = {(r["mix_id"], r["source"]): int(r["last"]) for r in at.collect()}  # rows of the targets' table
    used = {r["source"]: int(r["n"]) for r in blocks.groupBy("source").agg(F.count("*").alias("n")).collect()}

    ranges = []
    for m in sorted({p[0] for p in plan}):
        own = [p for p in plan if p[0] == m and p[4] > 0]
        draws = [p[7] * used.get(p[1], 0) + ends.get((m, p[1]), -1) + 1 for p in own]
        got = split(draws, shards, seed * 1000 + int(m)) if own else np.zeros((shards, 0), np.int64)
        for j, p in enumerate(own):
            ranges.append([m, p[1], p[7], p[8], ends.get((m, p[1]), -1), used.get(p[1], 0), [int(x) for x in np.cumsum(got[:, j])]])
    spread = spark.createDataFrame(ranges, "mix_id int, source string, passes int, rest double, last int, used int, bounds array<long>")

    of_pass = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda e: F.size(F.filter("bounds", lambda x: x <= e.cast("long") * F.col("used") + F.col("rank"))))
    where = blocks.select("source", "block", "rank", (F.col("upto") - F.col("size")).alias("before")).join(F.broadcast(spread), "source")
    placed = docs.join(where.withColumn("shards", of_pass).drop("bounds", "used"), ["source", "block"])
    partial = placed.where("rank = last")
    inside = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # one block
    partial = partial.withColumn("reps", F.col("passes") + (F.sum("n_tokens").over(inside) - F.col("n_tokens") / 2 + F.col("before") <= F.col("rest")).cast("int"))
    rest = placed.where("rank <> last").withColumn("reps", F.col("passes") + (F.col("rank") < F.col("last")).cast("int"))
    drawn = rest.unionByName(partial).where("reps > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)))
    out = drawn.select("mix_id", (F.col("shards")[F.col("epoch")] * parts + F.pmod(F.xxhash64("mix_id", "doc_id", "epoch", F.lit(seed + 3)), F.lit(parts)).cast("int")).alias("shard"), F.xxhash64("doc_id", "epoch", "mix_id", F.lit(seed)).alias("order_key"), "source", "doc_id", "epoch", "n_tokens")
    return out, wanted


def mixed(documents: DataFrame, mix_targets: DataFrame, **more) -> DataFrame:
    """The mix, each shard in one partition and shuffled within."""
    draws, _ = mix(documents, mix_targets, **more)
    return draws.repartition("mix_id", "shard").sortWithinPartitions("mix_id", "shard", "order_key", "doc_id")


def shares(documents: DataFrame, mix_targets: DataFrame, **more) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, have, documents, most_repeats, cap) of every source of every mix."""
    draws, wanted = mix(documents, mix_targets, **more)
    each = draws.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.sum((F.col("epoch") == 0).cast("long")).alias("documents"), (F.max("epoch") + 1).alias("most_repeats"))
    by = Window.partitionBy("mix_id")  # rows of the targets' table
    out = wanted.join(each, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(by)), F.lit(0.0)), 6)
    return out.select("mix_id", "source", share("weight").alias("target_share"), share("tokens").alias("actual_share"), "tokens", "have", "documents", "most_repeats", "cap")
