"""Problem 1: near-duplicate records with small edits.

Method: improved consistent weighted sampling (Ioffe 2010) over TF-IDF word shingles, banded, verified by weighted Jaccard.

1. Document frequencies of all shingles are counted over the whole corpus into a sketch of fixed size (sketch.py); a shingle
   weighs tf * idf^2, idf = ln((1 + n) / (1 + df)). The square keeps sentences that thousands of texts share from making
   strangers look alike.
2. Texts with one bag of shingles are one class; later steps see one representative of each class.
3. Each representative gets SAMPLES consistent weighted samples (shingle, quantised weight). Two texts agree in a sample with a
   probability equal to their weighted Jaccard similarity. Where a large share of the corpus is near copies of one text, inverse
   frequencies would leave only the edits; so every text gets a second set of samples: with weights tf alone, or equal weights where
   the plain Jaccard similarity is asked for.
4. BANDS keys, each of ROWS samples, of either set are the blocking keys. One shuffle brings equal keys together; they are read as a
   stream, so no bucket is held in memory. A bucket of more than BUCKET classes is cut into chunks, and pairs of chunks are tasks of
   their own: there, signatures are compared block by block, and only pairs that agree often enough leave the task. Keys that a
   sketch of all keys shows to hold far more than others never come together in one task, but go to the chunks at once.
5. Candidate pairs whose samples agree too rarely are dropped by a binomial bound, the rest are verified exactly on their
   shingles: weighted Jaccard by TF-IDF or by tf, whichever is higher, and the plain Jaccard of the sets.

Defined results: null, empty and wordless texts, and texts of fewer than min_words words, are in no group; a text of fewer than
k words is one shingle; an id given twice with one text is one record; an id with two texts belongs to the classes of both.
Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm import shingles
from shelfwright.llm.common import cut, forget, pick, ship
from shelfwright.llm.runs import whole_runs
from shelfwright.llm.shingles import U, mix
from shelfwright.llm.sketch import count_items

SAMPLES, ROWS, BANDS = 28, 3, 28
PLAIN_ROWS, PLAIN_BANDS = 4, 36  # of the second set of samples: many texts share a little boilerplate, so its keys are longer
WIDTH = 1 << 20  # counters of the document frequency sketch
BUCKET, CHUNK = 64, 1 << 14
HOT = 1 << 16  # classes of a key that one task may read, or eight times the mean load of the keys' sketch
CELLS = 1 << 13  # shingles sampled at once
TABLE = 1024
LOW = U((1 << 32) - 1)


@dataclass
class NearDuplicates:
    """members: id, class_id (hash of the class), rep (its smallest id). links: class_a, class_b, rep_a, rep_b, weighted, jaccard, each pair of classes once. copies: class_id, id of the classes of several rows."""

    members: DataFrame
    links: DataFrame
    copies: DataFrame
    parts: tuple[DataFrame, ...] = ()


def band_samples(samples: int = SAMPLES, rows: int = ROWS, bands: int = BANDS) -> list[tuple[int, ...]]:
    """The samples of each band: different sets, each sample in about as many bands as any other."""
    rng, out, pool = np.random.default_rng(11), [], []
    while len(out) < bands:
        if len(pool) < rows:
            pool = list(rng.permutation(samples))
        one, pool = tuple(sorted(int(x) for x in pool[:rows])), pool[rows:]
        if one not in out:
            out.append(one)
    return out


def sampler(samples: int = SAMPLES, seed: int = 7):
    """sample(hashes, log weights, starts) -> (documents, samples) array of 32-bit samples; every document has a shingle."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2.0, 1.0, TABLE).astype(np.float32)
    inv_r = (1 / r).astype(np.float32)
    ln_c = (np.log(rng.gamma(2.0, 1.0, TABLE)) + 64).astype(np.float32)  # + 64: all keys positive, so that their bits are in order
    seeds = rng.integers(1 << 32, size=samples).astype(np.uint32)
    c1, c2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)

    def cells(h: np.ndarray, lw: np.ndarray) -> np.ndarray:
        """The key of each (shingle, sample): ln a in order above, the sampled (shingle, step) below. 32-bit mixing, 10 + 10 + 12 bits."""
        low = (h ^ (h >> U(32))).astype(np.uint32)
        m = low[:, None] ^ seeds[None, :]
        m *= c1
        m ^= m >> np.uint32(15)
        m *= c2
        m ^= m >> np.uint32(16)
        beta = (m & np.uint32(4095)).astype(np.float32)
        beta *= np.float32(1 / 4096)
        m >>= np.uint32(12)
        ic = m & np.uint32(TABLE - 1)
        m >>= np.uint32(10)
        t = inv_r.take(m)
        t *= lw[:, None]
        t += beta
        np.floor(t, out=t)
        fp = t.astype(np.int32).view(np.uint32)
        fp *= np.uint32(0x9E3779B1)
        fp ^= low[:, None]
        t -= beta
        t += np.float32(1)
        t *= r.take(m)
        a = ln_c.take(ic)
        a -= t
        key = np.empty((*fp.shape, 2), np.uint32)
        key[..., 0], key[..., 1] = fp, a.view(np.uint32)
        return key.view(np.uint64)[..., 0]

    def sample(h: np.ndarray, lw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts) - 1, samples), np.uint32)
        d, n = 0, len(starts) - 1
        while d < n:
            to = max(d + 1, int(np.searchsorted(starts, starts[d] + CELLS, "right")) - 1)
            lo, hi = starts[d], starts[to]
            if hi - lo <= 2 * CELLS:
                best = np.minimum.reduceat(cells(h[lo:hi], lw[lo:hi]), starts[d:to] - lo, axis=0)
            else:  # one long text
                best = np.min([cells(h[i : i + CELLS], lw[i : i + CELLS]).min(0) for i in range(lo, hi, CELLS)], axis=0)[None, :]
            out[d:to] = best.astype(np.uint32)
            d = to
        return out

    return sample


def _slot(h: np.ndarray, width: int) -> np.ndarray:
    return (mix(h & LOW) & U(width - 1)).view(np.int64)  # of the half of a hash that bags keep


def _idf_table(counts: np.ndarray, docs: int) -> np.ndarray:
    """2 ln idf of each slot; what a slot counts for others, on average, is taken off."""
    own = np.clip(counts - counts.mean(), 1, docs) if docs else counts
    return (2 * np.log(np.log((2.0 + docs) / (1.0 + own)) + 1e-3)).astype(np.float32)


def find(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1, samples: int = SAMPLES, rows: int = ROWS, bands: int = BANDS, width: int = WIDTH, jaccard: float | None = None) -> NearDuplicates:
    """Links between classes of equal texts whose weighted Jaccard similarity is threshold or more.

    With jaccard, links are those of that plain Jaccard similarity instead, whatever the weighted one; every text is sampled as a set, too.
    """
    spark = df.sparkSession
    ship(spark)
    docs = pick(df, id_col, text_col).toDF("_id", "_text").where("_id is not null and _text is not null")

    def slots(b: pa.RecordBatch, counts: np.ndarray) -> int:
        n = 0
        for _, data, off in shingles.chunks(b.column(0)):
            h, _, starts, n_words = shingles.bags(data, off, k)
            keep = np.repeat(n_words >= min_words, np.diff(starts))
            counts += np.bincount(_slot(h[keep], width), minlength=width)
            n += int(((n_words >= min_words) & (n_words > 0)).sum())
        return n

    counts, n_docs = count_items(docs.select("_text"), slots, width)
    table = spark.sparkContext.broadcast(_idf_table(counts, n_docs))  # 4 bytes a slot, whatever the corpus

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, two_ln_idf = sampler(samples), table.value
        for b in batches:
            ids = b.column(0)
            for at, data, off in shingles.chunks(b.column(1)):
                h, tf, starts, n_words = shingles.bags(data, off, k)
                ok = np.flatnonzero((n_words >= min_words) & (n_words > 0))
                if not len(ok):
                    continue
                if len(ok) < len(off) - 1:
                    lens = np.diff(starts)
                    keep = np.zeros(len(lens), bool)
                    keep[ok] = True
                    keep = np.repeat(keep, lens)
                    h, tf, starts = h[keep], tf[keep], np.append(0, np.cumsum(lens[ok]))
                lw = two_ln_idf[_slot(h, width)]
                ln_tf = np.zeros(len(h), np.float32)
                many = tf > 1
                ln_tf[many] = np.log(tf[many]).astype(np.float32)
                sig = sample(h, lw + ln_tf, starts)
                plain = sample(h, ln_tf if jaccard is None else np.zeros(len(h), np.float32), starts)
                x = mix(h + tf.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                f1, f2 = np.add.reduceat(x, starts[:-1]), np.add.reduceat(mix(x ^ U(0x51)), starts[:-1])
                lists, more = (pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * samples), pa.array(x.reshape(-1).view(np.int32))) for x in (sig, plain))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(ok + at)), pa.array(mix(f1).view(np.int64)), pa.array(mix(f2).view(np.int64)), lists, more], names=["_id", "f1", "f2", "sig", "plain"])

    id_type = docs.schema["_id"].dataType.simpleString()
    signed = cut(docs.mapInArrow(signatures, f"_id {id_type}, f1 long, f2 long, sig array<int>, plain array<int>"), "signatures")
    classes = cut(signed.groupBy("f1", "f2").agg(F.min(F.struct("_id", "sig", "plain")).alias("m"), F.count("*").alias("n")).select("f1", "f2", F.col("m._id").alias("rep"), F.col("m.sig").alias("sig"), F.col("m.plain").alias("plain"), "n"), "classes")
    who = cut(signed.select("_id", "f1", "f2"), "who")
    forget(signed)
    members = who.join(classes.where("n > 1").select("f1", "f2", "rep"), ["f1", "f2"], "left").select(F.col("_id").alias("id"), F.col("f1").alias("class_id"), F.coalesce("rep", "_id").alias("rep")).distinct()

    #: Agreements out of `samples` that a pair just at the threshold misses with a probability under 0.01, and one 0.15 above it under 1e-4.
    enough = lambda x, r: int(max(r, np.floor(samples * x - 2.5 * np.sqrt(samples * x * (1 - x)))))
    sets = (band_samples(samples, rows, bands), band_samples(samples, PLAIN_ROWS, PLAIN_BANDS))
    least = (enough(threshold, rows), enough(threshold if jaccard is None else jaccard, PLAIN_ROWS))
    pairs, parts = _candidates(classes.select("f1", "sig", "plain"), sets, least)
    tested = {"sig": least[0], "plain": least[1]} if jaccard is None else {"plain": least[1]}  # what decides in the end
    likely = cut(_agreeing(pairs, classes, samples, tested), "likely")
    links, bags = _verify(docs, classes, likely, table, k, F.col("weighted") >= threshold if jaccard is None else F.col("jaccard") >= jaccard, width)
    several = classes.where("n > 1").select("f1", "f2", "rep")
    copies = cut(who.select("f1", "f2", F.col("_id").alias("id")).join(several, ["f1", "f2"]).select(F.col("f1").alias("class_id"), "id").distinct(), "copies")
    return NearDuplicates(members, links, copies, (who, classes, likely, copies, bags, *parts))


def _agreeing(pairs: DataFrame, classes: DataFrame, samples: int, tested: dict[str, int]) -> DataFrame:
    """The pairs (a, b) whose samples of one of the tested sets agree often enough. What is joined to a pair is a byte of each sample: one in 256 agrees by chance."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, samples) for k in tested]
            flat = np.ascontiguousarray(np.concatenate(each, axis=1)).reshape(-1)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * (len(tested) * samples)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(flat)])], names=["f1", "low"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, len(tested), samples) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array(((x == y).sum(2) >= np.array(list(tested.values()))[None, :]).any(1)))

    short = cut(classes.select("f1", *tested).mapInArrow(low, "f1 long, low binary"), "low")
    rows = pairs.join(short.toDF("a", "low_a"), "a").join(short.toDF("b", "low_b"), "b").select("a", "b", "low_a", "low_b")
    return rows.mapInArrow(test, "a long, b long").distinct()


def _candidates(classes: DataFrame, sets: tuple[list[tuple[int, ...]], ...], least: tuple[int, ...]) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a < b) of class hashes that share a band, once for each such band, and the tables they are made of."""

    def keys(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows they belong to) of the bands of either set of samples."""
        for side in (1, 2):
            v = b.column(side).flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64).reshape(b.num_rows, -1)
            for j, s in enumerate(sets[side - 1]):
                key = np.full(len(v), 1000 * side + j, np.uint64)
                for i in s:
                    key = mix(key * U(31) + v[:, i])
                yield key.view(np.int64), np.arange(len(v))

    def add(b: pa.RecordBatch, counts: np.ndarray) -> int:
        for key, _ in keys(b):
            counts += np.bincount(_slot(key.view(np.uint64), WIDTH), minlength=WIDTH)
        return b.num_rows

    load, _ = count_items(classes, add, WIDTH)
    over = load > max(HOT, 8 * load.mean())
    hot = classes.sparkSession.sparkContext.broadcast(np.flatnonzero(over))  # an eighth of the counters at most

    def keyed(batches: Iterator[pa.RecordBatch], want: bool) -> Iterator[pa.RecordBatch]:
        is_hot = np.zeros(WIDTH, bool)
        is_hot[hot.value] = True
        for b in batches:
            f1 = b.column(0).to_numpy(zero_copy_only=False)
            for key, row in keys(b):
                keep = is_hot[_slot(key.view(np.uint64), WIDTH)] == want
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(f1[row[keep]])], names=["key", "f1"])

    rows = lambda want: classes.mapInArrow(lambda b: keyed(b, want), "key long, f1 long")
    part = cut(_buckets(rows(False), BUCKET), "pairs")
    small = part.where("not big").select("a", "b")
    big = part.where("big").select(F.col("a").alias("key"), F.col("b").alias("f1"))
    if over.any():
        big = big.union(rows(True))
    elif big.isEmpty():
        return small, [part]
    return small.union(_large(big, classes, least)), [part]


def _large(big: DataFrame, classes: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """(a, b) of the members of large buckets (key, f1) whose samples (classes: f1, sig, plain) agree often enough: chunk against chunk, each pair of chunks a task."""
    size = big.groupBy("key").agg(F.count("*").alias("m"))
    rows = big.join(size, "key").join(classes, "f1").withColumn("parts", F.ceil(F.col("m") / CHUNK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("f1"), F.col("parts")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = rows.select("key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "f1", "sig", "plain")

    def compare(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        own, f1 = cell["own"].to_numpy(), cell["f1"].to_numpy()
        left, right = np.flatnonzero(own == cell["i"][0].as_py()), np.flatnonzero(own == cell["j"][0].as_py())
        sigs = [np.array(cell[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(f1), -1) for c in ("sig", "plain")]
        for at in range(0, len(left), 64):
            l = left[at : at + 64]  # noqa: E741
            for to in range(0, len(right), 4096):
                r = right[to : to + 4096]
                enough = np.zeros((len(l), len(r)), bool)
                for m, n in zip(sigs, least):
                    same = np.zeros((len(l), len(r)), np.uint8)
                    for k in range(m.shape[1]):
                        same += m[l, k][:, None] == m[r, k][None, :]
                    enough |= same >= n
                p, q = np.nonzero(enough)
                a, b = f1[l[p]], f1[r[q]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[a != b]), pa.array(np.maximum(a, b)[a != b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, 3):  # a cell holds two chunks at most
            for lo, hi in zip(starts, np.append(starts[1:], t.num_rows)):
                yield from compare(t.slice(lo, hi - lo))

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _buckets(rows: DataFrame, most: int) -> DataFrame:
    """(a, b, big) of rows (key, member): pairs of each key's members; of a key with more than most members (key, member, true) instead."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = member = np.zeros(0, np.int64)
        large: int | None = None  # the key that is being passed on as large

        def done(key: np.ndarray, member: np.ndarray, last: bool):
            """Pairs and large keys' rows of complete runs; the run at the end stays unless it is the last."""
            nonlocal large
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            out_a, out_b, big_k, big_m, rest = [], [], [], [], 0
            if not last:
                rest = size[-1]
                if large == key[-1] or rest > most:
                    big_k.append(key[-rest:]), big_m.append(member[-rest:])
                    was, rest = large, 0
                    tail = key[-1]
                else:
                    was, tail = large, None
                at, size = at[:-1], size[:-1]
            else:
                was, tail = large, None
            for n in np.unique(size):
                if n < 2 and was is None:
                    continue
                runs = at[size == n]
                is_big = key[runs] == was if was is not None else np.zeros(len(runs), bool)
                if n > most:
                    is_big[:] = True
                cells = runs[is_big][:, None] + np.arange(n)
                if cells.size:
                    big_k.append(key[cells].ravel()), big_m.append(member[cells].ravel())
                runs = runs[~is_big]
                if n < 2 or not len(runs):
                    continue
                cells = member[runs[:, None] + np.arange(n)]
                for i in range(1, n):  # i places apart: n steps, whatever the number of runs
                    out_a.append(cells[:, :-i].ravel()), out_b.append(cells[:, i:].ravel())
                    if sum(map(len, out_a)) > 200_000:
                        yield batch(out_a, out_b, False)
                        out_a, out_b = [], []
            large = tail
            if out_a:
                yield batch(out_a, out_b, False)
            if big_k:
                yield batch(big_k, big_m, True)
            left[:] = [key[len(key) - rest :], member[len(member) - rest :]] if rest else [key[:0], member[:0]]

        left: list[np.ndarray] = [key, member]
        for b in batches:
            key = np.concatenate([left[0], b.column(0).to_numpy(zero_copy_only=False)])
            member = np.concatenate([left[1], b.column(1).to_numpy(zero_copy_only=False)])
            if len(key):
                yield from done(key, member, False)
        if len(left[0]):
            yield from done(left[0], left[1], True)

    def batch(x: list[np.ndarray], y: list[np.ndarray], big: bool) -> pa.RecordBatch:
        x, y = np.concatenate(x), np.concatenate(y)
        if not big:
            keep = x != y
            x, y = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), big))], names=["a", "b", "big"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(emit, "a long, b long, big boolean")


BLOOM_BITS = 1 << 23


def _verify(docs: DataFrame, classes: DataFrame, likely: DataFrame, table, k: int, enough: Column, width: int) -> tuple[DataFrame, DataFrame]:
    """((class_a, class_b, rep_a, rep_b, weighted, jaccard) of the likely pairs that are similar enough, worked out exactly; the table of their bags)."""
    spark = docs.sparkSession
    ends = likely.select(F.col("a").alias("f1")).union(likely.select("b")).distinct()
    wanted = classes.join(ends, "f1", "left_semi").select("f1", "f2", "rep")

    def bits(b: pa.RecordBatch, counts: np.ndarray) -> int:
        h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & U(BLOOM_BITS - 1)
        np.bitwise_or.at(counts, (h >> U(6)).view(np.int64), np.left_shift(np.int64(1), (h & U(63)).view(np.int64)))
        return len(h)

    # A bitmap of fixed size of the wanted representatives, so that only their texts leave the scan. Sums of the blocks could carry
    # into neighbours' bits where partitions share a bit, so the rows are brought together by id first: each bit pattern is distinct.
    word = F.xxhash64("rep")
    one = wanted.select(word.bitwiseAND(F.lit(BLOOM_BITS - 1)).alias("h")).distinct()
    words, _ = count_items(one, bits, BLOOM_BITS // 64)
    bloom = spark.sparkContext.broadcast(words)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = bloom.value
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64) & U(BLOOM_BITS - 1)
            hit = np.flatnonzero((w[(h >> U(6)).view(np.int64)] >> (h & U(63)).view(np.int64)) & 1)
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            for at, data, off in shingles.chunks(b.column(1)):
                x, tf, starts, _ = shingles.bags(data, off, k)
                n = len(off) - 1
                full = np.flatnonzero(np.diff(starts) > 0)
                if not len(full):
                    continue
                y = mix(x + tf.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                f1, f2 = mix(np.add.reduceat(y, starts[full])), mix(np.add.reduceat(mix(y ^ U(0x51)), starts[full]))
                places = np.append(0, np.cumsum(tf))[starts]  # a bag lists a shingle as often as it occurs, by 32 bits of its hash
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(np.repeat((x & LOW).astype(np.uint32), tf).view(np.int32))).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n).take(pa.array(full)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["rep", "f1", "f2", "bag"])

    id_type = docs.schema["_id"].dataType.simpleString()
    bags = docs.select("_id", "_text", F.xxhash64("_id").alias("h")).mapInArrow(sets, f"rep {id_type}, f1 long, f2 long, bag array<int>")
    bags = cut(bags.join(wanted, ["f1", "f2", "rep"], "left_semi").dropDuplicates(["f1", "f2"]).select("f1", "rep", "bag"), "bags")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two_ln_idf = table.value
        idf2 = np.exp(two_ln_idf.astype(np.float64))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            each = []
            for c in (2, 3):
                lens = b.column(c).value_lengths().to_numpy(zero_copy_only=False)
                v = b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)
                v |= np.repeat(np.arange(n, dtype=np.uint64), lens) << U(32)
                each.append(np.unique(v, return_counts=True))
            la, lb = (np.bincount((v >> U(32)).view(np.int64), minlength=n) for v, _ in each)
            v, tf = np.concatenate([each[0][0], each[1][0]]), np.concatenate([each[0][1], each[1][1]]).astype(np.float64)
            o = np.argsort(v, kind="stable")
            v, tf = v[o], tf[o]
            p, w = (v >> U(32)).view(np.int64), tf * idf2[_slot(v, width)]
            same = np.flatnonzero(v[1:] == v[:-1])
            common_n = np.bincount(p[same], minlength=n)

            def jaccard(w: np.ndarray) -> np.ndarray:
                low = np.bincount(p[same], np.minimum(w[same], w[same + 1]), minlength=n)
                return low / np.maximum(np.bincount(p, w, minlength=n) - low, 1e-300)

            weighted = np.maximum(jaccard(w), jaccard(tf))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(weighted), pa.array(common_n / (la + lb - common_n))], names=["class_a", "class_b", "rep_a", "rep_b", "weighted", "jaccard"])

    x = bags.select(F.col("f1").alias("a"), F.col("rep").alias("x"), F.col("bag").alias("bag_x"))
    y = bags.select(F.col("f1").alias("b"), F.col("rep").alias("y"), F.col("bag").alias("bag_y"))
    both = likely.join(x, "a").join(y, "b").select("a", "b", "bag_x", "bag_y", "x", "y")
    return both.mapInArrow(similar, f"class_a long, class_b long, rep_a {id_type}, rep_b {id_type}, weighted double, jaccard double").where(enough), bags


def near_pairs(df: DataFrame, id_col: str, text_col: str, k: int = 3, jaccard: float = 0.6, weighted: float = 0.45, min_words: int = 30) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose shingle sets have a Jaccard similarity of jaccard or more.

    Candidates agree in bands of the weighted samples or of the samples as sets, so that pairs are found whatever share of the corpus
    their shingles stand in; the plain Jaccard similarity is checked exactly.
    """
    near = find(df, id_col, text_col, k, weighted, min_words, jaccard=jaccard)
    links = near.links.select("class_a", "class_b", "rep_a", "rep_b")
    # All ids of a class of copies are pairs, and each of them a pair with the ids of linked classes.
    within = near.copies.join(near.copies.select("class_id", F.col("id").alias("id_b")), "class_id").select(F.col("id").alias("id_a"), "id_b")
    x, y = near.copies.toDF("class_a", "x"), near.copies.toDF("class_b", "y")
    across = links.join(x, "class_a", "left").join(y, "class_b", "left").select(F.coalesce("x", "rep_a").alias("x"), F.coalesce("y", "rep_b").alias("y"))
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    out = cut(within.union(across).where("id_a < id_b").distinct(), "near_pairs")
    forget(*near.parts)
    return out


def near_groups(df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> DataFrame:
    """(id, group_id, class_rep, n_links): one row for each record that has a near copy; links count classes, not copies."""
    from shelfwright.llm.components import connected

    near = find(df, id_col, text_col, k, threshold, min_words)
    links = cut(near.links.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).where("a <> b").distinct(), "links")
    groups = connected(links).select(F.col("id").alias("rep"), "group_id")
    both = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    several = near.members.groupBy("rep").agg((F.count("*") > 1).alias("several"))  # combined before the shuffle, joined back to a row a class
    of = several.join(groups, "rep", "left").join(both, "rep", "left").where("group_id is not null or several")
    out = near.members.join(of, "rep")
    out = cut(out.select("id", F.coalesce("group_id", "rep").alias("group_id"), F.col("rep").alias("class_rep"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near_groups")
    forget(links, *near.parts)
    return out
