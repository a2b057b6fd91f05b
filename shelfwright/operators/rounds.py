"""k-means with a chosen number of clusters for buckets that no task fits by itself: every file takes part in every model and every score.

Up to WIDE clusters, Lloyd's rounds go over all files of all buckets at once; what reaches the driver is a sum for each cluster and
task. More clusters than that (a sixth, a quarter, a third of the files) would be a number of comparisons that grows with the square of
the files: the bucket is cut by likeness into cells, each with its share of the clusters, and k-means of a cell is about all of its
files. Scores are silhouettes of squared distances, which follow from the clusters' means, so they are of all files; in cells, the
nearest other cluster is one of the same cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.tables import cut, forget

WIDE = 10  # clusters that rounds over all files are made for; a branching of the tree of cells
LOCAL = 50_000  # files that a task holds to cut them into cells
LEAST = 12  # files of a cell, so that its share of the clusters is one at least
ROUNDS = 50
TOL = 1e-4  # of the mean variance of a term: smaller moves of the centres end the rounds
ALIKE = 1e-5  # squared distances up to this are none, at the precision of the weights
SEP = "\x1f"  # between the levels of a part's name
DENSE = 30  # terms a row from which products are faster by whole rows
AT_ONCE = 20  # parts whose sums go to the driver together
TASKS = 32  # tasks that hand sums to the driver, at most

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts of the rows, terms, weights


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of an Arrow column of bytes."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    values = np.frombuffer(held.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), kind) if held is not None else np.zeros(0, kind)
    return (at - at[0]) // np.dtype(kind).itemsize, values


def _some(x: Rows, pick: np.ndarray) -> Rows:
    n = np.diff(x[0])[pick]
    start = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(x[0][pick] - start[:-1], n) + np.arange(start[-1])
    return start, x[1][at], x[2][at]


def _dots(x: Rows, c: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Products of the rows lo to hi with the columns of c (terms x centres)."""
    a, b = x[0][lo], x[0][hi]
    out = np.zeros((hi - lo, c.shape[1]), np.float32)
    n = np.diff(x[0][lo : hi + 1])
    if b - a > DENSE * (hi - lo):
        for i in range(lo, hi, 128):
            j = min(i + 128, hi)
            rows = np.zeros((j - i, len(c)), np.float32)
            rows[np.repeat(np.arange(j - i), n[i - lo : j - lo]), x[1][x[0][i] : x[0][j]]] = x[2][x[0][i] : x[0][j]]
            out[i - lo : j - lo] = rows @ c
        return out
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(c[x[1][a:b]] * x[2][a:b, None], (x[0][lo:hi] - a)[full])
    return out


def _squares(x: Rows) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(x[0]) - 1), np.diff(x[0])), x[2].astype(float) ** 2, len(x[0]) - 1)


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, Rows]]:
    parts = batch["part"].to_pylist()
    for p, at in pd.Series(parts).groupby(parts).indices.items():
        own = batch.take(pa.array(at))
        start, terms = _flat(own["at"], np.int32)
        yield p, own, (start, terms, _flat(own["w"], np.float32)[1])


def _chance(h: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the file and the turn only."""
    z = h.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(s))) * np.uint64(m)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def packed(items: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """items with at, w in the place of terms, weights: places in the bucket's vocabulary and weights as bytes."""
    index = items.sparkSession.sparkContext.broadcast({b: {t: i for i, t in enumerate(v)} for b, v in vocabulary.items()})
    keep = [(c, k) for c, k in items.dtypes if c not in ("terms", "weights")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.array([index.value[b][t] for t in terms], np.int32).tobytes() for b, terms in zip(batch["bucket"].to_pylist(), batch["terms"].to_pylist())]
            w = [np.array(v, np.float32).tobytes() for v in batch["weights"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c, _ in keep), pa.array(at, pa.binary()), pa.array(w, pa.binary())], names=[*(c for c, _ in keep), "at", "w"])

    return items.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in keep), "at binary", "w binary"]))


def compact(items: DataFrame) -> DataFrame:
    """items (bucket, seq, id, ext, at, w) as a table with part, which is the bucket, and h, by which chance is decided."""
    return cut(items.select(F.col("bucket").alias("part"), "bucket", "seq", "id", "ext", F.xxhash64("id").alias("h"), "at", "w"), "compact")


def _few(table: DataFrame) -> DataFrame:
    """table in tasks whose number doesn't grow with it, as each hands its sums to the driver."""
    return table.coalesce(min(TASKS, max(1, table.sparkSession.sparkContext.defaultParallelism)))


def _seeds(table: DataFrame, width: dict[str, int], n: int) -> dict[str, np.ndarray]:
    """n centres for each part by k-means++ over all of its files, a pass each."""
    seeds = {p: np.zeros((0, f), np.float32) for p, f in width.items()}
    for turn in range(n):
        shared = table.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, tuple] = {}
            for batch in batches:
                for p, own, x in _by_part(batch):
                    if p not in shared.value:
                        continue
                    c, key = np.ascontiguousarray(shared.value[p].T), -np.log(_chance(own["h"].to_numpy(), turn))
                    if turn:
                        sq, cc = _squares(x), (c * c).sum(0)
                        far = np.concatenate([(cc - 2 * _dots(x, c, lo, min(lo + 1024, len(sq)))).min(1) for lo in range(0, len(sq), 1024)]) + sq
                        key = np.where(far > ALIKE, key / np.maximum(far, ALIKE), key * 1e30)  # alike ones only if there are no others
                    i = int(key.argmin())
                    if p not in best or key[i] < best[p][0]:
                        best[p] = (float(key[i]), own["at"][i].as_py(), own["w"][i].as_py())
            rows = [(p, *v) for p, v in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.binary(), pa.binary()))], names=["part", "key", "at", "w"])

        found: dict[str, tuple] = {}
        for r in _few(table.select("part", "h", "at", "w")).mapInArrow(run, "part string, key double, at binary, w binary").collect():  # a row a part and task
            if r["part"] not in found or r["key"] < found[r["part"]][0]:
                found[r["part"]] = (r["key"], r["at"], r["w"])
        for p, (_, at, w) in found.items():
            c = np.zeros((1, width[p]), np.float32)
            c[0, np.frombuffer(at, np.int32)] = np.frombuffer(w, np.float32)
            seeds[p] = np.concatenate([seeds[p], c])
        shared.destroy()
    return seeds


def _sums(table: DataFrame, centres: dict[str, dict[int, np.ndarray]]) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """{part: {k: (files, squares, sums of weights)}} of the clusters of nearest centres."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[str, int], list[np.ndarray]] = {}
        held = {p: (np.ascontiguousarray(np.concatenate(list(ks.values())).T), list(ks)) for p, ks in shared.value.items()}
        for batch in batches:
            for p, _, x in _by_part(batch):
                if p not in held:
                    continue
                c, ks = held[p]
                cc, sq = (c * c).sum(0), _squares(x)
                for lo in range(0, len(sq), 1024):
                    hi = min(lo + 1024, len(sq))
                    far, at = cc - 2 * _dots(x, c, lo, hi), 0
                    terms, w, n = x[1][x[0][lo] : x[0][hi]], x[2][x[0][lo] : x[0][hi]], np.diff(x[0][lo : hi + 1])
                    for k in ks:
                        label = far[:, at : at + k].argmin(1)
                        at += k
                        own = got.setdefault((p, k), [np.zeros(k), np.zeros(k), np.zeros(k * len(c))])
                        own[0] += np.bincount(label, minlength=k)
                        own[1] += np.bincount(label, sq[lo:hi], k)
                        own[2] += np.bincount(np.repeat(label * len(c), n) + terms, w, k * len(c))
        for (p, k), own in got.items():
            own[2] = own[2].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in own)], names=["part", "k", "n", "sq", "sum"])

    out: dict = {}
    for r in _few(table.select("part", "at", "w")).mapInArrow(run, "part string, k int, n binary, sq binary, sum binary").collect():  # sums of WIDE clusters at most a part, k and task
        own = (np.frombuffer(r["n"]), np.frombuffer(r["sq"]), np.frombuffer(r["sum"], np.float32).reshape(r["k"], -1).astype(float))
        old = out.setdefault(r["part"], {}).get(r["k"])
        out[r["part"]][r["k"]] = own if old is None else tuple(a + b for a, b in zip(old, own))
    shared.destroy()
    return out


def lloyd(table: DataFrame, width: dict[str, int], ks: dict[str, list[int]], rounds: int = ROUNDS) -> dict[str, dict[int, np.ndarray]]:
    """{part: {k: centres}} over all files of each part; width: terms of its vocabulary."""
    seeds = _seeds(table, {p: width[p] for p in ks}, max(max(v) for v in ks.values()))
    centres = {p: {k: seeds[p][:k] for k in own} for p, own in ks.items()}
    moving = {p: list(own) for p, own in ks.items()}
    for _ in range(rounds):
        got = _sums(table, {p: {k: centres[p][k] for k in own} for p, own in moving.items() if own})
        for p, found in got.items():
            for k, (n, sq, sums) in found.items():
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[p][k]).astype(np.float32)
                spread = max(0.0, sq.sum() / n.sum() - ((sums.sum(0) / n.sum()) ** 2).sum()) / width[p]
                if ((new - centres[p][k]) ** 2).sum() <= TOL * spread:
                    moving[p].remove(k)
                centres[p][k] = new
        if not any(moving.values()):
            break
    return centres


def scores(table: DataFrame, centres: dict[str, dict[int, np.ndarray]], sums: dict) -> dict[str, dict[int, float]]:
    """{part: {k: mean silhouette of squared distances}} over all files."""
    means = {p: {k: (c, n, sq / np.maximum(n, 1), (s / np.maximum(n, 1)[:, None]).astype(np.float32)) for k, c in ks.items() for n, sq, s in [sums[p][k]]} for p, ks in centres.items()}
    shared = table.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], float] = {}
        for batch in batches:
            for p, _, x in _by_part(batch):
                if p not in shared.value:
                    continue
                sq = _squares(x)
                both = np.ascontiguousarray(np.concatenate([m for c, _, _, mean in shared.value[p].values() for m in (c, mean)]).T)
                for lo in range(0, len(sq), 1024):
                    hi, at = min(lo + 1024, len(sq)), 0
                    dots = _dots(x, both, lo, hi)
                    for k, (c, n, ms, _) in shared.value[p].items():
                        label = ((c * c).sum(1) - 2 * dots[:, at : at + k]).argmin(1)
                        far = sq[lo:hi, None] + ms - 2 * dots[:, at + k : at + 2 * k]
                        at += 2 * k
                        total[p, k] = total.get((p, k), 0.0) + float(silhouettes(far, label, n).sum())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array(list(total.values()), pa.float64())], names=["part", "k", "s"])

    out: dict[str, dict[int, float]] = {p: dict.fromkeys(ks, 0.0) for p, ks in centres.items()}
    for r in _few(table.select("part", "at", "w")).mapInArrow(run, "part string, k int, s double").collect():
        out[r["part"]][r["k"]] += r["s"] / sums[r["part"]][r["k"]][0].sum()
    shared.destroy()
    for p, ks in out.items():
        for k in ks:
            if (sums[p][k][0] > 0).sum() < 2:
                ks[k] = -1.0
    return out


def silhouettes(far: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Silhouettes of rows from their mean squared distances to all members of each cluster (themselves among them) and the clusters' sizes."""
    at = np.arange(len(label))
    far = np.where(n[None, :] > 0, np.where(far > ALIKE, far, 0.0), np.inf)
    own = far[at, label] * n[label] / np.maximum(n[label] - 1, 1)
    far[at, label] = np.inf
    other = far.min(1)
    other = np.where(np.isfinite(other), other, own)  # the only cluster
    return np.where(n[label] > 1, (other - own) / np.maximum(np.maximum(other, own), ALIKE), 0.0)


def placed(table: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """table of the parts of centres with the column cluster, the nearest centre of the part."""
    shared = table.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, own, x in _by_part(batch):
                if p in shared.value:
                    c = np.ascontiguousarray(shared.value[p].T)
                    cc, m = (c * c).sum(0), len(own)
                    label = np.concatenate([(cc - 2 * _dots(x, c, lo, min(lo + 1024, m))).argmin(1) for lo in range(0, m, 1024)])
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(label.astype(np.int32))], names=[*own.schema.names, "cluster"])

    return table.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in table.dtypes), "cluster int"]))


def parted(table: DataFrame, centres: dict[str, np.ndarray], width: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """table with parts of at most LOCAL files, by nearest centres again and again, and the parts' files."""
    rest = placed(table, centres)
    parts = cut(rest.withColumn("part", F.concat_ws(SEP, "part", "cluster")).drop("cluster"), "parts")
    before = {}
    while True:
        size = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}  # a row for LOCAL files or so
        large = {p: n for p, n in size.items() if n > LOCAL}
        if not large:
            return parts, size
        stuck = {p: n for p, n in large.items() if n > 0.9 * before.get(p.rsplit(SEP, 1)[0], n * 2)}
        split = {p: [WIDE] for p in large if p not in stuck}
        found = {}
        for lo in range(0, len(split), AT_ONCE):
            some = dict(list(split.items())[lo : lo + AT_ONCE])
            got = lloyd(parts.where(F.col("part").isin(list(some))), {p: width[p.split(SEP)[0]] for p in some}, some, rounds=10)
            found |= {p: ks[WIDE] for p, ks in got.items()}
        same = parts.where(~F.col("part").isin(list(large)))
        ways = F.create_map(*[F.lit(v) for p, n in stuck.items() for v in (p, -(-2 * n // LOCAL))]) if stuck else None
        new = [same]
        if split:
            new.append(placed(parts, found).withColumn("part", F.concat_ws(SEP, "part", "cluster")).drop("cluster"))
        if stuck:  # alike files: any cut is as good
            own = parts.where(F.col("part").isin(list(stuck)))
            new.append(own.withColumn("part", F.concat_ws(SEP, "part", F.pmod("h", ways[F.col("part")]))))
        old, parts, before = parts, cut(_union(new), "parts"), size
        forget(old)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _split(x: Rows, most: int, width: int) -> list[np.ndarray]:
    """Cells of rows: cut by nearest centres until none has more than so many; neighbours in the tree are joined up to that."""
    leaves, stack = [], [np.arange(len(x[0]) - 1)]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            leaves.append(at)
            continue
        own, b = _some(x, at), min(16, max(2, 2 * -(-len(at) // most)))
        c = np.zeros((b, width), np.float32)
        for j, i in enumerate(np.linspace(0, len(at) - 1, b).astype(int)):
            c[j, own[1][own[0][i] : own[0][i + 1]]] = own[2][own[0][i] : own[0][i + 1]]
        label = np.zeros(len(at), int)
        for _ in range(8):
            ct, cc = np.ascontiguousarray(c.T), (c * c).sum(1)
            new = np.concatenate([(cc - 2 * _dots(own, ct, lo, min(lo + 1024, len(at)))).argmin(1) for lo in range(0, len(at), 1024)])
            if (new == label).all():
                break
            label, n = new, np.bincount(new, minlength=b)
            sums = np.bincount(np.repeat(label * width, np.diff(own[0])) + own[1], own[2], b * width).reshape(b, width)
            c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
        parts = [at[label == j] for j in range(b) if (label == j).any()]
        if max(map(len, parts)) > 0.95 * len(at):  # alike files: any cut is as good
            leaves += np.array_split(at, -(-len(at) // most))
        else:
            stack += parts[::-1]
    cells: list[np.ndarray] = []
    for leaf in leaves:
        if cells and (len(cells[-1]) + len(leaf) <= most or len(cells[-1]) < LEAST):
            cells[-1] = np.concatenate([cells[-1], leaf])
        else:
            cells.append(leaf)
    if len(cells) > 1 and len(cells[-1]) < LEAST:
        cells[-2:] = [np.concatenate(cells[-2:])]
    return cells


def kmeans_of_products(g: np.ndarray, k: int, seed: int = 42, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(labels, silhouettes of squared distances) by k-means++ and Lloyd's rounds, from the products of all rows with each other."""
    rng, sq, m = np.random.default_rng(seed), np.diag(g), len(g)
    pick = [int(rng.integers(m))]
    d = sq + sq[pick[0]] - 2 * g[:, pick[0]]
    for _ in range(k - 1):
        d = np.where(d > ALIKE, d, 0)
        pick.append(int(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), "right").clip(0, m - 1)) if d.sum() > 0 else int(rng.integers(m)))
        d = np.minimum(d, sq + sq[pick[-1]] - 2 * g[:, pick[-1]])
    share = np.zeros((m, k), np.float32)
    share[pick, np.arange(k)] = 1
    label = np.full(m, -1)
    for _ in range(rounds):
        dots = g @ share
        new = ((share * dots).sum(0) - 2 * dots).argmin(1)
        if (new == label).all():
            break
        label, n = new, np.bincount(new, minlength=k)
        own = np.zeros((m, k), np.float32)
        own[np.arange(m), label] = 1 / n[label]
        share = np.where(n > 0, own, share)
    n = np.bincount(label, minlength=k)
    own = np.zeros((m, k), np.float32)
    own[np.arange(m), label] = 1 / n[label]
    return label, silhouettes(sq[:, None] + sq @ own - 2 * g @ own, label, n)


def celled(parts: DataFrame, size: dict[str, int], ks: dict[str, list[int]], vocabulary: dict[str, list[str]], fit: int, top: int) -> DataFrame:
    """(bucket, id, seq, ext, cs, ss, ts): a file's clusters, silhouettes and, at the first file of each cluster, top terms, in the order of the bucket's ks."""
    most, offset, total, home = max(fit, LEAST), {}, {}, {}
    for p in sorted(size):
        b = p.split(SEP)[0]
        own = [q for q in size if q.split(SEP)[0] == b]
        home[p] = p if size[p] >= LEAST else max(own, key=lambda q: (size[q], q))  # a part of a few files goes with the largest
    joined: dict[str, int] = {}
    for p, q in home.items():
        joined[q] = joined.get(q, 0) + size[p]
    for q in sorted(joined):
        b = q.split(SEP)[0]
        offset[q] = total.get(b, 0)
        total[b] = offset[q] + joined[q]
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, offset, total, ks))
    moved = {p: q for p, q in home.items() if p != q}
    if moved:
        to = F.create_map(*[F.lit(v) for pair in moved.items() for v in pair])
        parts = parts.withColumn("part", F.coalesce(to[F.col("part")], F.col("part")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, offset, total, ks = shared.value
        b = key[0].split(SEP)[0]
        pdf = pdf.sort_values(["h", "id"], ignore_index=True)
        n = pdf["at"].map(len).to_numpy() // 4
        x = np.concatenate([[0], np.cumsum(n)]), np.frombuffer(b"".join(pdf["at"]), np.int32), np.frombuffer(b"".join(pdf["w"]), np.float32)
        cs, ss = np.zeros((len(pdf), len(ks[b])), np.int32), np.zeros((len(pdf), len(ks[b])))
        ts: list[list] = [[None] * len(ks[b]) for _ in range(len(pdf))]
        low = offset[key[0]]
        for cell in _split(x, most, len(words[b])):
            own = _some(x, cell)
            terms, at = np.unique(own[1], return_inverse=True)
            rows = np.zeros((len(cell), max(1, len(terms))), np.float32)
            rows[np.repeat(np.arange(len(cell)), np.diff(own[0])), at] = own[2]
            g = rows @ rows.T
            for i, k in enumerate(ks[b]):
                start, end = k * low // total[b], k * (low + len(cell)) // total[b]
                label, s = kmeans_of_products(g, end - start)
                cs[cell, i], ss[cell, i] = start + label, s
                for j, r in zip(*np.unique(label, return_index=True)):
                    mean = rows[label == j].mean(0)
                    full = np.flatnonzero(mean)
                    full = full[np.argsort(-mean[full], kind="stable")][:top]
                    best = [words[b][t] for t in (terms[full] if len(terms) else [])]
                    ts[cell[r]][i] = (best + [w for w in words[b][: 2 * top] if w not in best])[:top]
            low += len(cell)
        return pd.DataFrame({"bucket": b, "id": pdf["id"], "seq": pdf["seq"], "ext": pdf["ext"], "cs": list(cs), "ss": list(ss), "ts": ts})

    return cut(parts.groupBy("part").applyInPandas(run, f"bucket string, id string, seq {dict(parts.dtypes)['seq']}, ext string, cs array<int>, ss array<double>, ts array<array<string>>"), "celled")


def whole(items: DataFrame, vocabulary: dict[str, list[str]], size: dict[str, int], candidates: Callable[[int], list[int]], fit: int, top: int, done: Callable[[], None] = lambda: None) -> tuple[DataFrame, DataFrame]:
    """(clusters: bucket, cluster, score, top_terms; members: bucket, cluster, id, seq, ext) of items (bucket, seq, id, ext, at, w) of the buckets of size.

    The number of clusters of a bucket is the candidate of the highest score. done: called when items won't be read again.
    """
    spark = items.sparkSession
    table = compact(items)
    done()
    width = {b: max(1, len(vocabulary[b])) for b in size}
    few = {b: [k for k in candidates(n) if k <= WIDE] for b, n in size.items()}
    many = {b: ks for b, n in size.items() if (ks := [k for k in candidates(n) if k > WIDE])}
    centres = lloyd(table, width, few)
    score = scores(table, centres, _sums(table, centres))
    cells = None
    if many:
        parts, files = parted(table, {b: centres[b][max(few[b])] for b in many}, width)
        if len(many) == len(size):  # the same files
            forget(table)
            table = parts.withColumn("part", F.col("bucket"))
        cells = celled(parts, files, many, vocabulary, fit, top)
        for r in cells.groupBy("bucket").agg(*[F.sum(F.try_element_at("ss", F.lit(i + 1))).alias(f"s{i}") for i in range(max(map(len, many.values())))]).collect():
            for i, k in enumerate(many[r["bucket"]]):
                score[r["bucket"]][k] = r[f"s{i}"] / size[r["bucket"]]
    best = {b: max(sorted(s), key=lambda k: s[k]) for b, s in score.items()}  # noqa: B023
    known, members = [], []
    fixed = {b: centres[b][k] for b, k in best.items() if k <= WIDE}
    if fixed:
        rows = [[b, j, float(score[b][best[b]]), [vocabulary[b][t] for t in np.argsort(-row[: len(vocabulary[b])], kind="stable")[:top]]] for b, c in fixed.items() for j, row in enumerate(c)]
        known.append(spark.createDataFrame(rows, "bucket string, cluster int, score double, top_terms array<string>"))
        members.append(placed(table, fixed).select("bucket", "cluster", "id", "seq", "ext"))
    for b, k in best.items():
        if k > WIDE:
            own, i = cells.where(F.col("bucket") == b), many[b].index(k)
            known.append(own.where(F.col("ts")[i].isNotNull()).select("bucket", F.col("cs")[i].alias("cluster"), F.lit(float(score[b][k])).alias("score"), F.col("ts")[i].alias("top_terms")))
            members.append(own.select("bucket", F.col("cs")[i].alias("cluster"), "id", "seq", "ext"))
    return _union(known), _union(members)
