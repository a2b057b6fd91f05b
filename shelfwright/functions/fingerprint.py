"""FNV-1a, SimHash and perceptual hashes as signed 64-bit longs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.session import ship

#: FNV-1a, 64 bits. Fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WORDS = re.compile(r"[A-Za-z0-9_]+")
_U = np.uint64


def fnv1a(s: Column | str) -> Column:
    """FNV-1a of an ASCII string by built-in expressions: 64-bit state in two 32-bit halves, since ANSI longs don't wrap."""
    c = F.col(s) if isinstance(s, str) else s
    mask, low_prime = F.lit(0xFFFFFFFF), F.lit(435)  # the prime is 2^40 + 435
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.ascii(F.substr(c, i, F.lit(1))).cast("long"))
    start = F.struct(F.lit(FNV_OFFSET >> 32).alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        p = x * low_prime
        hi = (acc["hi"] * low_prime + F.shiftright(p, 32) + F.shiftleft(x, 8)).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), p.bitwiseAND(mask).alias("lo"))

    run = F.aggregate(codes, start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"]))
    return F.when(F.length(c) > 0, run).otherwise(F.lit(FNV_OFFSET - (1 << 64)))


def fnv1a_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FNV-1a of many stretches of one buffer, a byte of each at a time."""
    h = np.full(len(start), FNV_OFFSET, np.uint64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    state = h[order]
    for p in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -p, "left"))  # stretches longer than p
        state[:n] = (state[:n] ^ buf[start[:n] + p]) * _U(FNV_PRIME)
    h[order] = state
    return h


def simhash_batch(texts: list[str], k: int = 3) -> np.ndarray:
    """SimHash of each text: sign of the bit votes of its k-word shingles, with multiplicity; ties set the bit."""
    joined = [" ".join(WORDS.findall(t)).lower() for t in texts]
    out = np.empty(len(texts), np.uint64)
    at = 0
    while at < len(joined):
        to, size = at, 0
        while to < len(joined) and (to == at or size + len(joined[to]) < 1 << 19):
            size += len(joined[to]) + 1
            to += 1
        out[at:to] = _simhash(joined[at:to], k)
        at = to
    return out.view(np.int64)


def _simhash(joined: list[str], k: int) -> np.ndarray:
    raw = np.frombuffer(("\n".join(joined) + "\n").encode("ascii"), np.uint8)
    buf = raw.astype(np.uint64)
    line_end = np.flatnonzero(raw == 10)
    line_start = np.append(0, line_end[:-1] + 1)
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    word_end = gap
    word_start = np.append(0, gap[:-1] + 1)
    doc = np.searchsorted(line_end, word_start)
    n_words = np.bincount(doc, minlength=len(joined))
    first = np.append(0, np.cumsum(n_words)[:-1])
    starts, lens, docs = [], [], []
    full = n_words >= k
    i = np.arange(len(word_start))
    ok = full[doc] & (i - first[doc] <= n_words[doc] - k)
    starts.append(word_start[ok]), lens.append(word_end[i[ok] + k - 1] - word_start[ok]), docs.append(doc[ok])
    few = np.flatnonzero(~full)
    starts.append(line_start[few]), lens.append(line_end[few] - line_start[few]), docs.append(few)
    s, n, d = np.concatenate(starts), np.concatenate(lens), np.concatenate(docs)
    o = np.argsort(d, kind="stable")
    h, d = fnv1a_spans(buf, s[o], n[o]), d[o]
    at = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    count = np.diff(np.append(at, len(d)))
    out = np.zeros(len(joined), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((h >> _U(bit)) & _U(1)).astype(np.int64), at)
        out |= (2 * ones >= count).astype(np.uint64) << _U(bit)
    return out


def with_simhash(df: DataFrame, text: str, out: str = "fp", k: int = 3) -> DataFrame:
    """df with the SimHash of a text column; null for null."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            full = s.notna()
            res = pd.Series(pd.array([None] * len(s), dtype="Int64"))
            if full.any():
                res[full.to_numpy()] = simhash_batch(s[full].tolist(), k)
            yield res

    return df.withColumn(out, udf(text))


def _dct_matrix(n: int = 32) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    c = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2.0 / n)
    c[0] = np.sqrt(1.0 / n)
    return c


def phash_batch(pixels: np.ndarray) -> np.ndarray:
    """Perceptual hash of (images, 32, 32) luma: the 63 low frequencies over their mean, row by row, the last bit 0."""
    c = _dct_matrix()
    low = (c[:8] @ pixels @ c[:8].T).reshape(len(pixels), 64)[:, 1:]
    bits = low > low.mean(1, keepdims=True)
    weights = np.array([1 << (63 - i) for i in range(63)], np.uint64)
    return (bits * weights).sum(1, dtype=np.uint64).view(np.int64)


def with_phash(df: DataFrame, pixels: str, out: str = "fp") -> DataFrame:
    """df with the perceptual hash of a column of 1024 luma values; null for null and for other lengths."""
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            full = np.array([x is not None and len(x) == 1024 for x in s], bool)
            res = pd.Series(pd.array([None] * len(s), dtype="Int64"))
            if full.any():
                res[full] = phash_batch(np.stack([np.asarray(x, np.float64).reshape(32, 32) for x, ok in zip(s, full) if ok]))
            yield res

    return df.withColumn(out, udf(pixels))


def sign_bits(vec: Column | str, n: int = 64) -> Column:
    """The signs of a vector's first 64 numbers as bits, the first one highest."""
    v = F.col(vec) if isinstance(vec, str) else vec
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft((v[i] > 0).cast("long"), n - 1 - i))
    return out
