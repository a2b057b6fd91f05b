"""Word shingles of a batch of texts, as numpy arrays without a Python loop over words.

Words are runs of ASCII letters, digits and underscores, in lower case. A text is a bag of k-word shingles, each hashed to
44 bits; two texts of a few hundred shingles share a hash by chance in about one of 10^8 comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BITS = 44
CHUNK = 1 << 20  # bytes of text worked on at once; a longer text is one chunk of its own
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_POW: list[np.ndarray] = []


def _lut() -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for b in range(128):
        ch = chr(b)
        if ch.isalnum() or ch == "_":
            out[b] = ord(ch.lower())
    return out


LUT = _lut()


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U(33))
    h *= _M1
    h ^= h >> U(33)
    h *= _M2
    h ^= h >> U(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        n = max(n, CHUNK + (1 << 16))
        one = np.ones(n, np.uint64)
        a, b = one.copy(), one.copy()
        a[1:] = U(_P)
        b[1:] = U(_PINV)
        _POW[:] = [np.cumprod(a), np.cumprod(b)]
    return _POW[0], _POW[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each document's first word: n + 1 numbers) of concatenated UTF-8 texts."""
    v = LUT[data]
    is_word = v != 0
    prev = np.empty(len(data), bool)
    if len(data):
        prev[1:] = is_word[:-1]
        prev[0] = False
    inner = offsets[:-1][offsets[:-1] < len(data)]
    prev[inner] = False  # a document starts a word
    start = np.flatnonzero(is_word & ~prev)
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1] = is_word[1:]
        after[-1] = False
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    stop = np.flatnonzero(is_word & ~after)
    pw, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v * pw[: len(data)], out=total[1:])
    h = (total[stop + 1] - total[start]) * inv[start]
    return mix(h), np.searchsorted(start, offsets)


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about size bytes; null texts count as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def bags(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending: (hashes, counts, n + 1 starts, words of each document).

    A document of fewer than k words, but at least one, is one shingle of all its words.
    """
    h, first = words(data, offsets)
    n = len(offsets) - 1
    n_words = np.diff(first)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(n + 1, np.int64), n_words
    doc = np.repeat(np.arange(n), n_words)
    mul = [U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    short = (n_words > 0) & (n_words < k)
    m = len(h) - k + 1
    if m > 0:
        s = h[:m] * mul[0]
        for i in range(1, k):
            s = s + h[i : m + i] * mul[i]
        keep = doc[:m] == doc[k - 1 :]
        s, d = s[keep], doc[:m][keep]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short.any():
        extra = []
        for i in np.flatnonzero(short):
            x = U(1)
            with np.errstate(over="ignore"):
                for j, w in enumerate(h[first[i] : first[i + 1]]):
                    x = x + w * mul[j]
            extra.append(x)
        s = np.concatenate([s, np.array(extra, np.uint64)])
        d = np.concatenate([d, np.flatnonzero(short)])
    key = (d.astype(np.uint64) << U(BITS)) | (mix(s) >> U(64 - BITS))
    key.sort()
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    starts = np.searchsorted(key >> U(BITS), np.arange(n + 1).astype(np.uint64))
    return key & U((1 << BITS) - 1), count, starts, n_words
