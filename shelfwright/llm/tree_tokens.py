"""Problem 6: encoding of a corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is halved down to leaves of LEAF characters, each leaf is encoded on its own, and
neighbours are joined up the tree. A join re-splits a window around the seam and re-encodes it. On the left the window begins at the
last piece of the pre-splitting that what follows can't change any more: one that ends at least `reach` characters before the seam, the
farthest that the pattern looks beyond a piece. To the right it grows piece by piece until the text's pieces and those of the right
side alone end at the same place: from there on the pre-splitting, which looks ahead only, sees the same text in both, so no token
outside the window can differ. Joining is associative with the empty text as neutral element, so any tree gives the same ids. Decoding
concatenates up the same tree.

This holds for any pattern that doesn't look behind. Places beside characters that this Python doesn't know are no such ends, since
the tokenizer's tables of letters may be newer.

The vocabulary (under 1 MB, fixed) is read on the driver from a path that is a parameter, and broadcast. Texts are encoded whole.

Defined results: a null text and an empty text both have the empty list of ids. Special tokens' strings are ordinary text. Rows
are kept as they are: one row out for each row in. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwright.llm.common import pick, ship

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 4096
#: The published pre-splitting pattern of this family of byte-level tokenizers. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE: dict[int, Encoder] = {}
REACH = 3
BLANKS = 100_000
LONG_BLANK = re.compile(rf"\s{{{BLANKS}}}")


class Encoder:
    """Leaves by the tokenizer library, joins by seams. vocab: the lines of a rank file, base64 of the bytes and the id."""

    def __init__(self, vocab: bytes, leaf: int = LEAF, pattern: str = PATTERN, reach: int = REACH):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line)}
        self.tokenizer = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.leaf, self.reach, self.pieces = leaf, reach, regex.compile(pattern).finditer

    def flat(self, text: str) -> list[int]:
        """The ids by the tokenizer library; its expression engine gives up on very long runs of blanks, which are split here instead."""
        if len(text) < BLANKS or not LONG_BLANK.search(text):
            return self.tokenizer.encode_ordinary(text)
        return [i for m in self.pieces(text) for i in self.tokenizer._encode_single_piece(m.group())]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self.flat(text) if len(text) <= self.leaf else self._node(text, 0, len(text))[0]

    def _node(self, text: str, lo: int, hi: int) -> tuple[list[int], int]:
        """(ids of text[lo:hi], the last end of a piece in it that what follows can't change)."""
        if hi - lo <= self.leaf:
            firm = lo
            for m in self.pieces(text, lo, hi):
                if m.end() <= hi - self.reach:
                    firm = m.end()
            return self.flat(text[lo:hi]), firm
        mid = (lo + hi) // 2
        (ids_a, firm_a), (ids_b, firm_b) = self._node(text, lo, mid), self._node(text, mid, hi)
        whole, right = self.pieces(text, firm_a, hi), self.pieces(text, mid, hi)
        end, own, firm = firm_a, mid, firm_a  # ends of pieces: of the text's, and of the right side's alone
        while end < hi and (end != own or not _known(text, end)):
            if end <= own:
                end = next(whole).end()
                firm = end if end <= hi - self.reach else firm
            else:
                own = next(right).end()
        ids = self._head(ids_a, len(text[firm_a:mid].encode())) + self.flat(text[firm_a:end]) + self._tail(ids_b, len(text[mid:end].encode()))
        return ids, max(firm, firm_b) if end <= firm_b else firm

    def _head(self, ids: list[int], cut: int) -> list[int]:
        """ids without those of the last cut bytes."""
        n = len(ids)
        while cut > 0:
            n -= 1
            cut -= self.length[ids[n]]
        assert cut == 0
        return ids[:n]

    def _tail(self, ids: list[int], cut: int) -> list[int]:
        n = 0
        while cut > 0:
            cut -= self.length[ids[n]]
            n += 1
        assert cut == 0
        return ids[n:]

    def decode(self, ids: list[int]) -> str:
        return self._bytes(ids, 0, len(ids)).decode()

    def _bytes(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return b"".join(self.bytes[i] for i in ids[lo:hi])
        mid = (lo + hi) // 2
        return self._bytes(ids, lo, mid) + self._bytes(ids, mid, hi)


def _known(text: str, i: int) -> bool:
    """Whether the characters at both sides of a place are known to this Python."""
    return all(unicodedata.category(c) != "Cn" for c in text[max(0, i - 1) : i + 1])


def encoder(vocab: bytes) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = hash(vocab)
    if key not in _CACHE:
        _CACHE[key] = Encoder(vocab)
    return _CACHE[key]


def read_vocab(path: str = VOCAB) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocab_path: str = VOCAB) -> DataFrame:
    """(id_col, ids) of every row."""
    return _mapped(df, id_col, text_col, vocab_path, "ids array<int>", lambda e, texts: pa.array([e.encode(x) for x in texts], pa.list_(pa.int32())))


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocab_path: str = VOCAB) -> DataFrame:
    """(id_col, n_tokens) of every row."""
    return _mapped(df, id_col, text_col, vocab_path, "n_tokens long", lambda e, texts: pa.array([len(e.encode(x)) for x in texts], pa.int64()))


def _mapped(df: DataFrame, id_col: str, text_col: str, vocab_path: str, out: str, make) -> DataFrame:
    ship(df.sparkSession)
    vocab = df.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    rows = pick(df, id_col, text_col).toDF("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab.value)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                s = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([s.column(0), make(e, s.column(1).to_pylist())], names=["_id", out.split()[0]])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {out}").withColumnRenamed("_id", id_col)


