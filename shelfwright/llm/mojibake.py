"""Problem 4: garbled text from wrong character encodings.

Method: noisy-channel decoding. A channel is a pair (true encoding, encoding it was read with); undoing one turns characters into a
lattice of bytes and reads the bytes again. Two kinds of channels are searched.

* UTF-8 read as a single-byte encoding. Multi-byte sequences are found in the lattice of each such encoding. A sequence counts by
  what it decodes to and by what stands around it: accented letters and typographic signs at once, letters of other scripts in runs
  (box-drawing frames, lone capitals before quotes and the like don't count). Up to three layers are undone.
* One single-byte encoding read as another. Words are scored by their frequency in the whole corpus under each channel, and a
  Viterbi search over the words of a text chooses the channel of each, with a price for every change of channel.

Every text goes through both, so that a text may be damaged in several ways. A stretch without blanks is cut at ASCII punctuation,
and a very long one without any at LONGEST characters: one character is one byte there, so a cut loses nothing but a word across it.

Lost bytes (replacement characters) are wildcards of the lattice. In a sequence of the first kind they stand for any continuation
byte, in a word for any letter beyond ASCII of its alphabet. Fillings are ranked by the frequency of the word they make, and by letter
pairs on the way there (a beam of BEAM); a sign by how often it stands between such neighbours. Where the corpus knows none, or less is
left of a word than is lost, the stretch is reported but not restored.

Corpus frequencies are a count sketch of fixed size over all texts (two rows, the smaller count holds): words with letters beyond
ASCII, their letter pairs, and signs beyond ASCII by their neighbours, since nothing else can come out of a restoration. It is broadcast.

Defined results: null and empty texts have no garbled stretch; a C1 control other than NEL is garbled; entities, percent codes, other
scripts and rare but right characters are not. Repeated rows have one result each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import pick, ship
from shelfwright.llm.sketch import count_items
from shelfwright.llm.spans import Taken

WIDTH = 1 << 20
BEAM = 24
LONGEST = 512  # characters of a stretch that are scored at once
#: Encodings that UTF-8 is read with by mistake.
READERS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8_r", "cp1254", "cp1257", "iso8859_2", "iso8859_15"]
#: (true, read) pairs of single-byte encodings.
SINGLE = [
    ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "cp866"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1251"),
    ("cp852", "cp1250"), ("cp852", "cp1252"), ("cp1250", "cp437"), ("cp1250", "cp852"), ("cp1251", "mac_roman"), ("iso8859_5", "cp1251"), ("cp1252", "cp852"), ("iso8859_2", "cp1250"),
]
SWITCH, BACK = 8.0, 1.0  # prices of entering a channel, and of leaving one for none, in nats
LOST = "�"
C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: A stretch between blanks that has a character beyond ASCII; linear in a text's length.
TOKEN = re.compile(r"(?<![^ \t\r\n\f\v])[!-~\x00-\x08\x0e-\x1f\x7f]*+[^\x00-\x7f][^ \t\r\n\f\v]*")
WORD = re.compile(r"[^\W\d_]+")
DAMAGED = re.compile(rf"(?:[^\W\d_]|{LOST})+")
MANY = 8  # lost letters of a word from which as many must be left
SIGN = re.compile(rf"[^\w\s\x00-\x9f{LOST}]")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
BOX = re.compile("[─-╿▀-▟]")


def _to_byte(name: str) -> dict[str, int]:
    """Character -> byte of an encoding; bytes it leaves open, and C1 controls, stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    if name in ("cp1252", "cp1250", "cp1254", "cp1257", "cp1251", "iso8859_2", "iso8859_15"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


TABLES = {n: _to_byte(n) for n in {*READERS, *(r for _, r in SINGLE)}}
MAPS = {n: {ord(c): b for c, b in t.items()} for n, t in TABLES.items()}
CHARS = {n: frozenset([*map(chr, range(128)), *t]) for n, t in TABLES.items()}


def _class(name: str, lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in TABLES[name].items() if lo <= b <= hi) + "]"


def _sequence(name: str, lost: bool = False) -> re.Pattern:
    """Multi-byte sequences as they look when read with name; with lost, one continuation byte may be a replacement character."""
    more = _class(name, 0x80, 0xBF)
    if lost:
        more = more[:-1] + LOST + "]"
    return re.compile(f"{_class(name, 0xC2, 0xDF)}{more}|{_class(name, 0xE0, 0xEF)}{more}{{2}}|{_class(name, 0xF0, 0xF4)}{more}{{3}}")


SEQUENCES = {n: _sequence(n) for n in READERS}
LOST_SEQUENCES = {n: _sequence(n, True) for n in READERS}
ANY = re.compile("|".join(p.pattern for p in SEQUENCES.values()))
CLOSING = set("\"'”’“»…–—›„")


def _kind(c: str) -> int:
    """3: counts alone; 2: counts beside a letter; 1: counts in runs of three; 0: doesn't count."""
    o = ord(c)
    if 0xA0 <= o <= 0xFF or o == 0xFEFF:
        return 3
    if 0x2010 <= o <= 0x2044 or 0x20A0 <= o <= 0x20BF or o in (0x2122, 0x2212, 0x2264, 0x2265, 0x2192, 0x2116):
        return 3
    if 0x1F300 <= o <= 0x1FAFF:
        return 3
    if 0x100 <= o <= 0x17F or o in (0x192, 0x2C6, 0x2DC):
        return 2
    if 0x2190 <= o <= 0x25FF or 0x2600 <= o <= 0x27BF:
        return 2
    if 0x400 <= o <= 0x45F or 0x490 <= o <= 0x491 or 0x386 <= o <= 0x3CE or 0x5D0 <= o <= 0x5EA or 0x621 <= o <= 0x64A or 0x3041 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0x3000 <= o <= 0x3002:
        return 1
    return 0


def sequences(text: str, name: str) -> list[tuple[int, int, str]]:
    """(start, end, character) of the sequences of UTF-8 read with name that count in text."""
    found, run = [], []
    table = MAPS[name]
    boxes = name in ("cp437", "cp850", "cp866")

    def close() -> None:
        if len(run) >= 3:
            found.extend(run)
        run.clear()

    for m in SEQUENCES[name].finditer(text):
        s = m.group()
        try:
            c = bytes(table[ord(x)] for x in s).decode()
        except UnicodeDecodeError:
            continue
        i, j = m.span()
        if run and run[-1][1] < i and text[run[-1][1] : i].strip(" .,;:()!?\n\r") != "":
            close()
        k = 3 if "\x80" <= c <= "\x9f" and found and found[-1][1] == i else _kind(c)  # a control inside a second layer
        if not k:
            continue
        before, after = text[i - 1] if i else " ", text[j] if j < len(text) else " "
        if k > 1 and s[0].isalpha() and s[-1] in CLOSING and before.isupper() and len(s) == 2:
            continue  # the last letter of a word in capitals, and a quotation mark
        if k > 1 and name in ("cp1251", "koi8_r") and s[0].isalpha() and s[-1] in "»«" and len(s) == 2:
            continue
        if boxes and BOX.match(s[0]):
            if BOX.match(before) and not (run and run[-1][1] == i):
                if not (found and found[-1][1] == i):
                    continue
            if k != 1 and BOX.match(s[-1]) and not (before.isalnum() or after.isalnum()):
                continue
        if k == 2 and not (before.isalpha() or after.isalpha() or (found and found[-1][1] == i)):
            continue
        if k == 1:
            run.append((i, j, c))
        else:
            found.append((i, j, c))
    close()
    return sorted(set(found))


class Words:
    """Frequencies of words and letter pairs from a count sketch, and what follows from them."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.half = counts, len(counts) // 2
        self.total = max(1.0, float(counts.sum()) / 2)
        self.word = lru_cache(1 << 16)(self._word)
        self.pair = lru_cache(1 << 16)(self._pair)
        self.fill = lru_cache(1 << 14)(self._fill)
        self.token = lru_cache(1 << 16)(self._token)

    def count(self, s: str) -> int:
        a, b = slots(s, self.half)
        return int(min(self.counts[a], self.counts[b]))

    def _pair(self, two: str) -> float:
        """Log count of a letter pair."""
        return math.log(self.count("\0" + two.lower()) + 0.05)

    def _word(self, w: str) -> float:
        """Log probability of a word with a letter beyond ASCII, 0 for others."""
        if w.isascii():
            return 0.0
        w = w.lower()
        n = self.count(w)
        if n:
            return math.log(n / self.total)
        pairs = sum(self.pair(w[i : i + 2]) - math.log(self.total) for i in range(len(w) - 1) if not w[i : i + 2].isascii())
        return -math.log(self.total) - 3 + max(-12.0 * max(1.0, len(w) / 16), pairs / 4)

    def score(self, token: str) -> float:
        """Log probability of a token's words; signs inside words, and letters of two scripts in one word, cost extra."""
        out = sum(self.word(w) for w in WORD.findall(token))
        for w in WORD.findall(token):
            if not w.isascii() and len({_script(c) for c in w}) > 1:
                out -= 6
        if INNER.search(token):
            out -= 4
        return out - 5 * len(ODD.findall(token))

    @staticmethod
    def undo(token: str, k: int) -> str | None:
        """A token read by channel k's true encoding, if it can be."""
        true, read = SINGLE[k]
        try:
            return token.translate(MAPS[read]).encode("latin-1").decode(true) if CHARS[read].issuperset(token) else None
        except UnicodeDecodeError:
            return None

    def _token(self, token: str) -> tuple[tuple[int, float, str], ...]:
        """(channel, score, restored) of a token under each channel that applies; channel -1 is none."""
        own = self.score(token)
        out = [(-1, own, token)]
        for k in range(len(SINGLE)):
            o = self.undo(token, k)
            if o is None or o == token or not any(c.isalpha() and c > "\x7f" for c in o):
                continue
            s = self.score(o) - 2 * sum(c > "\x7f" and c.isalpha() and not (x.isalpha() or x.isspace()) for c, x in zip(token, o))  # letters read as signs
            if not any(len(w) > 1 and not w.isascii() and self.count(w.lower()) > 2 for w in WORD.findall(o)):
                s -= 12  # no word that the corpus knows
            if s > own - 8:
                out.append((k, s, o))
        return tuple(out)

    def _fill(self, word: str) -> str | None:
        """A word whose lost letters are filled in, if the corpus knows one."""
        lost = word.count(LOST)
        if lost == len(word) > 1 or lost > MANY and 2 * lost > len(word):
            return None  # less is left than is lost
        letters = alphabet(word)
        width = BEAM * (len(letters) if lost <= 2 else 4)
        beam: list[tuple[float, tuple | None, str]] = [(0.0, None, "")]  # score, fillings so far, last letter
        for i, c in enumerate(word):
            if c == LOST:
                beam = nlargest(width, ((p + (self.pair(last + x) if last else 0.0), (fills, x), x) for p, fills, last in beam for x in letters), key=lambda b: b[0])
            elif i and word[i - 1] == LOST:
                beam = [(p + self.pair(last + c), fills, c) for p, fills, last in beam]
            else:
                beam = [(p, fills, c) for p, fills, _ in beam]
        best = (0, 0.0, "")
        parts = word.split(LOST)
        for p, fills, _ in beam:
            made = []
            while fills:
                fills, x = fills
                made.append(x)
            whole = "".join(a + b for a, b in zip(parts, [*reversed(made), ""]))
            best = max(best, (self.count(whole.lower()), p, whole))
        return best[2] if best[0] > 2 else None


#: Signs of one byte beyond ASCII.
SIGNS = [c for c in TABLES["cp1252"] if not c.isalnum() and not c.isspace() and c.isprintable()]
#: Letters beyond ASCII of the alphabets that lost letters are looked for in. Fixed values.
LETTERS = tuple("áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßąćęłńóśźżčďěňřšťůžőűÁÀÂÄÃÅÇÉÈÊËÍÎÏÑÓÔÖÕÚÛÜ")
CYRILLIC = tuple(map(chr, [*range(0x410, 0x450), 0x401, 0x451, 0x404, 0x454, 0x406, 0x456, 0x407, 0x457, 0x490, 0x491]))
GREEK = tuple(map(chr, [0x386, 0x388, 0x389, 0x38A, 0x38C, 0x38E, 0x38F, *range(0x391, 0x3A2), *range(0x3A3, 0x3CF)]))


def alphabet(word: str) -> tuple[str, ...]:
    """The letters beyond ASCII that may be lost in a word, by those that it has."""
    kinds = {_script(c) for c in word if c.isalpha()}
    return CYRILLIC if 1 in kinds else GREEK if 2 in kinds else LETTERS


INNER = re.compile(r"[^\W\d_][¡-©«-´¶-¹»-¿×÷‚„†‡‰‹›€™]+[^\W\d_]")


#: Signs beyond ASCII that seldom stand in a word's place; common punctuation, currencies and units are left out.
ODD = re.compile(r"[^\w\s\x00-\x7f€£§©«»°±·¿¡…–—‘’‚“”„•™®№›‹\u2500-\u27bf\U0001f000-\U0001ffff\ufe0f\ufeff\ufffd√≈]|[²³¹¼½¾]")


def _script(c: str) -> int:
    o = ord(c)
    return 0 if o < 0x250 else 1 if 0x400 <= o < 0x530 else 2 if 0x370 <= o < 0x400 else 3


def slots(s: str, half: int) -> tuple[int, int]:
    b = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) & (half - 1), half + (zlib.adler32(b[::-1]) * 0x9E3779B1 >> 7 & (half - 1))


def between(text: str, i: int, j: int) -> str:
    """What stands before and after text[i:j]: 1 a digit, 2 a letter, 0 anything else."""
    return "".join("1" if c.isdigit() else "2" if c.isalpha() else "0" for c in (text[i - 1 : i], text[j : j + 1]))


def _lost_sign(text: str, i: int, words: Words) -> str | None:
    """The sign of one byte that stands in such a place far more often than others, but between letters, where letters are lost."""
    place = between(text, i, i + 1)
    if place == "22" or text[i - 1 : i] == LOST or text[i + 1 : i + 2] == LOST:
        return None
    (n, c), (m, _) = nlargest(2, ((words.count("\1" + place + c), c) for c in SIGNS))
    return c if n > 2 and n >= 3 * m else None


def _filled(text: str, m: re.Match, words: Words) -> str:
    """A word with lost letters filled in, or the sign that a lone lost one is."""
    w = m.group()
    if LOST not in w:
        return w
    i, j = m.span()
    if w != LOST or between(text, i, j) == "00":
        if new := words.fill(w):
            return new
    ends = {k for k in (i, j - 1) if text[k] == LOST}
    return "".join((k in ends and _lost_sign(text, k, words)) or c for k, c in enumerate(w, i))


def _readings(s: str, table: dict[int, int]) -> list[str]:
    """The characters that a multi-byte sequence may be, its lost bytes standing for any continuation byte; of three lost ones nothing is told."""
    known = [table.get(ord(c)) for c in s]
    if known.count(None) > 2:
        return []
    out = []
    for v in product(range(0x80, 0xC0), repeat=known.count(None)):
        lost = iter(v)
        try:
            out.append(bytes(next(lost) if b is None else b for b in known).decode())
        except UnicodeDecodeError:
            pass
    return out


def _lost_sequences(text: str, words: Words) -> list[tuple[int, int, str]]:
    """Sequences with lost bytes: (start, end, character). Letters are those of the most frequent word, signs those most frequent in such a place."""
    if LOST not in text:
        return []
    out = _lost_letters(text, words)
    taken = Taken(out)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for name in READERS:
        for m in LOST_SEQUENCES[name].finditer(text):
            if LOST in m.group() and not taken.hit(*m.span()):
                place = "\1" + between(text, *m.span())
                for c in _readings(m.group(), MAPS[name]):
                    if not c.isalnum() and (n := words.count(place + c)) > max(2, best.get(m.span(), (0, ""))[0]):
                        best[m.span()] = (n, c)
    for (i, j), (_, c) in sorted(best.items(), key=lambda x: -x[1][0]):
        if not taken.hit(i, j):
            taken.add(i, j)
            out.append((i, j, c))
    return out


def _lost_letters(text: str, words: Words) -> list[tuple[int, int, str]]:
    """Letters with lost continuation bytes, each reader's whole words over the 64 values of each such byte, by the corpus frequency of the word they make."""
    out = []
    for t in TOKEN.finditer(text):
        token, at = t.group(), t.start()
        if LOST not in token:
            continue
        best: tuple[tuple[int, int], list] = ((2, 0), [])
        for name in READERS:
            table = MAPS[name]
            parts = []
            for m in LOST_SEQUENCES[name].finditer(token):
                fits = [c for c in _readings(m.group(), table) if c.isalpha()]
                if fits:
                    parts.append((*m.span(), fits))
            if not any(LOST in token[i:j] for i, j, _ in parts):
                continue
            beam, end = [("", 0.0, [])], 0
            for i, j, fits in parts:
                beam = [(w + token[end:i] + c, p + words.pair((w + token[end:i])[-1:] + c), [*e, (at + i, at + j, c)]) for w, p, e in beam for c in fits]
                beam = sorted(beam, key=lambda x: -x[1])[: 4 * BEAM]
                end = j
            for w, _, e in beam:
                made = [x for x in WORD.findall(w + token[end:]) if not x.isascii()]
                n = min((words.count(x.lower()) for x in made), default=0), -sum(not (x.islower() or x.isupper() or x.istitle()) for x in made)
                if n > best[0]:
                    best = (n, e)
        out += best[1]
    return out


def _source(p: int, layers: list[list[tuple[int, int, int, int]]], end: bool = False) -> int:
    """The place in the given text of a place (or an end) in the text after some layers of edits (start, end after; start, end before)."""
    for edits in reversed(layers):
        k = bisect_right(edits, (p - end, math.inf)) - 1
        if k >= 0:
            i, j, x, y = edits[k]
            p = (y if end else x) if p - end < j else y + p - j
    return p


def restore(text: str | None, words: Words, sequences_too: bool = True) -> tuple[str | None, list[tuple[int, int, str]]]:
    """(restored text, stretches): each stretch is (start, end in the given text, the channel); where none, the text itself.

    Without sequences_too, the text is known to hold no multi-byte sequence.
    """
    if not text or text.isascii():
        return text, []
    spans: list[tuple[int, int, str]] = []
    layers: list[list[tuple[int, int, int, int]]] = []
    whole = text
    for layer in range(3):
        if not (sequences_too and ANY.search(whole)) and LOST not in whole:
            break
        edits: list[tuple[int, int, str, str]] = [(i, j, c, "lost byte") for i, j, c in _lost_sequences(whole, words)]
        by = sorted(((len(s), -k, n, s) for k, n in enumerate(READERS) if (s := sequences(whole, n))), reverse=True)
        taken = Taken(e[:2] for e in edits)
        for _, _, name, found in by:
            for i, j, c in found:
                if not taken.hit(i, j):
                    taken.add(i, j)
                    edits.append((i, j, c, f"utf_8 as {name}"))
        if not edits:
            break
        edits.sort()
        if layer == 0:
            spans += [(i, j, n) for i, j, _, n in edits]
        out, steps, at, n = [], [], 0, 0
        for i, j, c, _ in edits:
            out += [whole[at:i], c]
            n += i - at
            steps.append((n, n + len(c), i, j))
            n += len(c)
            at = j
        layers.append(steps)
        whole = "".join([*out, whole[at:]])
    more, whole = _single(whole, words)
    taken = Taken(spans)
    lost = [(m.start(), m.end(), "lost") for m in re.finditer(LOST + "+", text)] if LOST in text else []
    for i, j, n in [*((_source(i, layers), _source(j, layers, True), n) for i, j, n in more), *lost]:
        if not taken.hit(i, j):
            taken.add(i, j)
            spans.append((i, j, n))
    if not spans:
        spans = [(m.start(), m.end(), "control") for m in C1.finditer(text)]
    return whole, sorted(spans)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Stretches between blanks that hold a character beyond ASCII, long ones in pieces."""
    out = []
    for m in TOKEN.finditer(text):
        i, j = m.span()
        while j - i > LONGEST:
            cut = max((p.end() for p in PUNCTUATION.finditer(text, i, i + LONGEST)), default=i + LONGEST)
            out.append((i, cut))
            i = cut
        out.append((i, j))
    return [(i, j) for i, j in out if not text[i:j].isascii()]


def _parts(text: str, i: int, j: int) -> Iterator[tuple[int, int, re.Match | None]]:
    """The words with lost letters of text[i:j], and what lies between them."""
    at = i
    for m in DAMAGED.finditer(text, i, j):
        yield at, m.start(), None
        yield *m.span(), m
        at = m.end()
    yield at, j, None


def _single(text: str, words: Words) -> tuple[list[tuple[int, int, str]], str]:
    """Stretches of one single-byte encoding read as another, by Viterbi over the tokens; lost letters are filled in."""
    marks = _stretches(text)
    if not marks:
        return [], text
    tokens = [text[i:j] for i, j in marks]
    options = [words.token(t) for t in tokens]
    path = [-1] * len(marks)
    if any(len(o) > 1 for o in options):
        cost = {-1: 0.0}
        back: list[dict[int, int]] = []
        for o in options:
            low = dict((k, s) for k, s, _ in o)
            floor = low[-1] - 2  # a channel that doesn't apply to this token passes by it at a price
            best = max(cost, key=cost.get)
            new, from_ = {}, {}
            for k in {*cost, *low}:
                stay, jump = cost.get(k, -math.inf), cost[best] - (SWITCH if k >= 0 else BACK)
                new[k], from_[k] = (stay, k) if stay >= jump else (jump, best)
                new[k] += low.get(k, floor)
            cost = new
            back.append(from_)
        k = max(cost, key=cost.get)
        for i in range(len(marks) - 1, -1, -1):
            path[i] = k
            k = back[i][k]
    spans, out, at = [], [], 0
    for (i, j), t, o, k in zip(marks, tokens, options, path):
        new = t if k < 0 else next((x for c, _, x in o if c == k), None) or words.undo(t, k) or t
        if new != t:
            spans.append((i, j, "{} as {}".format(*SINGLE[k])))
        elif LOST in new:
            new = "".join(_filled(text, m, words) if m else text[x:y] for x, y, m in _parts(text, i, j))
        out += [text[at:i], new]
        at = j
    return spans, "".join([*out, text[at:]])


def word_counts(df: DataFrame, text_col: str, width: int = WIDTH) -> np.ndarray:
    """The count sketch of all words with letters beyond ASCII, of their letter pairs, and of signs in their places."""
    ship(df.sparkSession)
    half = width // 2
    rows = pick(df, text_col).toDF("_text").where("_text is not null")

    def add(b: pa.RecordBatch, counts: np.ndarray) -> int:
        seen: Counter[str] = Counter()
        signs: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            if not t.isascii():
                seen.update(w for x in TOKEN.findall(t) for w in WORD.findall(x))
                signs.update(between(t, *m.span()) + m.group() for m in SIGN.finditer(t))
        for w, n in signs.items():
            for p in slots("\1" + w, half):
                counts[p] += n
        for w, n in seen.items():
            if w.isascii():
                continue
            w = w.lower()
            for s in {w, *("\0" + w[i : i + 2] for i in range(len(w) - 1))}:
                for p in slots(s, half):
                    counts[p] += n
        return b.num_rows

    return count_items(rows, add, width)[0]


def repaired(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, restored, n_stretches, channels) of the rows with a garbled stretch; restored keeps what can't be restored."""
    counts = df.sparkSession.sparkContext.broadcast(word_counts(df, text_col))
    rows = pick(df, id_col, text_col).toDF("_id", "_text").where(F.col("_text").rlike(r"[^\x00-\x7f]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(counts.value)
        for b in batches:
            keep, new, n, how = [], [], [], []
            some = pc.match_substring_regex(b.column(1), ANY.pattern).to_pylist()
            for i, t in enumerate(b.column(1).to_pylist()):
                whole, spans = restore(t, words, some[i])
                if spans:
                    keep.append(i), new.append(whole), n.append(len(spans)), how.append(sorted({s[2] for s in spans}))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(new, pa.string()), pa.array(n, pa.int32()), pa.array(how, pa.list_(pa.string()))], names=["_id", "restored", "n_stretches", "channels"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, restored string, n_stretches int, channels array<string>").withColumnRenamed("_id", id_col)


def found(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_col): ids with a garbled stretch, once each."""
    return repaired(df, id_col, text_col).select(id_col).where(F.col(id_col).isNotNull()).distinct()
