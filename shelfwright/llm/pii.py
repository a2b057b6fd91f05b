"""Problem 8: personal information inside free text.

Method: offset-preserving deobfuscation. A chain of transducers rewrites a text to a plain form: compatibility forms and look-alike
letters of other scripts inside Latin words, invisible characters, unusual blanks, digits written out, and the disguises of at and
dot in e-mail addresses. Every character of the plain form knows the source characters it stands for. Identifiers are found in the
plain form and mapped back, so that everything else in the text stays as it was.

Found are e-mail addresses, phone numbers, identity numbers, street addresses with house number, and personal names:

* Numbers are told apart by form (groups, prefixes, check letters) and by the words before them: forms that only identity numbers
  have count unless a word such as "part no." or "ticket" stands before; forms that other numbers have too need such a word as
  "tax" or "DNI" before, or "call", "tel" for phones.
* Names are a given name or initials with a family name, in either order. Where a title, a label, an address or number after it
  marks a name, any capitalised words will do. Elsewhere the first word must be known as a given name: the corpus itself teaches
  those, by how often a word stands as given name in marked places among all its capitalised uses.
* Longer kinds win over shorter ones where they overlap: e-mail, address, identity number, phone, name.

Every text is looked at once. That look finds what a text tells by itself, lists its candidates for names with what marks them, and
counts marked and capitalised words; a detector runs on those texts only that the native expression of its form (without what stands
around it) finds something in. The counts are added up exactly by word, joined to the candidates' words, and names are settled from
the lists alone.

Defined results: null and empty texts have nothing to find; a text without findings is returned as it is; positions count code
points from 0. Repeated rows have results each; in found() rows are distinct. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.common import cut, pick, ship
from shelfwright.llm.spans import Taken

FLUSH = 200_000  # different words that a task counts before it hands them on
KINDS = ("email", "address", "id_number", "phone", "name")

# --- Transducers -----------------------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = str.maketrans("АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΧο", "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTXo")
INVISIBLE = set("­​‌‎‏⁠﻿")
#: Digits written out. Fixed values.
DIGITS = {
    w: str(d)
    for d, ws in enumerate([
        "zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
        "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
    ]) for w in ws.split()
}
SPELLED = re.compile(r"(?i)\b(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?:[\s,.-]{1,3}(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")){5,}\b")
OTHER = re.compile("[Ͱ-ԯ]")
MIXED = re.compile(r"(?<![A-Za-z])[A-Za-z]++[Ͱ-ԯ]+\w*|(?<![Ͱ-ԯ])[Ͱ-ԯ]++[A-Za-z]+\w*")
AT = r"(?:\s*[\[({<]\s*(?:at|@|ät|arroba|arobase|chez)\s*[\])}>]\s*|\s+(?:at|arroba|arobase)\s+(?=[\w-]+\s*(?:[\[({]\s*(?:dot|punkt|punto|point)|\s(?:dot|punkt|punto|point)\s)))"
DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|punto|point|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|punto|point)\s+)"
DISGUISED = re.compile(rf"(?i)(?<![\w.%+-])[\w.%+-]++(?:{DOT}[\w%+-]+){{0,4}}(?:{AT}|@|\s@\s?|@\s)[\w-]+(?:(?:{DOT}|\.)[\w-]+){{1,8}}")
AT_RE, DOT_RE = re.compile(f"(?i){AT}|\\s*@\\s*"), re.compile(f"(?i){DOT}")


class Plain:
    """A text in plain form; its character i stands for the source's characters from at[i] to before to[i]."""

    def __init__(self, text: str):
        self.text, self.at, self.to = text, None, None

    def source(self, i: int, j: int) -> tuple[int, int]:
        """The stretch of the source that characters i to before j stand for."""
        return (i, j) if self.at is None else (self.at[i], self.to[j - 1])

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches; each character of a replacement stands for its whole stretch."""
        if not edits:
            return
        n = len(self.text)
        at, to = (self.at, self.to) if self.at is not None else (list(range(n)), list(range(1, n + 1)))
        out, new_at, new_to, p = [], [], [], 0
        for i, j, s in edits:
            out += [self.text[p:i], s]
            new_at += at[p:i] + [at[i]] * len(s)
            new_to += to[p:i] + [to[j - 1]] * len(s)
            p = j
        self.text, self.at, self.to = "".join([*out, self.text[p:]]), new_at + at[p:], new_to + to[p:]


@lru_cache(1)
def _unusual() -> re.Pattern:
    """The characters beyond ASCII that _plain_char rewrites."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if _plain_char(c) is not None]
    spans: list[list[str]] = []
    for c in found:
        if spans and ord(spans[-1][1]) + 1 == ord(c):
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(x)}-{re.escape(y)}" for x, y in spans) + "]")


def _plain_char(c: str) -> str | None:
    """What a character beyond ASCII is rewritten to, or none."""
    if c in INVISIBLE:
        return ""
    if c.isspace():
        return " " if c not in "\u2028\u2029\x85" else None
    if c in "‐‑‒−﹘﹣":
        return "-"
    if "！" <= c <= "～" or "①" <= c <= "⓿" or "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    if c in "’ʼ":
        return "'"
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return None


def _rewritten(text: str) -> Plain:
    """The first transducers: compatibility forms, blanks, invisible characters and look-alike letters."""
    p = Plain(text)
    if not text.isascii():
        p.edit([(m.start(), m.end(), _plain_char(m.group())) for m in _unusual().finditer(text)])
        if OTHER.search(p.text):
            p.edit([(m.start(), m.end(), m.group().translate(LOOKALIKES)) for m in MIXED.finditer(p.text)])
    return p


def plain(text: str) -> Plain:
    """The chain of transducers."""
    return _undisguised(_rewritten(text))


def _undisguised(p: Plain, spelled: bool = True, disguised: bool = True) -> Plain:
    """The last transducers: digits written out, and at and dot in disguise."""
    if spelled:
        p.edit([(m.start(), m.end(), "".join(DIGITS[w.lower()] for w in re.findall(r"\w+", m.group()))) for m in SPELLED.finditer(p.text)])
    edits = []
    for m in DISGUISED.finditer(p.text) if disguised else ():
        whole = m.group()
        if "@" in whole and not re.search(r"[\s\[({<]", whole):
            continue
        for x in [*AT_RE.finditer(whole)][:1]:
            edits.append((m.start() + x.start(), m.start() + x.end(), "@"))
        for x in DOT_RE.finditer(whole):
            edits.append((m.start() + x.start(), m.start() + x.end(), "."))
    p.edit(sorted(set(edits)))
    return p


# --- Detectors -------------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"(?<![\w.%+\-])(?!mailto:)[A-Za-z0-9À-ÿ_][\w.%+\-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])")
CAP = r"[A-ZÀ-ÖØ-ÞŚŻŹŁĆĐŽŠČ]"
WORD = rf"{CAP}[\w'À-ÿ-]*"
STREETS_EN = r"(?:Street|Road|Lane|Close|Row|Avenue|Drive|Court|Terrace|Place|Way|Crescent|Gardens|Grove|Hill|Square|Boulevard|Parkway|Mews|Walk|Rise|Alley|Highway|Circle|St\.|Rd\.|Ave\.?|Blvd\.?|Ln\.|Dr\.)"
FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Floor)\s+\d+\w?,\s*"
ADDRESS_EN = re.compile(rf"(?<![\w.,:/-])(?:{FLAT})?(?:No\.?\s+)?\d{{1,5}}(?:\s?[A-Za-z]|-\d{{1,4}})?,?\s+(?!The\s)(?:{CAP}[\w'-]*\s+){{1,3}}{STREETS_EN}(?!\w)")
ADDRESS_EN_CAPS = re.compile(rf"(?<![\w.,:/-])(?:(?:FLAT|APT\.?|UNIT)\s+\d+\w?,\s*)?\d{{1,5}}[A-Z]?\s+(?:[A-Z][A-Z'-]*\s+){{1,3}}(?:STREET|ROAD|LANE|CLOSE|ROW|AVENUE|DRIVE|COURT|TERRACE|PLACE|WAY|SQUARE)\b")
ADDRESS_DE = re.compile(
    rf"(?<![\w-])(?:{CAP}[\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|hof|graben|markt|steig|chaussee|pfad|stieg|zeile|promenade)|{CAP}[\wäöüß-]+\s(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Ring|Damm)|(?:Am|An der|An den|An dem|Hinterm|Hinter dem|Hinter der|Im|In der|In den|Auf der|Auf dem|Auf den|Zum|Zur|Zu den|Unter den|Beim|Vor dem|Vor der|Vorm|Unterm|Überm)(?:\s{CAP}[\wäöüß-]+){{1,2}})\s+\d{{1,4}}(?:\s?[a-zA-Z])?(?![\w.:/]?\d)(?!\w)"
)
ADDRESS_FR = re.compile(rf"(?<![\w.,:/-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Z]))?,?\s+(?:rue|avenue|av\.|boulevard|bd|chemin|place|impasse|allée|quai|route|cours|square|passage|sentier|ruelle|montée|esplanade|villa)\s+(?:(?:de\s+la|de\s+l'|du|des|de|d'|aux|au|à\s+la|la|le|les)\s*)?{CAP}[\w'-]*", re.I)
ADDRESS_ES = re.compile(rf"(?<!\w)(?:Calle|C/|Avenida|Avda\.?|Av\.|Camino|Plaza|Pza\.|Paseo|P\.º|Ronda|Travesía|Carretera|Callejón|Cuesta|Glorieta|Rambla|Vía)\s+(?:(?:de\s+la|de\s+los|de\s+las|del|de|la|el|los|las)\s+)?{CAP}[\w'-]*(?:\s+(?:(?:de|del|la|los|las)\s+)*{CAP}[\w'-]*){{0,3}},?\s+(?:n\.?\s?[ºo°]\s*|núm\.?\s*)?\d{{1,4}}(?!\w)", re.I)

NUM_BEFORE = r"(?<![\w.,:/@#=+-])"
NUM_BEFORE_OPEN = r"(?<![\w.:/@#+-])(?<!\d,)"
PHONE = re.compile(
    NUM_BEFORE_OPEN
    + r"(?:\(\s?\+\d{1,3}\s?\)|\+\d{1,3}|00\d{2}|\((?:0\d{1,5}|\d{3})\)|\d)"  # country or area code, or the first digit
    + r"(?:[ \t.\-/]{0,2}(?:\(0\)|\(\d{1,5}\)|\d)){6,14}(?![\w@]|[-/.:]\d)"
)
DATE = re.compile(r"^(?:\d{4}-\d\d-\d\d|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|(?:19|20)\d{6})(?:[\sT]\d.*)?$")
CALL = re.compile(r"(?i)(?:\b(?:tel|telefon\w*|téléphone|teléfono|phone|fon|mobile?|cell|handy|call|ring|dial|voicemail|reached|text|fax|whatsapp|appeler|joindre|joignable|llamar|llame|erreichbar|anrufen|rufnummer|nummer|unter|portable|móvil|contact)\b[^\n]{0,24}|@[\w-]+:\s*|[;|]\s*|\"(?:tel|phone|mobile)\"\s*:\s*\")$")
NOT_NUMBER = re.compile(r"(?i)\b(?:part\s*(?:no|number|nr)\.?|asset(?:\s+tag)?|ticket|issue|invoice|inv|order|build|version|release|size|wrote|serial(?:\s+no\.?)?|sku|batch|isbn|issn|port|row|rows|page|seite|página|edition|commit|rev|revision|model|item|lot|case|tracking|job|pid|checksum|hash|port|line|bug|pr)\W{0,3}$")
AFTER_NOT = re.compile(r"^\s*(?:[Bb]ytes?|[kKMGT]i?B|rows?|files?|Dateien|fichiers|ficheros|items?|px|ms|sec)\b")
ID_WORDS = re.compile(
    r"(?i)(?:social\s+security|\bssn\b|national\s+insurance|\bni\s+(?:no|number)|\bnino\b|\btax\b|tax[_\s-]*id|\btin\b|\bid\s*(?:no|nr|number|card)?\b|identity|identification|passport|reisepass|pasaporte|passeport|steuer\w*|ausweis\w*|personalausweis|sozialversicherung\w*|versicherungs\w*|rentenversicherung\w*|\bdni\b|\bnie\b|\bnif\b|identidad|documento|identité|sécu\b|sécurité\s+sociale|\bnir\b|fiscal\w*|impôts?|seguridad\s+social|carte\s+d)[^\n]{0,70}$"
)
#: Forms that hardly any number but an identity number has.
ID_STRONG = re.compile(
    NUM_BEFORE
    + r"(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"  # social security
    + r"|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"  # national insurance
    + r"|\d{8}[ -]?[A-HJ-NP-TV-Z]|\d{2}\.\d{3}\.\d{3}[ -]?[A-HJ-NP-TV-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]|[XYZ]-?\d\.\d{3}\.\d{3}-?[A-Z]"  # identity card, foreigner's number
    + r"|[12378]\s\d{2}\s(?:0[1-9]|[1-9]\d)\s(?:\d{2}|2[AB])\s\d{3}\s\d{3}(?:\s\d{2})?"  # social security in groups
    + r")(?![\w@]|[-.]\d)"
)
#: Forms that need a word before them.
ID_WEAK = re.compile(NUM_BEFORE + r"(?:\d{2} \d{3} \d{3} \d{3}|\d{2} \d{6} [A-Z] \d{3}|[12378]\d{12}(?:\d{2})?|\d{11}|\d{9,10}|\d{3}[ -]?\d{3}[ -]?\d{3}|[A-Z]\d{2}[A-Z0-9]\d{5}\d?|[A-Z0-9]{9,10}|[A-Z]{1,2}\d{6,8}[A-Z]?|\d{2}/\d{3}/\d{5}|\d{2} \d{3} \d{3} \d{3}|\d{7,8}[A-Z]?)(?![\w@]|[-.]\d)")

PARTICLE = r"(?:(?:(?:de la|de los|de las|van der|van den|von der|von dem|zu|von|van|de|del|della|di|da|du|des|la|le|el|al|bin|ben|ter|ten)[ \t]|de l'|d'))"
NAME_PART = rf"(?:O'|D'|Mc|Mac|L')?{CAP}(?:[a-zß-öø-ÿœ]+(?:'[a-z]+)?|[A-ZÀ-ÖØ-Þß]+)(?:-(?:O'|Mc)?{CAP}[\wß-ÿ]+){{0,2}}"
INITIAL = rf"{CAP}\.(?:-?{CAP}\.){{0,2}}"  # bounded, as all repetitions of names are, to stay linear
GAP = r"[ \t]"
NAMED = re.compile(
    rf"(?<![\w'.@/\-])(?:(?P<given>{NAME_PART})(?:{GAP}{INITIAL}|{GAP}(?P<second>{NAME_PART}(?={GAP})))?|(?!M\.{GAP}(?:{NAME_PART}|{INITIAL}){GAP}(?:{PARTICLE})?{CAP})(?P<initials>{CAP}\.(?:{GAP}?-?{CAP}\.){{0,3}})){GAP}(?P<particle>{PARTICLE})?(?P<family>{NAME_PART})(?![\w@'/]|-\w|\.\w)"
)
SHORT = re.compile(rf"(?<![\w'.@/\-])(?P<given>{NAME_PART})(?:{GAP}{INITIAL})?{GAP}(?P<particle>{PARTICLE})?(?P<family>{NAME_PART})(?![\w@'/]|-\w|\.\w)")
REVERSED = re.compile(rf"(?<![\w'.@/\-])(?P<particle>{PARTICLE})?(?P<family>{NAME_PART}),{GAP}(?P<given>{NAME_PART}|{INITIAL})(?:{GAP}{INITIAL})?(?![\w@'/]|-\w|\.\w)")
TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Herrn?|Frau|Mme|Mlle|Maître|Me|Monsieur|Madame|Don|Doña|[Ss]eñora?|Sra?|Sig|Signora?|Ing|Dipl)\.?|\bM\.)\s$")
LABEL = re.compile(r"(?i)(?:\b(?:name|nombre|nom|from|von|cc|to|contact|kontakt|contacto|author|autor|auteur|owner|assignee|user|full_name|signed|regards|attn)\s*[:=]\s*\"?|\"(?:contact|name|author|owner|assignee|user)\"\s*:\s*\"|\b(?:according\s+to|laut|selon|según|d'après)\s)$")
MARK_AFTER = re.compile(r"^(?:\s?[<(](?:mailto:)?[\w.+%-]+\s?(?:@|[\[(])|;\s?(?:\+|\(|\d)|\",\s?\"(?:tel|mail|phone)|,\s(?:erreichbar|joignable|con\steléfono|who\scan\sbe|reachable)|,[\w.-]+\.\w{2,4}\b|\sleft\sa\s(?:voicemail|message))")
#: Words that make a capitalised pair something else than a person. Fixed values.
NOT_PERSON = set("street road lane close row avenue drive court terrace place square way plan project archive team desk board review survey dataset committee department office group report release shelf library institute university inc ltd gmbh llc corp company foundation museum bank hotel station bridge river lake park gardens club party press news times straße strasse platz weg gasse allee".split())
NOT_GIVEN = set("the a an der die das le la les el los las un une on in at for since only after before while if when today every please check dear hello hallo hola bonjour hi open age ask bitte demander consultar am im zur zum von bei seit für ob unter möglicherweise ältere früher während zusätzlich laut selon según according no not new old north south east west san santa saint mr mrs ms miss mx dr prof sir dame herr herrn frau mme mlle monsieur madame don doña señor señora sr sra sig signora".split())


def _marked(text: str, start: int, end: int) -> bool:
    before = text[max(0, start - 28) : start]
    return bool(TITLE.search(before) or LABEL.search(before) or MARK_AFTER.match(text[end : end + 40]))


def _name_like(m: re.Match) -> bool:
    g, f = m.group("given") or "", m.group("family")
    if f.lower() in NOT_PERSON or g.lower() in NOT_GIVEN or f.lower() in NOT_GIVEN or g.lower() in NOT_PERSON:
        return False
    return not (f.isupper() and g and not g.isupper() and len(f) > 2)


CAPS = re.compile(rf"(?<![\w'.@/\-])(?:{NAME_PART})(?![\w@'/])")
#: Places where a name of capitalised words may begin: a capital, and after its word a blank and another one or a particle.
BEGIN = re.compile(rf"{CAP}(?<![\w'.@/\-].)(?=[\w'.\-]*+[ \t](?:[ \t]?-?{CAP}|d[eiua']|von |van |zu |l[aeo]|el |al |bin |ben |ter |ten ))")
COMMA = re.compile(rf",[ \t](?={CAP})")
TAIL = re.compile(r"[\w'-]+\Z")


def _reversed(t: str) -> list[re.Match]:
    """All matches of REVERSED, one for each place where one begins."""
    out, last = [], -1
    for m in COMMA.finditer(t):
        k = m.start()
        while k > 0 and (t[k - 1].isalnum() or t[k - 1] in "_'-"):
            k -= 1
        for i in range(max(last + 1, k - 8), k + 1):
            if (i == k or t[i] in "dvzulabet") and (x := REVERSED.match(t, i)):
                out.append(x)
                last = i
    return out


def _beginnings(t: str, rxs: tuple[re.Pattern, ...]) -> list[list[re.Match]]:
    out: list[list[re.Match]] = [[] for _ in rxs]
    for b in BEGIN.finditer(t):
        for found, rx in zip(out, rxs):
            if m := rx.match(t, b.start()):
                found.append(m)
    return out


def _marked_words(found: list[re.Match], marked: Callable[[re.Match], bool]) -> Iterator[str]:
    """Given and family names of the marked names among matches, each from behind the one before, as g: and f: with the lower-case word."""
    end = 0
    for m in found:
        if m.start() < end:
            continue
        end = m.end()
        g = m.group("given")
        if g and not g.endswith(".") and _name_like(m) and marked(m):
            yield from ("g:" + x for x in g.lower().split("-"))
            yield from ("f:" + x for x in m.group("family").lower().split("-"))


@dataclass
class Candidate:
    """A match that may be a name. Places are of the plain form; kind 0 reversed, 1 given and family name, 2 with more between."""

    kind: int
    start: int
    end: int
    second_start: int  # of the second given name, -1 if there is none
    given: str
    second: str
    family: str
    marked: bool
    beside: int  # end of what stands between the match and what may mark it, -1 if nothing does
    free: int  # bits: initials may stand here if the name is marked (1), if it isn't (2)


@dataclass
class Look:
    """What one text tells by itself. spans: start, end (plain form), kind; names: Counter of marked words."""

    plain: Plain
    spans: list[tuple[int, int, str]] = field(default_factory=list)
    candidates: list[Candidate] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


ALL = frozenset(("address_en", "address_caps", "address_de", "address_fr", "address_es", "strong", "weak", "phone"))
ADDRESSES = {"address_en": ADDRESS_EN, "address_caps": ADDRESS_EN_CAPS, "address_de": ADDRESS_DE, "address_fr": ADDRESS_FR, "address_es": ADDRESS_ES}


def look(p: Plain, forms: frozenset[str] | set[str] = ALL) -> Look:
    """Everything but the decision about names. forms: those whose native expression found something."""
    t, out = p.text, Look(p)
    taken = Taken()

    def add(i: int, j: int, kind: str) -> None:
        if not taken.hit(i, j):
            taken.add(i, j)
            out.spans.append((i, j, kind))

    if "@" in t:
        for m in EMAIL.finditer(t):
            i = m.start() + (7 if m.group().lower().startswith("mailto:") else 0)
            add(i, m.end(), "email")
    for name, rx in ADDRESSES.items():
        if name in forms:
            for m in rx.finditer(t):
                if rx is ADDRESS_DE and _weekday(m.group()):
                    continue
                add(m.start(), m.end(), "address")
    for m in ID_STRONG.finditer(t) if "strong" in forms else ():
        before = t[max(0, m.start() - 90) : m.start()]
        if NOT_NUMBER.search(before) or AFTER_NOT.match(t[m.end() : m.end() + 12]):
            continue
        add(m.start(), m.end(), "id_number")
    for m in ID_WEAK.finditer(t) if "weak" in forms else ():
        if sum(map(str.isdigit, m.group())) >= 6 and not DATE.match(m.group()):
            before = t[max(0, m.start() - 90) : m.start()]
            if ID_WORDS.search(before) and not NOT_NUMBER.search(before) and not CALL.search(before[-28:]) and not AFTER_NOT.match(t[m.end() : m.end() + 12]):
                add(m.start(), m.end(), "id_number")
    for m in PHONE.finditer(t) if "phone" in forms else ():
        if is_phone(m.group(), t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 14]):
            add(m.start(), m.end(), "phone")

    known: dict[tuple[int, int], bool] = {}

    def marked(m: re.Match) -> bool:
        if (at := m.span()) not in known:
            known[at] = _marked(t, *at)
        return known[at]

    turned = _reversed(t)
    short, named = _beginnings(t, (SHORT, NAMED))
    out.names = [*_marked_words(named, marked), *_marked_words(turned, marked)]
    for kind, found in enumerate((turned, short, named)):
        for m in found:
            i, j = m.span()
            if not _name_like(m) or taken.hit(i, j) or (kind and _weekday(m.group())):
                continue
            b = BESIDE.match(t, j)
            before, second = t[max(0, i - 3) : i], m.group("second") if kind == 2 else None
            free = (not NO_INITIAL_MARKED.search(before)) + 2 * (not NO_INITIAL.search(before))
            out.candidates.append(Candidate(kind, i, j, m.start("second") if second else -1, m.group("given") or "", second or "", m.group("family"), marked(m) or t[max(0, i - 2) : i] == "/ ", b.end() + 1 if b else -1, free))
    return out


NO_INITIAL_MARKED = re.compile(r"[º°][ \t]?\Z|\w\.\Z")
NO_INITIAL = re.compile(r"[º°\d][ \t]?\Z|\w\.\Z")


def settle(spans: list[tuple[int, int]], candidates: list[Candidate], given: set[str], family: set[str]) -> list[tuple[int, int]]:
    """(candidate's number, whether from its second given name) of the candidates that are names. given, family: the known parts of words."""
    taken, out = Taken(spans), []

    def is_given(word: str) -> bool:
        w = word.lower()
        return w not in NOT_GIVEN and all(x in given for x in w.split("-"))

    was, next_ = -1, 0
    for n, c in enumerate(candidates):
        if c.kind != was:
            was, next_ = c.kind, 0
        if c.start < next_ or taken.hit(c.start, c.end):
            continue
        if c.kind == 1 and is_given(c.family):
            continue  # two given names: the family comes later
        sure, second = c.marked or (c.beside >= 0 and taken.hit(c.end, c.beside)), 0
        if c.given and not c.given.endswith("."):
            ok = is_given(c.given) or (sure and not is_given(c.family))
            if not ok and c.second and is_given(c.second):
                ok, second = True, 1
        else:  # initials: the family must be known, or the name marked
            ok = sure and c.free & 1 or c.free & 2 and all(x in family for x in c.family.lower().split("-"))
        if ok:
            out.append((n, second))
            taken.add(c.second_start if second else c.start, c.end)
            next_ = c.end
    return out


def words_of(c: Candidate) -> Iterator[str]:
    """The words whose standing in the corpus decides about a candidate."""
    for w in (c.given, c.second, c.family):
        if w and not w.endswith("."):
            yield from w.lower().split("-")


def known_words(counts: Counter) -> tuple[set[str], set[str]]:
    """(given names, family names): words that stand so, marked, at least twice and in a tenth of their capitalised uses."""
    find = lambda k: {w[2:] for w, n in counts.items() if w[:2] == k and n >= 2 and n * 10 >= counts["t:" + w[2:]]}
    return find("g:"), find("f:")


def counted(text: str) -> Iterator[str]:
    """What a text adds to the corpus' counts: g:, f: of marked names, t: of capitalised words."""
    p = plain(text)
    yield from look(p).names
    for w in CAPS.findall(p.text):
        yield from ("t:" + x for x in w.lower().split("-"))


def findings(text: str | None, known: tuple[set[str], set[str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the source, ascending, without overlaps."""
    if not text:
        return []
    found = look(plain(text))
    names = [(c.second_start if second else c.start, c.end, "name") for n, second in settle([s[:2] for s in found.spans], found.candidates, *known) for c in [found.candidates[n]]]
    return sorted((*found.plain.source(i, j), k) for i, j, k in [*found.spans, *names])


#: What may stand between a name and the address or number that marks it.
BESIDE = re.compile(r"(?:,[ \t]|[ \t]\|[ \t]|\n(?!\s)|;)")


def _weekday(s: str) -> bool:
    return bool(re.match(r"(?:Am|Im|Zum|Zur|Beim)\s(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonnabend|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Seite|Jahr|Ticket|Raum)\b", s))


def is_phone(s: str, before: str, after: str) -> bool:
    digits = re.sub(r"\D", "", s)
    if not 8 <= len(digits) <= 15 or DATE.match(s) or AFTER_NOT.match(after) or NOT_NUMBER.search(before) or re.search(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d\b|\b(?:19|20)\d\d-\d\d-\d\d", s):
        return False
    if re.match(r"^\s?\d\d?:\d\d", after) or re.search(r"\bINV-[\d-]*$|\bTicket [\d-]*$", before):
        return False
    called = bool(CALL.search(before)) or (before.rstrip(" \t").endswith("\n") and after[:1] in ("", "\n", "\r"))
    if s[0] == "+" or s.startswith("(+"):
        return len(digits) >= 9
    groups = re.split(r"[\s.\-/()]+", s.strip("() "))
    if s.startswith("(0") or re.match(r"\(\d{3}\)", s):
        return len(digits) >= 8
    if digits.startswith("00") and 11 <= len(digits) <= 15:
        return True
    if digits.startswith("0") and 9 <= len(digits) <= 12:
        return len(groups) > 1 and [len(g) for g in groups] != [3, 2, 4] or called
    shape = [len(g) for g in groups]
    if shape in ([3, 3, 4], [1, 3, 3, 4]) and re.match(r"^(?:1[\s.-])?[2-9]", s):
        return True
    if called and (len(digits) in (9, 10, 11)) and shape in ([9], [10], [11], [3, 3, 3], [3, 2, 2, 2], [2, 3, 2, 2], [3, 6], [5, 6], [3, 3, 4]):
        return True
    return shape in ([3, 2, 2, 2], [3, 3, 3]) and digits[0] in "56789" and called


# --- Operators -------------------------------------------------------------------------------------------------------------------


def native(pattern: str, ignore_case: bool = False) -> str:
    """A pattern in the native expression language that finds something wherever pattern does: without lookarounds and atomic repeats.

    Word ends know ASCII letters only there, so they must stand beside one: then there are more of them, never fewer."""
    letters, blanks = r"\pL\pN_", r"\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}"
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith(("(?<!", "(?<=", "(?!", "(?="), i) and not inside:
            depth, in_class = 0, False
            while True:
                x = pattern[i]
                if x == "\\":
                    i += 1
                elif in_class:
                    in_class = x != "]"
                elif x == "[":
                    in_class = True
                elif x in "()":
                    depth += 1 if x == "(" else -1
                i += 1
                if not depth:
                    break
            continue
        if c == "\\":
            e = pattern[i + 1]
            out.append({"w": letters if inside else f"[{letters}]", "s": blanks if inside else f"[{blanks}]"}.get(e, c + e))
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "+" and i and pattern[i - 1] in "+*":
            i += 1
            continue
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


_DIGIT_WORDS = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_B = r"[\s\v\x{85}\x{a0}\x{2028}\x{2029}]"
#: Forms that the transducers and detectors look for, in the native expression language.
NATIVE = {
    "spelled": rf"(?i){_DIGIT_WORDS}(?:(?:{_B}|[,.-]){{1,3}}{_DIGIT_WORDS}){{5}}",
    "disguised": rf"(?i)@{_B}|{_B}@|[\[({{<]{_B}*(?:at|@|ät|arroba|arobase|chez|dot|punkt|punto|point|\.){_B}*[\])}}>]|@[\pL\pN_-]+{_B}+(?:dot|punkt|punto|point){_B}|{_B}(?:dot|punkt|punto|point){_B}+[\pL\pN_%+-]+@|{_B}(?:at|arroba|arobase){_B}+[\pL\pN_-]+{_B}*(?:[\[({{]{_B}*|{_B})(?:dot|punkt|punto|point)",
    **{k: native(rx.pattern, bool(rx.flags & re.I)) for k, rx in ADDRESSES.items()},
    "strong": native(ID_STRONG.pattern),
    "weak": native(ID_WEAK.pattern),
    "id_words": native(ID_WORDS.pattern.removesuffix(r"[^\n]{0,70}$")),
    "phone": r"\d(?:[ \t.\-/()]{0,4}\d){6}",
}


def looks(texts: list[str | None]) -> list[Look | None]:
    """look() of many texts."""
    first = [_rewritten(t) if t else None for t in texts]
    col = pa.array([p.text if p else None for p in first], pa.string())
    has = lambda col, k: pc.match_substring_regex(col, NATIVE[k]).to_pylist()
    plains = [_undisguised(p, s, d) if p else None for p, s, d in zip(first, has(col, "spelled"), has(col, "disguised"))]
    col = pa.array([p.text if p else None for p in plains], pa.string())
    forms = sorted(ALL)
    hits = [has(col, k) for k in forms]
    hits[forms.index("weak")] = [x and y for x, y in zip(hits[forms.index("weak")], has(col, "id_words"))]
    hits = zip(*hits)
    return [look(p, {k for k, y in zip(forms, h) if y}) if p else None for p, h in zip(plains, hits)]


SPAN = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())]))
CANDIDATE = pa.list_(pa.struct([("kind", pa.int8()), ("i", pa.int32()), ("j", pa.int32()), ("second_i", pa.int32()), ("given", pa.string()), ("second", pa.string()), ("family", pa.string()), ("marked", pa.bool_()), ("beside", pa.int32()), ("free", pa.int8()), ("start_pos", pa.int64()), ("second_pos", pa.int64()), ("end_pos", pa.int64())]))
SPAN_DDL = "array<struct<i: int, j: int, start_pos: long, end_pos: long, kind: string>>"
CANDIDATE_DDL = "array<struct<kind: tinyint, i: int, j: int, second_i: int, given: string, second: string, family: string, marked: boolean, beside: int, free: tinyint, start_pos: long, second_pos: long, end_pos: long>>"


def _looked(df: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """(row, _id, _text, spans, candidates, words) of each row, and (word, n) of what it was counted; only _text is optional.

    row numbers the rows; a row without spans and candidates is left out unless its text is kept. words: what decides about its candidates.
    """
    ship(df.sparkSession)
    rows = pick(df, id_col, text_col).toDF("_id", "_text")
    rows = rows if keep_text else rows.where("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        seen: Counter[str] = Counter()
        caps: Counter[str] = Counter()
        id_type = None

        def counts() -> pa.RecordBatch:
            for w, n in caps.items():
                for x in w.lower().split("-"):
                    seen["t:" + x] += n
            k = len(seen)
            none = lambda t: pa.nulls(k, t)
            out = pa.RecordBatch.from_arrays([none(pa.int64()), none(id_type), none(pa.string()), none(SPAN), none(CANDIDATE), none(pa.list_(pa.string())), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=NAMES)
            seen.clear(), caps.clear()
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(1).to_pylist()
                kept, spans, candidates, words = [], [], [], []
                for n, x in enumerate(looks(texts)):
                    if x is not None:
                        seen.update(x.names)
                        caps.update(CAPS.findall(x.plain.text))
                    if not keep_text and (x is None or not (x.spans or x.candidates)):
                        continue
                    kept.append(n)
                    source = x.plain.source if x else None
                    spans.append([(i, j, *source(i, j), k) for i, j, k in x.spans] if x else [])
                    candidates.append([(c.kind, c.start, c.end, c.second_start, c.given, c.second, c.family, c.marked, c.beside, c.free, source(c.start, c.end)[0], source(c.second_start, c.end)[0] if c.second else -1, source(c.start, c.end)[1]) for c in x.candidates] if x else [])
                    words.append(sorted({w for c in x.candidates for w in words_of(c)}) if x else [])
                k = len(kept)
                place = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at + i for i in kept], pa.int64()), part.column(0).take(place), part.column(1).take(place) if keep_text else pa.nulls(k, pa.string()), _structs(spans, SPAN), _structs(candidates, CANDIDATE), pa.array(words, pa.list_(pa.string())), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=NAMES
                )
                at += part.num_rows
                if len(seen) + len(caps) > FLUSH:
                    yield counts()
        if seen or caps:
            yield counts()

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, _id {kind}, _text string, spans {SPAN_DDL}, candidates {CANDIDATE_DDL}, words array<string>, word string, n long")


NAMES = ["row", "_id", "_text", "spans", "candidates", "words", "word", "n"]


def _structs(lists: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]
    flat = [x for one in lists for x in one]
    cols = list(zip(*flat)) if flat else [[] for _ in fields]
    starts = [0]
    for one in lists:
        starts.append(starts[-1] + len(one))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], fields=fields), type=kind)


FOUND = "array<struct<start_pos: long, end_pos: long, kind: string>>"


def _settled(df: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """(_id, _text, found) of every row, or without keep_text of those in which something may be found."""
    looked = cut(_looked(df, id_col, text_col, keep_text), "looked")
    count = looked.where("word is not null").groupBy(F.substring("word", 3, 1 << 30).alias("w")).agg(*[F.coalesce(F.sum(F.when(F.col("word").startswith(k + ":"), F.col("n"))), F.lit(0)).alias(k) for k in "gft"])
    stands = lambda c: (F.col(c) >= 2) & (F.col(c) * 10 >= F.col("t"))
    names = count.select("w", stands("g").alias("given"), stands("f").alias("family")).where("given or family")
    rows = looked.where("row is not null")
    known = rows.where("size(words) > 0").select("row", F.explode("words").alias("w")).join(names, "w").groupBy("row").agg(F.collect_set(F.when(F.col("given"), F.col("w"))).alias("given"), F.collect_set(F.when(F.col("family"), F.col("w"))).alias("family"))  # words of one row
    open_ = rows.where("size(candidates) > 0").join(known, "row", "left").select("_id", "_text", "spans", "candidates", "given", "family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            out = []
            for spans, candidates, given, family in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                cs = [Candidate(c["kind"], c["i"], c["j"], c["second_i"], c["given"], c["second"], c["family"], c["marked"], c["beside"], c["free"]) for c in candidates]
                found = [(x["start_pos"], x["end_pos"], x["kind"]) for x in spans]
                for n, second in settle([(x["i"], x["j"]) for x in spans], cs, set(given or ()), set(family or ())):
                    c = candidates[n]
                    found.append((c["second_pos"] if second else c["start_pos"], c["end_pos"], "name"))
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _structs(out, kind)], names=["_id", "_text", "found"])

    settled = open_.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _text string, found {FOUND}")
    rest = rows.where("size(candidates) = 0").select("_id", "_text", F.array_sort(F.transform("spans", lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["kind"].alias("kind")))).alias("found"))
    return settled.unionByName(rest)


def masked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, masked, found: array<struct<start_pos, end_pos, kind>>) of every row; findings replaced by [EMAIL] and so on."""
    rows = _settled(df, id_col, text_col, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(2).to_pylist()
            new = [mask(t, [(x["start_pos"], x["end_pos"], x["kind"]) for x in f]) for t, f in zip(b.column(1).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), b.column(2)], names=["_id", "masked", "found"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, masked string, found {FOUND}").withColumnRenamed("_id", id_col)


def mask(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if not text or not found:
        return text
    out, at = [], 0
    for i, j, k in found:
        out += [text[at:i], f"[{k.upper()}]"]
        at = j
    return "".join([*out, text[at:]])


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind, start_pos): one row for each occurrence."""
    rows = _settled(df, id_col, text_col, False).select(F.col("_id").alias(id_col), F.explode("found").alias("f"))
    return rows.select(id_col, F.col("f.kind").alias("kind"), F.col("f.start_pos").alias("start_pos")).distinct()
