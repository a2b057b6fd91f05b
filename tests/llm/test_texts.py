from collections import Counter

import numpy as np
import pytest

from shelfwright.llm import mojibake, pii

CLEAN = ["Die Größe der Übersicht ist größer als früher.", "La révision du café été déjà vérifiée, où est l’élément ?", "A relação não está na próxima seção.", "Просьба сохранить копию отчёта до окончания проверки хранилища.", "Zespół łączy się z grupą, część załączników.", "naïve façade résumé £5 — “ok” ±3 °C"] * 30


def words():
    counts, half = np.zeros(mojibake.WIDTH, np.int64), mojibake.WIDTH // 2
    for t in CLEAN:
        for x in mojibake.TOKEN.findall(t):
            for w in mojibake.WORD.findall(x):
                if not w.isascii():
                    w = w.lower()
                    for s in {w, *("\0" + w[i : i + 2] for i in range(len(w) - 1))}:
                        for p in mojibake.slots(s, half):
                            counts[p] += 1
        for m in mojibake.SIGN.finditer(t):
            for p in mojibake.slots("\1" + mojibake.between(t, *m.span()) + m.group(), half):
                counts[p] += 1
    return mojibake.Words(counts)


@pytest.fixture(scope="module")
def lm():
    return words()


@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp866", "cp1250"])
@pytest.mark.parametrize("text", CLEAN[:6])
def test_utf8_read_wrongly_is_restored(lm, text, reader):
    try:
        bad = text.encode().decode(reader)
    except UnicodeDecodeError:
        bad = "".join(chr(b) if reader == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(reader, "replace") for b in text.encode())
        if "�" in bad:
            pytest.skip("bytes are lost")
    got, spans = mojibake.restore(bad, lm)
    assert spans and got == text


def test_twice_wrong_is_restored(lm):
    text = CLEAN[0]
    assert mojibake.restore(text.encode().decode("latin-1").encode().decode("latin-1"), lm)[0] == text


@pytest.mark.parametrize("true,read,text", [("cp1251", "cp1252", CLEAN[3]), ("koi8_r", "cp1251", CLEAN[3]), ("cp1252", "cp1251", CLEAN[0]), ("cp1250", "cp1252", CLEAN[4])])
def test_single_byte_channels(lm, true, read, text):
    bad = "".join(c if c < "\x80" else bytes([c.encode(true)[0]]).decode(read, "replace") for c in text)
    got, spans = mojibake.restore(bad, lm)
    assert spans and ("�" in bad or got == text)


def test_lost_letters_are_filled_from_the_corpus(lm):
    got, spans = mojibake.restore("na�ve fa�ade, Gr��e, xq�zz", lm)
    assert spans and got == "naïve façade, Größe, xq�zz"


@pytest.mark.parametrize("bad,good", [("dÃ�jÃ\xa0 vÃ©rifiÃ©e", "déjà vérifiée"), ("GrÃ�ÃŸe", "Größe"), ("РџСЂРѕСЃСЊР�Р°", "Просьба")])
def test_lost_bytes_of_letters_are_restored(lm, bad, good):
    assert mojibake.restore(bad, lm)[0] == good


def test_several_kinds_of_damage_in_one_text(lm):
    """UTF-8 read as one encoding, Cyrillic read as another, and a lost letter."""
    wrong = lambda t: t.encode("cp1251").decode("cp1252")
    clean = "La révision déjà vérifiée. " + CLEAN[3] + " naïve façade"
    bad = "La rÃ©vision dÃ©jÃ\xa0 vÃ©rifiÃ©e. " + wrong(CLEAN[3]) + " na�ve façade"
    got, spans = mojibake.restore(bad, lm)
    assert got == clean
    assert {n for _, _, n in spans} >= {"utf_8 as cp1252", "cp1251 as cp1252", "lost"}
    places = [(i, j) for i, j, _ in spans]
    assert places == sorted(places) and all(j <= x for (_, j), (x, _) in zip(places, places[1:]))
    assert all(not bad[i:j].isascii() for i, j in places)


@pytest.mark.parametrize("join", [",", ";", "\xa0"])
def test_long_stretches_without_blanks(lm, join):
    """10,000 characters without a blank: still searched under the single-byte channels."""
    clean = join.join(["сохранить", "копию", "отчёта", "окончания", "проверки", "хранилища"] * 200)
    got, spans = mojibake.restore(clean.encode("koi8_r").decode("cp1251"), lm)
    assert spans and got == clean


def test_lost_letters_of_other_alphabets(lm):
    assert mojibake.restore("Просьба сохран�ть ко�ию", lm)[0] == "Просьба сохранить копию"


def test_lost_signs_are_those_of_the_corpus(lm):
    assert mojibake.restore("naïve â€�ok” ±3", lm)[0] in ("naïve “ok” ±3", "naïve ”ok” ±3")


def test_lone_lost_bytes(lm):
    assert mojibake.restore("at �5 or café �t� não �", lm)[0] == "at �5 or café été não —"  # £ and ± stand before digits equally often there


def test_runs_of_lost_characters_end(lm):
    import time

    began = time.time()
    text = "�" * 50_000 + " " + "a�" * 20_000 + " " + "ab�" * 3_000
    assert mojibake.restore(text, lm)[1] and time.time() - began < 60


@pytest.mark.parametrize("text", [None, "", " ", "plain", *CLEAN[:6], "╔══╗ ║17║ ╚══╝ ▒▒▒", "├── Папка\n│   └── größe.txt", "√45 ≈ 6,7 ± 0,2 µm; Ø 17 mm", "INFORMAÇÃO “MAÇÔ, AMANHÃ…", "caf&eacute; %C3%A9t%C3%A9", "日本語 🗂️ Ž Ş Đ Ł", "Það er í lagi", "«ВСЁ» — СЁСТРЫ…"])
def test_right_texts_stay(lm, text):
    assert mojibake.restore(text, lm) == (text, [])


def test_garbled_rows(spark):
    data = [(f"c{i}", t, 1) for i, t in enumerate(CLEAN)] + [("g", "La rÃ©vision", 1), ("g", "La rÃ©vision", 1), ("l", "fa�ade", 1), ("n", None, 1), ("e", "", 1), ("long", "wörter " * 30_000 + "MÃ¶ge", 1)]
    df = spark.createDataFrame(data, "id string, text string, restored int")
    assert {r.id for r in mojibake.found(df).collect()} == {"g", "l", "long"}
    rows = {r.id: r for r in mojibake.repaired(df, "id", "text").collect()}
    assert rows["g"].restored == "La révision" and rows["l"].restored == "façade" and rows["long"].restored.endswith("Möge")
    assert mojibake.found(df.limit(0)).collect() == []


# Personal information

MARKED = ["Name: Tabitha Stanshaw\n", "From: Clive Fernwick <c@x.example>", "Dr Silke Möhrenbrück said", "Name: Ramón Peñalvarón\n"] * 3


G = pii.known_words(Counter(w for t in MARKED for w in pii.counted(t)))


def kinds(text):
    return [(text[i:j], k) for i, j, k in pii.findings(text, G)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to tom.o+x@mail.example.org or ring (225) 555-0188.", [("tom.o+x@mail.example.org", "email"), ("(225) 555-0188", "phone")]),
        ("ines [at] records [dot] tarn [dot] test; mailto:a@b.example", [("ines [at] records [dot] tarn [dot] test", "email"), ("a@b.example", "email")]),
        ("m_k(at)halden.test", [("m_k(at)halden.test", "email")]),
        ("Tel. +49\xa0(0)30\xa023125\xa0854, call 07700 900690", [("+49\xa0(0)30\xa023125\xa0854", "phone"), ("07700 900690", "phone")]),
        ("call zero seven seven zero zero nine zero zero six nine zero", [("zero seven seven zero zero nine zero zero six nine zero", "phone")]),
        ("Her social security number, 963-24-0867, is printed", [("963-24-0867", "id_number")]),
        ("Seine Steuer-ID 29 711 689 014 steht auf Seite 37", [("29 711 689 014", "id_number")]),
        ("Su DNI, 05.382.024-R, aparece", [("05.382.024-R", "id_number")]),
        ("lives at Flat 3, 101 Tanner's Row, Easterlow", [("Flat 3, 101 Tanner's Row", "address")]),
        ("Anschrift Am Alten Speicher 110, 80384 Hohlstadt", [("Am Alten Speicher 110", "address")]),
        ("habite 126 bis, place aux Grains.", [("126 bis, place aux Grains", "address")]),
        ("vive en Calle del Molino, 138, 6º B. Antes", [("Calle del Molino, 138", "address")]),
        ("According to Tabitha Stanshaw, it is.", [("Tabitha Stanshaw", "name")]),
        ("Ask Clive O'Fernwick-Penlow first", [("Clive O'Fernwick-Penlow", "name")]),
        ("Don Peñalvarón, Ramón firmó; Frau M. Stanshaw wohnt", [("Peñalvarón, Ramón", "name"), ("M. Stanshaw", "name")]),
        ("Mr TABITHA STANSHAW Only", [("TABITHA STANSHAW", "name")]),
        ("Тabitha Stanshaw", [("Тabitha Stanshaw", "name")]),
    ],
)
def test_found(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text",
    ["", None, "Install kel@2.0.122 and ssh deploy@build-53, @lunel", "Build 2.14.555.013 replaced part no. 441-20-5121", "Asset tag 949-44-70; ticket 030-13-3 into INV-2024-007-118", "size 870055516 bytes, wrote 1401234567 bytes at 2024-05-07T03:12:55.010",
     "The Mill Road invoice (edition 12), Larkspur Street dataset", "2019-09-21 08:44 The Mill Road extract", "Blue Heron Project and Copper Lantern Plan", "Am Montag 12 Dateien", "md5 49cf578940353848e018a6c63f52e30b 0xDEADBEEF 1234567890123456789"],
)
def test_not_found(text):
    assert pii.findings(text, G) == []


def test_rows_are_masked_and_the_rest_is_kept(spark):
    text = "é 🙂 Name: Tabitha Stanshaw, tel +1-745-555-0144.\n"
    data = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 100_000 + "a@b.example", "x"), (1, text, "x")] + [(100 + i, t, "x") for i, t in enumerate(MARKED)]
    df = spark.createDataFrame(data, "doc_id long, text string, found string")
    got = {r.doc_id: r.masked for r in pii.masked(df, "doc_id", "text").collect()}
    assert got[1] == "é 🙂 Name: [NAME], tel [PHONE].\n" and got[2] is None and got[3] == "" and got[4].endswith("word [EMAIL]")
    rows = {tuple(r) for r in pii.found(df).collect() if r.doc_id < 100}
    assert rows == {(1, "name", 10), (1, "phone", text.index("+1")), (4, "email", 500_000)}
    assert pii.found(df.limit(0)).collect() == []


def test_native_forms_miss_nothing():
    """Wherever a detector finds something, so does its native expression; both ways of looking agree."""
    texts = [t for t in [*MARKED, "Tel. +49 (0)30 23125 854, call 07700 900690", "DNI 05.382.024-R; lives at Flat 3, 101 Tanner's Row", "m_k(at)halden.test, tom at mail dot test", "Am Alten Speicher 110; 126 bis, place aux Grains", "en Calle del Molino, 138 ١٢٣٤٥٦٧٨٩", "ring zero seven seven zero zero nine zero zero six nine zero", "Steuer-ID 29 711 689 014", "Ｔｅｌ ０７７００ ９００６９０", "", None]]
    for t, x in zip(texts, pii.looks(texts)):
        assert (x is None and not t) or (x.spans, x.candidates, x.names) == ((y := pii.look(pii.plain(t))).spans, y.candidates, y.names)


def test_two_letter_family_names():
    assert kinds("Name: Tabitha Li wrote; Mr J. Ng too") == [("Tabitha Li", "name"), ("J. Ng", "name")]
