import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwright.functions import fingerprint as fpr
from shelfwright.functions import text as tx
from shelfwright.functions.json_recovery import EMPTY, largest_object, recover

FNV = {"": -3750763034362895579, "a": -5808556873153909620, "foobar": -8821353812377114648, "hello world": 8618312879776256743}
SIM = {
    "   ": -3750763034362895579,
    "日本語": -3750763034362895579,
    "Hello World": 8618312879776256743,
    "The quick BROWN": -8421630478583369269,
    "the quick brown fox": -37330637039862833,
    "the quick brown fox jumps over the lazy dog": 7998782212829606347,
    "Été déjà vu": -144291934723244609,
}


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("o")).first().o


def test_fnv_known_answers(spark):
    rows = spark.createDataFrame([(k,) for k in FNV], "s string").select("s", fpr.fnv1a("s").alias("h")).collect()
    assert {r.s: r.h for r in rows} == FNV


def test_simhash_known_answers(spark):
    df = spark.createDataFrame([(k,) for k in SIM] + [(None,)], "s string")
    assert {r.s: r.fp for r in fpr.with_simhash(df, "s").collect()} == SIM | {None: None}


def test_simhash_batches_agree_with_a_plain_model():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "d_1", "é"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["w " * 40_000]

    def plain(t):
        import re

        w = re.findall("[a-z0-9_]+", t.lower())
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
        votes = [0] * 64
        for s in sh:
            h = fpr.FNV_OFFSET
            for b in s.encode():
                h = (h ^ b) * fpr.FNV_PRIME % (1 << 64)
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        u = sum(1 << i for i in range(64) if votes[i] >= 0)
        return u - (1 << 64) if u >> 63 else u

    assert fpr.simhash_batch(texts).tolist() == [plain(t) for t in texts]


def test_phash_against_the_definition():
    rng = np.random.default_rng(4)
    px = rng.uniform(0, 255, (3, 32, 32))

    def naive(m):
        def dct(v):
            n = len(v)
            return [math.sqrt((1 if k == 0 else 2) / n) * sum(v[x] * math.cos(math.pi * (2 * x + 1) * k / (2 * n)) for x in range(n)) for k in range(8)]

        rows = [dct(r) for r in m]
        low = list(zip(*[dct(c) for c in zip(*rows)]))
        flat = [v for r in low for v in r][1:]
        mean = sum(flat) / 63
        u = 0
        for v in flat:
            u = u << 1 | (v > mean)
        u <<= 1
        return u - (1 << 64) if u >> 63 else u

    assert fpr.phash_batch(px).tolist() == [naive(m.tolist()) for m in px]


def test_phash_of_bad_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0]), (3, [5.0] * 1024)], "k int, p array<double>")
    got = {r.k: r.fp for r in fpr.with_phash(df, "p").collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


@pytest.mark.parametrize("path,name,parent,ext", [("a/b/c.TXT", "c.TXT", "b", "txt"), ("demo\\img\\x.bin", "x.bin", "img", "bin"), (".bashrc", ".bashrc", "", ""), ("a/..x.tar.gz", "..x.tar.gz", "a", "gz"), ("a/b/", "b", "a", ""), ("g~", "g~", "", ""), ("x.", "x.", "", "")])
def test_paths(spark, path, name, parent, ext):
    assert one(spark, path, tx.basename("v")) == name and one(spark, path, tx.parent("v")) == parent and one(spark, path, tx.suffix(tx.basename("v"))) == ext


@pytest.mark.parametrize("mime,want", [("image/png", "Images"), ("AUDIO/x", "Audio"), ("application/zip", "Documents"), ("font/woff", "Other"), (None, "Other"), ("", "Other")])
def test_bucket(spark, mime, want):
    assert one(spark, mime, tx.bucket("v")) == want


@pytest.mark.parametrize("label,want", [("!!", "cluster"), (" Ab  c_d ", "ab-c-d"), (None, "cluster"), ("All Documents", "all-documents"), ("é", "cluster")])
def test_slug(spark, label, want):
    assert one(spark, label, tx.slug("v")) == want


def test_age_boundaries(spark):
    now = 1e9
    rows = [(30.0, tx.AGES[1]), (29.999, tx.AGES[0]), (180.0, tx.AGES[2]), (-5.0, tx.AGES[0])]
    for days, want in rows:
        assert one(spark, now - days * 86400, tx.age_band("v", now), "double") == want
    assert one(spark, None, tx.age_band("v", now), "double") is None


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 * 1024**3, "5.0 GB"), (3 * 1024**5, "3.0 PB"), (2000 * 1024**5, "2000.0 PB")])
def test_human_bytes(spark, n, want):
    assert one(spark, n, tx.human_bytes("v"), "long") == want


def test_labels_tags_and_shingles(spark):
    assert tuple(one(spark, "Docs → A → b", tx.split_label("v", F.lit("x")))) == ("Docs", "A → b")
    assert tuple(one(spark, "Solo", tx.split_label("v", F.lit(None).cast("string")))) == ("Category", "Solo")
    assert one(spark, "x" * 41, tx.tidy_label("v")) == "x" * 37 + "…" and one(spark, "x" * 40, tx.tidy_label("v")) == "x" * 40
    assert one(spark, "<p a='1'>A\n <b>b</b></p>", tx.strip_tags("v")) == "A b"
    assert one(spark, "a b c d", tx.shingles(tx.words("v"))) == ["a b c", "b c d"]
    assert one(spark, "A b", tx.shingles(tx.words("v"))) == ["a b"] and one(spark, "é", tx.shingles(tx.words("v"))) == [""]


@pytest.mark.parametrize("url,want", [("http://h/", "http://h/v1/chat/completions"), ("http://h/v1", "http://h/v1/chat/completions"), ("http://h/v1/chat/completions/", "http://h/v1/chat/completions")])
def test_endpoint(url, want):
    assert tx.chat_endpoint(url) == want


@pytest.mark.parametrize(
    "text,want",
    [('{"a": 1}', '{"a": 1}'), ('So: {"a": {"b": "}"}} ok {"c": 1}', '{"a": {"b": "}"}}'), ('{"a":1} {"b":2}', '{"a":1}'), ('an "odd { quote', None), (r'{"a": "\"}"}', r'{"a": "\"}"}'), ("", None), (None, None)],
)
def test_largest_object(text, want):
    assert largest_object(text) == want


def test_recover():
    assert recover('x {"categories": []} y') == {"categories": []} and recover("none") == EMPTY and recover("[1]") == [1]
