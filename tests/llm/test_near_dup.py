import random

import numpy as np
import pytest

from shelfwright.llm import near_dup, shingles

SCHEMA = "id string, text string, key string, sig string, f1 int, rep string, a int"


def rows(texts):
    return [(i, t, "x", "y", 1, "z", 2) for i, t in texts]


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed=1, groups=40):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = words(rng, rng.randrange(40, 120))
        for v in range(rng.choice([1, 1, 2, 3, 5])):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            if rng.random() < 0.2:
                half = len(w) // 2
                w = w[half:] + w[:half]
            out.append((f"id{g:03d}{v}", " ".join(w)))
    rng.shuffle(out)
    return out


def brute(texts, k, least, min_words):
    import re

    sets = {}
    for i, t in texts:
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", t or "")]
        if len(w) >= min_words and w:
            sets.setdefault(i, []).append(frozenset(zip(*[w[j:] for j in range(k)])) or frozenset([tuple(w)]))
    out = set()
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(len(p & q) >= least * len(p | q) for p in sets[i] for q in sets[j]):
                out.add((i, j))
    return out


def test_pairs_against_brute_force(spark):
    texts = corpus()
    got = {tuple(r) for r in near_dup.near_pairs(spark.createDataFrame(rows(texts), SCHEMA), "id", "text").collect()}
    want = brute(texts, 3, 0.6, 30)
    assert len(want) > 20 and not got - want
    assert len(want - got) <= 0.02 * len(want)


def test_words_and_shingles_as_defined():
    import pyarrow as pa

    texts = ["Aé_1 b-C", None, "", "x " * 5, "日本 one two three four", "a b"]
    (at, data, off), = shingles.chunks(pa.array(texts))
    h, tf, starts, n = shingles.bags(data, off, 3)
    assert at == 0 and list(n) == [4, 0, 0, 5, 4, 2]
    assert list(np.diff(starts)) == [2, 0, 0, 1, 2, 1]
    assert tf[starts[3]] == 3


def test_long_text_equals_short_chunks(spark):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(words(rng, 30_000)), "tiny text", " ".join(words(rng, 3))]
    whole = [shingles.bags(d, o, 5)[0] for _, d, o in shingles.chunks(pa.array(texts))]
    one = [shingles.bags(d, o, 5)[0] for t in texts for _, d, o in shingles.chunks(pa.array([t]))]
    assert np.array_equal(np.concatenate(whole), np.concatenate(one))


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    sample = near_dup.sampler(2000)
    h = rng.integers(1 << 43, size=60).astype(np.uint64)
    w = rng.uniform(0.5, 9, 60)
    w2 = np.where(rng.random(60) < 0.3, w * 1.7, w)
    a, b = sample(h[:50], np.log(w[:50]).astype(np.float32), np.array([0, 50])), sample(h[10:], np.log(w2[10:]).astype(np.float32), np.array([0, 50]))
    low = np.minimum(w[10:50], w2[10:50]).sum()
    high = w[:10].sum() + np.maximum(w[10:50], w2[10:50]).sum() + w2[50:].sum()
    assert abs((a == b).mean() - low / high) < 0.04


def test_edge_cases(spark):
    long = " ".join(words(random.Random(5), 50_000))
    base = " ".join(words(random.Random(6), 40))
    texts = [("n", None), ("e", ""), ("b", "  \n"), ("s", "one two"), ("t", "one two"), ("L1", long), ("L2", long + " tail"), (None, base), ("c1", base), ("c1", base), ("c2", base.upper()), ("d", "日本語")]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {tuple(r) for r in near_dup.near_pairs(df, "id", "text", k=3, jaccard=0.6, min_words=1).collect()}
    assert got == {("s", "t"), ("L1", "L2"), ("c1", "c2")}
    assert {tuple(r) for r in near_dup.near_pairs(df, "id", "text").collect()} == {("L1", "L2"), ("c1", "c2")}
    groups = {r.id: r.group_id for r in near_dup.near_groups(df, "id", "text").collect()}
    assert groups == {"s": "s", "t": "s", "L1": "L1", "L2": "L1", "c1": "c1", "c2": "c1"}
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_pairs(empty, "id", "text").collect() == [] and near_dup.near_groups(empty, "id", "text").collect() == []


@pytest.mark.parametrize("most", [4, 10, 100])
def test_buckets(spark, most):
    rng = random.Random(4)
    data = [(k, 100 * k + m) for k in range(30) for m in range(rng.choice([1, 2, 3, 7, 12]))]
    got = near_dup._buckets(spark.createDataFrame(data, "key long, member long"), most).collect()
    by = {}
    for k, m in data:
        by.setdefault(k, []).append(m)
    big = {k for k, v in by.items() if most and len(v) > most}
    assert {(r.a, r.b) for r in got if r.big} == {(k, m) for k in big for m in by[k]}
    assert sorted((r.a, r.b) for r in got if not r.big) == sorted((x, y) for k, v in by.items() if k not in big for i, x in enumerate(v) for y in v[i + 1 :])


def hot(n, others):
    """n near copies of one text, and other texts."""
    rng = random.Random(8)
    base = words(rng, 100)
    texts = []
    for v in range(n):
        w = base[:]
        for _ in range(4):
            w[rng.randrange(100)] = f"v{v}"
        texts.append((f"k{v:03d}", " ".join(w)))
    return texts + [(f"o{v:03d}", " ".join(words(rng, 60))) for v in range(others)]


@pytest.mark.parametrize("others", [0, 180])
def test_group_of_near_copies_that_is_a_large_share_of_all(spark, others, monkeypatch):
    """More near copies than a bucket holds, and as common as boilerplate: pairs are still found, in chunks."""
    monkeypatch.setattr(near_dup, "CHUNK", 40)
    texts = hot(near_dup.BUCKET + 26, others)
    got = {tuple(r) for r in near_dup.near_pairs(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()}
    want = brute(texts, 3, 0.6, 30)
    assert len(want) > 3000 and not got - want and len(want - got) <= 0.02 * len(want)


def test_pairs_of_a_family_of_one_percent(spark):
    """Shingles of a large family weigh less than the edits of each copy, but the plain Jaccard similarity counts."""
    rng = random.Random(3)
    base, family = words(rng, 100), []
    for v in range(25):
        w = base[:]
        for at in range(5 + v % 12, 100, 25):
            w[at] = f"own{v}x{at}"
        family.append((f"f{v:02d}", " ".join(w)))
    others = [(f"o{i:04d}", " ".join(words(rng, 40))) for i in range(2000)]
    got = {tuple(r) for r in near_dup.near_pairs(spark.createDataFrame(rows(family + others), SCHEMA), "id", "text").collect()}
    want = brute(family, 3, 0.6, 30)
    assert len(want) == 300 and not got - want
    assert len(want & got) >= 0.95 * len(want)


@pytest.mark.parametrize("hot_keys", [False, True])
def test_one_text_with_edits_in_a_third_of_the_rows(spark, hot_keys, monkeypatch):
    """Groups are linear: one row a record, whatever the size of the group; hot keys go to chunks without passing one task."""
    if hot_keys:
        monkeypatch.setattr(near_dup, "HOT", 8)
    monkeypatch.setattr(near_dup, "CHUNK", 64)
    rng = random.Random(9)
    base = words(rng, 300)
    texts = []
    for v in range(150):
        w = base[:]
        w[rng.randrange(300)] = f"v{v}"
        texts.append((f"k{v:03d}", " ".join(w)))
    texts += [(f"c{v:03d}", " ".join(base)) for v in range(150)]  # and exact copies
    texts += [(f"o{v:03d}", " ".join(words(rng, 60))) for v in range(600)]
    got = near_dup.near_groups(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()
    assert len(got) == 300 and {r.group_id for r in got} == {"c000"} and sum(r.class_rep == "c000" for r in got) == 150


def test_an_id_with_two_texts(spark):
    """The smallest id of both classes: its two texts are not taken for copies of each other."""
    rng = random.Random(12)
    a, b = words(rng, 50), words(rng, 50)
    texts = [("a", " ".join(a)), ("a", " ".join(b)), ("p", " ".join(a)), ("q", " ".join(b))]
    got = {tuple(r) for r in near_dup.near_pairs(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()}
    assert got == {("a", "p"), ("a", "q")}


def test_recall_of_groups(spark):
    """near_groups (five words, 0.8) against all pairs of a corpus compared by brute force, linked through others or directly."""
    texts = corpus(seed=21, groups=60)
    got = {r.id: r.group_id for r in near_dup.near_groups(spark.createDataFrame(rows(texts), SCHEMA), "id", "text").collect()}
    want = brute(texts, 5, 0.8, 1)
    assert len(want) > 20 and sum(got.get(i, 0) == got.get(j, 1) for i, j in want) >= 0.95 * len(want)
