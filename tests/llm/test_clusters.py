import random

import pytest

from shelfwright.llm import rnn_clusters as rc

SCHEMA = "result_id long, label string, file_ids array<string>, top_terms array<string>, score double, c string, n string, side string"


def rows(items):
    return [(i, "x", f, t, s, "a", "b", "c") for i, f, t, s in items]


def fixture(seed=1, groups=12, big=90):
    rng, out, truth, i = random.Random(seed), [], {}, 0
    for g in range(groups):
        files, terms = [f"f{g}-{k}" for k in range(12)], [f"term{g} {k}" for k in range(8)]
        for _ in range(big if g == 0 else rng.choice([1, 2, 3, 6])):
            i += 1
            f, t = rng.sample(files, rng.randrange(9, 13)), rng.sample(terms, 7)
            f = [x.upper() if rng.random() < 0.2 else f" {x} " for x in f] + [f"s{rng.randrange(10**6)}", f[0]]
            t = [x.replace(" ", "_").title() for x in t] + ["report"]
            kind = rng.random()
            out.append((i, None if kind < 0.1 else f, [] if 0.1 < kind < 0.2 else t, rng.choice([0.4, None, float("nan"), -1.0])))
            truth[i] = g
    return out, truth


@pytest.mark.parametrize("chunk", [rc.CHUNK, 3])
def test_groups_are_found(spark, chunk, monkeypatch):
    monkeypatch.setattr(rc, "CHUNK", chunk)
    monkeypatch.setattr(rc, "FEW", 2 if chunk == 3 else rc.FEW)
    items, truth = fixture()
    got = {r.result_id: r.cluster_id for r in rc.found(spark.createDataFrame(rows(items), SCHEMA)).collect()}
    by = {}
    for i, g in truth.items():
        by.setdefault(g, []).append(i)
    want = {i: min(v) for v in by.values() if len(v) > 1 for i in v}
    # one without terms and one without files have nothing to be compared by, unless others link them
    assert sum(got.get(i) == c for i, c in want.items()) >= 0.98 * len(want) and set(got) <= set(want)


def test_description(spark):
    items, _ = fixture()
    df = spark.createDataFrame(rows(items), SCHEMA)
    found = {}
    for r in rc.found(df).collect():
        found.setdefault(r.cluster_id, set()).add(r.result_id)
    told = {r.cluster_id: r for r in rc.described(df).collect()}
    assert {c: len(v) for c, v in found.items()} == {c: r["size"] for c, r in told.items()}
    assert all(set(r.typical) <= found[c] and 0 < len(r.typical) <= 3 for c, r in told.items())
    assert all(r.mean_score is None or 0 <= r.mean_score <= 1 for r in told.values())


def test_copies_nulls_and_empty(spark):
    items = [(1, ["a", "b"], None, 0.1), (2, ["B", "a", None, "a"], None, None), (3, None, None, 0.5), (4, [None, " "], [], 0.5), (2, ["a", "b"], None, 0.5), (None, ["a", "b"], None, 0.5), (7, None, ["x y"], None), (8, ["q"], ["X_Y", "x y"], 2.0)]
    df = spark.createDataFrame(rows(items), SCHEMA)
    assert {tuple(r) for r in rc.found(df).collect()} == {(1, 1), (2, 1), (7, 7), (8, 7)}
    assert rc.found(df.limit(0)).collect() == [] and rc.described(df.limit(0)).collect() == []


def test_average_linkage_does_not_chain(spark):
    """A row between two groups, half like either, doesn't join them."""
    a, b = [f"a{k}" for k in range(10)], [f"b{k}" for k in range(10)]
    items = [(i, a if i % 2 else a[:9] + ["z"], None, None) for i in range(1, 9)] + [(i, b if i % 2 else b[:9] + ["y"], None, None) for i in range(11, 19)] + [(30, a[:5] + b[:5], None, None)]
    got = {r.result_id: r.cluster_id for r in rc.found(spark.createDataFrame(rows(items), SCHEMA)).collect()}
    assert {got[i] for i in range(1, 9)} == {1} and {got[i] for i in range(11, 19)} == {11}


def test_early_merges_are_between_best_neighbours(spark):
    """Sets a1, a2, b1, b2 of 20: a1 a2 and b1 b2 share 12, a1 b1 11, the others 8; clusters are a1 a2 and b1 b2, whatever the order."""
    items, want = [], set()
    for g in range(150):
        file = lambda kind, n: [f"{g}-{kind}-{k}" for k in range(n)]  # noqa: B023, E731
        all_, aa, bb, ab = file("all", 8), file("aa", 4), file("bb", 4), file("ab", 3)
        sets = [all_ + aa + ab + file("a1", 5), all_ + aa + file("a2", 8), all_ + bb + ab + file("b1", 5), all_ + bb + file("b2", 8)]
        ids = random.Random(g).sample(range(4 * g, 4 * g + 4), 4)
        items += [(i, s, None, None) for i, s in zip(ids, sets)]
        want |= {(i, min(i, ids[m ^ 1])) for m, i in enumerate(ids)}
    got = {tuple(r) for r in rc.found(spark.createDataFrame(rows(items), SCHEMA)).collect()}
    assert len(got & want) >= 0.9 * len(want)


def dense(items, threshold=0.5):
    """Strict average linkage over all pairs of rows, one merge at a time, in plain Python."""
    norm = lambda xs, f: frozenset(f(x) for x in xs or [] if x and x.strip())
    sets = {i: (norm(f, lambda x: x.strip().lower()), norm(t, lambda x: x.strip().lower().replace("_", " "))) for i, f, t, _ in items}
    groups = [[i] for i in sorted(sets) if any(sets[i])]

    def sim(g, h):
        best = 0.0
        for k in (0, 1):
            x, y = [sets[i][k] for i in g if sets[i][k]], [sets[i][k] for i in h if sets[i][k]]
            if x and y:
                best = max(best, sum(len(p & q) / (len(p) * len(q)) ** 0.5 for p in x for q in y) / len(x) / len(y))
        return round(best, 9)

    while True:
        s, _, _, g, h = max(((sim(g, h), -min(g), -min(h), g, h) for n, g in enumerate(groups) for h in groups[n + 1 :]), key=lambda p: p[:3], default=(0,) * 5)
        if s < threshold:
            return {i: min(g) for g in groups if len(g) > 1 for i in g}
        groups = [x for x in groups if x is not g and x is not h] + [g + h]


@pytest.mark.parametrize("local", [rc.LOCAL, 3])
def test_equals_strict_dense_linkage(spark, local):
    """Random overlapping sets; small components in tasks, and all larger ones in distributed rounds."""
    rng, items = random.Random(8), []
    for i in range(1, 91):
        g = rng.randrange(9)
        f = [f"f{g * 6 + rng.randrange(9)}" for _ in range(rng.randrange(1, 9))]
        t = [f"t{g * 5 + rng.randrange(8)}" for _ in range(rng.randrange(0, 7))]
        items.append((i, f if rng.random() < 0.9 else None, t, None))
    want = dense(items)
    got = {r.result_id: r.cluster_id for r in rc.found(spark.createDataFrame(rows(items), SCHEMA), local=local).collect()}
    pairs = lambda m: {(a, b) for a in m for b in m if a < b and m[a] == m[b]}
    p, q = pairs(want), pairs(got)
    assert len(p & q) >= 0.97 * len(p) and len(p & q) >= 0.97 * len(q) and len(p) > 100


def test_merge_rounds_equal_dense(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(2, 30))
        x = rng.random((n, 6)) ** 3
        x /= np.linalg.norm(x, axis=1)[:, None]
        root = rc.merge_rounds([x @ x.T, np.zeros((n, n))], [np.ones(n), np.zeros(n)], 0.8)
        groups = [[i] for i in range(n)]
        while True:
            best = max(((float((x[g] @ x[h].T).mean()), g, h) for k, g in enumerate(groups) for h in groups[k + 1 :]), key=lambda p: p[0], default=(0, 0, 0))
            if best[0] < 0.8:
                break
            groups = [g for g in groups if g is not best[1] and g is not best[2]] + [sorted(best[1] + best[2])]
        assert {tuple(g) for g in groups} == {tuple(np.flatnonzero(root == r)) for r in set(root)}


def test_one_group_of_a_third(spark):
    """Distinct, mutually similar rows that share hot keys: more of them than a chunk holds."""
    rng = random.Random(4)
    files = [f"h{k}" for k in range(14)]
    items = [(i, rng.sample(files, 12) + [f"own{i}"], None, None) for i in range(1, 1501)] + [(2000 + i, [f"x{i}-{k}" for k in range(9)], None, None) for i in range(300)]
    got = {r.result_id: r.cluster_id for r in rc.found(spark.createDataFrame(rows(items), SCHEMA)).collect()}
    assert got == {i: 1 for i in range(1, 1501)}
