import datetime as dt
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwright.llm import components, survivor

FILES = "seq long, id string, path string, size long, mtime double, type string, hash string, scan_id int, seen_at timestamp, record string, field string, best int"
T0 = dt.datetime(2024, 1, 1)
HEX = "ab" * 32


def md5(p):
    return hashlib.md5(p.encode()).hexdigest()


def run(spark, files, plans=(), scans=((1, "a", 1), (2, "b", 3), (3, "c", 3)), standings=True):
    f = spark.createDataFrame([(*r, "x", "y", 1) for r in files], FILES)
    s = spark.createDataFrame(list(scans), "scan_id int, tool string, trust int")
    p = spark.createDataFrame(list(plans), "plan_seq long, id string, path string, reason string, confidence double")
    return {r.id: tuple(r)[1:] for r in survivor.surviving_rows(f, s, p).collect()}, survivor.surviving_values(f, s, p, standings)


def test_rules_and_ties(spark):
    p, q = "vol/é.txt", "vol/b.txt"
    i, j = md5(p), md5(q)
    late = T0 + dt.timedelta(days=400)
    files = [
        (5, i, p, 1, 100.0, None, HEX, 1, T0),
        (3, i, p, 1, float("nan"), None, HEX.upper(), 2, late),
        (4, i, p, 1, 1e12, None, "zz", 3, late),
        (9, i, "./" + p, 1, -5.0, None, None, 3, T0),
        (2, i, p, 1, 100.0, None, HEX, 1, T0),
        (6, j, None, 1, None, None, None, 1, T0),
        (7, j, "other", 1, 0.0, None, HEX + "\n", 9, None),
        (8, md5("single"), "single", 1, 5.0, None, HEX, 1, T0),
        (10, None, p, 1, 5.0, None, HEX, 1, T0),
        (11, None, p, 1, 5.0, None, HEX, 1, T0),
    ]
    plans = [(1, i, None, "unknown", 0.9), (2, i, None, " N/A ", 1.0), (3, i, None, "same bytes", None), (4, i, None, "same text", 0.5), (5, i, None, "other", 0.5), (6, j, None, "?", 0.5), (7, None, None, "x", 1.0), (8, i, None, "nan", float("nan"))]
    got, values = run(spark, files, plans)
    assert got == {i: (3, 2, 3, 4), j: (0, 0, 0, 0)}
    rows = {r.id: r for r in values.collect()}
    assert rows[i].path == p and rows[i].mtime == 100.0 and rows[i].hash == HEX and rows[j].path is None


def test_truth_discovery_trusts_sources_that_agree(spark):
    """Two liars agree on nothing; one honest source that is right elsewhere wins a two-against-one vote where the two disagree."""
    files, seq = [], 0
    for k in range(30):
        p = f"f{k}"
        for scan, m in ((1, 1000.0 + k), (2, 1000.0 + k), (3, 5000.0 + 7 * k)):
            seq += 1
            files.append((seq, md5(p), p, 1, m, None, HEX, scan, T0))
    p = "last"
    files += [(900, md5(p), p, 1, 50.0, None, HEX, 1, T0), (901, md5(p), p, 1, 77.0, None, HEX, 3, T0)]
    _, values = run(spark, files, standings=False)
    assert {r.id: r.mtime for r in values.collect()}[md5(p)] == 50.0


def test_votes_overrule_preference_that_keeps_losing(spark):
    """Source 9 gives the latest times, against eight others that agree: their votes decide, also where only three of them speak.

    Source 1 gives the latest times against one other; nothing tells against it, and it keeps them.
    """
    files, seq = [], 0
    for k in range(40):
        p = f"f{k}"
        for scan in range(1, 10):
            seq += 1
            files.append((seq, md5(p), p, 1, 1000.0 + k if scan < 9 else 9000.0 + k, None, HEX, scan, T0))
    for k in range(40, 60):
        p = f"f{k}"
        files += [(seq + 1, md5(p), p, 1, 2000.0 + k, None, HEX, 1, T0), (seq + 2, md5(p), p, 1, 1000.0 + k, None, HEX, 2, T0)]
        seq += 2
    p = "few"
    files += [(seq + i, md5(p), p, 1, 500.0 if i < 4 else 900.0, None, HEX, i if i < 4 else 9, T0) for i in range(1, 5)]
    got, values = run(spark, files)
    rows = {r.id: r.mtime for r in values.collect()}
    assert all(rows[md5(f"f{k}")] == 1000.0 + k for k in range(40)) and rows[md5(p)] == 500.0
    assert all(rows[md5(f"f{k}")] == 2000.0 + k for k in range(40, 60))
    assert got[md5(p)][1] == seq + 1


def test_accuracy_on_the_smallest_tables(spark):
    """Values of the survivors against the rules of the task, worked out row by row."""
    sf = "/root/testdata/sf0.001"
    load = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    values = {r.id: r for r in survivor.surviving_values(load("files"), load("scans"), load("plan_deletes")).collect()}
    by = {}
    for r in load("files").collect():
        by.setdefault(r.id, []).append(r)
    right = total = 0
    for i, rows in by.items():
        if i is None or len(rows) < 2:
            continue
        times = [r.mtime for r in rows if r.mtime and r.mtime > 0 and r.mtime <= r.seen_at.replace(tzinfo=dt.UTC).timestamp()]
        hashes = [(r.seen_at, -r.seq, r.hash.lower()) for r in rows if r.hash and re.fullmatch("[0-9A-Fa-f]{64}", r.hash)]
        right += (values[i].mtime == max(times, default=None)) + (values[i].hash == (max(hashes)[2] if hashes else None))
        total += 2
    assert total > 50 and right >= 0.98 * total


def test_empty(spark):
    assert run(spark, [])[0] == {}


def groups(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def found(spark, edges, **more):
    return {r.id: r.group_id for r in components.connected(spark.createDataFrame(edges, "a string, b string"), **more).collect()}


def test_components_shapes(spark):
    rng = random.Random(2)
    star = [("hub", f"s{i:04d}") for i in range(400)]
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    shuffled = [f"x{rng.randrange(10**6)}" for _ in range(80)]
    odd = [(None, "n"), ("self", "self"), ("b", "a"), ("a", "b"), ("a", "b")]
    edges = star + chain + list(zip(shuffled, shuffled[1:])) + odd
    rng.shuffle(edges)
    assert found(spark, edges) == groups(edges)


def test_search_that_ends_early_is_contracted(spark):
    rng = random.Random(3)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    hub = [("c030", f"h{i}") for i in range(5)]
    other = [("z1", "z2"), ("z2", "z0")]
    edges = chain + hub + other
    rng.shuffle(edges)
    assert found(spark, edges, max_depth=3) == groups(edges)


def test_no_links(spark):
    assert found(spark, []) == {}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.integers(1, 30))
def test_components_at_random(spark, pairs, depth):
    edges = [(f"v{a}", f"v{b}") for a, b in pairs]
    assert found(spark, edges, max_depth=depth) == groups(edges)


def test_stars(spark):
    df = spark.createDataFrame([(["b", None, "a", "a", "c"], "x"), ([], "x"), (None, "x"), (["q", "q"], "x")], "ids array<string>, a string")
    assert {tuple(r) for r in components.star_links(df, "ids").collect()} == {("a", "b"), ("a", "c")}
