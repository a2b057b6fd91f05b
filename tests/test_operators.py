import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwright.functions import text as tx
from shelfwright.operators import autocat, categorize, clusters, graph, leader, plan, rounds, summarize, views
from shelfwright.plans import pipeline, queries
from shelfwright.plans.pipeline import organize, write_documents
from shelfwright.schema import FILES
from shelfwright.tables import numbered

NOW = 1_700_000_000.0


def sequential(items, t):
    """Greedy leader clustering by the book: [(seq, id, fp)] in order."""
    done, out = set(), []
    for i, (s, a, x) in enumerate(items):
        if s in done:
            continue
        group = [(s, a)]
        done.add(s)
        for s2, b, y in items[i + 1 :]:
            if s2 not in done and bin((x ^ y) & (1 << 64) - 1).count("1") <= t:
                group.append((s2, b))
                done.add(s2)
        if len(group) > 1:
            out.append(group)
    return out


def led(spark, items, t):
    rows = leader.leader_clusters(spark.createDataFrame(items, "seq long, id string, fp long"), t).orderBy("cluster_idx", "seq").collect()
    out = {}
    for r in rows:
        out.setdefault(r.cluster_idx, []).append((r.seq, r.id))
    return [out[k] for k in sorted(out)]


def test_leader_is_not_transitive(spark):
    assert led(spark, [(1, "a", 0), (2, "b", 0xFF), (3, "c", 0xFFFF)], 8) == [[(1, "a"), (2, "b")]]
    assert led(spark, [(1, "a", 0xFF), (2, "b", 0), (3, "c", 0xFFFF)], 8) == [[(1, "a"), (2, "b"), (3, "c")]]
    assert led(spark, [(1, "a", None), (2, "b", 5)], 8) == [] and led(spark, [], 8) == []


@pytest.mark.parametrize("t,seed", [(8, 1), (12, 2), (8, 3)])
def test_leader_against_the_sequential_model(spark, t, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    items = []
    for s in range(90):
        x = rng.choice(centres)
        for _ in range(rng.randrange(0, t)):
            x ^= 1 << rng.randrange(64)
        items.append((s * 3, f"f{s}", x - (1 << 64) if x >> 63 else x))
    shuffled = items[:]
    rng.shuffle(shuffled)
    assert led(spark, shuffled, t) == sequential(items, t)


@pytest.mark.parametrize("m", [2, 3])
def test_hamming_blocks_lose_no_pair(spark, m, monkeypatch):
    monkeypatch.setattr(leader, "BLOCKS", (m,))
    rng = random.Random(m)
    base = [rng.getrandbits(63) for _ in range(12)]
    words = {b ^ sum(1 << p for p in rng.sample(range(63), rng.randrange(0, 10))) for b in base for _ in range(8)}
    got = {(r.fp_a, r.fp_b, r.distance) for r in leader.hamming_pairs(spark.createDataFrame([(w,) for w in words], "fp long"), 8).collect()}
    assert got == {(a, b, bin(a ^ b).count("1")) for a in words for b in words if a < b and bin(a ^ b).count("1") <= 8}


@pytest.mark.parametrize("t,m,d", [(8, 2, 1), (8, 3, 3), (12, 2, 1)])
def test_hamming_words_travel_by_few_blocks(spark, t, m, d, monkeypatch):
    """Each pair once, wherever its words are sent, and far fewer rows sent than there are keys."""
    monkeypatch.setattr(leader, "BLOCKS", (m,))
    monkeypatch.setattr(leader, "ALONE", 10)
    monkeypatch.setattr(leader, "AT_ONCE", 50)
    monkeypatch.setattr(leader, "TOGETHER", 100 if d == 1 else 1)
    assert len(leader.choices(t, m, 1)) == t + 1 and len(leader.choices(t, m, m)) == math.comb(t + m, m)
    rng = random.Random(t + m)
    base = [rng.getrandbits(64) for _ in range(12)]
    words = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, t + 2))) for b in base for _ in range(8)}
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    got = leader.hamming_pairs(spark.createDataFrame([(w,) for w in words], "fp long"), t)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    count = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert sorted((r.fp_a, r.fp_b, r.distance) for r in got.collect()) == sorted((a, b, count(a, b)) for a in words for b in words if a < b and count(a, b) <= t)


def small_files_on_the_driver(df):
    """Broadcasts in df's plan that are chosen by the size of files alone: no shuffle below tells how large they are in memory."""
    plan_ = df._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    found = []
    for i, x in enumerate(plan_):
        if "BroadcastExchange" in x:
            below = list(itertools.takewhile(lambda y, d=deep(x): deep(y) > d, plan_[i + 1 :]))
            if any("FileScan" in y for y in below) and not any("Exchange" in y for y in below):
                found.append(below)
    return found


def plans_of(monkeypatch, module):
    """The tables that module cuts from now on, as they are before they are written."""
    seen, cut_ = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, *a: seen.append(df) or cut_(df, *a))
    return seen


def test_leader_clusters_broadcast_nothing_by_file_size(spark, monkeypatch):
    seen = plans_of(monkeypatch, leader)
    items = [(s, f"f{s}", x) for s, x in enumerate([0, 1, 3, 0xFF << 20, 0xFF << 21, 7 << 40, 7 << 40, 0x1FFFF << 3])]
    out = leader.leader_clusters(spark.createDataFrame(items, "seq long, id string, fp long"), 8)
    assert out.count() == 7 and len(seen) > 4
    assert [x for df in [*seen, out] for x in small_files_on_the_driver(df)] == []


def test_near_texts_send_fingerprints_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pipeline.leader, "leader_clusters", lambda items, t: seen.append(items) or items)
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, id string")
    pipeline.near_texts(f, spark.createDataFrame([("a", "one two three four"), ("b", ""), ("x", "no such file")], "id string, text string"))
    assert [(r.seq, r.id) for r in seen[0].collect()] == [(1, "a")] and "ArrowEvalPython" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_moves_need_no_near_duplicates(spark, monkeypatch):
    def never(*_):
        raise AssertionError("moves don't depend on them")

    monkeypatch.setattr(queries, "near", never)
    monkeypatch.setattr(queries.leader, "leader_clusters", never)
    assert queries.planned_moves(spark, "/root/testdata/sf0.001").columns == ["id", "from_path", "to_dir", "reason"]


@pytest.mark.parametrize("name", ["planned_deletes", "node_inspector", "graph_edges", "node_record", "graph_nodes", "plan_summary"])
def test_queries_broadcast_nothing_of_near_duplicates_by_file_size(spark, name, monkeypatch):
    monkeypatch.setattr(queries, "_NEAR", {})  # searched anew
    seen = plans_of(monkeypatch, leader)
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.columns and len(seen) > 4
    assert [x for df in seen for x in small_files_on_the_driver(df)] == []


def data_on_the_driver(df):
    """Broadcasts in df's plan other than of rows that are made by hand, of one row, or of one row an age band (a)."""
    plan_ = df._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    found = []
    for i, x in enumerate(plan_):
        if "BroadcastExchange" in x:
            below = list(itertools.takewhile(lambda y, d=deep(x): deep(y) > d, plan_[i + 1 :]))
            if not any(s in y for y in below for s in ("keys=[]", "output=[a#", "ExistingRDD", "LocalTableScan")):
                found.append(below)
    return found


@pytest.mark.parametrize("name", ["node_inspector", "graph_edges", "graph_nodes", "node_record", "plan_summary"])
def test_queries_broadcast_no_data_whatever_its_size(spark, name, monkeypatch):
    seen = plans_of(monkeypatch, queries)  # all tables here are under Spark's threshold
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [x for df in [*seen, out] for x in data_on_the_driver(df)] == []


def test_graph_edges_search_near_duplicates_without_data_on_the_driver(spark, monkeypatch):
    monkeypatch.setattr(queries, "_NEAR", {})  # searched anew
    seen = plans_of(monkeypatch, leader)
    out = queries.graph_edges(spark, "/root/testdata/sf0.001")
    assert len(seen) > 4 and [x for df in [*seen, out] for x in data_on_the_driver(df)] == []


def test_viewer_edges_are_made_once(spark, monkeypatch):
    made = plans_of(monkeypatch, queries)
    sf = "/root/testdata/sf0.001"
    out = queries.viewer_edges(spark, sf)
    read = {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in out.inputFiles()}
    assert read == {"catalogue", "edges"} and len(made) >= 2


def test_numbered(spark):
    rows = numbered(spark.range(5000).select((F.col("id") * 7 % 5003).alias("k")), "k").collect()
    assert sorted((r.k, r.idx) for r in rows) == [(k, i) for i, k in enumerate(sorted(r.k for r in rows))]
    assert numbered(spark.range(0).toDF("k"), "k").collect() == []


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


ROWS = [
    (1, "a", "d/a.txt", 10, NOW, "text/plain", "h1"),
    (2, "b", "d/b.tmp", 10, NOW - 40 * 86400, "text/plain", "h1"),
    (3, "c", "d/c.png", 20, NOW - 400 * 86400, "image/png", None),
    (4, "e", "d/e~", 0, None, None, "h2"),
    (5, "f", "d/f.mp3", 7, NOW, "audio/mpeg", "h1"),
]


def test_clusters(spark):
    f = files(spark, [*ROWS, (0, "a", "old", 1, NOW, None, None)])
    now = clusters.current(f)
    assert now.count() == 5 and now.where("id = 'a'").first().path == "d/a.txt"
    dup = {r.id: (r.n, r.is_first) for r in clusters.exact_duplicates(now).collect()}
    assert dup == {"a": (3, True), "b": (3, False), "f": (3, False)}
    assert {r.age: r.n for r in clusters.age_clusters(now, NOW).collect()} == {tx.AGES[0]: 2, tx.AGES[1]: 1, tx.AGES[2]: 1}
    assert {r.age: r.n for r in clusters.age_clusters(now.limit(0), NOW).collect()} == dict.fromkeys(tx.AGES, 0)
    assert {r.bucket: r.n for r in clusters.type_clusters(now).collect()} == {"Documents": 2, "Images": 1, "Other": 1, "Audio": 1}
    ext = now.select(F.lit(1).alias("k"), tx.suffix(tx.basename("path")).alias("ext"), "seq")
    assert clusters.dominant_extension(ext, "k").first().ext == "txt"


def test_summaries(spark):
    f = files(spark, ROWS)
    members = spark.createDataFrame([("n", 1, "a"), ("n", 2, "b"), ("n", 3, "c"), ("n", 9, "gone"), ("m", 4, "e")], "node_id string, seq long, id string")
    texts = spark.createDataFrame([("a", " \n "), ("b", "  two\nlines "), ("c", "x" * 500), ("e", "é" * 1000)], "id string, text string")
    got = {r.node_id: r.summary for r in summarize.summaries(members, f, texts).collect()}
    assert got["n"] == "Files: 4, Total bytes: 40 | Snippet[b]: two lines | Snippet[c]: " + "x" * 160
    assert got["m"] == "Files: 1, Total bytes: 0 | Snippet[e]: " + "é" * 160


def test_fifty_edges_but_all_duplicates(spark):
    f = files(spark, [(i, f"i{i:03d}", f"p/{i}.txt", 1, NOW, "text/plain", "same") for i in range(51)])
    cats = categorize.fallback(f)
    near = spark.createDataFrame([], "cluster_idx long, seq long, id string, leader_seq long, n long")
    e = graph.edges(graph.membership(f, cats, near, NOW), cats)
    count = {r.source: r["count"] for r in e.groupBy("source").count().collect()}
    assert count["dup:same"] == 51 and count["type:Documents"] == 50 and count["sub:Documents:All Documents"] == 50 and count["root"] == 6
    assert count["age:" + tx.AGES[0]] == 50


def test_model_categories(spark):
    def answer(*cats):  # inside, since workers can't import test modules
        import json

        return json.dumps({"categories": [dict(zip(("label", "file_ids", "rationale", "confidence"), c)) for c in cats]})

    f = files(spark, [(i, f"i{i:03d}", f"p/{i}.txt", 1, NOW, "text/plain", None) for i in range(450)] + [(900, "pic", "x.png", 1, NOW, "image/png", None), (901, "pic2", "y.png", 1, NOW, "image/png", None)])
    texts = spark.createDataFrame([], "id string, text string")

    def chat(bucket, rows):
        if bucket == "Images":
            raise OSError("no server")
        first = rows[0]["id"]
        if first == "i000":
            return "Sure! " + answer(("Letters", ["i000", "i001", "nobody"], "first", 0.5), ("Bills", ["i001", "i002"], "b", 0.5), ("L" * 90, ["i003"], "l", 0.2))
        return answer(("LETTERS ", ["i400", "i000"], "better", 0.9))

    cats, notes = categorize.discovered(f, texts, chat, wait=0.0)
    by = {}
    for r in cats.collect():
        by.setdefault((r.bucket, r.label), set()).add(r.id)
    assert by["Documents", "Letters"] == {"i000", "i001", "i400"} and by["Documents", "Bills"] == {"i002"} and by["Documents", "L" * 80] == {"i003"}
    assert len(by["Documents", "Uncategorized"]) == 450 - 5 and by["Images", "Uncategorized"] == {"pic", "pic2"}
    told = {r.node_id: r.summary for r in notes.collect()}
    assert told["sub:Documents:Letters"] == "better (conf 0.5)" and told["sub:Images:Uncategorized"].startswith("LLM discovery failed: no server")


def test_null_confidence_fails_its_bucket(spark):
    items = spark.createDataFrame([("B", 0, '{"categories": [{"label": "x", "file_ids": ["1"], "confidence": null}]}', None), ("C", 0, '{"categories": [{"file_ids": ["1"]}]}', None), ("D", 0, "[]", None)], "bucket string, batch int, answer string, error string")
    got = {r.bucket: r for r in categorize.parsed(items).collect()}
    assert got["B"].error and got["C"].confidence == 0.5 and got["C"].label == "Cluster" and got["D"].error


def test_failed_calls_are_repeated(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp()

    def chat(bucket, rows):
        n = len(os.listdir(d))
        open(f"{d}/{n}", "w").close()
        if n < 2:
            raise OSError("again")
        return '{"categories": []}'

    f = files(spark, ROWS[:1])
    got = categorize.ask(categorize.inventory(f, spark.createDataFrame([], "id string, text string")), chat, wait=0.0).collect()
    assert len(os.listdir(d)) == 3 and got[0].error is None


def test_request(spark):
    body = categorize.request_body("m", "Images", [{"id": "1", "name": "n", "pos": 3}])
    assert body["model"] == "m" and body["max_tokens"] == 1800 and "pos" not in body["messages"][1]["content"]


def test_plan_and_views(spark):
    f = files(spark, ROWS)
    near = spark.createDataFrame([(0, 1, "a", 1, 2), (0, 2, "b", 1, 2)], "cluster_idx long, seq long, id string, leader_seq long, n long")
    de = plan.deletes(f, near, near)
    assert sorted((r.branch, r.id, r.reason) for r in de.collect()) == [(0, "b", "exact_duplicate"), (0, "f", "exact_duplicate"), (1, "b", "near_duplicate_text:0"), (2, "b", "near_duplicate_image:0"), (3, "b", "temp_suffix"), (3, "e", "temp_suffix")]
    mv = plan.moves(f, categorize.fallback(f))
    assert {r.id: r.to_dir for r in mv.collect()}["c"] == "Images/all-images/"
    s = plan.summary(f, de, mv, near, near, 0.5).first()
    assert (s.files_scanned, s.duplicate_clusters, s.near_duplicate_clusters, s.image_similarity_clusters, s.suggested_deletions, s.suggested_moves) == (5, 1, 1, 1, 6, 5)
    assert categorize.costs(categorize.fallback(f), 0.0).count() == 0
    assert tuple(views.total_cost(categorize.costs(categorize.fallback(f), 0.0), 0.0).first()) == (0.0, 0.0)
    log = plan.audit(mv.union(spark.createDataFrame([("z", None, "q/", "r")], mv.schema)), de.drop("branch"), f.where("id <> 'c'"), "/r", "/q")
    status = {(r.op, r.src): (r.status, r.dst) for r in log.collect()}
    assert status["move", "d/a.txt"] == ("dry_run", "/r/Documents/all-documents/a.txt") and status["move", "d/c.png"][0] == "skip_not_found" and status["move", ""] == ("skip_not_found", None)
    hits = spark.createDataFrame([("k", x) for x in "ab"] + [("l", x) for x in "abcxy"] + [("m", "c"), ("o", None)], "node_id string, id string")
    assert {r.node_id: r.status for r in views.junk_status(hits, spark.createDataFrame([("a",), ("a",)], "id string")).collect()} == {"k": "JUNK", "l": "REVIEW", "m": "NOT JUNK", "o": "NOT JUNK"}


def test_viewer(spark):
    n = spark.createDataFrame([(1, "r", "root", "Root", None), (2, "f1", "file", "A.txt", 0.4), (3, "f2", "strange", "b", 0.9), (4, "d", "duplicate_cluster", "Dup", 0.95)], "o int, id string, kind string, label string, c double")
    e = spark.createDataFrame([("r", "d", 0), ("d", "f1", 7), ("d", "gone", 1), ("d", "f0", 9)], "source string, target string, ord long")
    assert {r.id for r in views.filter_nodes(n, "c", min_confidence=0.5).collect()} == {"r", "f2", "d"}
    assert {r.id for r in views.filter_nodes(n, "c", "file", search=".TXT").collect()} == {"f1"}
    assert views.visible_edges(e, n).count() == 0 and views.visible_edges(e, n, "all").count() == 2
    assert views.visible_edges(e, n, "selected", "f1").count() == 1 and views.visible_edges(e, n, "selected").count() == 0
    assert {r.id: (r.x, r.y) for r in views.layout(n, "o").collect()} == {"r": (40, 40), "d": (40, 680), "f1": (40, 1160), "f2": (324, 1160)}
    more = n.union(spark.createDataFrame([(5, "f0", "file", "0.txt", 0.4)], n.schema))
    assert {(r.source, r.pos, r.id) for r in views.linked_files(e, more).collect()} == {("d", 1, "f1"), ("d", 2, "f0")}  # in the order of the edges
    assert {(r.pos, r.id) for r in views.linked_files(e, more, 1).collect()} == {(1, "f1")}


def test_inspection(spark):
    n = spark.createDataFrame([("d", "duplicate_cluster", "Dup", 0.95, "two", "why", "h", 3), ("f", "file", "a", 1.0, None, "", None, None), ("g", "age_bucket", "Age", 0.6, "", None, None, 0)], "id string, kind string, label string, confidence double, summary string, rationale string, hash string, n_files long")
    m = spark.createDataFrame([("d", "f"), ("d", "f"), ("d", "x")], "node_id string, id string")
    e = spark.createDataFrame([("d", "f", 2), ("d", "x", 1)], "source string, target string, ord long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.id: tuple(r)[4:] for r in views.inspect(n, m, e, ids("x", "x"), ids("f", None)).collect()}
    assert got == {"d": ("two", "why", "h", 3, 2, 1, ["a"]), "f": (None, None, None, None, None, None, []), "g": (None, None, None, 0, 0, 0, [])}


def test_groups_are_in_order_with_their_first_children(spark):
    mv = spark.createDataFrame([(3, "1", "p\\q.txt", "b/", None), (1, "2", None, "b/", "r"), (2, "3", "z", None, "r"), (4, "4", "y", "a/", "r"), (5, "5", "w", "b/", "r")], "plan_seq long, id string, from_path string, to_dir string, reason string")
    got = sorted(tuple(r) for r in views.moves_by_destination(mv, "plan_seq", 2).collect())
    assert got == [("", 0, 1, 1, "z  →  ", "r"), ("a/", 1, 1, 1, "y  →  a/", "r"), ("b/", 2, 3, 1, "  →  b/", "r"), ("b/", 2, 3, 2, "q.txt  →  b/", "")]
    de = spark.createDataFrame([(2, "1", "p/q", None, 0.125), (1, "2", None, "x", None), (3, "1", "p/q", None, 0.5)], "plan_seq long, id string, path string, reason string, confidence double")
    assert sorted(tuple(r) for r in views.deletes_by_reason(de, "plan_seq").collect()) == [("unknown", 0, 2, 1, "q", "0.12"), ("unknown", 0, 2, 2, "q", "0.50"), ("x", 1, 1, 1, "", "0.00")]


def test_overview_has_costs_or_zero(spark):
    m = spark.createDataFrame([("A:x", "1"), ("A:x", "2"), ("B:y", None)], "node_id string, id string")
    c = spark.createDataFrame([("A:x", 1.5, 0.25)], "cluster_key string, gb double, monthly_cost double")
    got = {r.cluster_key: (r["size"], r.hits, r.status, r.gb, r.monthly_cost) for r in views.cluster_overview(m, spark.createDataFrame([("1",)], "id string"), c).collect()}
    assert got == {"A:x": (2, 1, "JUNK", 1.5, 0.25), "B:y": (0, 0, "NOT JUNK", 0.0, 0.0)}


def test_topics(spark):
    assert autocat.k_candidates(3) == [2] and autocat.k_candidates(2) == []
    docs = [("B", i, f"d{i}", "txt", "alpha beta gamma" if i % 2 else "delta epsilon zeta eta") for i in range(20)] + [("C", 0, "z", "", "one"), ("D", 1, "y", None, None), ("D", 2, "x", None, None), ("D", 3, "v", None, None)]
    items = spark.createDataFrame(docs, "bucket string, seq int, id string, ext string, d string")
    w = autocat.tfidf(items, "id", "d")
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect())
    for fit in (500, 8):  # fitted on all files, and on some; every file has its cluster
        got, of = autocat.topics(items, autocat.tfidf(items, "id", "d", "bucket"), fit)
        by = {}
        for r in of.collect():
            by.setdefault((r.bucket, r.cluster), set()).add(r.id)
        assert sorted(map(sorted, (v for k, v in by.items() if k[0] == "B"))) == sorted([sorted(f"d{i}" for i in range(0, 20, 2)), sorted(f"d{i}" for i in range(1, 20, 2))])
        rows = got.collect()
        assert all(r.label.startswith("txt ") and len(r.label.split(", ")) == 4 and r.n_files == 10 for r in rows if r.bucket == "B")
        assert [(r.label, r.score, r.n_files) for r in rows if r.bucket == "C"] == [("all", 1.0, 1)] and sum(r.n_files for r in rows if r.bucket == "D") == 3
    assert {r.pos for r in autocat.top_terms(w, 2).collect()} == {1, 2}


def test_weights_beside_their_files(spark, monkeypatch):
    """The weights of tfidf() without a shuffle of terms by id, and topics of the whole without a join."""
    monkeypatch.setattr(autocat, "COUNTED", 20)
    docs = [("B", i, f"d{i}", "txt", f"Alpha beta x alpha_{i % 3} gam\u00e9ma, beta" if i % 2 else "delta epsilon beta zeta eta") for i in range(20)] + [("C", 0, "z", "", "one"), ("C", 1, "y", "", ""), ("D", 1, "x", None, None)]
    items = spark.createDataFrame(docs, "bucket string, seq int, id string, ext string, d string")
    for features in (6000, 4):
        got = autocat.weighed(items, features=features)
        assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join"))
        rows = [(r.bucket, r.id, t, round(w, 9)) for r in got.collect() for t, w in zip(r.terms, r.weights)]
        assert sorted(rows) == sorted((r.bucket, r.id, r.term, round(r.weight, 9)) for r in autocat.tfidf(items, "id", "d", "bucket", features=features).collect())
    a, b = autocat.described_topics(items, weigh=autocat.weigher(items))[0].collect(), autocat.topics(items, autocat.tfidf(items, "id", "d", "bucket"))[0].collect()
    shown = lambda rows: sorted(repr((*r[:4], round(r.score, 6), r.n_files)) for r in rows)
    assert shown(a) == shown(b) and sum(r.n_files for r in a) == 23


def test_topics_of_all_files(spark, monkeypatch):
    """Files after the first ones make topics too: in rounds over all files, and in cells where there are many topics."""
    words = [f"{a}{b}{c}" for a in "kmn" for b in "aeiou" for c in "prstvz"]
    docs = [("B", i, f"d{i}", "txt", "alpha beta gamma" if i < 8 and i % 2 else "delta epsilon zeta" if i < 8 else "eta theta iota") for i in range(20)]
    docs += [("M", i, f"m{i}", "txt", " ".join(words[(3 * (i // 3) + j) % 90] for j in range(3))) for i in range(90)]
    items = spark.createDataFrame(docs, "bucket string, seq int, id string, ext string, d string")

    def found():
        rows, of = autocat.described_topics(items, 8, autocat.weigher(items))
        by = {}
        for r in of.collect():
            by.setdefault((r.bucket, r.cluster), set()).add(int(r.id[1:]))
        rows = {(r.bucket, r.cluster): r for r in rows.collect()}
        assert {k: r.n_files for k, r in rows.items()} == {k: len(v) for k, v in by.items()}
        return rows, by

    rows, by = found()
    assert sorted(sorted(v) for k, v in by.items() if k[0] == "B") == [[0, 2, 4, 6], [1, 3, 5, 7], list(range(8, 20))]
    assert sorted(r.label for k, r in rows.items() if k[0] == "B") == ["txt alpha, alpha beta, beta, beta gamma", "txt delta, delta epsilon, epsilon, epsilon zeta", "txt eta, eta theta, iota, theta"]
    for local in (rounds.LOCAL, 40):
        monkeypatch.setattr(rounds, "LOCAL", local)
        rows, by = found()
        many = [v for k, v in by.items() if k[0] == "M"]
        assert sum(map(len, many)) == 90 and len(many) > 10 and sum(len({i // 3 for i in v}) == 1 for v in many) > len(many) / 2
        assert all(len(r.top_terms) == 8 and 0 < r.score <= 1 for k, r in rows.items() if k[0] == "M")


def test_silhouettes_of_all_files(spark):
    """Rounds over all files give the clusters, and scores the silhouettes of squared distances, that come from all pairs."""
    rng = np.random.default_rng(1)
    docs = [("B", i, f"d{i}", "txt", " ".join(rng.choice([f"{'xyz'[i % 3]}{j}" for j in range(6)] + ["common"], 5))) for i in range(60)]
    items = spark.createDataFrame(docs, "bucket string, seq int, id string, ext string, d string")
    weigh = autocat.weigher(items)
    table, width = rounds.compact(weigh.packed(items)), {"B": len(weigh.terms["B"])}
    centres = rounds.lloyd(table, width, {"B": [3]})
    sums = rounds._sums(table, centres)
    x, label = np.zeros((60, width["B"])), np.zeros(60, int)
    for r in rounds.placed(table, {"B": centres["B"][3]}).collect():
        x[r.seq, np.frombuffer(r["at"], np.int32)], label[r.seq] = np.frombuffer(r["w"], np.float32), r.cluster
    for j in range(3):
        assert np.allclose(sums["B"][3][2][j], x[label == j].sum(0), atol=1e-5) and np.allclose(centres["B"][3][j], x[label == j].mean(0), atol=1e-2)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(60):
        mean = [d[i, (label == j) & (np.arange(60) != i)].mean() for j in range(3)]
        a, b = mean[label[i]], min(m for j, m in enumerate(mean) if j != label[i])
        s.append((b - a) / max(a, b))
    assert abs(rounds.scores(table, centres, sums)["B"][3] - np.mean(s)) < 1e-4
    l2, s2 = rounds.kmeans_of_products((x @ x.T).astype(np.float32), 3)
    mean = np.stack([[d[i, (l2 == j) & (np.arange(60) != i)].mean() for j in range(3)] for i in range(60)])
    own = mean[np.arange(60), l2]
    mean[np.arange(60), l2] = np.inf
    assert np.allclose(s2, (mean.min(1) - own) / np.maximum(mean.min(1), own), atol=1e-4)


def test_one_file_makes_the_known_documents(spark, tmp_path):
    fid, path = "8e44afe4870f50eb2869e7bcfcb32b34", "demo_data\\images\\img1.bin"
    h = "5e7714856962b963ca06c5089b28dd14b64f10dccb58044cda815d13a7d7d0af"
    f = files(spark, [(0, fid, path, 2048, 1755127178.0, "application/octet-stream", h)])
    docs = write_documents(organize(f, spark.createDataFrame([], "id string, text string"), 1755127178.0 + 60), str(tmp_path))
    nodes = {n["id"]: n for n in docs["graph"]["nodes"]}
    assert set(nodes) == {"root", "cat:Documents", "sub:Documents:All Documents", "type:Documents", *(f"age:{a}" for a in tx.AGES), fid} and len(docs["graph"]["edges"]) == 9
    assert nodes["sub:Documents:All Documents"]["meta"] == {"file_ids": [fid], "bucket": "Documents", "summary": "1 files (fallback)."} and nodes["root"]["meta"] == {}
    assert nodes[f"age:{tx.AGES[1]}"]["meta"] == {"file_ids": [], "summary": "Files: 0, Total bytes: 0"} and nodes[fid]["meta"] == {"size": 2048, "mtime": 1755127178.0, "type": "application/octet-stream", "hash": h}
    assert docs["summaries"] == {"type:Documents": "Files: 1, Total bytes: 2048", f"age:{tx.AGES[0]}": "Files: 1, Total bytes: 2048", f"age:{tx.AGES[1]}": "Files: 0, Total bytes: 0", f"age:{tx.AGES[2]}": "Files: 0, Total bytes: 0", "sub:Documents:All Documents": "1 files (fallback)."}
    assert docs["plan"]["moves"] == [{"id": fid, "from": path, "to": "Documents/all-documents/", "reason": "Documents:All Documents"}] and docs["plan"]["deletes"] == [] and docs["plan"]["cluster_costs"] == {}
