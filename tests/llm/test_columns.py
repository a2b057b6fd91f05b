"""Extra columns whose names clash with the operators' own, or differ in case only, and nulls in any column."""

import pytest

from shelfwright.llm import components, mixing, mojibake, near_dup, pii, rnn_clusters, survivor, tree_tokens

LONG = " ".join(f"word{i}" for i in range(40))


def wide(spark, rows, schema, *extra):
    """A table with columns of the given extra names before and after."""
    df = spark.createDataFrame(rows, schema)
    n = len(extra)
    full = spark.createDataFrame([(*["x"] * n, *r, *["y"] * n) for r in df.collect()], ", ".join([*(f"`a{i}` string" for i in range(n)), *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`b{i}` string" for i in range(n))]))
    names = [*extra, *df.columns, *(f"{e}2" for e in extra)]
    return full.toDF(*names)


def test_texts(spark):
    rows = [("1", LONG), ("2", LONG), (None, None), ("3", None)]
    df = wide(spark, rows, "id string, text string", "ID", "Text", "_id", "_text", "f1", "sig", "rep", "key", "a.b")
    assert [tuple(r) for r in near_dup.near_pairs(df, "id", "text").collect()] == [("1", "2")]
    assert mojibake.found(df).collect() == [] and pii.found(df, "id", "text").collect() == []
    assert {r.id: r.ids for r in tree_tokens.encode_corpus(df, "id", "text").collect()}["3"] == []


def test_survivor(spark):
    f = wide(spark, [(1, "i", None, None, None, None, None), (2, "i", None, None, None, None, None)], "seq long, id string, path string, mtime double, hash string, scan_id int, seen_at timestamp", "trust", "ID", "record", "n", "c")
    s = wide(spark, [(None, None)], "scan_id int, trust int", "id", "seq")
    p = wide(spark, [(1, "i", None, None), (2, None, None, None)], "plan_seq long, id string, reason string, confidence double", "seq", "value")
    assert [tuple(r) for r in survivor.surviving_rows(f, s, p).collect()] == [("i", 0, 0, 0, 0)]


def test_components(spark):
    m = wide(spark, [("a", "b", True), ("c", None, True), ("d", "e", None), (None, None, None)], "id_a string, id_b string, is_match boolean", "ID_A", "src", "v")
    g = spark.createDataFrame([("duplicate_cluster", (["b", None, "z"],), "x"), ("near_duplicate_text", None, "x"), (None, (["p", "q"],), "x"), ("type_cluster", (["r", "s"],), "x")], "kind string, meta struct<file_ids: array<string>>, Meta2 string")
    assert {tuple(r) for r in components.connected(components.file_links(m, g)).collect()} == {("a", "a"), ("b", "a"), ("z", "a")}


def test_clusters_and_mixes(spark):
    c = wide(spark, [(1, ["a", "b"], None, None), (2, ["a", "b"], None, None), (3, None, None, None)], "result_id long, file_ids array<string>, top_terms array<string>, score double", "c", "n", "Score", "side", "h")
    assert {tuple(r) for r in rnn_clusters.found(c).collect()} == {(1, 1), (2, 1)}
    assert [r.mean_score for r in rnn_clusters.described(c).collect()] == [None]
    d = wide(spark, [(1, "one two", "mail"), (2, None, None), (None, "x", "mail")], "doc_id long, text string, source string", "n_tokens", "d", "block", "SOURCE")
    t = wide(spark, [(1, "mail", 1.0, 1), (None, None, None, None), (2, "mail", None, None)], "mix_id int, source string, weight double, max_repeats int", "cap", "have")
    assert {r.doc_id for r in mixing.mixed(d, t).collect()} == {1, None}


def test_a_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="no column text"):
        near_dup.near_pairs(spark.range(1), "id", "text")
