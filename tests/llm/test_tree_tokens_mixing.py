import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwright.llm import mixing, tree_tokens

VOCAB = tree_tokens.read_vocab()
SMALL, WHOLE = tree_tokens.Encoder(VOCAB, leaf=7), tree_tokens.Encoder(VOCAB, leaf=1 << 30)
ODD = ["", " ", "a" * 3000, "  \n\n \t x", "don't I'LL we'd " * 40, "日本語。テスト、" * 50, "ab12cd 3.14" * 30, "   x\x85y　z\x1c" * 20, "<|endoftext|>" * 9, "🙂‍👩" * 50, "é̀" * 99, "'s't're" * 20]


@pytest.mark.parametrize("text", ODD)
def test_tree_equals_whole(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE.encode(text) and SMALL.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'.,sdx1é日　\x85\x1c")), st.characters(codec="utf-8")), max_size=120))
def test_tree_equals_whole_at_random(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE.encode(text) and SMALL.decode(ids) == text


@pytest.mark.parametrize("text", ["！？、" * 350_000, "字" * 1_000_001, " " * 1_000_000, "'l" * 500_000, "9" * 1_000_000])
def test_a_million_characters_without_a_plain_break(text):
    """No white space beside words, no ASCII punctuation: windows grow until the pieces agree."""
    ids = tree_tokens.Encoder(VOCAB, leaf=1 << 17).encode(text)
    assert ids == WHOLE.encode(text)


def test_another_pattern():
    """The joins follow from the pattern: here numbers split in threes, and line ends with the blanks before them."""
    pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    small, whole = tree_tokens.Encoder(VOCAB, leaf=5, pattern=pattern), tree_tokens.Encoder(VOCAB, leaf=1 << 30, pattern=pattern)
    rng = random.Random(3)
    for text in [*ODD, *("".join(rng.choice("ab1234567  \n\r'ls.é") for _ in range(200)) for _ in range(200))]:
        assert small.encode(text) == whole.encode(text)


def test_against_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tree_tokens.VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in ODD:
        assert t.encode(text, add_special_tokens=False).ids == SMALL.encode(text)


def test_rows_and_edge_cases(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x"), (None, "a", "x"), (4, "ab " * 200_000, "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in tree_tokens.encode_corpus(df, "doc_id", "text").collect()), key=str)
    assert len(got) == 6 and (2, []) in got and (3, []) in got and [x for x in got if x[0] == 1] == [(1, WHOLE.encode("hello world"))] * 2
    counts = {r.doc_id: r.n_tokens for r in tree_tokens.count_tokens(df, "doc_id", "text").collect()}
    assert counts[4] == len(WHOLE.encode("ab " * 200_000)) and counts[2] == 0
    assert tree_tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_quotas():
    q = mixing.quotas({"a": 1, "b": 1, "c": 2, "d": 0, "e": 5}, {"a": 1, "b": 2, "c": 9, "d": 9, "e": 3}, {"a": 10, "b": 100, "c": 100, "d": 100}, 200)
    assert q["a"] == 10 and q["d"] == 0 and q["e"] == 0
    assert abs(q["b"] - 190 / 3) < 1e-6 and abs(q["c"] - 380 / 3) < 1e-6
    assert mixing.quotas({}, {}, {}, 5) == {} and mixing.quotas({"a": 1}, {"a": 0}, {"a": 9}, 5) == {"a": 0.0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 17))
def test_split_is_exact(counts, shards):
    got = mixing.split(counts, shards, 3)
    assert (got >= 0).all() and list(got.sum(0)) == counts
    assert abs(got.sum(1).max() - got.sum(1).min()) <= shards


def fixture(spark, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(600):
        s = rng.choice(["mail", "Mail ", "MAIL", "wiki", "wiki", "memo", None, " "]) if i else None
        t = rng.choice([None, "", "word " * rng.randrange(1, 60)]) if i % 9 == 0 else "word " * rng.randrange(1, 60)
        rows.append((i, t, s, "x"))
    targets = [(1, "mail", 1.0, 1), (1, "WIKI", 1.0, 2), (1, "memo", 2.0, 4), (1, "ghost", 1.0, 5), (2, "wiki", None, 3), (2, "memo", 1.0, None), (2, "mail", 1.0, 0), (3, "mail", 0.0, 1), (None, "mail", 1.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string"), spark.createDataFrame(targets, "mix_id int, source string, weight double, max_repeats int")


def test_mix(spark):
    docs, targets = fixture(spark)
    rows = mixing.mixed(docs, targets, shards=5, block_tokens=300).collect()
    again = mixing.mixed(docs.repartition(7), targets, shards=5, block_tokens=300).collect()
    key = lambda r: (r.mix_id, r.shard, r.doc_id, r.epoch)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len({(r.mix_id, r.doc_id, r.epoch) for r in rows}) == len(rows) and {r.shard for r in rows} <= set(range(5))
    report = {(r.mix_id, r.source): r for r in mixing.shares(docs, targets, block_tokens=300).collect()}
    caps = {(1, "mail"): 1, (1, "wiki"): 2, (1, "memo"): 4, (2, "memo"): 1}
    for (m, s), cap in caps.items():
        assert 0 < report[m, s].most_repeats <= cap
        assert report[m, s].tokens == sum(r.n_tokens for r in rows if (r.mix_id, r.source) == (m, s))
    assert all(report[k].tokens == 0 for k in ((1, "ghost"), (2, "wiki"), (2, "mail"), (3, "mail")))
    have = {s: report[1, s].have for s in ("mail", "wiki", "memo")}
    want = mixing.quotas({"mail": 1, "wiki": 1, "memo": 2, "ghost": 1}, {"mail": 1, "wiki": 2, "memo": 4, "ghost": 5}, have, sum(have.values()))
    assert all(abs(report[1, s].tokens - want[s]) <= 65 for s in have)  # a document, at most
    small = {(r.mix_id, r.source): r for r in mixing.shares(docs, targets, total_tokens=10 * sum(have.values()), block_tokens=300).collect()}
    assert all(small[1, s].tokens == cap * have[s] for s, cap in (("mail", 1), ("wiki", 2), ("memo", 4)))  # every cap binds


def test_a_hundred_shards_and_parts_of_leaves(spark, monkeypatch):
    """Every draw in one shard, each shard a fair sample; with more shards than leaves, leaves are cut further."""
    docs, targets = fixture(spark)
    want = sorted((r.mix_id, r.doc_id, r.epoch) for r in mixing.mixed(docs, targets, shards=5, block_tokens=60).collect())
    for most in (mixing.MAX_SHARDS, 30):
        monkeypatch.setattr(mixing, "MAX_SHARDS", most)
        rows = mixing.mixed(docs, targets, shards=100, block_tokens=60).collect()
        assert sorted((r.mix_id, r.doc_id, r.epoch) for r in rows) == want
        size = {}
        for r in rows:
            size[r.mix_id, r.shard] = size.get((r.mix_id, r.shard), 0) + 1
        assert len({k for m, k in size if m == 1}) > 80 and max(k for _, k in size) < 120


def test_mix_of_nothing(spark):
    docs, targets = fixture(spark)
    assert mixing.mixed(docs.limit(0), targets).collect() == [] and mixing.mixed(docs, targets.limit(0)).collect() == []
    assert all(r.tokens == 0 for r in mixing.shares(docs.limit(0), targets).collect())
