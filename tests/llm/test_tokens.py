"""Encoding against the tokenizers' own libraries, decoding, splitting, mixing, on literals and random texts."""

import base64
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidewright.llm import mixing, splitting, tokens

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k")
TEXTS = st.text(alphabet="ab's t're'll12 \n\t.,é字  　d'🎉́Σİ<|endoftext|>", max_size=60)


def library(name):
    if name.startswith("byte_bpe_multi"):
        import public_tokenizers as P
        import tiktoken

        with open(f"{tokens.TOKENIZER_DIR}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{name}.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name):
    want, c = library(name), tokens.coder(name)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXTS, max_size=5))
    def check(texts):
        assert c.encode(texts) == [list(want(t)) for t in texts]
        assert c.count(texts).tolist() == [len(want(t)) for t in texts]
        if c.blank_joins:
            assert [c.decode(i) for i in c.encode(texts)] == texts

    check()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_own_merging_equals_the_library(piece):
    c = tokens.coder("byte_bpe_50k")
    ranks = {b: i for i, b in enumerate(c.vocab) if b}
    assert tokens.merge_pairs(piece, ranks) == list(c.merge(piece))


def test_long_piece_is_merged_whole():
    c = tokens.coder("byte_bpe_50k")
    text = "字" * 20000
    assert c.decode(c.encode([text])[0]) == text


def test_corpus(spark):
    d = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (1, "Hello world", 5), (None, "x", 5)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_corpus(d).collect()), key=str)
    assert got == sorted([(1, [15496, 995]), (2, []), (3, []), (1, [15496, 995]), (None, [87])], key=str)
    assert tokens.encode_corpus(d.limit(0)).count() == 0
    assert sorted(r.text for r in tokens.decode_corpus(tokens.encode_corpus(d)).collect()) == ["", "", "Hello world", "Hello world", "x"]
    assert sorted(r.text for r in tokens.round_tripped(d).collect()) == ["", "", "Hello world", "Hello world", "x"]
    words = tokens.decode_corpus(tokens.encode_corpus(d, tokenizer="word_bpe_49k"), tokenizer="word_bpe_49k")
    assert sorted(r.text for r in words.collect()) == ["", "", "hello world", "hello world", "x"]
    with pytest.raises(ValueError):
        tokens.coder("unknown")


@pytest.mark.parametrize("name", NAMES)
def test_offsets_quote_the_tokens(spark, name):
    texts = ["Hello wörld's  字字。🎉x\n\n 12", "", "İstanbul café"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    c = tokens.coder(name)
    for r in tokens.encode_corpus(d, tokenizer=name, with_offsets=True).collect():
        t = texts[r.doc_id]
        assert len(r.starts) == len(r.ids) and r.starts == sorted(r.starts)
        for i, a, b in zip(r.ids, r.starts, [*r.starts[1:], len(t)]):
            part = c.decode([i])
            # a token that is whole characters stands where its offset says
            if c.blank_joins and "\ufffd" not in part:
                assert t[a:b] == part
            elif c.prepared(t) is not None and part.strip().isascii() and "\ufffd" not in part:
                assert t[a:].lower().startswith(part.strip())


LIMITS = [(1, 40, 8), (2, 12, 0), (3, 9, 3)]
PARTS = ["word ", "lelquist-lel", "\n", "\n\n", "A. ", "字字。", "é", "🎉", "'s", "  ", "x" * 30, "12", "'", "\t", "!'", "'ll", "\u3000", "' ", "'re x"]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_cover_and_fit(name):
    c = tokens.coder(name)

    @settings(max_examples=80, deadline=None)
    @example(["字字。's" + "x" * 30, "word 字字。'slelquist-lel"])
    @example(["字。  \n\n" * 12, "字。 \n\n \nword  \n " * 9])
    @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), max_size=3))
    def check(texts):
        ready = [c.prepared(t) for t in texts]
        assert None not in ready
        rows = splitting.split_texts(ready, c, LIMITS)
        by = defaultdict(list)
        for r in rows:
            by[r[0], r[1]].append(r[2:])
        n = c.count(ready)
        assert set(by) == {(i, d) for i, most, _ in LIMITS for d in range(len(texts)) if n[d] > most}
        for (i, d), pieces in by.items():
            most, overlap = next(x[1:] for x in LIMITS if x[0] == i)
            at = 0
            for k, (no, lo, core, hi, tokens_, over) in enumerate(pieces):
                assert no == k and core == at and lo <= core < hi
                assert tokens_ == c.count([ready[d][lo:hi]])[0] and tokens_ <= most
                assert over == 0 if not k else over >= overlap or lo == 0 or c.count([ready[d][lo - 1 : hi]])[0] > most
                at = hi
            assert at == len(texts[d])

    check()


@settings(max_examples=150, deadline=None)
@example(["l'Maison d'Turin", "it's 'so", "we'LL see'S", "plain words don't 12 differ", "", "1２٣ é字 Α Ⱥ"])
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_texts_over_a_limit_of_words(texts):
    c, want = tokens.coder("word_bpe_49k"), library("word_bpe_49k")
    texts = [t for t in texts if c.prepared(t) is not None]
    cuts = tokens.Cuts(texts, True)
    n = [len(want(t)) for t in texts]
    for most in (3, 8, 20):
        over = c.over(cuts, most).tolist()
        # a text with an apostrophe may be called over, to be counted exactly; none that is over may be missed
        assert all(o or k <= most for o, k in zip(over, n)) and all(not o or k > most or "'" in t for o, k, t in zip(over, n, texts))


def test_no_place_to_cut_leaves_a_range_whole():
    places = splitting._Places(np.array([3, 0, 0, 0, 0, 0]))
    lo, hi = splitting._bisect(places, np.array([0]), np.array([6]), np.array([2]))
    assert lo.tolist() == [0] and hi.tolist() == [6]
    lo, hi = splitting._bisect(splitting._Places(np.array([3, 1, 1, 5, 1, 1])), np.array([0]), np.array([6]), np.array([3]))
    assert lo.tolist() == [0, 3] and hi.tolist() == [3, 6]


def test_cuts_at_sentences():
    c = tokens.coder("byte_bpe_50k")
    text = "The first sentence is here. The second one stands there. A third follows now. The last one ends it."
    (a, b) = splitting.split_texts([text], c, [(1, 15, 0)])
    assert text[: a[5]] == "The first sentence is here. The second one stands there." and b[4] == a[5]


def test_split_corpus(spark):
    d = spark.createDataFrame([(1, "word " * 100, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x")], "doc_id bigint, text string, limit_id string")
    r = splitting.split_corpus(d, [(7, "byte_bpe_50k", 30, 5), (8, "word_bpe_49k", 1000, 0), (None, "byte_bpe_50k", 3, 0), (9, "byte_bpe_50k", None, 0)], with_text=True).collect()
    assert {x.doc_id for x in r} == {1} and {x.limit_id for x in r} == {7}
    assert "".join(x.piece[x.core_lo - x.piece_lo :] for x in sorted(r, key=lambda x: x.piece_no)) == "word " * 100
    assert splitting.split_corpus(d.limit(0), [(7, "byte_bpe_50k", 30, 5)]).count() == 0


def test_mix(spark):
    docs = spark.createDataFrame([(i, s, "t", n, q) for i, (s, n, q) in enumerate([("a", 10, 1.0)] * 300 + [("b", 5, 0.5)] * 40 + [(None, 9, 1.0)] * 3 + [("a", 0, 1.0)] * 5)], "doc_id bigint, source string, tokenizer string, n_tokens bigint, quality double")
    t = spark.createDataFrame([("r", "a", 0.5, 1, "t"), ("r", "b", 0.4, 4, "t"), ("r", "none", 0.1, 2, "t"), (None, "a", 1.0, 1, "t"), ("r", "a", 0.5, 1, "t")], "recipe string, source string, target_share double, max_repeats int, tokenizer string")
    m = mixing.mix(docs, t)
    rows = m.collect()
    # b: 200 tokens four times; a gets 800 * 0.5 / 0.4 of its 3000
    total = {s: sum(r.repeats * r.n_tokens for r in rows if r.source == s) for s in "ab"}
    assert total == {"a": 1000, "b": 800} and max(r.repeats for r in rows) == 4
    assert len({(r.recipe, r.doc_id) for r in rows}) == len(rows)
    s = {r.source: r for r in mixing.shares(m, docs, t).collect()}
    assert s["none"].tokens == 0 and s["a"].reached_share == pytest.approx(1000 / 1800)
    assert sorted(map(tuple, mixing.mix(docs, t).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(docs.limit(0), t).count() == 0


def test_mix_size_and_quality(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "word " * (1 + i % 5), float(i % 3), "x") for i in range(300)], "doc_id bigint, source string, text string, good double, recipe string")
    t = spark.createDataFrame([("r", "a", 0.5, 1, "byte_bpe_50k"), ("r", "b", 0.25, 1, "byte_bpe_50k"), ("r", "none", 0.25, 1, "byte_bpe_50k")], "recipe string, source string, target_share double, max_repeats int, tokenizer string")
    c = mixing.counted(docs, t, quality="good")
    assert sorted({r.quality for r in c.collect()}) == [mixing.LEAST_QUALITY, 1.0, 2.0]
    m = mixing.mix(c, t, total_tokens=90)
    by = {r.source: r.tokens for r in mixing.shares(m, c, t, total_tokens=90).collect()}
    assert by["none"] == 0 and abs(by["a"] - 60) <= 4 and abs(by["b"] - 30) <= 4
    # a third of the documents are of least quality, and hardly any of them is among the first
    least = {r.doc_id for r in c.collect() if r.quality == mixing.LEAST_QUALITY}
    used = [r.doc_id in least for r in m.collect()]
    assert sum(used) <= 0.15 * len(used)
    every = mixing.mix(c, t, total_tokens=1e9).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, mixing.mix(c, t).collect()))


@pytest.mark.parametrize("quality", [0.25, 0.5, 1.0])
def test_mix_buckets_are_bounded(spark, monkeypatch, quality):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 500)
    d = spark.range(100_000).selectExpr("id as doc_id", "'a' as source", "'t' as tokenizer", "1L as n_tokens", f"{quality}d as quality")
    p = mixing.plan(mixing.sizes(d), spark.createDataFrame([("r", "a", "t", 1.0, 1)], "recipe string, source string, tokenizer string, target_share double, max_repeats int"))
    n = [r["count"] for r in mixing._keyed(d, p, 0).groupBy("_bucket").count().collect()]
    assert max(n) <= 2 * mixing.BUCKET_ROWS and sum(n) == 100_000


def test_mix_buckets_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "t", 1 + i % 7, 0.3 + (i % 5) / 10) for i in range(400)], "doc_id bigint, source string, tokenizer string, n_tokens bigint, quality double")
    t = spark.createDataFrame([("r", "a", 0.9, 1, "t"), ("r", "b", 0.1, 1, "t")], "recipe string, source string, target_share double, max_repeats int, tokenizer string")
    one = sorted(map(tuple, mixing.mix(docs, t).collect()))
    for size in (20, 3):
        monkeypatch.setattr(mixing, "BUCKET_ROWS", size)
        assert sorted(map(tuple, mixing.mix(docs, t).collect())) == one
    monkeypatch.setattr(mixing, "FEW_TARGETS", 0)  # nothing is broadcast
    assert sorted(map(tuple, mixing.mix(docs, t).collect())) == one
