import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from textloom.llm import token_counts
from textloom.llm.token_counts import PrefixCounter, count_tokens, prefix_counts, truncation_points, window_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "  ", " a", "a ", "a  b", "a\n\nb", "\n", "a \n b", "we're 'Re 're", "x<|endoftext|>y <|endoftext|>", "<|endoft", "日本語 テスト", "é  x\x85y\x1cz", "²½ª", "İstanbul Σας", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "tab\there\r\nend", "🎉🎉 ok", "don't 'll 'v 12345 3.14"]


@pytest.fixture(scope="module")
def both():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


def test_whole_texts(both):
    c, t = both
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab e'st\n12.,!é&  日<|") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for x in texts:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_every_prefix(both):
    c, t = both
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab e'stre\n12.!é  日") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for x in texts:
        x = x[:150]
        assert c.prefixes(x) == [len(t.encode(x[: i + 1], add_special_tokens=False).ids) for i in range(len(x))], repr(x)


def test_rows(spark, both):
    rows = [(1, None, "x"), (1, None, "x"), (None, "the end", "y"), (3, "", None), (4, "word " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = count_tokens(df)
    got = sorted(map(tuple, counted.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    fit = {r.doc_id: r.fit_chars for r in counted.collect()}
    assert fit[None] == 7 and fit[3] == 0 and len(both[1].encode(("word " * 3000)[: fit[4]]).ids) <= 1024 < len(both[1].encode(("word " * 3000)[: fit[4] + 5]).ids)
    n = len(both[1].encode("word " * 3000).ids)
    assert got == sorted([(1, 0, 0, False)] * 2 + [(None, 7, 2, False), (3, 0, 0, False), (4, 15000, n, True)], key=str)
    assert count_tokens(df.limit(0)).count() == 0


def test_budget_questions(spark, both):
    text = "The quick brown fox isn't here any more, is it?"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    counted = count_tokens(df)
    assert {r.doc_id: r.prefix_counts for r in prefix_counts(counted).collect()} == {1: [len(both[1].encode(text[: i + 1]).ids) for i in range(len(text))], 2: []}
    n = {r.doc_id: r.n_chars_kept for r in truncation_points(counted, 5).collect()}
    enc = lambda x: len(both[1].encode(x).ids)
    assert n == {1: max(i for i in range(len(text) + 1) if enc(text[:i]) <= 5), 2: 0}
    assert {r.doc_id: r.n_tokens for r in window_tokens(counted, 12).collect()} == {1: enc(text[:12]), 2: 0}


def test_long_pieces_take_linear_time_and_are_not_kept(both):
    c, t = both
    for x in (" " * 5000 + "x", "'" * 5000, "a" * 5000, "\n" * 3000 + " b", "中" * 3000):
        got = c.prefixes(x)
        assert got[-1] == len(t.encode(x, add_special_tokens=False).ids)
        assert got[1999] == len(t.encode(x[:2000], add_special_tokens=False).ids)
    assert max(map(len, c.pieces)) <= 128


def test_pieces_of_more_tokens_than_16_bits_hold(spark, both):
    c, t = both
    texts = [" " * 100_000, "\t" + "qx" * 50_000, "漢字" * 25_000, " \n" * 40_000 + "x", "'" * 70_000, "a <|endoftext|>" + "\x85" * 40_000]
    n = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = count_tokens(df)
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()} == {i: (len(x.encode()), n[i], n[i] > 1024) for i, x in enumerate(texts)}
    for at in (10, 999, 33_000, 45_001):
        got = {r.doc_id: r.n_tokens for r in window_tokens(counted, at).collect()}
        assert got == {i: len(t.encode(x[:at], add_special_tokens=False).ids) for i, x in enumerate(texts)}, at


def test_a_change_that_16_bits_do_not_hold():
    for changes in ([1, 40_000, -50_000, 0], [1, 0, -1], []):
        x = np.array(changes, np.int32)
        assert token_counts._changes(token_counts._packed(x, zstandard.compress)).tolist() == changes


def test_registered_query_over_whole_texts(spark, both, sf_dir):
    from textloom.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (len((d.text or "").encode()), len(both[1].encode(d.text or "", add_special_tokens=False).ids)) for d in docs}
    got = queries()["op1_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
