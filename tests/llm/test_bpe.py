import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe

ODD = [None, "", " ", "\n", "Hello World's don't", "x\x85y z\xa0w\x1cv", "<|endoftext|> A<|startoftext|>b <|EndOfText|>", "日本語 テスト", "İstanbul ΣΑΣ ΟΔΟΣ", "é ̈a ́", "12345 ½²", "!!! ###word$$$", "tab\tand\r\nend", "🎉🎉", "word " * 20_000, "a" * 3000, "Word, WORD. word! Ünïcode; 's. don't, x.. a.b, Ωmega. ĸra: İs,"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdE é's\n.,!<|1 日") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    out = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    return out + [out[5], out[5]]


def test_matches_the_library(spark, rows, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, ids string").repartition(3)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode(df, digests=True).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(df.limit(0)).count() == 0


def test_small_blocks(spark, rows, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    df = spark.createDataFrame(rows[16:120], "doc_id long, text string").repartition(2)
    split = bpe.split_blocks
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 50)
    assert split(df, texts=True).count() >= 2
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(df).collect()}
    assert got == {(i, tuple(t.encode(x, add_special_tokens=False).ids)) for i, x in rows[16:120]}


def test_decode_is_an_exact_round_trip(spark, rows):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    df = spark.createDataFrame(rows[:60], "doc_id long, text string")
    want = [(i, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in rows[:60]]
    assert sorted(map(tuple, bpe.decode(bpe.encode(df)).collect()), key=str) == sorted(want, key=str)
