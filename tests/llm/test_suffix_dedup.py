import hashlib
import random

import numpy as np
import pytest

from textloom.llm import suffix_dedup
from textloom.llm.suffix_array import permuted_lcp, suffix_array

DOCS = "doc_id long, text string, lang string, spans string"


@pytest.mark.parametrize("k", [2, 4, 30, 3000])
def test_suffix_array_and_lcp(k):
    rng = np.random.default_rng(k)
    for n in [0, 1, 2, 3, 7, 60, 900]:
        for low in (1, max(1, k - 2)):
            t = np.append(rng.integers(low, max(k, low + 1), n), 0).astype(np.int32)
            if n > 50:
                t[30:45] = t[5:20]
            sa = suffix_array(t, max(k, int(t.max()) + 1))
            s = t.tolist()
            assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
            want = [0] * len(s)
            for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
                while want[b] < len(s) - max(a, b) and s[a + want[b]] == s[b + want[b]]:
                    want[b] += 1
            assert permuted_lcp(t, sa).tolist() == want


def brute(rows, n):
    count = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for a in range(len(t) - n + 1):
            count[t[a : a + n]] = count.get(t[a : a + n], 0) + 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - n + 1):
            if count[t[a : a + n]] > 1:
                gone[a : a + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(70), text(24)
    rows = [(1, None), (2, ""), (3, "a" * 700), (4, "short"), (None, text(90)), (5, passage + passage), (6, "ab" * 150), (7, "é" * 130)]
    for i in range(40):
        parts = [text(rng.randint(0, 60)), rng.choice([passage, line, line[:150], passage[:210], passage[7:207], ""]), text(rng.randint(0, 60)), rng.choice([line, ""])]
        rows.append((10 + i, " ".join(parts)))
    copy = text(120)
    rows += [(100 + i, copy) for i in range(5)] + [(110, copy[:300] + "X" + copy[300:]), (111, "Y" + copy), (rows[-1])]
    rows += [rows[20], rows[20]]
    return rows


@pytest.mark.parametrize(("hot", "shard", "buffer"), [(500, 1 << 20, 1 << 22), (1, 2000, 300)])
def test_removal_matches_brute_force(spark, monkeypatch, hot, shard, buffer):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rows = corpus(hot)
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in rows], DOCS)
    got = suffix_dedup.remove_repeats(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 200)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_kept_text_and_ranges(spark):
    shared = "wörter " * 40
    df = spark.createDataFrame([(1, "one " + shared), (2, shared + "two"), (3, "three")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, keep=["doc_id", "text"], with_text=True).collect()}
    assert rows[3].kept_text == "three" and rows[3].removed == []
    for r in rows.values():
        raw = r.text.encode()
        left = bytes(c for k, c in enumerate(raw) if not any(a <= k < b for a, b in zip(r.removed[::2], r.removed[1::2], strict=True)))
        assert hashlib.sha256(left).hexdigest() == r.kept_sha256
        assert r.kept_text == left.decode(errors="ignore")


def test_repeats_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == brute(rows, 200)


def test_runs_of_one_character_and_long_texts(spark):
    rng = random.Random(3)
    rows = [(1, "x" * 30_000), (2, "ab" * 20_000), (3, "".join(rng.choice("abcdef ") for _ in range(40_000))), (4, "y" * 199), (5, "z" * 200)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 200)


def test_one_passage_in_many_contexts_stays_spread(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(600)
    rows = [(i, text(90) + passage + text(90)) for i in range(3000)]
    seen = []
    real = suffix_dedup._sorted_shards

    def watched(strings, shards, length):
        sizes = strings.groupBy((strings.key % shards).alias("s")).agg({"bytes": "count"}).collect()
        total = strings.selectExpr("sum(octet_length(bytes))").first()[0]
        seen.append((shards, total, max(r[1] for r in sizes) * 210))
        return real(strings, shards, length)

    monkeypatch.setattr(suffix_dedup, "SHARD", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", watched)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_removed >= 600 and got[i].n_spans == 1 for i, _ in rows)
    (shards, total, largest), = seen
    assert shards >= total / (1 << 16) and largest <= 2 * (1 << 16) + 210 * 600
