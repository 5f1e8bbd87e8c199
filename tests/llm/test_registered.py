"""The registered queries over whole tables, against the contracts by brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from textloom.llm.queries import queries


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).collect()
    return {r.doc_id: r for r in got} if "doc_id" in got[0] else got


def test_op2(spark, sf_dir, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    got = rows(spark, sf_dir, "op2_bpe")
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, i


def test_op4(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op4_quality")
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(got[i].predicted, q) for i, q in labels.items() if i in got and got[i].held_out]
    assert len(held) > 10 and np.mean([p == q for p, q in held]) >= 0.8


def test_op6(spark, sf_dir, docs):
    raw = {i: (d.text or "").encode() for i, d in docs.items()}
    count: dict[bytes, int] = {}
    key = lambda b, k: hashlib.blake2b(b[k : k + 200], digest_size=12).digest()
    for b in raw.values():
        for k in range(len(b) - 199):
            count[h] = count.get(h := key(b, k), 0) + 1
    got = rows(spark, sf_dir, "op6_suffix_dedup")
    assert got.keys() == docs.keys()
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - 199):
            if count[key(b, k)] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        out = np.cumsum(gone)[:-1] > 0
        spans = int((out & ~np.append(False, out[:-1])).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~out])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(out.sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_op7(spark, sf_dir, docs):
    prints = {}
    for i, d in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else [], np.uint64)
        prints[i] = sum(1 << b for b in range(64) if int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h))
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows(spark, sf_dir, "op7_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op8(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op8_language")
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert {r.lang_pred for r in got.values()} <= {d.lang for d in docs.values()} | {"und"}
    held = [(r.lang_pred, docs[i].lang) for i, r in got.items() if r.held_out and docs[i].lang and r.lang_pred != "und"]
    assert len(held) > 15 and np.mean([a == b for a, b in held]) >= 0.9


def test_op9(spark, sf_dir):
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got: dict[int, list] = {}
    for r in sorted(rows(spark, sf_dir, "op9_nearest"), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in v if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q)[:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(abs(s - float(np.sqrt(((v[q] - v[i]) ** 2).sum()))) < 1e-9 for _, i, s in found)
        hit += len({i for _, i in want} & {i for _, i, _ in found})
    assert hit >= 0.9 * 10 * len(got)


def test_op5(spark, sf_dir, docs):
    """Every token of every text has one place: the slots are all there once, and so are the sequences."""
    got = queries()["op5_training_order"](spark, sf_dir)
    assert {"slot"} <= set(got.columns)
    slots = sorted(r.slot for r in got.select("slot").collect())
    assert slots == list(range(len(slots)))
