"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from textloom.llm import bpe

from .test_similar_groups import brute as brute_jaccard
from .test_suffix_dedup import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "123 ...", "en", "s", 7), (None, first.text, "en", None, 0), (first.doc_id, first.text, "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    steps = dict(cp.STAGES)
    names = list(steps)

    a = spark.createDataFrame(steps[names[0]](spark, docs, sf_dir).collect(), docs.schema)
    kept = {r.doc_id for r in a.collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and re.search(r"[^\W\d_]{2}", r.text)}
    assert not kept & {10_000, 10_001, 10_002} and len(clean - kept) <= 0.02 * len(clean)

    b = spark.createDataFrame(steps[names[1]](spark, a, sf_dir).collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in a.collect() if r.doc_id is not None]
    want, _ = brute_jaccard(rows)
    assert sorted(r.doc_id for r in b.collect()) == want  # the row without id has a copy with one

    c = spark.createDataFrame(steps[names[2]](spark, b, sf_dir).collect(), docs.schema)
    want = {i: h for i, _, _, _, h in brute([(r.doc_id, r.text) for r in b.collect()], 200)}
    got = {r.doc_id: r for r in c.collect()}
    assert got.keys() == want.keys()
    ascii_only = {r.doc_id for r in b.collect() if r.text.isascii()}
    assert all(hashlib.sha256(got[i].text.encode()).hexdigest() == want[i] for i in ascii_only)
    assert all(r.n_chars == len(r.text) for r in got.values())

    d = spark.createDataFrame(steps[names[3]](spark, c, sf_dir).collect(), docs.schema)
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] if w for i in range(max(1, len(w) - 4))}
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in c.collect() if any(len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - dirty

    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    out = {r.doc_id: r for r in steps[names[4]](spark, d, sf_dir).collect()}
    for r in d.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert out[r.doc_id].n_tokens == len(ids) and out[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    for f in steps.values():
        assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_run_is_its_stages(spark, sf_dir):
    rows = cp.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100
