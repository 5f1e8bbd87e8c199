"""Decontamination, quality, language, SimHash and sharding against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from textloom.llm import decontamination, language, quality, sharding, simhash
from textloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "clash") for i, t in rows], DOCS)


def test_decontamination_is_exact(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["red", "blue", "green", "one", "two", "Three", "x", "été"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 4, 5, 6, 9, 12, 20, 31, 40, 64])] + [(90, None), (91, ""), (None, "a b c d e f g"), (92, "same words here again and again"), (93, "same words here again and again")]
    docs = [(0, None), (1, ""), (None, "zz A, b; c d e f g!"), (2, " ".join(word() for _ in range(3000))), (7, "!!!")]
    for k, (_, t) in enumerate(x for x in items if x[1]):
        w = t.split()
        if len(w) > 8:
            w[rng.randrange(len(w))] = "changed"
        docs.append((100 + k, " ".join([word(), *w, word()]) if k % 2 else t))
    docs += [docs[-1], docs[-1]]
    shingles = lambda t: {" ".join(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] if w for i in range(max(1, len(w) - 4))}
    want = set()
    for i, t in items:
        for d, x in docs:
            if t and x and (a := shingles(t)) and len(a & shingles(x)) >= 0.8 * len(a):
                want.add((d, i, len(a), len(a & shingles(x))))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contaminated(frame(spark, docs), df)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()} == want and len(want) > 8
    assert got.count() == len(want)
    assert decontamination.find_contaminated(frame(spark, docs), df.limit(0)).count() == 0
    assert decontamination.find_contaminated(frame(spark, docs).limit(0), df).count() == 0


def test_decontamination_joins_large_tables_by_shuffle(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    assert [r.doc_id for r in decontamination.find_contaminated(frame(spark, [(5, "x a b c d e f g h"), (6, "a b c")]), items).collect()] == [5]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta Éa b".split()) for _ in range(200)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (None, "x y\x85z"), (6, "Ä b\x0bc\x1dd")]
    for k in range(60):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(200)] = "new"
        rows.append((10 + k, " ".join(w)))
    rows.append(rows[-1])
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    fp = {x: brute_fingerprint(x) for _, x in rows}
    root = {v: v for v in fp.values()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, x in rows:
        if i is not None:
            least[find(fp[x])] = min(i, least.get(find(fp[x]), 1 << 60))
    want = [(i, f"{fp[x]:016x}", least.get(find(fp[x]))) for i, x in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_covering_masks():
    masks = simhash.masks()
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_large_buckets_give_few_links(spark):
    base, rng = 0x0123456789ABCDEF, random.Random(1)
    fps = {base} | {base ^ 1 << a ^ 1 << b for a in range(62) for b in range(a)}
    fps = [x - (1 << 64) if x >> 63 else x for x in rng.sample(sorted(fps), 900)] + [base]
    links = simhash.covering_links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert links.count() < 40 * len(fps)
    roots = {r.root for r in connected_components(links).collect()}
    assert len(roots) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    model = quality.train(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    right = [got[i].predicted == q for i, q in held.items()]
    assert sum(right) / len(right) > 0.93
    odd = frame(spark, [(None, None), (1, ""), (1, ""), (2, "word " * 50_000)])
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.score_quality(odd.limit(0), model).count() == 0
    assert (quality.train(docs.limit(0), labels)[0] == 0).all()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(100, 400, 20), [5, 6] if y else [7, 8])), int(y)) for y in rng.integers(0, 2, 200)]
    model = quality.fit(rows)
    assert all((quality.score(model, x) >= 0.5) == y for x, y in rows)


def test_language_marginals_are_exact():
    rng = np.random.default_rng(1)
    crf = language.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    lengths = [1, 4, 3]
    scores = rng.normal(size=(8, 3))
    got, at = crf.marginals(scores, np.array(lengths)), 0
    for n in lengths:
        own, want = scores[at : at + n], np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            v = np.exp(sum(own[t, y[t]] for t in range(n)) + sum(crf.move[a, b] for a, b in itertools.pairwise(y))) * np.exp(crf.move[:, y[0]]).sum()
            for t in range(n):
                want[t, y[t]] += v
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n
    # across many segments: the same as one long plain pass
    n = 300
    scores = rng.normal(size=(n, 3))
    move, e = np.exp(crf.move), np.exp(scores)
    alpha, a = [], np.ones(3)
    for t in range(n):
        a = (a @ move) * e[t]
        a /= a.sum()
        alpha.append(a)
    b, want = np.ones(3), [None] * n
    for t in reversed(range(n)):
        want[t] = alpha[t] * b / (alpha[t] @ b)
        b = move @ (b * e[t])
        b /= b.sum()
    assert np.allclose(crf.marginals(scores, np.array([n])), want)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
    crf = language.train(docs.filter(f"NOT {held}"))
    rows = docs.filter(held).collect()
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, crf).collect()}
    assert sum(got[r.doc_id] == r.lang for r in rows) / len(rows) > 0.97
    odd = frame(spark, [(None, None), (1, ""), (1, "123 | ..."), (2, "the of and " * 30_000), (2, "the of and " * 30_000)])
    rows = language.identify(odd, crf).collect()
    assert sorted(r.lang_pred for r in rows) == ["en", "en", "und", "und", "und"]
    assert language.identify(odd.limit(0), crf).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(docs.limit(0))).collect()} == {"und"}


def test_code_switched_words_follow_their_passage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language.train(docs)
    text = {r.lang: r.text for r in docs.filter("n_chars between 900 and 2000").collect()}
    a, b = language.lettered(text["de"])[:60], language.lettered(text["es"])[:60]
    p = crf.marginals(crf.words(a + b), np.array([120])).argmax(1)
    want = np.array([crf.langs.index("de")] * 60 + [crf.langs.index("es")] * 60)
    assert (p == want).mean() > 0.9


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_sharding(spark, limit, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(60)) for i in range(120)] + [(None, None), (500, ""), (501, "y" * 900)] + [(7, "same" * 5)] * 30
    got = [tuple(r) for r in sharding.assign_shards(frame(spark, rows), limit=limit).collect()]
    assert sorted((i or -1, n) for i, n, *_ in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    size, count = {}, {}
    for _, n, s, _, _ in got:
        size[s], count[s] = size.get(s, 0) + n, count.get(s, 0) + 1
    assert all(size[s] == b and count[s] == c for _, _, s, b, c in got)
    assert all(b <= limit or c == 1 for _, _, _, b, c in got)
    shards = sorted(size)
    assert not any(y.startswith(x) for x, y in itertools.pairwise(shards))
    for s in shards:  # no bucket split that fitted
        if s:
            parent = [x for x in shards if x.startswith(s[:-1])]
            assert sum(size[x] for x in parent) > limit and sum(count[x] for x in parent) > 1
    assert sharding.assign_shards(frame(spark, rows).limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    directory = sharding.write_shards(docs, str(tmp_path / "out"), limit=100_000).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == len(directory) > 1


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 60, 12)) + 40 * int(y), int(y)) for y in rng.integers(0, 2, 120)]
    (r, w), bias = quality.fit(rows, epochs=2000)
    # the primal objective at the weights is no more than at any nearby point
    x = np.zeros((len(rows), 100))
    for i, (own, _) in enumerate(rows):
        v = r[own].astype(float)
        x[i, own] = v / np.sqrt(v @ v)
    y = np.array([2 * k - 1 for _, k in rows])
    n = [(y == -1).sum(), (y == 1).sum()]
    cost = np.array([len(rows) / (2 * n[(k + 1) // 2]) for k in y])
    value = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = value(w[:100].astype(float), bias)
    for _ in range(300):
        d = rng.normal(size=101) * rng.choice([1e-3, 1e-2, 0.1])
        assert best <= value(w[:100] + d[:100], bias + d[100]) + 1e-3
    assert not w[100:].any()


def test_sharded_files_hold_every_row_once(spark, tmp_path):
    rows = [(1, "a" * 30, "x"), (None, "b" * 40, "y"), (2, "c" * 50, "z"), (2, "d" * 60, "z"), (2, "d" * 60, "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    sharding.write_shards(df, str(tmp_path / "out"), limit=70)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "n_bytes").collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_write_shards_beside_columns_of_its_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, "text " * 5, f"own{i}", i, "r") for i in range(40)], "doc_id long, text string, shard string, __row int, bits string")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard_"}
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))


def test_a_dirty_label_column(spark):
    """600 labels for 600 rows: the most frequent are learned, in bounded time and memory."""
    clean = [(i, "the cat and the dog are here" if i % 2 else "el gato y el perro estan alli", "en" if i % 2 else "es") for i in range(60)]
    rows = clean + [(100 + i, f"word{i} and so on", f"junk{i:03}") for i in range(600)] + [(900, "x " * 400_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = language.train(docs, labels=8, size=1 << 20)
    assert {"en", "es"} < set(crf.langs) and len(crf.langs) == 8
    got = {r.doc_id: r.lang_pred for r in language.identify(docs.filter("doc_id < 10"), crf).collect()}
    assert got == {i: "en" if i % 2 else "es" for i in range(10)}
    assert len(language.train(docs).langs) == language.LABELS


def test_a_label_with_many_documents(spark):
    """An id that a hundred rows share is learned from once."""
    docs = spark.createDataFrame([(1, f"b text {i}") for i in range(100)] + [(1, "a text"), (2, None), (3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (3, 7), (3, None)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    try:
        quality.fit = lambda rows, *a, **k: seen.extend(rows) or real(rows, *a, **k)
        model = quality.train(docs, labels)
    finally:
        quality.fit = real
    assert len(seen) == 4 and quality.score_quality(docs, model).count() == 103
