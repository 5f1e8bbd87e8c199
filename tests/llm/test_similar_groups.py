"""Pipeline stage 2 against brute-force Jaccard over five-word shingles."""

import random

import corpus_pipeline as cp
from textloom.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, least=0.8):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return sorted(i for i in group if group[i] == i), links


def texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 600]))]
        rows.append((i, " ".join(base)))
        for j in range(4):  # copies with some words changed: similarity from about 0.5 to 1
            own = list(base)
            for _ in range(max(1, len(own) * j // 100)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + 10 * i + j, " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "One TWO three"), (904, "one two  three")]


def test_stage_is_brute_force_jaccard(spark, sf_dir):
    rows = texts()
    extra = [(None, rows[0][1], "en", "s", 0), (None, "alone without any id " * 9, "en", "s", 0), (0, "another text of the same id " * 9, "en", "s", 0), (0, rows[0][1], "de", "a", 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows] + extra, "doc_id long, text string, lang string, source string, n_chars int")
    want, links = brute(rows)
    assert len(links) > 100
    left = cp.drop_near_duplicates(spark, docs, sf_dir).collect()
    got = sorted((r.doc_id, r.text[:7] if r.text else "") for r in left if r.doc_id is not None)
    assert [i for i, _ in got] == sorted([*want, 0]) and (0, "another") in got
    assert [r.lang for r in left if r.text == rows[0][1]] == ["de"]
    assert [r.text[:5] for r in left if r.doc_id is None] == ["alone"]


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 20_000)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(250):  # one large group whose texts are from about 0.4 to 0.95 alike
        own = list(base)
        for _ in range(rng.randint(1, 12)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    want, _ = brute(rows)
    got = simhash.similar_groups(docs).collect()
    assert sorted({r["first"].doc_id for r in got}) == want and len(got) == len(rows)


def test_stage_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect()) == want
    assert cp.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0
