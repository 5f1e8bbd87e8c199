"""Operators 11 and 13 against brute force in Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import vector_codes, voronoi


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale, width):
    return [math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v))


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, lab) for i, v, lab in rows if usable(v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    part = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = [[q[p * part : (p + 1) * part] for p in range(parts)] for q in (whole(v, scale, width) for _, v, _ in kept)]
    books = [[list(r[p]) for r in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda a, book: min((far(a, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(r[p], books[p])[1] for r in x]
            for e in range(len(books[p])):
                if mine := [r[p] for r, o in zip(x, own) if o == e]:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, lab), r in zip(kept, x):
        found = [near(a, books[p]) for p, a in enumerate(r)]
        error = sum(d for d, _ in found)
        out.append([i, "".join(f"{e:02x}" for _, e in found), error, lab])
        by_label[lab] = by_label.get(lab, 0) + error
    fit = lambda e: e if e < 1 << 63 else None
    wide = {lab for *_, e, lab in out if fit(e) is None}
    return [(i, c, fit(e), None if lab in wide else fit(by_label[lab]), digest) for i, c, e, lab in out]


def check_codes(spark, rows, **how):
    df = spark.createDataFrame([(i, v, lab, "clash", 0) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    order = lambda r: [str(x) for x in r]
    got = sorted(map(tuple, vector_codes.encode(df.repartition(3), **how).collect()), key=order)
    assert got == sorted(codes_by_hand(rows, **how), key=order)


def cloud(n, d, seed, spread=0.3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(5, d))
    return [(i, (centre[i % 5] + spread * r.normal(size=d)).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def test_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 400)
    check_codes(spark, cloud(240, 16, 1))


def test_codes_of_odd_rows(spark):
    rows = cloud(40, 16, 2)
    same = rows[3][1]
    rows += [(100, None, 1), (101, [1.0, None] * 8, 1), (102, [math.nan] * 16, 1), (103, [math.inf] * 16, 2), (104, [], 2), (105, [0.5] * 3, 2), (None, [0.25] * 16, None)]
    rows += [(3, same, 1)] * 3 + [(3, [-x for x in same], 1)] + [(200 + i, same, 5) for i in range(60)] + [(-5, [-1e-9] * 16, 0), (-4, [1e-9] * 16, 0)]
    check_codes(spark, rows)


def test_codes_of_large_numbers(spark):
    rows = cloud(30, 8, 3) + [(50, [1e6] * 8, 1), (51, [3e9, -3e9] * 4, 1), (52, [1e30] * 8, 2), (53, [-1.7e308] + [0.0] * 7, 4), (54, [1e5] * 8, 6)]
    check_codes(spark, rows)


def test_codes_of_small_tables(spark):
    for n in (0, 1, 5):
        check_codes(spark, cloud(n, 16, 4))
    check_codes(spark, [(1, [], 1), (2, [], 1)])
    check_codes(spark, cloud(60, 10, 5), parts=4, entries=3, rounds=2, scale=10)


def test_exponion_is_exact_with_ties():
    r = np.random.default_rng(6)
    for _ in range(200):
        x, c = r.integers(-3, 4, (30, 2)), r.integers(-3, 4, (r.integers(1, 12), 2))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best, least = vector_codes.nearest_entries(x, c, r.integers(0, len(c), 30))
        assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def search_by_hand(rows, every, k=5, scale=256):
    kept = [(i, v) for i, v in rows if i is not None and usable(v)]
    width = max((len(v) for _, v in kept), default=0)
    cut = lambda q: [max(-(1 << 58), min(1 << 58, c)) for c in q]
    x = [(i, cut(whole(v, scale, width))) for i, v in kept]
    first = {}
    for i, v in sorted(kept, key=lambda r: list(r[1]), reverse=True):
        first[i] = cut(whole(v, scale, width))
    out = []
    for i, q in first.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, y)), j) for j, y in x if j != i)[:k]
            out += [(i, r, j, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, j) in enumerate(best, 1)]
    return sorted(out, key=lambda r: r[:2])


def check_search(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, cell string")
    got = sorted(map(tuple, voronoi.search(df.repartition(3), f"vec_id % {every} = 0", k).collect()), key=lambda r: r[:2])
    assert got == search_by_hand(rows, every, k)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 300)
    monkeypatch.setattr(voronoi, "CHUNK", 1000)
    monkeypatch.setattr(voronoi, "PART", 7)
    check_search(spark, [r[:2] for r in cloud(300, 12, 1)])


def test_search_of_odd_rows(spark):
    rows = [r[:2] for r in cloud(60, 8, 2)]
    same = rows[3][1]
    rows += [(100, None), (105, [1.0, None] * 4), (110, [math.nan] * 8), (115, [math.inf] * 8), (120, []), (125, [0.5] * 3), (None, [0.25] * 8), (130, [0.0] * 8)]
    rows += [(3, same)] * 4 + [(5, [9.0] * 8), (5, [-9.0] * 8), (-10, [-1e-9] * 8)] + [(200 + i, same) for i in range(50)]
    check_search(spark, rows)


def test_search_of_large_numbers(spark):
    small = [r[:2] for r in cloud(20, 8, 3)]
    for top in (3e3, 1e6, 1e10, 1e200):
        check_search(spark, small + [(50, [top] * 8), (55, [-top, top] * 4), (56, [top] + [0.0] * 7)])


def test_search_of_small_tables(spark):
    for n in (0, 1, 3):
        check_search(spark, [r[:2] for r in cloud(n, 4, 4)])
    check_search(spark, [(1, [1.0]), (2, [2.0])])
    check_search(spark, [(5, []), (10, [])])


def test_search_leaves_out_what_is_far(spark, monkeypatch):
    """Groups that lie far apart: most vectors go to one group of queries only, and the answers are whole."""
    made, real = [], voronoi._copies
    monkeypatch.setattr(voronoi, "discard", lambda df: None)  # the copies are read again
    monkeypatch.setattr(voronoi, "_copies", lambda *a: made.append(real(*a)) or made[-1])
    r = np.random.default_rng(9)
    centre = 5 * np.eye(8)
    rows = [(i, (centre[i % 8] + 0.02 * r.normal(size=8)).tolist()) for i in range(800)]
    check_search(spark, rows)
    copied = sum(len(x.ids) // 8 for x in made[0].select("ids").collect())
    groups = made[0].select("cell", "part").distinct().count()
    assert groups >= 8 and copied < 0.7 * groups * len(rows)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_exact_top_k"])
def test_registered_queries(spark, sf_dir, name):
    from textloom.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, queries()[name](spark, sf_dir).collect()))
    assert got == (search_by_hand([r[:2] for r in rows], 50) if name == "op13_exact_top_k" else sorted(codes_by_hand(rows)))
