"""Span plans against a plain fold: bins of few tokens, giants, empty chunks, members, a long work."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import spans

CHUNK = "work string, member string, seq long, token_count long"


def fold(rows, target, by_member):
    out, state = [], {}
    for w, m, s, t in sorted(rows, key=lambda r: (str(r[0]), str(r[1]) if by_member else "", r[2], r[3] or 0)):
        t = max(t or 0, 0)
        last = state.get(w)
        if last is None or last["tokens"] + t > target or (by_member and last["member"] != m):
            state[w] = last = {"work": w, "member": m, "span": 1 + (last["span"] if last else 0), "first_seq": s, "last_seq": s, "chunks": 0, "tokens": 0}
            out.append(last)
        last.update(last_seq=s, chunks=last["chunks"] + 1, tokens=last["tokens"] + t)
    keys = ["work", *(["member"] if by_member else []), "span", "first_seq", "last_seq", "chunks", "tokens"]
    return sorted((tuple(r[k] for k in keys) for r in out), key=str)


def made(seed):
    r = random.Random(seed)
    rows = []
    for w in ("a", "b", None):
        for s in range(r.randrange(1, 150)):
            rows.append((w, r.choice(["m1", "m2"]), s, r.choice([0, 1, 5, 9, 10, 11, r.randrange(30), 200 if r.random() < 0.05 else 3, None, -4])))
    return rows + [("one", "m", 1, 5), ("giant", "m", 1, 9_000), ("giant", "m", 2, 9_000), ("giant", "m", 3, 1)]


@pytest.mark.parametrize(("width", "large"), [(1, 10), (3, 1_000_000), (512, 10)])
def test_like_a_fold(spark, monkeypatch, width, large):
    monkeypatch.setattr(spans, "BIN_SPANS", width)
    monkeypatch.setattr(spans, "LARGE", large)
    rows = made(width + large)
    df = spark.createDataFrame(rows, CHUNK)
    for by_member in (False, True):
        got = spans.span_plan(df, 20, member="member" if by_member else None)
        assert sorted(map(tuple, got.collect()), key=str) == fold(rows, 20, by_member)


def test_a_work_of_200000_chunks(spark, monkeypatch):
    """Numbered by ranges, packed by bins: no task holds more than a bin and a span of the next."""
    monkeypatch.setattr(spans, "LARGE", 100_000)
    df = spark.range(200_000).select(F.lit("w").alias("work"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(400))).alias("token_count"))
    rows = [("w", None, r.seq, r.token_count) for r in df.collect()]
    plan = spans.span_plan(df, 6000)
    assert sorted(map(tuple, plan.collect()), key=str) == fold(rows, 6000, False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "CoGroup" in text


def test_a_frozen_plan(spark, tmp_path):
    rows = made(7)
    plan = spans.span_plan(spark.createDataFrame(rows, CHUNK).filter("work IS NOT NULL"), 20)
    digest = spans.freeze(plan, str(tmp_path / "plan"), 20)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "plan/spans")).collect()]
    assert {r["plan_hash"] for r in got} == {digest} and len(got) == plan.count()
    lines = [r.value for r in spark.read.text(str(tmp_path / "plan/summary")).collect()]
    assert digest in lines[0] and "| one | 1 | 5 | degenerate |" in lines and len(lines) == 6 + plan.select("work").distinct().count()
    with pytest.raises(Exception, match="already exists"):
        spans.freeze(plan, str(tmp_path / "plan"), 20)


def test_empty(spark):
    assert spans.span_plan(spark.createDataFrame([], CHUNK)).collect() == []
