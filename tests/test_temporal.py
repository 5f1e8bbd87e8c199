import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, temporal

T0 = dt.datetime(2024, 1, 1)


def made(seed, n, spread, keys="ab"):
    r = random.Random(seed)
    return [(i, r.choice(keys) if r.random() > 0.05 else None, T0 + dt.timedelta(seconds=r.randrange(-spread, spread))) for i in range(n)]


@pytest.mark.parametrize(("width", "within"), [(7, None), (100, 30), (10**9, None)])
def test_as_of(spark, width, within):
    left, right = made(1, 80, 300), made(2, 40, 300)
    left.append((99, "a", None))
    a = spark.createDataFrame(left, "id int, k string, ts timestamp")
    b = spark.createDataFrame([(i, k, t, i % 3) for i, k, t in right] + [(90, "a", None, 1)], "rid int, k string, at timestamp, v int")
    got = temporal.as_of(a, b, ["k"], "ts", "at", ["rid", "v"], width, within)
    want = {}
    for i, k, t in left:
        best = max(((u, j) for j, q, u in right if k is not None and q == k and t is not None and u <= t and (within is None or t - u <= dt.timedelta(seconds=within))), default=None)
        want[i] = (best[1], best[1] % 3, best[0]) if best else (None, None, None)
    assert {r.id: (r.rid, r.v, r["at"]) for r in got.collect()} == want and got.columns == ["id", "k", "ts", "at", "rid", "v"]


def test_a_hot_key_is_spread_over_its_bins(spark):
    e = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), "id")
    right = e.filter("id % 1000 = 0").select("k", F.col("ts").alias("at"), F.col("id").alias("rid"))
    got = temporal.as_of(e, right, ["k"], "ts", "at", ["rid"], width=3600)
    assert got.filter("rid <> id - id % 1000").count() == 0 and got.count() == 20_000


def test_in_intervals(spark):
    r = random.Random(3)
    points = made(4, 60, 1000)
    spans = [(i, k, t, t + dt.timedelta(seconds=r.choice([0, -5, 1, 3, 50, 4000]))) for i, k, t in made(5, 50, 1000)] + [(70, "a", T0, None), (71, "b", T0 - dt.timedelta(days=900), T0 + dt.timedelta(days=900)), (72, "b", T0, T0 + dt.timedelta(microseconds=1))]
    p = spark.createDataFrame([*points, (80, "b", T0)], "id int, k string, ts timestamp")
    i = spark.createDataFrame(spans, "iv int, k string, s timestamp, e timestamp")
    got = temporal.in_intervals(p, i, ["k"], "ts", "s", "e")
    want = sorted((a, b) for a, k, t in [*points, (80, "b", T0)] for b, q, s, e in spans if k == q and k is not None and e is not None and s <= t < e)
    assert sorted((x.id, x.iv) for x in got.collect()) == want and len(want) > 60


def test_walk(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("b", "d")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",), ("x",), ("z",), ("a",)], "id string")
    got = lambda n: sorted(map(tuple, graph.walk(edges, seeds, n).collect()))
    assert got(0) == [("a", "a", 0), ("x", "x", 0), ("z", "z", 0)]
    assert got(1) == [("a", "a", 0), ("a", "b", 1), ("x", "x", 0), ("x", "y", 1), ("z", "z", 0)]
    assert got(9) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("x", "x", 0), ("x", "y", 1), ("z", "z", 0)]
