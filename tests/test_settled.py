"""The review queue as a stateful stream: crashes, repeats, late actions, and the same tables as one batch."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import review
from textloom.sources.store import Store
from textloom.streaming import settled

TAG = "id long, chunk_id string, concept_id string, score int, is_new_concept boolean, new_concept_def string, status string, model string, reviewed_by string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()


def first_tables(spark):
    return {
        "staged_tags": spark.createDataFrame([(i, f"c{i % 4}", f"k{i % 3}", 1 + i % 3, i % 5 == 0, f"about {i}", "pending" if i % 6 else "accepted", "m", None) for i in range(24)], TAG),
        "staged_edges": spark.createDataFrame([(i, f"a{i}", f"b{i}", "PARALLELS", 0.9, "pending", "proposed") for i in range(5)], "id long, source_chunk string, target_chunk string, edge_type string, confidence double, status string, tier string"),
        "staged_cleanups": spark.createDataFrame([(i, f"x{i}", i % 2 == 0, "pending", "body") for i in range(4)], "id long, chunk_id string, words_preserved boolean, status string, original_body string"),
        "edges": spark.createDataFrame([("c1", "concept.k1", "EXPRESSES", "verified")], "source_id string, target_id string, type string, tier string"),
        "nodes": spark.createDataFrame([], "id string, type string, label string, definition string"),
        "review_actions": spark.createDataFrame([], settled.ACTION + ", applied_at string"),
    }


def made(n=40):
    r = random.Random(4)
    rows = []
    for i in range(n):
        table = r.choice(["tag", "tag", "tag", "edge", "cleanup"])
        verb = r.choice(review.VERBS[table])
        kind = {"edge": "CONTRASTS", "cleanup": "apparatus_drop"}.get(table)
        rows.append((i, table, r.randrange({"tag": 26, "edge": 6, "cleanup": 4}[table]), verb, "z" if verb == "reassign" else None, kind if verb == "reclassify" else None, f"r{i}", f"u{i}"))
    return rows


def put(spark, folder, rows, at, name):
    """One file that arrives ``at`` seconds after the beginning."""
    spark.createDataFrame(rows, settled.ACTION).coalesce(1).write.mode("overwrite").parquet(f"{folder}.new")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(f"{folder}.new") if f.endswith(".parquet"))
    os.rename(f"{folder}.new/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (T0 + at, T0 + at))


def content(store):
    shown = {"staged_tags": ["id", "concept_id", "status", "reviewed_by"], "staged_edges": ["id", "edge_type", "status", "tier"], "staged_cleanups": ["id", "status"], "edges": ["source_id", "target_id", "type", "tier"], "nodes": ["id", "definition"]}
    return {t: sorted(map(str, store.read(t).select(*c).collect())) for t, c in shown.items()}


@pytest.fixture
def quick(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_killed_between_batches_and_run_again(spark, tmp_path, quick):
    acts = made()
    want = Store(spark, str(tmp_path / "batch"))
    want.commit(first_tables(spark))
    log = spark.createDataFrame(acts, settled.ACTION).withColumn("applied_at", F.lit(None).cast("string"))
    review.apply_batch(want, F.lit("now"), commit=True, queue=review.enqueue(want.read("review_actions"), log)[0])

    got, folder, ck = Store(spark, str(tmp_path / "stream")), str(tmp_path / "in"), str(tmp_path / "ck")
    got.commit(first_tables(spark))
    put(spark, folder, acts[::2], 0, "a")
    put(spark, folder, acts[1::2] + acts[:4], 5, "b")  # the same targets again, and repeats
    put(spark, folder, [(1000, "tag", 500, "skip", None, None, "r", "end")], 500, "c")  # all others are quiet by now

    commit, fail = got.commit, {"before": 1, "after": 1}

    def lost(*a, **b):
        if fail["before"]:
            fail["before"] = 0
            raise OSError("lost before the commit")
        out = commit(*a, **b)
        if fail["after"]:
            fail["after"] = 0
            raise OSError("lost after the commit")
        return out

    got.commit = lost
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            settled.run(settled.read_arriving(spark, folder), got, ck, quiet=60).awaitTermination()
    versions = got.published()
    settled.run(settled.read_arriving(spark, folder), got, ck, quiet=60).awaitTermination()
    assert fail == {"before": 0, "after": 0} and got.published() == versions  # the batch that ran again changed nothing
    assert content(got) == content(want)
    said = {r.client_action_id: r.outcome for r in got.read("review_outcomes").filter("outcome <> 'duplicate'").collect()}
    assert set(said) == {a[-1] for a in acts} and said["u0"] in ("queued", "already resolved", "unknown target")
    assert got.read("review_outcomes").filter("outcome = 'duplicate'").count() == 4
    progress = got.read("stream_progress").collect()
    assert len(progress) == 1 and progress[0].actions == 44

    # an action made before all others that arrives after them is not dropped, and finds its target resolved
    done = next(a for a in acts if said[a[-1]] == "queued" and a[1] == "edge" and a[3] in ("accept", "reject"))
    put(spark, folder, [(-1, "edge", done[2], "accept", None, None, "late", "late")], 600, "d")
    put(spark, folder, [(1001, "tag", 500, "skip", None, None, "r", "end2")], 900, "e")
    settled.run(settled.read_arriving(spark, folder), got, ck, quiet=60).awaitTermination()
    late = {r.client_action_id: r.outcome for r in got.read("review_outcomes").collect()}
    assert late["late"] == "already resolved" and content(got) == content(want)


def test_poll(spark, tmp_path, quick):
    s = Store(spark, str(tmp_path / "db"))
    s.commit({"nodes": spark.range(3), "edges": spark.range(5)})
    q = settled.poll(spark, s, ["nodes", "edges", "none"], str(tmp_path / "ck"), every="1 second")
    end = time.time() + 60
    while time.time() < end and s.done("poll") < 2:
        time.sleep(0.5)
    q.stop()
    rows = s.read("table_stats").collect()
    assert {(r.table, r["rows"], r.version) for r in rows} == {("nodes", 3, 1), ("edges", 5, 1)} and len({r.poll for r in rows}) >= 2
