"""Snapshots that can be restored, and the sweep of versions that nothing names."""

import pytest
from pyspark.sql import functions as F

from textloom.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"))


def table(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, status string")


def read(store, name, version=None):
    return [r.status for r in store.read(name, version).orderBy("id").collect()]


def test_restore(spark, store):
    store.commit({"a": table(spark, "pending", "done"), "b": table(spark, "x")})
    kept = store.snapshot(["a", "b"], "one", {"open": ("a", "status = 'pending'"), "all_b": ("b", "true")})
    assert kept["a"]["rows"] == 2 and kept["a"]["canaries"] == {"open": 1} and kept["b"]["canaries"] == {"all_b": 1}
    store.commit({"a": table(spark, "done", "done"), "c": table(spark, "new")})
    assert store.verify("one") and read(store, "a") == ["done", "done"]
    assert store.restore("one") == {"a": 1, "b": 1}
    assert read(store, "a") == ["pending", "done"] and read(store, "c") == ["new"]
    with pytest.raises(ValueError, match="no published version of zz"):
        store.snapshot(["a", "zz"])


def test_a_snapshot_that_was_changed_is_not_restored(spark, store):
    store.write("a", table(spark, "x", "y"))
    store.snapshot(["a"], "one")
    table(spark, "x", "z").write.mode("overwrite").parquet(f"{store.root}/a/v=1")  # as many rows
    store.write("a", table(spark, "w"))
    assert not store.verify("one")
    with pytest.raises(ValueError, match="not whole"):
        store.restore("one")
    assert read(store, "a") == ["w"]


def test_retention_sweeps_data(spark, store):
    for k in range(5):
        store.write("a", table(spark, f"v{k}"))
        if k < 3:
            store.snapshot(["a"], f"s{k}")
    table(spark, "failed").write.parquet(f"{store.root}/a/v=9")  # of a run that published nothing
    assert store.sweep(commit=False) == {"a": [4, 9]} and store.versions("a") == [1, 2, 3, 4, 5, 9]
    assert store.retain(2) == ["s0.json"] and store.snapshots() == ["s2", "s1"]
    assert store.versions("a") == [2, 3, 5] and store.verify("s1") and store.verify("s2") and read(store, "a") == ["v4"]


def test_a_crash_between_mark_and_sweep(spark, store, monkeypatch):
    for k in range(4):
        store.write("a", table(spark, f"v{k}"))
    store.snapshot(["a"], "kept")
    real, calls = Store._remove, []

    def cut_off(self, t, v):
        if calls:
            raise OSError("lost")
        calls.append(v)
        real(self, t, v)

    monkeypatch.setattr(Store, "_remove", cut_off)
    with pytest.raises(OSError, match="lost"):
        store.sweep()
    monkeypatch.setattr(Store, "_remove", real)
    assert store.versions("a") == [2, 3, 4] and read(store, "a") == ["v3"]
    # what is named in between stays
    store.publish("a", 2)
    assert store.sweep() == {"a": [3]} and read(store, "a") == ["v1"] and store.verify("kept") and store.versions("a") == [2, 4]


def test_a_step_is_published_once(spark, store):
    add = lambda n: store.commit({}, {"a": table(spark, f"s{n}").withColumn("id", F.lit(n).cast("long"))}, step=("job", n))
    assert store.done("job") == -1
    add(0), add(1), add(1), add(0)
    assert read(store, "a") == ["s0", "s1"] and store.done("job") == 1 and store.published() == {"a": 2}
