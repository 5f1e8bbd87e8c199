"""Chunk files: dry run, commit, abort, recovery, and rereading what has changed."""

import os
import tomllib

import pytest
from pyspark.sql import functions as F

from textloom.sources import chunk_writer, files
from textloom.sources.store import Store

ODD = 'a "quote", a \\ and\ttabs\n\nünï \x7f\x01 end'
ROW = "id string, tradition string, section string, body string, concepts array<string>"


def chunks(spark, *rows):
    return spark.createDataFrame([(i, "T", "s", b, ["k"]) for i, b in rows], ROW)


def actions(df):
    return {r.id: r.action for r in df.collect()}


def all_files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_written_files_read_back(spark, tmp_path):
    root = str(tmp_path / "corpus")
    new = chunks(spark, ("t.a.001", ODD), ("t.a.002", ""), ("t.b.001.x", "two"))
    assert actions(chunk_writer.write_chunks(new, root)) == dict.fromkeys(["t.a.001", "t.a.002", "t.b.001.x"], "create")
    assert not os.path.exists(root)  # a plan writes nothing
    plan = chunk_writer.write_chunks(new, root, commit=True)
    assert {r.path for r in plan.collect()} == set(all_files(root)) == {"t/a/chunks/001.toml", "t/a/chunks/002.toml", "t/b/chunks/001.x.toml"}
    back = {r.id: r for r in files.read_chunks(spark, root).collect()}
    assert back["t.a.001"].body == ODD and back["t.a.001"].token_count == len(ODD) // 4 and back["t.a.002"].body == "" and back["t.b.001.x"].concepts == ["k"]
    before = os.stat(f"{root}/t/a/chunks/001.toml").st_mtime_ns
    again = chunks(spark, ("t.a.001", ODD), ("t.b.001.x", "three"), ("t.c.1", "new"))
    assert actions(chunk_writer.write_chunks(again, root, commit=True)) == {"t.a.001": "same", "t.b.001.x": "replace", "t.c.1": "create"}
    assert os.stat(f"{root}/t/a/chunks/001.toml").st_mtime_ns == before
    assert {r.id: r.body for r in files.read_chunks(spark, root).collect()} == {"t.a.001": ODD, "t.a.002": "", "t.b.001.x": "three", "t.c.1": "new"}


def test_an_aborted_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "corpus")
    chunk_writer.write_chunks(chunks(spark, ("t.a.001", "one")), root, commit=True)
    bad = chunks(spark, *[(f"t.a.{i:03}", "changed") for i in range(1, 30)], ("t...", "no id")).repartition(3)
    spark.dataSource.register(chunk_writer.ChunkFiles)
    with pytest.raises(Exception, match="not the id of a chunk"):
        bad.write.format("textloom_chunks").mode("append").save(root)
    assert all_files(root) == ["t/a/chunks/001.toml"] and os.listdir(root) == ["t"]
    assert tomllib.load(open(f"{root}/t/a/chunks/001.toml", "rb"))["content"]["body"] == "one"


def test_recovery_after_a_crash(tmp_path):
    root = str(tmp_path / "corpus")
    os.makedirs(root)
    w = chunk_writer._Writer(root)

    class R(dict):
        asDict = dict.copy

    ended, lost = w.write([R(id="t.a.001", body="x"), R(id="t.a.002", body="y")]), w.write([R(id="t.a.003", body="an attempt that was run again")])
    begun = f"{root}/_staging/{w.run}"
    with open(f"{begun}/commit.json", "w") as f:
        f.write(f'["{ended.attempt}"]')
    os.makedirs(f"{root}/t/a/chunks")
    os.rename(f"{begun}/{ended.attempt}/t/a/chunks/001.toml", f"{root}/t/a/chunks/001.toml")  # the crash came after the first move
    other = chunk_writer._Writer(root)
    other.write([R(id="t.b.001", body="never committed")])
    assert chunk_writer.recover(root) == {"ended": 1, "thrown away": 1} and lost.files == 1
    assert all_files(root) == ["t/a/chunks/001.toml", "t/a/chunks/002.toml"] and chunk_writer.recover(root) == {"ended": 0, "thrown away": 0}


@pytest.mark.parametrize("named", [10_000, 1])
def test_only_changed_files_are_parsed(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(chunk_writer, "NAMED", named)
    root, s = str(tmp_path / "corpus"), Store(spark, str(tmp_path / "db"))
    chunk_writer.write_chunks(chunks(spark, *[(f"t.a.{i}", f"b{i}") for i in range(6)]), root, commit=True)
    assert chunk_writer.refresh_bodies(spark, s, root) == {"parsed": 6, "kept": 0, "gone": 0}
    assert chunk_writer.refresh_bodies(spark, s, root) == {"parsed": 0, "kept": 6, "gone": 0} and s.versions("chunk_bodies") == [1]
    chunk_writer.write_chunks(chunks(spark, ("t.a.2", "longer now"), ("t.a.9", "b9")), root, commit=True)
    same = f"{root}/t/a/chunks/3.toml"
    text = open(same).read().replace("b3", "c3")  # as long as before, but newer
    with open(same, "w") as f:
        f.write(text)
    os.utime(same, (2e9, 2e9))
    os.remove(f"{root}/t/a/chunks/5.toml")
    assert chunk_writer.refresh_bodies(spark, s, root) == {"parsed": 3, "kept": 3, "gone": 1}
    want = {"t.a.0": "b0", "t.a.1": "b1", "t.a.2": "longer now", "t.a.3": "c3", "t.a.4": "b4", "t.a.9": "b9"}
    assert {r.id: r.body for r in s.read("chunk_bodies").collect()} == want
    ids = spark.createDataFrame([("t.a.3",), ("t.a.5",)], "id string")
    assert {r.id: r.body for r in files.bodies_for(ids, s.read("chunk_bodies")).collect()} == {"t.a.3": "c3", "t.a.5": ""}


def test_changes_are_planned_first(spark, tmp_path):
    from textloom.operators import mutators

    s = Store(spark, str(tmp_path / "db"))
    s.commit({
        "staged_tags": spark.createDataFrame([(1, "c1", "k", "accepted"), (2, "c2", "j", "accepted")], "id long, chunk_id string, concept_id string, status string"),
        "staged_edges": spark.createDataFrame([(1, "a", "b", "PARALLELS", 0.9, "pending", "proposed"), (2, "a", "c", "PARALLELS", 0.2, "pending", "proposed")], "id long, source_chunk string, target_chunk string, edge_type string, confidence double, status string, tier string"),
        "edges": spark.createDataFrame([("c1", "concept.k", "EXPRESSES", "verified")], "source_id string, target_id string, type string, tier string"),
        "nodes": spark.createDataFrame([("concept.k",), ("concept.j",)], "id string"),
        "concept_aliases": spark.createDataFrame([], "alias string, concept_id string"),
    })
    alias = spark.createDataFrame([("j", "concept.k")], "alias string, canonical string")
    before = s.published()
    runs = {"repair": lambda c: mutators.repair_edges(s, commit=c), "promote": lambda c: mutators.auto_promote(s, commit=c), "merge": lambda c: mutators.merge_concepts(s, alias, commit=c)}
    assert runs["repair"](False) == {"plan": [("edges", "added", 1)], "versions": {}} and s.published() == before
    assert runs["repair"](True)["plan"] == [("edges", "added", 1)] and runs["repair"](True)["plan"] == []
    assert runs["promote"](True)["plan"] == [("edges", "added", 1), ("staged_edges", "changed", 1)]
    assert runs["merge"](False)["plan"] == [("concept_aliases", "added", 1), ("edges", "added", 1), ("edges", "removed", 1), ("nodes", "removed", 1), ("staged_tags", "changed", 1)]
    runs["merge"](True)
    assert s.read("edges").filter("target_id = 'concept.j'").count() == 0 and s.read("concept_aliases").first().alias == "j"
    assert s.read("edges").filter(F.col("target_id") == "concept.k").count() == 2


def test_many_changed_files_are_opened_by_name_and_no_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_writer, "NAMED", 1)
    root, s = str(tmp_path / "corpus"), Store(spark, str(tmp_path / "db"))
    chunk_writer.write_chunks(chunks(spark, *[(f"t.a b.{i}", f"b{i}") for i in range(300)]), root, commit=True)
    assert chunk_writer.refresh_bodies(spark, s, root)["parsed"] == 300
    broken = f"{root}/t/a b/chunks/7.toml"
    kept = os.stat(broken)
    with open(broken, "r+b") as f:
        f.write(b"?")  # as old and as long as before: nobody opens it
    os.utime(broken, ns=(kept.st_atime_ns, kept.st_mtime_ns))
    for i in range(20, 40):
        with open(f"{root}/t/a b/chunks/{i}.toml", "a") as f:
            f.write("\n")
    assert chunk_writer.refresh_bodies(spark, s, root) == {"parsed": 20, "kept": 280, "gone": 0}
    assert files.read_chunk_files(spark, [f"{root}/t/a b/chunks/8.toml"]).first().body == "b8"
    scan = files.small_files(spark, f"{root}/t/a b", "*.toml")
    assert scan.rdd.getNumPartitions() <= files.many(spark)


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    root = tmp_path / "cor pus"
    names = ["top.toml", "t/a/chunks/1.toml", "t/a/chunks/ü 2%20.toml", "t/a/chunks/deep/er/3.toml", "t/a/metadata.toml", "t/a/chunks/1.txt", "t/_x/chunks/4.toml", "t/_x=1/chunks/5.toml", "t/.h/chunks/6.toml", "_staging/r/t/a/chunks/7.toml", "t/a/chunks/_8.toml", "t/a/chunks/9.toml._COPYING_"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f'[chunk]\nid = "{n}"\n')
    want = files.small_files(spark, str(root), "*.toml").select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).collect()
    one = files.small_files(spark, str(root), "*.toml").select("path", "content").filter(files.CHUNKS).select("path").collect()
    monkeypatch.setattr(files, "small_files", None)  # the driver's listing
    got = files.list_files(spark, str(root), ".toml")
    assert sorted(got.collect()) == sorted(want) and len(want) == 6 and got.schema["modified"].dataType.typeName() == "timestamp"
    assert sorted(r.path for r in files.read_chunks(spark, str(root)).collect()) == sorted(r.path for r in one)
    assert [r.text_id for r in files.read_texts(spark, str(root)).collect()] == ["a"]


def test_the_driver_holds_no_row_a_file(spark, tmp_path, monkeypatch):
    """Neither as a listing nor as a broadcast."""
    root, s = str(tmp_path / "corpus"), Store(spark, str(tmp_path / "db"))
    os.makedirs(root)
    plans, write = [], Store.write
    monkeypatch.setattr(files, "small_files", None)
    monkeypatch.setattr(chunk_writer, "NAMED", 1)
    monkeypatch.setattr(Store, "write", lambda self, t, df: plans.append(df) or write(self, t, df))
    chunk_writer.write_chunks(chunks(spark, *[(f"t.a{i % 3}.{i}", f"b{i}") for i in range(60)]), root, commit=True)
    assert chunk_writer.refresh_bodies(spark, s, root)["parsed"] == 60
    changed = chunks(spark, *[(f"t.a{i % 3}.{i}", f"c{i}") for i in range(20)])
    plans.append(chunk_writer.write_chunks(changed, root))
    chunk_writer.write_chunks(changed, root, commit=True)
    assert chunk_writer.refresh_bodies(spark, s, root) == {"parsed": 20, "kept": 40, "gone": 0}
    assert len(plans) == 3 and not any("Broadcast" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_a_commit_holds_the_names_of_one_folder(tmp_path):
    root = str(tmp_path / "corpus")
    w = chunk_writer._Writer(root)

    class R(dict):
        asDict = dict.copy

    done = [w.write([R(id=f"t.b{i}.{k}", body="x") for i in range(4) for k in range(5)]) for _ in range(2)]
    store, base, at = w._at()
    assert [len(names) for a in done for _, names in chunk_writer._folders(store, f"{at}/{a.attempt}")] == [5] * 8
    w.commit(done)
    assert len(all_files(root)) == 20
