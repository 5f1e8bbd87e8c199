"""Readers, the versioned store, dispatch, export checks and the review stream."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import files, store
from textloom.streaming import review_stream


def test_toml_corpus(spark, tmp_path):
    at = tmp_path / "corpus" / "zo" / "yasna-1"
    (at / "chunks").mkdir(parents=True)
    for i in (1, 2):
        (at / "chunks" / f"00{i}.toml").write_text(f'[chunk]\nid = "zo.yasna-1.00{i}"\ntradition = "Zo"\ntext_name = "Y"\nsection = "S{i}"\ntranslator = "T"\nsource_url = "u"\ntoken_count = {i}\n[content]\nbody = "b{i}"\n[annotations]\nconcepts = []\nrelated_chunks = []\n')
    (at / "metadata.toml").write_text('tradition = "Zo"\ntext_id = "yasna-1"\nchunk_count = 3\n')
    c = files.read_chunks(spark, str(tmp_path / "corpus"))
    assert sorted((r.id, r.token_count, r.body) for r in c.collect()) == [("zo.yasna-1.001", 1, "b1"), ("zo.yasna-1.002", 2, "b2")]
    t = files.read_texts(spark, str(tmp_path / "corpus")).first()
    assert (t.tradition_dir, t.text_id, t.text_name, t.chunk_count) == ("zo", "yasna-1", "yasna-1", 3)
    got = files.bodies_for(spark.createDataFrame([("zo.yasna-1.001",), ("no",)], "id string"), c)
    assert sorted((r.id, r.body) for r in got.collect()) == [("no", ""), ("zo.yasna-1.001", "b1")]


def test_raw_texts_and_fixtures(spark, tmp_path):
    for name, body in {"a-02.txt": "two", "a-01.txt": "one", "b.txt": "bee\nb"}.items():
        (tmp_path / name).write_text(body)
    raw = files.read_raw(spark, str(tmp_path / "*.txt"))
    assert sorted(tuple(r) for r in raw.collect()) == [("a", 1, "one"), ("a", 2, "two"), ("b", 0, "bee\nb")]
    assert {r.doc_id: r.text for r in files.join_pages(raw).collect()} == {"a": "one\n\ntwo", "b": "bee\nb"}
    (tmp_path / "x.json").write_text(json.dumps({"actions": [{"action": "accept", "id": 5}, {"action": "skip", "id": 6}]}))
    assert [r.id for r in files.read_actions(spark, str(tmp_path / "x.json")).collect()] == [5, 6]
    (tmp_path / "p.json").write_text(json.dumps({"works": [{"id": "w", "gated_by": "g"}]}))
    assert files.read_plan(spark, str(tmp_path / "p.json")).first().gated_by == "g"


def test_dispatch_and_links(spark):
    df = spark.createDataFrame([("http://www.gnosis.org/x", "html"), ("http://a.org/x", "html_multi"), ("http://a.org", "html"), ("http://notgnosis.org", "sefaria_api"), ("http://a.org", "pdf"), (None, None)], "url string, form string")
    assert [r.m for r in df.select(files.downloader(F.col("url"), F.col("form")).alias("m")).collect()] == ["gnosis_org", "sacred_texts", "generic_html", "sefaria", None, None]
    page = spark.createDataFrame([("http://a.org/t/index.htm", '<a href="one.htm"> <a href="/t/two.htm"> <a href="../up.htm"> <a href="http://b.org/t/x"> <a href="#top">')], "url string, html string")
    assert sorted(r.link for r in files.scoped_links(page).collect()) == ["http://a.org/t/one.htm", "http://a.org/t/two.htm"]
    page = spark.createDataFrame([("http://a.org/t/", "<a href='three.htm#x'> <A HREF = four.htm> <a class=b href=five.htm> <a href=''> <a href='#y'> <a href=six.htm#z>")], "url string, html string")
    assert sorted(r.link.rpartition("/")[2] for r in files.scoped_links(page).collect()) == ["five.htm", "four.htm", "six.htm", "three.htm"]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.current("t") is None
    with pytest.raises(ValueError, match="no published"):
        s.read("t")
    assert s.write("t", spark.range(3)) == 1 and s.write("t", spark.range(5), publish=False) == 2
    assert s.read("t").count() == 3 and s.read("t", 2).count() == 5
    s.publish("t", 2)
    assert s.read("t").count() == 5 and s.append("t", spark.range(2)) == 3 and s.read("t").count() == 7
    for k in "abc":
        pinned = s.snapshot(["t"], k)["t"]
        assert (pinned["version"], pinned["rows"]) == (3, 7)
    assert s.verify("a") and len(s.retain(2)) == 1 and s.retain(2) == []


def test_export(spark):
    summ, emb = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a",)], "id string")
    runs = lambda *r: spark.createDataFrame([r], "run_id long, generated_at string, limit_concepts int, edge_rows int")
    store.check_export(summ, emb, runs(1, "2026-01-02", None, 5), "2026-01-01")
    for bad in ((summ, emb.limit(0), runs(1, "x", None, 5)), (summ, emb, runs(1, "x", 3, 5)), (summ, emb, runs(1, "x", None, 0)), (summ, emb, runs(1, "2025", None, 5), "2026")):
        with pytest.raises(store.ExportRefused):
            store.check_export(*bad)
    ddl = "\n".join(store.index_ddl("corpus_new"))
    assert "USING hnsw (embedding vector_cosine_ops)" in ddl and ddl.count("INDEX") == 10 and "WHERE is_primary" in ddl
    assert all("corpus_new" in x for x in store.grant_ddl("corpus_new", "reader"))


def test_stream_applies_each_action_once(spark, tmp_path):
    schema = "client_action_id string, target_id long, created_at timestamp"
    src = tmp_path / "in"
    for k in range(3):
        rows = [(f"c{i}", i, f"2026-01-01 00:0{k}:00") for i in range(4 + k)]
        spark.createDataFrame(rows, "client_action_id string, target_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at")).coalesce(1).write.mode("append").parquet(str(src))
    seen = []
    live = review_stream.deduplicated(review_stream.read_actions(spark, str(src), schema))
    q = review_stream.apply_batches(live, lambda b, epoch: seen.extend(r.client_action_id for r in b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(seen) == [f"c{i}" for i in range(6)]
