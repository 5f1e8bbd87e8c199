"""Graph, table and review operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, parallels, review, spans, tables, vectors
from textloom.sources import store

TAG = "id long, chunk_id string, concept_id string, score int, is_new_concept boolean, new_concept_def string, status string, model string, reviewed_by string"
ACTION = "id long, target_table string, target_id long, action string, reassign_to string, reclassify_to string, reviewer string, client_action_id string, applied_at string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_chunk_ids(spark):
    df = spark.createDataFrame([("buddhism.diamond-sutra.003",), ("notvalid",), ("trad.text",), ("g.foo.bar.001",)], "id string")
    got = [r.r for r in df.select(graph.resolve_chunk_id(F.col("id")).alias("r")).collect()]
    assert tuple(got[0]) == ("buddhism", "diamond-sutra", "003") and got[1] is None and got[2] is None and tuple(got[3]) == ("g", "foo", "bar.001")


def test_bootstrap_and_concepts(spark):
    c = spark.createDataFrame([("zo.yasna-1.001", "Zoroastrianism", "One"), ("zo.yasna-2.001", "Zoroastrianism", "Two"), ("bad", "x", "y")], "id string, tradition string, section string")
    nodes, edges = graph.bootstrap(c)
    assert nodes.count() == 3 and edges.count() == 2
    assert graph.bootstrap(c, "yasna-2")[1].count() == 1 and graph.bootstrap(c, "none")[0].count() == 0
    n = spark.createDataFrame([("chunk-1", "chunk", "X"), ("concept.gnosis", "concept", "Gnosis")], "id string, type string, label string")
    e = spark.createDataFrame([("chunk-1", "concept.gnosis", "EXPRESSES")], "source_id string, target_id string, type string")
    assert rows(graph.concepts_for(e, n, n.select("id"))) == [("chunk-1", "gnosis", "Gnosis")]


def test_works(spark):
    t = spark.createDataFrame([("a", "A", "x"), ("b", "B", "x"), ("c", "C", "y"), ("z", "Z", "x"), ("own", "Own", "x")], "text_id string, text_name string, tradition string")
    d = spark.createDataFrame([("w", "W", "x", ["a", "b"]), ("v", "V", "x", ["b", "no-such-text"]), ("u", "U", "x", ["a", "c"]), ("q", "Q", "x", ["c"]), ("b", "B", "x", []), ("z", "Z", "x", ["a"]), ("own", "Own", "x", ["own"])], "id string, label string, tradition string, members array<string>")
    faults = {(r.work_id, r.fault) for r in graph.work_faults(t, d).collect()}
    assert {("v", "not in corpus"), ("u", "span traditions"), ("q", "wrong tradition"), ("z", "id is a text's")} <= faults
    # a work may be named like its own member, and like one that another work claims
    assert not {("own", "id is a text's"), ("b", "id is a text's")} & faults
    assert any(f == "claimed twice" for _, f in faults)
    got = rows(graph.works(t, d.filter("id = 'w'")), "work_id", "grouped")
    assert got == [("c", False), ("own", False), ("w", True), ("z", False)]
    assert rows(graph.work_of(graph.works(t, d.filter("id = 'w'")))) == [("a", "w"), ("b", "w"), ("c", "c"), ("own", "own"), ("z", "z")]


def test_remap(spark):
    body = lambda x: spark.createDataFrame(list(x.items()), "id string, body string")
    old, new = body({"001": "A", "002": "B", "003": "A", "004": "C"}), body({"001": "B ", "002": "A", "003": " A"})
    m = tables.match_by_body(old, new)
    assert dict(rows(m)) == {"001": "002", "002": "001", "003": "003", "004": None}
    assert tables.remap_faults(m, new).count() == 0
    assert rows(tables.remap_faults(m.filter("old_id <> '002'"), new)) == [("001", "unmapped")]
    refs = spark.createDataFrame([("001", "x"), ("004", "y"), ("zz", "004")], "a string, b string")
    moved = tables.rewrite_refs(refs, ["a", "b"], m)
    assert rows(moved) == [("002", "x")] and tables.residual(moved, ["a", "b"], spark.createDataFrame([("004",)], "id string")).count() == 0


def test_many_to_one_and_dedupe(spark):
    e = spark.createDataFrame([(1, "006", "t"), (2, "005", "t"), (3, "006", "u")], "id long, s string, t string")
    m = spark.createDataFrame([("006", "005")], "old string, new string")
    assert rows(tables.update_or_ignore(e, "s", m, ["s", "t"])) == [(2, "005", "t"), (3, "005", "u")]
    d = spark.createDataFrame([(1, "p", 1), (2, "p", 1), (3, "d", 1), (4, "d", 1)], "id long, st string, k long")
    assert rows(tables.dedupe_where(d, F.col("st") == "p", ["k"]), "id") == [(1,), (3,), (4,)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, label string, rest string")
    new = spark.createDataFrame([(2, "B", "Z"), (3, "c", "z")], "id long, label string, rest string")
    assert rows(tables.upsert(old, new, ["id"])) == [(1, "a", "x"), (2, "B", "Z"), (3, "c", "z")]
    assert rows(tables.insert_ignore(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert rows(tables.selective_upsert(old, new, ["id"], ["label"])) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert tables.missing_tables(spark, ["a", "b"], ["a"]) == ["b"]


def test_repair_and_rejects(spark):
    t = spark.createDataFrame([(1, "c1", "k", 3, False, None, "accepted", "m1", None), (2, "c1", "k", 2, False, None, "rejected", "m2", None), (3, "c2", "k", 2, False, None, "rejected", "m2", None), (4, "c3", "j", 2, False, None, "accepted", "m2", None)], TAG)
    e = spark.createDataFrame([("c3", "concept.j", "EXPRESSES", "verified")], "source_id string, target_id string, type string, tier string")
    assert rows(graph.missing_edges(t, e)) == [("c1", "concept.k")]
    assert graph.repair_edges(t, e).count() == 2
    assert rows(graph.redundant_rejects(t, "m2"), "id") == [(2,)]
    alias = spark.createDataFrame([("concept.j", "concept.k")], "alias string, canonical string")
    assert rows(graph.retarget_concept(e, alias), "target_id") == [("concept.k",)]


def test_parallels_and_concept_match(spark):
    x = spark.createDataFrame([("a", "k", "verified"), ("b", "k", "proposed"), ("c", "k", "inferred"), ("a", "j", "inferred"), ("b", "j", "verified")], "chunk_id string, concept_id string, tier string")
    t = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "chunk_id string, tradition string")
    assert rows(parallels.derived_parallels(x, t)) == [("a", "b", 1.1, "j,k"), ("b", "c", 0.4, "k")]
    q = spark.createDataFrame([("What is divine light?", "divine_light"), ("an ox", "of_ox"), ("lightning", "inner_light")], "q string, c string")
    assert [r.m for r in q.select(graph.concept_matches(F.col("q"), F.col("c")).alias("m")).collect()] == [True, False, True]


def test_spans(spark):
    c = spark.createDataFrame([("w", i, 2500) for i in range(5)] + [("v", 0, 9000)], "work string, seq long, token_count long")
    plan = spans.span_plan(c)
    assert rows(plan, "work", "span", "chunks", "tokens") == [("v", 1, 1, 9000), ("w", 1, 2, 5000), ("w", 2, 2, 5000), ("w", 3, 1, 2500)]
    assert rows(spans.plan_summary(plan), "work", "spans", "degenerate") == [("v", 1, True), ("w", 3, False)]
    assert spans.fold_spans(plan, 0).count() == 0 and spans.fold_spans(plan, 10_000).filter("work = 'w'").count() == 2
    assert spans.plan_hash(plan).first() == spans.plan_hash(plan.orderBy(F.desc("span"))).first()
    other = spans.span_plan(c.filter("seq < 4"))
    assert rows(spans.plan_diff(plan, other, ["work", "span"])) == [("w", 3, "removed")]


@pytest.fixture
def queue(spark):
    return spark.createDataFrame([], ACTION)


def actions(spark, *acts):
    return spark.createDataFrame([(i, t, x, a, r, k, "me", c, None) for i, (t, x, a, r, k, c) in enumerate(acts, 1)], ACTION)


def test_enqueue(spark, queue):
    new = actions(spark, ("tag", 1, "accept", None, None, "u1"), ("tag", 1, "accept", None, None, "u1"), ("tag", 1, "reclassify", None, "PARALLELS", "u2"), ("tag", 1, "reassign", None, None, "u3"), ("cleanup", 1, "reclassify", None, "PARALLELS", "u4"), ("tag", 99, "skip", None, None, "u5"), ("edge", 1, "reclassify", None, "unrelated", "u6"))
    there = spark.createDataFrame([("tag", 1), ("edge", 1), ("cleanup", 1)], "target_table string, target_id long")
    q, out = review.enqueue(queue, new, there)
    assert rows(out, "outcome", "client_action_id") == [("duplicate", "u1"), ("invalid", "u2"), ("invalid", "u3"), ("invalid", "u4"), ("queued", "u1"), ("queued", "u6"), ("unknown", "u5")]
    again, out = review.enqueue(q, new.filter("client_action_id = 'u1'").limit(1), there)
    assert again.count() == 2 and out.first().outcome == "duplicate"
    assert review.undo(q, "u1").count() == 1
    assert review.undo(review.mark_applied(q, F.lit("now")), "u1").count() == 2


def test_apply_tags(spark):
    t = spark.createDataFrame([(1, "c1", "k", 3, False, None, "pending", "m", None), (2, "c1", "j", 1, False, None, "pending", "m", None), (3, "c1", "n", 3, True, "new one", "pending", "m", None), (4, "c1", "s", 3, False, None, "pending", "m", None), (5, "c2", "k", 3, False, None, "pending", "m", None), (6, "c2", "k", 3, False, None, "accepted", "m2", None), (7, "c3", "k", 3, False, None, "pending", "m", None), (8, "c1", "q", 3, False, None, "pending", "m", None)], TAG)
    q = actions(spark, ("tag", 1, "accept", None, None, "a"), ("tag", 2, "accept", None, None, "b"), ("tag", 3, "accept", None, None, "c"), ("tag", 4, "skip", None, None, "d"), ("tag", 5, "reject", None, None, "e"), ("tag", 7, "reject", None, None, "f"), ("tag", 8, "reassign", "z", None, "g"))
    e = spark.createDataFrame([("c2", "concept.k", "EXPRESSES", "verified"), ("c3", "concept.k", "EXPRESSES", "verified")], "source_id string, target_id string, type string, tier string")
    n = spark.createDataFrame([("concept.k", "concept", "k", None)], "id string, type string, label string, definition string")
    tags, edges, nodes = review.apply_tags(t, q, e, n)
    status = dict(rows(tags, "id", "status"))
    spawned = [i for i in status if i > 100]
    assert len(spawned) == 1 and {(-8 if i > 100 else i): x for i, x in status.items()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "pending", 5: "rejected", 6: "accepted", 7: "rejected", 8: "reassigned", -8: "accepted"}
    assert rows(edges, "source_id", "target_id", "tier") == [("c1", "concept.j", "proposed"), ("c1", "concept.k", "verified"), ("c1", "concept.n", "verified"), ("c1", "concept.z", "verified"), ("c2", "concept.k", "verified")]
    assert ("concept.n", "new one") in rows(nodes, "id", "definition")
    result = review.apply_result(t, q, edges, e).first()
    assert (result.applied, result.edges_created, result.already_applied) == (7, 4, False)
    same = review.apply_tags(tags, q, edges, nodes)[1]
    assert rows(same) == rows(edges)


def test_a_spawned_row_takes_part_in_its_batch(spark):
    t = spark.createDataFrame([(i, "c", f"k{i}", 3, False, None, "pending", "m", None) for i in range(1, 7)], TAG)
    one = spark.range(1).select(*[review.spawned_id(F.lit(i).cast("long"), F.lit("z")).alias(f"s{i}") for i in range(1, 8)]).first()
    deep = spark.range(1).select(review.spawned_id(F.lit(one.s4).cast("long"), F.lit("y")).alias("d")).first().d
    acts = [
        ("tag", 1, "reassign", "z", None, "1a"), ("tag", one.s1, "accept", None, None, "1b"),
        ("tag", 2, "reassign", "z", None, "2a"), ("tag", one.s2, "reject", None, None, "2b"), ("tag", one.s2, "skip", None, None, "2c"),
        ("tag", one.s3, "reject", None, None, "3a"), ("tag", 3, "reassign", "z", None, "3b"),  # before there is such a row
        ("tag", 4, "reassign", "z", None, "4a"), ("tag", one.s4, "reassign", "y", None, "4b"), ("tag", deep, "reject", None, None, "4c"),
        ("tag", 5, "reassign", "z", None, "5a"), ("tag", one.s5, "reject", None, None, "5b"), ("tag", 5, "accept", None, None, "5c"),  # the spawned row is gone
        ("tag", one.s7, "accept", None, None, "7"),  # of no tag
    ]
    e = spark.createDataFrame([], "source_id string, target_id string, type string, tier string")
    n = spark.createDataFrame([], "id string, type string, label string, definition string")
    q = actions(spark, *acts)
    tags, edges, _ = review.apply_tags(t, q, e, n)
    got = dict(rows(tags, "id", "status"))
    assert got == {1: "reassigned", one.s1: "accepted", 2: "reassigned", one.s2: "rejected", 3: "reassigned", one.s3: "accepted", 4: "reassigned", one.s4: "reassigned", deep: "rejected", 5: "accepted", 6: "pending"}
    assert {r.id: r.concept_id for r in tags.filter("id > 100").collect()} == {one.s1: "z", one.s2: "z", one.s3: "z", one.s4: "z", deep: "y"}
    assert rows(edges, "target_id") == [("concept.k5",), ("concept.z",)]
    empty = {"staged_edges": spark.createDataFrame([], "id long, status string"), "staged_cleanups": spark.createDataFrame([], "id long, status string, words_preserved boolean")}
    assert rows(review.refused({"staged_tags": t, **empty}, q)) == [(14, "unknown target")]
    again = review.apply_tags(tags, q, edges, n)
    assert rows(again[0]) == rows(tags) and rows(again[1]) == rows(edges)


def test_many_actions_on_one_tag(spark):
    """They pass through in order; the last decides."""
    t = spark.createDataFrame([(1, "c", "k", 3, False, None, "pending", "m", None)], TAG)
    verb = F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("reassign")), (F.col("id") % 3 + 1).cast("int"))
    q = spark.range(30_000).select("id", F.lit("tag").alias("target_table"), F.lit(1).cast("long").alias("target_id"), verb.alias("action"), F.when(verb == "reassign", "z").alias("reassign_to"), F.lit(None).cast("string").alias("reclassify_to"), F.lit("me").alias("reviewer"), F.col("id").cast("string").alias("client_action_id"), F.lit(None).cast("string").alias("applied_at"))
    assert rows(review.fold_tag_actions(t, q), "parent", "verb") == [(1, None), (None, "reassign")]


def test_apply_edges_and_cleanups(spark):
    s = spark.createDataFrame([(1, "a", "b", "PARALLELS", 0.9, "pending", "proposed"), (2, "a", "c", "PARALLELS", 0.8, "pending", "proposed"), (3, "a", "d", "PARALLELS", 0.1, "pending", "inferred"), (4, "a", "e", "PARALLELS", 0.9, "pending", "proposed")], "id long, source_chunk string, target_chunk string, edge_type string, confidence double, status string, tier string")
    e = spark.createDataFrame([("a", "c", "PARALLELS", "inferred"), ("a", "z", "BELONGS_TO", "verified")], "source_id string, target_id string, type string, tier string")
    q = actions(spark, ("edge", 1, "accept", None, None, "1"), ("edge", 2, "reclassify", None, "surface_only", "2"), ("edge", 3, "reject", None, None, "3"), ("edge", 4, "reclassify", None, "CONTRASTS", "4"))
    staged, edges = review.apply_edges(s, q, e)
    assert rows(staged, "id", "edge_type", "status", "tier") == [(1, "PARALLELS", "accepted", "verified"), (2, "surface_only", "rejected", "proposed"), (3, "PARALLELS", "rejected", "inferred"), (4, "CONTRASTS", "accepted", "verified")]
    assert rows(edges) == [("a", "b", "PARALLELS", "verified"), ("a", "e", "CONTRASTS", "verified"), ("a", "z", "BELONGS_TO", "verified")]
    assert rows(review.auto_promote(s), "id") == [(1,), (4,)]
    c = spark.createDataFrame([(1, "x", True, "pending"), (2, "x", False, "pending"), (3, "x", True, "pending")], "id long, chunk_id string, words_preserved boolean, status string")
    q = actions(spark, ("cleanup", 1, "accept", None, None, "1"), ("cleanup", 2, "accept", None, None, "2"), ("cleanup", 3, "reclassify", None, "apparatus_drop", "3"))
    assert rows(review.apply_cleanups(c, q), "id", "status") == [(1, "accepted"), (2, "pending"), (3, "apparatus")]
    t = spark.createDataFrame([(1, "c", "k", 3, False, None, "pending", "m", None), (2, "c", "j", 3, False, None, "pending", "m", None)], TAG)
    one = actions(spark, ("tag", 1, "accept", None, None, "1"))
    assert rows(review.verb_for_chunk(t, one, "c", "reject", "me"), "target_id", "action") == [(2, "reject")]
    with pytest.raises(ValueError, match="whole chunk"):
        review.verb_for_chunk(t, one, "c", "reassign", "me")
    n = spark.createDataFrame([("c", "Chunk C")], "id string, label string")
    ctx = review.queue_with_context(one, t, s.select("id", "source_chunk", "target_chunk", "edge_type"), c, n).first().context
    assert '"chunk_id_label":"Chunk C"' in ctx


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [1.0, 0.1], "x"), (2, [0.0, 1.0], "y"), (3, [1.0, 0.2], "y"), (4, [0.0, 0.0], "y")], "vec_id long, embedding array<float>, label string")
    top = vectors.top_k(v, v.filter("vec_id = 0"), 2, 0.5)
    assert rows(top, "vec_id", "rank") == [(1, 1), (3, 2)]
    assert rows(vectors.cross_group_pairs(v, v.filter("vec_id < 2"), 1, 0.5), "id_a", "id_b") == [(0, 3), (1, 3)]
    found = spark.createDataFrame([(1, "x", 0.9), (2, "x", 0.8), (3, "y", 0.1)], "id long, tradition string, similarity double")
    walk = spark.createDataFrame([(2, "x", 1.0, 0.2), (9, "z", 0.4, 0.5)], "id long, tradition string, tier_weight double, graph_score double")
    got = {r.id: round(r.score, 6) for r in vectors.fuse(found, walk).collect()}
    assert got == {1: 0.63, 2: 0.96, 3: 0.17, 9: 0.25}
    assert vectors.cap_per_group(vectors.fuse(found, walk), 1).count() == 3


def test_a_batch_is_published_at_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "db"))
    q = actions(spark, ("tag", 1, "accept", None, None, "a"), ("tag", 2, "accept", None, None, "b"), ("tag", 99, "accept", None, None, "c"), ("cleanup", 1, "accept", None, None, "d"), ("cleanup", 2, "accept", None, None, "e"))
    first = {
        "staged_tags": spark.createDataFrame([(1, "c1", "k", 3, False, None, "pending", "m", None), (2, "c1", "j", 3, False, None, "rejected", "m", None)], TAG),
        "staged_edges": spark.createDataFrame([], "id long, source_chunk string, target_chunk string, edge_type string, confidence double, status string, tier string"),
        "staged_cleanups": spark.createDataFrame([(1, "x", True, "pending", "old"), (2, "y", True, "pending", "same")], "id long, chunk_id string, words_preserved boolean, status string, original_body string"),
        "edges": spark.createDataFrame([], "source_id string, target_id string, type string, tier string"),
        "nodes": spark.createDataFrame([], "id string, type string, label string, definition string"),
        "review_actions": q,
    }
    s.commit(first)
    bodies = spark.createDataFrame([("x", "new"), ("y", "same")], "id string, body string")
    plan = review.apply_batch(s, F.lit("2026-01-01"), bodies=bodies)
    assert plan["versions"] == {} and s.read("edges").count() == 0
    errors = {r.error for r in plan["errors"].collect()}
    assert errors == {"already resolved", "unknown target", "stale body"}
    done = review.apply_batch(s, F.lit("2026-01-01"), commit=True, bodies=bodies)
    assert set(done["versions"].values()) == {2} and rows(s.read("edges"), "target_id") == [("concept.k",)]
    assert rows(s.read("staged_cleanups"), "id", "status") == [(1, "pending"), (2, "accepted")]
    assert s.read("review_actions").filter("applied_at IS NULL").count() == 3


def test_plan_hash_sees_moved_ends(spark):
    plan = lambda *r: spark.createDataFrame(list(r), "work string, span int, first_seq int, last_seq int, chunks long, tokens long")
    a = plan(("w", 1, 1, 3, 3, 10), ("w", 2, 4, 9, 6, 10))
    assert spans.plan_hash(a).first() != spans.plan_hash(plan(("w", 1, 1, 5, 5, 10), ("w", 2, 6, 9, 4, 10))).first()
    assert spans.plan_hash(a).first() == spans.plan_hash(a.orderBy(F.desc("span"))).first()


def test_lookup_and_merge(spark):
    ids = spark.createDataFrame([("t.x.001",), ("t.x.002",), ("bad",)], "id string")
    files = spark.createDataFrame([("corpus/t/x/chunks/001.toml",)], "path string")
    assert dict(rows(graph.lookup_paths(ids, files))) == {"t.x.001": "corpus/t/x/chunks/001.toml", "t.x.002": None, "bad": None}
    d = tables.add_columns(tables.rename_columns(ids, {"id": "chunk_id"}), {"note": "string"})
    assert d.columns == ["chunk_id", "note"]
    with pytest.raises(ValueError, match="cannot rename"):
        tables.rename_columns(d, {"id": "x"})
    body = spark.createDataFrame([("1", "a\n")], "id string, body string"), spark.createDataFrame([("2", "a")], "id string, body string")
    assert rows(tables.match_by_body(*body)) == [("1", "2")]


def test_spawned_rows_are_numbered_apart_from_staged_ones(spark):
    """Whatever the sign of the hash."""
    ids = spark.range(2000).select(review.spawned_id(F.col("id"), F.lit("z")).alias("s"))
    low, high, n = ids.agg(F.min("s"), F.max("s"), F.count_distinct("s")).first()
    assert review.SPAWNED <= low and high < 2 * review.SPAWNED and n == 2000
