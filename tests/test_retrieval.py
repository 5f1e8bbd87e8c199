from textloom.operators import retrieval


def test_retrieve(spark):
    q = spark.createDataFrame([(1, "What of divine light?", [1.0, 0.0]), (2, "none", [0.0, 1.0])], "query_id long, question string, vector array<float>")
    v = spark.createDataFrame([("a1", [1.0, 0.1]), ("a2", [1.0, 0.2]), ("b1", [0.8, 0.6]), ("c1", [-1.0, 0.0])], "id string, vector array<float>")
    e = spark.createDataFrame([("c1", "concept.divine_light", "EXPRESSES", "verified"), ("b1", "concept.other", "EXPRESSES", "verified")], "source_id string, target_id string, type string, tier string")
    c = spark.createDataFrame([("divine_light",), ("other",)], "concept_id string")
    ch = spark.createDataFrame([("a1", "A", "body a1"), ("a2", "A", "body a2"), ("b1", "B", None), ("c1", "C", "body c1")], "id string, tradition string, body string")
    got = retrieval.retrieve(q, v, e, c, ch).orderBy("query_id", "rank").collect()
    one = [(r.id, round(r.score, 4), r.body) for r in got if r.query_id == 1]
    assert [x[0] for x in one] == ["a1", "a2", "b1", "c1"]
    assert one[3][1] == 0.4 and one[2][2] == ""
    assert [r.id for r in got if r.query_id == 2] == ["b1"]
    capped = retrieval.retrieve(q, v, e, c, ch, retrieval.Ranking(max_per_tradition=1)).filter("query_id = 1")
    assert sorted(r.id for r in capped.collect()) == ["a1", "b1", "c1"]


def test_picker_and_memory(spark):
    n = spark.createDataFrame([("concept.gnosis", "Gnosis"), ("concept.nous", "NOUS"), ("x", "Other")], "id string, label string")
    assert [r.id for r in retrieval.picker(n, "NO", "concept.gnosis").collect()] == ["concept.nous"]
    now, calls = [0.0], []
    m = retrieval.Remembered(30, lambda: now[0])
    get = lambda: m.get("k", lambda: calls.append(1) or len(calls))
    assert (get(), get()) == (1, 1)
    now[0] = 31
    assert get() == 2
    m.forget()
    assert get() == 3


def test_walk_tasks_hold_a_bounded_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_EDGES", 50)
    tiers = {"verified": 1.0, "proposed": 0.7, "inferred": 0.4}
    rows = [(f"c{i % 37}", f"concept.{i % 91}", "EXPRESSES" if i % 11 else "BELONGS_TO", list(tiers)[i % 3]) for i in range(1000)]
    e = spark.createDataFrame(rows, "source_id string, target_id string, type string, tier string")
    m = [(q, str(c)) for q in (1, 2) for c in range(q, 91, 5)]
    df = retrieval.graph_walk(spark.createDataFrame(m, "query_id long, concept_id string"), e)
    most = max(4, -(-sum(r[2] == "EXPRESSES" for r in rows) // 50))
    assert f", {most}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s, t, kind, tier in rows:
        for q, c in m:
            if kind == "EXPRESSES" and t == f"concept.{c}":
                w, seen = want.get((q, s), (0.0, set()))
                want[q, s] = max(w, tiers[tier]), seen | {c}
    of = {q: sum(x == q for x, _ in m) for q in (1, 2)}
    assert {(r.query_id, r.id): (r.tier_weight, r.graph_score) for r in df.collect()} == {(q, s): (w, len(seen) / of[q]) for (q, s), (w, seen) in want.items()}
