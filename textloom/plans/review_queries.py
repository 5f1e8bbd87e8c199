"""Queries of the graph, the review queue and the small table operators, beside their oracle SQL.

labels stand in for staged tags (doc_id: chunk, quality: score), events for
review actions, documents for chunks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import canonical_params, render
from ..operators import chunking, cleaning, graph, review, spans, tables
from ..sources.files import bodies_for
from ..sources.shared import shared_dir
from ..sources.store import Store
from .catalogue import _SQL, _query, _t

TAGS = """tags AS (SELECT doc_id AS id, 'd' || (doc_id // 2) AS chunk_id, 'k' || (doc_id // 2 % 3) AS concept_id, (quality + 2 * toxic)::INT AS score, doc_id % 5 = 0 AS is_new_concept, 'about ' || doc_id AS new_concept_def,
  CASE doc_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN doc_id % 7 < 4 THEN 'm1' ELSE 'm2' END AS model FROM labels)"""
ACTS = """acts AS (SELECT event_id AS id, user_id AS target_id, CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'reassign' ELSE 'skip' END AS action, CASE WHEN event_id % 4 = 2 THEN 'k9' END AS reassign_to, event_type AS reviewer FROM events),
deciding AS (SELECT target_id AS id, arg_max(action, id) AS act, arg_max(reviewer, id) AS who FROM acts WHERE action <> 'skip' GROUP BY target_id)"""


def _tags(spark, sf_dir):
    d = F.col("doc_id")
    status = F.when(d % 4 == 0, "accepted").when(d % 4 == 1, "rejected").otherwise("pending")
    return _t(spark, sf_dir, "labels").select(
        d.alias("id"), F.concat(F.lit("d"), F.floor(d / 2)).alias("chunk_id"), F.concat(F.lit("k"), F.floor(d / 2) % 3).alias("concept_id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("score"), (d % 5 == 0).alias("is_new_concept"),
        F.concat(F.lit("about "), d).alias("new_concept_def"), status.alias("status"), F.when(d % 7 < 4, "m1").otherwise("m2").alias("model"), F.lit(None).cast("string").alias("reviewed_by"),
    )


def _acts(spark, sf_dir, table="tag", verbs=("accept", "reject", "reassign", "skip"), to="k9"):
    e = F.col("event_id")
    verb = F.element_at(F.array(*map(F.lit, verbs)), (e % len(verbs) + 1).cast("int"))
    null = F.lit(None).cast("string")
    return _t(spark, sf_dir, "events").select(
        e.alias("id"), F.lit(table).alias("target_table"), F.col("user_id").alias("target_id"), verb.alias("action"), F.when(verb == "reassign", to).alias("reassign_to"), F.when(verb == "reclassify", to).alias("reclassify_to"),
        F.col("event_type").alias("reviewer"), F.concat(F.lit("c"), e).alias("client_action_id"), null.alias("applied_at"),
    )


def _edges(tags):
    """An edge for every third accepted tag."""
    return tags.filter("status = 'accepted' AND id % 3 = 0").select(F.col("chunk_id").alias("source_id"), F.concat(F.lit("concept."), "concept_id").alias("target_id"), F.lit("EXPRESSES").alias("type"), F.lit("proposed").alias("tier")).distinct()


EDGES = "e AS (SELECT DISTINCT chunk_id AS source_id, 'concept.' || concept_id AS target_id FROM tags WHERE status = 'accepted' AND id % 3 = 0)"


@_query(f"WITH {TAGS}, {EDGES} SELECT DISTINCT chunk_id AS source_id, 'concept.' || concept_id AS target_id FROM tags WHERE status = 'accepted' EXCEPT SELECT * FROM e")
def missing_edges(spark, sf_dir):
    t = _tags(spark, sf_dir)
    return graph.missing_edges(t, _edges(t))


@_query(f"WITH {TAGS}, {EDGES} SELECT source_id, target_id, 'EXPRESSES' AS type, 'proposed' AS tier FROM e UNION ALL (SELECT source_id, target_id, 'EXPRESSES', 'verified' FROM (SELECT DISTINCT chunk_id AS source_id, 'concept.' || concept_id AS target_id FROM tags WHERE status = 'accepted' EXCEPT SELECT * FROM e))")
def repair_edges(spark, sf_dir):
    t = _tags(spark, sf_dir)
    return graph.repair_edges(t, _edges(t))


@_query(f"WITH {TAGS}, {EDGES} SELECT source_id AS chunk_id, substr(target_id, 9) AS concept_id, 'Name ' || substr(target_id, 9) AS label FROM e WHERE target_id <> 'concept.k2'")
def concepts_for_chunks(spark, sf_dir):
    t = _tags(spark, sf_dir)
    names = t.filter("concept_id <> 'k2'").select(F.concat(F.lit("concept."), "concept_id").alias("id"), F.lit("concept").alias("type"), F.concat(F.lit("Name "), "concept_id").alias("label")).distinct()
    return graph.concepts_for(_edges(t), names, t.select(F.col("chunk_id").alias("id")).distinct())


@_query(f"WITH {TAGS} SELECT id, chunk_id FROM tags t WHERE status = 'rejected' AND model = 'm1' AND EXISTS (SELECT 1 FROM tags o WHERE o.status = 'accepted' AND o.chunk_id = t.chunk_id AND o.concept_id = t.concept_id)")
def redundant_rejects(spark, sf_dir):
    return graph.redundant_rejects(_tags(spark, sf_dir), "m1").select("id", "chunk_id")


@_query(f"WITH {TAGS}, {EDGES} SELECT DISTINCT source_id, CASE target_id WHEN 'concept.k1' THEN 'concept.k0' ELSE target_id END AS target_id FROM e")
def retarget_concepts(spark, sf_dir):
    alias = spark.createDataFrame([("concept.k1", "concept.k0")], "alias string, canonical string")
    return graph.retarget_concept(_edges(_tags(spark, sf_dir)), alias).select("source_id", "target_id")


@_query(f"WITH {TAGS}, {EDGES} SELECT 'edges' AS part, count(*) AS n FROM (SELECT DISTINCT source_id, replace(target_id, 'k1', 'k0') FROM e) UNION ALL SELECT 'tags', count(*) FROM tags WHERE concept_id IN ('k0', 'k1') UNION ALL SELECT 'nodes', 2 UNION ALL SELECT 'aliases', 1")
def merge_concepts(spark, sf_dir):
    t = _tags(spark, sf_dir)
    alias = spark.createDataFrame([("concept.k1", "concept.k0")], "alias string, canonical string")
    nodes = t.select(F.concat(F.lit("concept."), "concept_id").alias("id")).distinct()
    edges, tags, left, names = graph.merge_concept(_edges(t), t, nodes, alias, spark.createDataFrame([], "alias string, concept_id string"))
    parts = {"edges": edges, "tags": tags.filter("concept_id = 'k0'"), "nodes": left, "aliases": names}
    return tables.manifest(parts).withColumnRenamed("label", "part")


@_query("""SELECT source || '.' || lang || '.' || doc_id AS id, 'chunk' AS type, source AS tradition_id, 'BELONGS_TO' AS edge FROM documents
UNION ALL SELECT DISTINCT source, 'tradition', source, NULL FROM documents""")
def graph_bootstrap(spark, sf_dir):
    c = _t(spark, sf_dir, "documents").select(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("tradition"), F.lit("s").alias("section"))
    nodes, edges = graph.bootstrap(c)
    return nodes.join(edges.select(F.col("source_id").alias("id"), F.col("type").alias("edge")), "id", "left").select("id", "type", "tradition_id", "edge")


@_query("SELECT doc_id::VARCHAR AS text_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE doc_id::VARCHAR END AS work_id FROM documents")
def work_of_texts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    texts = d.select(F.col("doc_id").cast("string").alias("text_id"), F.col("source").alias("text_name"), F.col("lang").alias("tradition"))
    declared = d.filter("doc_id % 2 = 0").groupBy(F.col("source").alias("id")).agg(F.min("source").alias("label"), F.min("lang").alias("tradition"), F.collect_list(F.col("doc_id").cast("string")).alias("members"))
    return graph.work_of(graph.works(texts, declared))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN 'corpus/' || source || '/' || lang || '/chunks/' || doc_id || '.toml' END AS path FROM documents")
def path_lookup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("id"))
    files = d.filter("doc_id % 3 <> 1").select(graph.chunk_path(F.col("id")).alias("path"))
    return graph.lookup_paths(d, files).select("doc_id", "path")


@_query("SELECT l.doc_id AS id, coalesce(d.text, '') AS body FROM (SELECT doc_id FROM labels UNION SELECT -5) l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def bodies_of_ids(spark, sf_dir):
    ids = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(spark.range(1).select((F.col("id") - 5).alias("id"))).distinct()
    return bodies_for(ids, _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")))


# --- the review queue ---


@_query(f"""WITH {TAGS}, {ACTS}, d AS (SELECT t.*, CASE WHEN t.status = 'pending' THEN k.act END AS act, k.who FROM tags t LEFT JOIN deciding k ON k.id = t.id)
SELECT id, chunk_id, concept_id, CASE act WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reassign' THEN 'reassigned' ELSE status END AS status, CASE WHEN act IS NOT NULL THEN who END AS reviewed_by FROM d
UNION ALL SELECT -1, chunk_id, 'k9', 'accepted', who FROM d WHERE act = 'reassign'""")
def apply_tags_fold(spark, sf_dir):
    t = _tags(spark, sf_dir)
    nodes = spark.createDataFrame([], "id string, type string, label string, definition string")
    done, _, _ = review.apply_tags(t, _acts(spark, sf_dir), _edges(t), nodes)
    spawned = F.col("concept_id") == "k9"
    return done.select(F.when(spawned, -1).otherwise(F.col("id")).alias("id"), "chunk_id", "concept_id", "status", "reviewed_by")


@_query(f"""WITH {TAGS}, {ACTS}, {EDGES}, d AS (SELECT t.*, CASE WHEN t.status = 'pending' THEN k.act END AS act FROM tags t LEFT JOIN deciding k ON k.id = t.id),
s AS (SELECT chunk_id, concept_id, score, CASE act WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reassign' THEN 'reassigned' ELSE status END AS status, act FROM d UNION ALL SELECT chunk_id, 'k9', score, 'accepted', 'accept' FROM d WHERE act = 'reassign'),
made AS (SELECT chunk_id AS source_id, 'concept.' || concept_id AS target_id, CASE WHEN max(score) >= 2 THEN 'verified' ELSE 'proposed' END AS tier FROM s WHERE act = 'accept' GROUP BY 1, 2),
gone AS (SELECT chunk_id AS source_id, 'concept.' || concept_id AS target_id FROM s WHERE act = 'reject' EXCEPT SELECT chunk_id, 'concept.' || concept_id FROM s WHERE status = 'accepted')
SELECT source_id, target_id, 'proposed' AS tier FROM e WHERE (source_id, target_id) NOT IN (SELECT * FROM gone) AND (source_id, target_id) NOT IN (SELECT source_id, target_id FROM made) UNION ALL SELECT * FROM made""")
def apply_tags_edges(spark, sf_dir):
    t = _tags(spark, sf_dir)
    nodes = spark.createDataFrame([], "id string, type string, label string, definition string")
    return review.apply_tags(t, _acts(spark, sf_dir), _edges(t), nodes)[1].select("source_id", "target_id", "tier")


@_query(_SQL["apply_tags_edges"])
def batch_applied(spark, sf_dir):
    """The whole batch through the store: refused actions aside, all tables published at once, the edges read back."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    t = _tags(spark, sf_dir)
    none = {
        "staged_edges": "id long, source_chunk string, target_chunk string, edge_type string, confidence double, status string, tier string",
        "staged_cleanups": "id long, chunk_id string, words_preserved boolean, status string, original_body string",
        "nodes": "id string, type string, label string, definition string",
    }
    s.commit({"staged_tags": t, "edges": _edges(t), "review_actions": _acts(spark, sf_dir)} | {n: spark.createDataFrame([], k) for n, k in none.items()})
    review.apply_batch(s, F.lit("2026-01-01"), commit=True)
    return s.read("edges").select("source_id", "target_id", "tier")


@_query(f"""WITH {TAGS}, {ACTS}, w AS (SELECT target_id AS id, arg_max(id, id) AS e FROM acts WHERE action <> 'skip' GROUP BY target_id),
d AS (SELECT t.*, CASE WHEN t.status = 'pending' THEN k.act END AS act, k.who, w.e FROM tags t LEFT JOIN deciding k ON k.id = t.id LEFT JOIN w ON w.id = t.id)
SELECT id AS tag, 0 AS generation, concept_id, CASE act WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reassign' THEN 'reassigned' ELSE status END AS status, CASE WHEN act IS NOT NULL THEN who END AS reviewed_by FROM d
UNION ALL SELECT id, 1, 'k9', CASE e % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'reassigned' END, 'second' FROM d WHERE act = 'reassign'
UNION ALL SELECT id, 2, 'k8', CASE WHEN e % 5 < 2 THEN 'rejected' ELSE 'accepted' END, 'third' FROM d WHERE act = 'reassign' AND e % 3 = 2""")
def respawned_tags(spark, sf_dir):
    """Rows that a reassignment spawns are accepted again, rejected or reassigned in the same batch."""
    t = _tags(spark, sf_dir)
    first = _acts(spark, sf_dir).withColumn("e", F.col("id"))
    spawn = lambda row, to: review.spawned_id(row, F.lit(to))
    born = first.filter("action = 'reassign'").withColumn("target_id", spawn(F.col("target_id"), "k9"))
    verb = F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("reassign")), (F.col("e") % 3 + 1).cast("int"))
    second = born.withColumns({"id": F.col("e") * 4 + 1, "action": verb, "reassign_to": F.when(verb == "reassign", "k8"), "reviewer": F.lit("second")})
    third = second.filter("action = 'reassign'").withColumns({"id": F.col("e") * 4 + 2, "target_id": spawn(F.col("target_id"), "k8"), "action": F.when(F.col("e") % 5 < 2, "reject").otherwise("accept"), "reassign_to": F.lit(None).cast("string"), "reviewer": F.lit("third")})
    queue = first.withColumn("id", F.col("e") * 4).unionByName(second).unionByName(third).drop("e")
    nodes = spark.createDataFrame([], "id string, type string, label string, definition string")
    done = review.apply_tags(t, queue, _edges(t), nodes)[0]
    generation = F.when(F.col("id") < review.SPAWNED, 0).when(F.col("concept_id") == "k9", 1).otherwise(2)
    return done.select(F.regexp_extract("new_concept_def", r"(\d+)", 1).cast("long").alias("tag"), generation.alias("generation"), "concept_id", "status", "reviewed_by")


@_query("""WITH s AS (SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'accepted' ELSE 'pending' END AS status FROM embeddings),
a AS (SELECT user_id AS id, arg_max(event_id % 3, event_id) AS v FROM events GROUP BY user_id)
SELECT s.id, CASE WHEN s.status = 'pending' AND v = 2 THEN 'unrelated' ELSE 'PARALLELS' END AS edge_type, CASE WHEN s.status = 'pending' AND v = 0 THEN 'accepted' WHEN s.status = 'pending' AND v IS NOT NULL THEN 'rejected' ELSE s.status END AS status,
  CASE WHEN s.status = 'pending' AND v = 0 THEN 'verified' ELSE 'proposed' END AS tier FROM s LEFT JOIN a USING (id)""")
def apply_edges_fold(spark, sf_dir):
    v = F.col("vec_id")
    staged = _t(spark, sf_dir, "embeddings").select(v.alias("id"), F.concat(F.lit("a"), v).alias("source_chunk"), F.concat(F.lit("b"), v).alias("target_chunk"), F.lit("PARALLELS").alias("edge_type"), F.when(v % 3 == 0, "accepted").otherwise("pending").alias("status"), F.lit("proposed").alias("tier"))
    edges = spark.createDataFrame([], "source_id string, target_id string, type string, tier string")
    return review.apply_edges(staged, _acts(spark, sf_dir, "edge", ("accept", "reject", "reclassify"), "unrelated"), edges)[0].select("id", "edge_type", "status", "tier")


@_query("""WITH a AS (SELECT user_id AS id, arg_max(event_id % 3, event_id) AS v FROM events GROUP BY user_id),
l AS (SELECT user_id AS id, arg_max(event_id % 3, event_id) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY user_id)
SELECT d.doc_id AS id, CASE coalesce(CASE WHEN d.doc_id % 4 = 0 THEN l.v ELSE a.v END, -1) WHEN 0 THEN CASE WHEN d.doc_id % 5 = 0 THEN 'pending' ELSE 'accepted' END WHEN 1 THEN 'rejected' WHEN 2 THEN 'apparatus' ELSE 'pending' END AS status
FROM documents d LEFT JOIN a ON a.id = d.doc_id LEFT JOIN l ON l.id = d.doc_id""")
def apply_cleanups_fold(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    staged = d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("chunk_id"), (F.col("doc_id") % 5 != 0).alias("words_preserved"), F.lit("pending").alias("status"), F.col("text").alias("original_body"))
    now = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"))
    return review.apply_cleanups(staged, _acts(spark, sf_dir, "cleanup", ("accept", "reject", "reclassify"), "apparatus_drop"), now).select("id", "status")


@_query("SELECT doc_id AS chunk, doc_id % 4 = 0 AS stale FROM documents")
def stale_cleanups(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    staged = d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("original_body"))
    now = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"))
    return cleaning.fresh_cleanups(staged, now).select(F.col("chunk_id").alias("chunk"), "stale")


@_query(f"WITH {TAGS} SELECT t.id AS target_id, 'accept' AS action, 'me:accept:' || t.id AS client_action_id FROM tags t WHERE chunk_id = (SELECT 'd' || max(doc_id // 2) FROM labels WHERE doc_id % 4 >= 2) AND status = 'pending' AND t.id NOT IN (SELECT user_id FROM events)")
def verb_for_a_chunk(spark, sf_dir):
    last = _t(spark, sf_dir, "labels").filter("doc_id % 4 >= 2").agg(F.expr("max(doc_id div 2)")).first()[0]
    return review.verb_for_chunk(_tags(spark, sf_dir), _acts(spark, sf_dir), f"d{last}", "accept", "me").select("target_id", "action", "client_action_id")


@_query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 AND label / 10.0 >= 0.85")
def auto_promotion(spark, sf_dir):
    v = F.col("vec_id")
    staged = _t(spark, sf_dir, "embeddings").select(v.alias("id"), F.when(v % 3 == 0, "accepted").otherwise("pending").alias("status"), (F.col("label") / 10.0).alias("confidence"))
    return review.auto_promote(staged).select("id")


@_query("SELECT event_id AS id FROM events WHERE event_id <> 7 OR event_id % 2 = 0")
def undo_action(spark, sf_dir):
    q = _acts(spark, sf_dir).withColumn("applied_at", F.when(F.col("id") % 2 == 0, "2026-01-01"))
    return review.undo(review.undo(q, "c7"), "c8").select("id")


@_query(f"""WITH {TAGS}, {ACTS} SELECT a.id, a.target_id, a.action, t.chunk_id, t.concept_id FROM acts a LEFT JOIN tags t ON t.id = a.target_id""")
def queue_context(spark, sf_dir):
    t = _tags(spark, sf_dir)
    none = spark.createDataFrame([], "id long, source_chunk string, target_chunk string, edge_type string")
    clean = spark.createDataFrame([], "id long, chunk_id string, words_preserved boolean")
    nodes = spark.createDataFrame([], "id string, label string")
    q = review.queue_with_context(_acts(spark, sf_dir), t, none, clean, nodes)
    return q.select("id", "target_id", "action", F.get_json_object("context", "$.chunk_id").alias("chunk_id"), F.get_json_object("context", "$.concept_id").alias("concept_id"))


# --- small operators ---


@_query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def latest_events(spark, sf_dir):
    return tables.latest(_t(spark, sf_dir, "events"), 25, "ts", "event_id").select("event_id", "event_type")


@_query("SELECT doc_id AS chunk_id, source AS tradition, NULL::VARCHAR AS note FROM documents")
def renamed_and_added_columns(spark, sf_dir):
    d = tables.rename_columns(_t(spark, sf_dir, "documents").select("doc_id", "source"), {"doc_id": "chunk_id", "source": "tradition"})
    return tables.add_columns(d, {"note": "string"})


@_query("""WITH e AS (SELECT event_id, user_id, event_type, event_type = 'view' AND value > 50 AS neg FROM events)
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY neg, user_id, event_type ORDER BY event_id) AS k FROM e) WHERE NOT neg OR k = 1""")
def negative_dedupe(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return tables.dedupe_where(e, (F.col("event_type") == "view") & (F.col("value") > 50), ["user_id", "event_type"], "event_id").select("event_id")


@_query("""WITH m AS (SELECT doc_id AS old_id, doc_id // 2 * 2 AS new_id FROM documents WHERE doc_id % 6 < 4), c AS (SELECT new_id, count(*) AS n FROM m GROUP BY new_id)
SELECT d.doc_id AS new_id, CASE WHEN n IS NULL THEN 'unmapped' ELSE 'ambiguous' END AS fault FROM documents d LEFT JOIN c ON c.new_id = d.doc_id WHERE n IS NULL OR n > 1""")
def remap_guards(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    m = d.filter("doc_id % 6 < 4").select(F.col("doc_id").alias("old_id"), F.expr("doc_id div 2 * 2").alias("new_id"))
    return tables.remap_faults(m, d.select(F.col("doc_id").alias("id")))


@_query("""SELECT doc_id, CASE WHEN regexp_extract(text, '(\\d+)', 1) <> '' THEN 'Page ' || regexp_extract(text, '(\\d+)', 1) ELSE 'Leaf ' || doc_id END AS section FROM documents""")
def page_chunks(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.pages_as_chunks(d, "Page {n}", r"(\d+)", "Leaf {n}", "doc_id").select("doc_id", "section")


@_query("SELECT doc_id, '<' || source || '> in ' || lang || ', ' || doc_id AS prompt FROM documents")
def rendered_prompts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", render("<{{source}}> in {{lang}}, {{id}}", {"source": F.col("source"), "lang": F.col("lang"), "id": F.col("doc_id")}).alias("prompt"))


@_query("""SELECT doc_id, '{' || CASE WHEN doc_id % 2 = 0 THEN '"lang":"' || lang || '",' ELSE '' END || '"source":"' || source || '"}' AS params FROM documents""")
def filter_params(spark, sf_dir):
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit("none"), F.lit(None).cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", canonical_params(m).alias("params"))


@_query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source AS text_id, 'count' AS fault, NULL::INT AS ordinal FROM d GROUP BY source HAVING max(doc_id) % 2 = 1 UNION ALL SELECT 'no such text', 'count', NULL UNION ALL SELECT source, 'label', k::INT FROM d WHERE doc_id % 3 = 0""")
def enumeration_audit(spark, sf_dir):
    """All sources as enumerated texts: the canon of some has one more, and a third of the labels are wrong."""
    d = _t(spark, sf_dir, "documents")
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    chunks = d.select(F.col("source").alias("text_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.concat(F.lit("Saying "), k)).alias("section"))
    canon = d.groupBy(F.col("source").alias("text_id")).agg((F.count("*") + F.max("doc_id") % 2).alias("expected"))
    canon = canon.unionByName(spark.range(1).select(F.lit("no such text").alias("text_id"), F.lit(3).cast("long").alias("expected")))
    return chunking.enumeration_faults(chunks, canon, "Saying {n}")


@_query("""WITH p AS (SELECT source AS work, doc_id AS span, (length(text) // 4)::BIGINT AS tokens FROM documents), q AS (SELECT source AS work, doc_id AS span, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE length(text) // 4 END::BIGINT AS tokens FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'new', 1, 5)
SELECT coalesce(p.work, q.work) AS work, coalesce(p.span, q.span) AS span, CASE WHEN p.span IS NULL THEN 'added' WHEN q.span IS NULL THEN 'removed' ELSE 'changed' END AS state FROM p FULL JOIN q ON p.work = q.work AND p.span = q.span WHERE p.tokens IS DISTINCT FROM q.tokens""")
def plan_changes(spark, sf_dir):
    p = _t(spark, sf_dir, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("span"), F.floor(F.char_length("text") / 4).alias("tokens"))
    q = p.filter("span % 7 <> 0").withColumn("tokens", F.when(F.col("span") % 9 == 0, 0).otherwise(F.col("tokens")).cast("long"))
    return spans.plan_diff(p, q.union(spark.createDataFrame([("new", 1, 5)], "work string, span long, tokens long")), ["work", "span"])
