"""The review queue: idempotent actions, previews, and their application as a fold.

``review_actions`` is an append-only log.  Applying it derives the next
versions of the staged tables, edges and nodes; nothing is updated in place.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .cleaning import fresh_cleanups

VERBS = {"tag": ["accept", "reject", "skip", "reassign"], "edge": ["accept", "reject", "skip", "reclassify"], "cleanup": ["accept", "reject", "skip", "reclassify"]}
EDGE_TYPES = ["PARALLELS", "CONTRASTS", "surface_only", "unrelated"]
#: Rows that a reassignment spawns are numbered from this on, far from the ids of staged ones.
SPAWNED = 1 << 61
NEGATIVE = ["surface_only", "unrelated"]


def action_valid() -> Column:
    """The row checks: verbs by table, and targets exactly where the verb needs one; null is invalid."""
    table, verb = F.col("target_table"), F.col("action")
    known = F.lit(False)
    for t, verbs in VERBS.items():
        known = known | ((table == t) & verb.isin(verbs))
    to = F.when(verb == "reassign", F.coalesce(F.col("reassign_to") != "", F.lit(False))).otherwise(F.col("reassign_to").isNull())
    kind = F.when(table == "edge", F.col("reclassify_to").isin(EDGE_TYPES)).otherwise(F.col("reclassify_to") == "apparatus_drop")
    re = F.when(verb == "reclassify", F.coalesce(kind, F.lit(False))).otherwise(F.col("reclassify_to").isNull())
    return F.coalesce(known & to & re & F.col("client_action_id").isNotNull(), F.lit(False))


def enqueue(queue: DataFrame, new: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The queue with the accepted actions, and ``client_action_id, outcome`` of each new one.

    Outcomes: queued, duplicate (also within the batch: its first by id counts), invalid, unknown.
    ``targets``: target_table, target_id of what exists.
    """
    w = Window.partitionBy("client_action_id").orderBy("id")
    rows = new.withColumn("__ok", action_valid()).withColumn("__r", F.row_number().over(w))
    old = queue.select("client_action_id", F.lit(True).alias("__old")).dropDuplicates(["client_action_id"])
    rows = rows.join(old, "client_action_id", "left")
    if targets is not None:
        rows = rows.join(targets.select("target_table", "target_id", F.lit(True).alias("__there")).distinct(), ["target_table", "target_id"], "left")
    else:
        rows = rows.withColumn("__there", F.lit(True))
    outcome = F.when(~F.col("__ok"), "invalid").when(F.col("__old") | (F.col("__r") > 1), "duplicate").when(F.col("__there").isNull(), "unknown").otherwise("queued")
    rows = rows.withColumn("outcome", outcome)
    return queue.unionByName(rows.filter("outcome = 'queued'").select(*queue.columns)), rows.select("client_action_id", "outcome")


def undo(queue: DataFrame, client_action_id: str) -> DataFrame:
    """Without the action, if it is not applied yet."""
    return queue.filter(~((F.col("client_action_id") == client_action_id) & F.col("applied_at").isNull()))


def queue_with_context(queue: DataFrame, tags: DataFrame, edges: DataFrame, cleanups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unapplied actions with what they are about, as JSON shaped by table; latest first."""
    label = lambda name: nodes.select(F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    t = tags.select(F.lit("tag").alias("target_table"), F.col("id").alias("target_id"), "chunk_id", "concept_id", "score").join(label("chunk_id"), "chunk_id", "left")
    e = edges.select(F.lit("edge").alias("target_table"), F.col("id").alias("target_id"), "source_chunk", "target_chunk", "edge_type").join(label("source_chunk"), "source_chunk", "left").join(label("target_chunk"), "target_chunk", "left")
    c = cleanups.select(F.lit("cleanup").alias("target_table"), F.col("id").alias("target_id"), F.col("chunk_id").alias("cleanup_chunk"), F.coalesce(F.col("words_preserved"), F.lit(False)).alias("words_preserved"))
    key = ["target_table", "target_id"]
    rows = queue.filter("applied_at IS NULL").join(t, key, "left").join(e, key, "left").join(c, key, "left")
    shape = F.when(F.col("target_table") == "tag", F.to_json(F.struct("chunk_id", "chunk_id_label", "concept_id", "score")))
    shape = shape.when(F.col("target_table") == "edge", F.to_json(F.struct("source_chunk", "source_chunk_label", "target_chunk", "target_chunk_label", "edge_type")))
    shape = shape.when(F.col("target_table") == "cleanup", F.to_json(F.struct(F.col("cleanup_chunk").alias("chunk_id"), "words_preserved")))
    return rows.select("id", "target_table", "target_id", "action", "reviewer", shape.alias("context")).orderBy(F.desc("id"))


def apply_preview(queue: DataFrame, action: str = "action", table: str = "target_table", target: str = "target_id") -> DataFrame:
    """``action, target_table, n, targets``: totals, by action and by table, from one pass."""
    sets = queue.groupingSets([[], [action], [table]], action, table)
    return sets.agg(F.count("*").alias("n"), F.count_distinct(target).alias("targets"))


def latest_action(queue: DataFrame, target: str = "target_id", at: str = "created_at", action: str = "action", order: str = "id") -> DataFrame:
    """Each target's last action."""
    return queue.groupBy(target).agg(F.max_by(action, F.struct(at, order)).alias("action"), F.max(at).alias("at"))


def _last(queue: DataFrame, table: str) -> DataFrame:
    """Of unapplied actions on a table, each target's deciding one: the last that is not a skip."""
    live = queue.filter((F.col("target_table") == table) & F.col("applied_at").isNull() & (F.col("action") != "skip"))
    return live.groupBy(F.col("target_id").alias("id")).agg(F.max_by(F.struct("action", "reassign_to", "reclassify_to", "reviewer"), "id").alias("act"))


def spawned_id(row: Column, concept: Column) -> Column:
    """The id of the row that a reassignment of ``row`` to ``concept`` spawns."""
    return F.lit(SPAWNED) + F.pmod(F.xxhash64(row, concept), F.lit(SPAWNED))


def _rooted(tags: DataFrame, live: DataFrame) -> DataFrame:
    """The actions with ``root``, the staged tag that their target is or descends from; without those of no tag.

    A step up the chain of reassignments is a join, of the actions alone whose
    target is not found yet.
    """
    parent = live.filter("action = 'reassign'").select(F.col("spawn").alias("__at"), F.col("target_id").alias("__parent")).distinct()
    there = tags.select(F.col("id").alias("__at"))
    rest = live.withColumn("__at", F.col("target_id"))
    found = rest.join(there, "__at", "left_semi")
    rest = rest.join(there, "__at", "left_anti")
    while not rest.isEmpty():
        rest = rest.join(parent, "__at").withColumn("__at", F.col("__parent")).drop("__parent")
        found = found.unionByName(rest.join(there, "__at", "left_semi"))
        rest = rest.join(there, "__at", "left_anti")
    return found.withColumnRenamed("__at", "root")


def _fold_tag(actions) -> list[tuple]:
    """The rows (id, parent, concept, verb, reviewer) of one tag after its actions in order.

    An action on a row replaces what an earlier one did to it; a row spawned by a
    reassignment that no longer stands is gone, with what was done to it.
    """
    rows: dict[int, list] = {}
    for root, target, verb, to, who, spawn in actions:
        row = rows.setdefault(root, [None, None, None, None, None])
        row = rows.get(target)
        if row is None:
            continue
        child = row[4]
        while child is not None:
            child = rows.pop(child)[4]
        row[2:] = [verb, who, spawn if verb == "reassign" else None]
        if verb == "reassign":
            rows[spawn] = [target, to, None, who, None]
    return [(i, *r[:4]) for i, r in rows.items()]


def fold_tag_actions(tags: DataFrame, queue: DataFrame) -> DataFrame:
    """``root, id, parent, concept_id, verb, reviewer``: what unapplied tag actions, in the order of their ids, make of each
    tag and of the rows that reassignments in the batch spawn (``parent`` null: the tag itself).

    Skips have no effect, nor have actions on rows that are gone.  The actions of
    one tag pass through a task in order and are not gathered.
    """
    live = queue.filter("target_table = 'tag' AND applied_at IS NULL AND action <> 'skip'").select("id", "target_id", "action", "reassign_to", "reviewer")
    live = live.withColumn("spawn", spawned_id(F.col("target_id"), F.col("reassign_to")))
    kind = queue.schema["target_id"].dataType.simpleString()
    cols = ["root", "target_id", "action", "reassign_to", "reviewer", "spawn"]
    in_order = _rooted(tags, live).repartition("root").sortWithinPartitions("root", "id").select(*cols)
    out_type = [("root", 0), ("id", 0), ("parent", 0), ("concept_id", 3), ("verb", 2), ("reviewer", 4)]

    def fold(batches):
        def rows():
            nonlocal types
            for b in batches:
                types = b.schema
                yield from zip(*(b.column(c).to_pylist() for c in range(len(cols))))

        types, made = None, []
        for root, own in groupby(rows(), key=lambda r: r[0]):
            made += [(root, *r) for r in _fold_tag(own)]
            if len(made) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.field(k).type) for c, (_, k) in zip(zip(*made), out_type)], names=[n for n, _ in out_type])
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, types.field(k).type) for c, (_, k) in zip(zip(*made), out_type)], names=[n for n, _ in out_type])

    return in_order.mapInArrow(fold, f"root {kind}, id {kind}, parent {kind}, concept_id string, verb string, reviewer string")


def apply_tags(tags: DataFrame, queue: DataFrame, edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next staged_tags, edges and nodes.

    accept: an EXPRESSES edge (score 2 or 3: verified, else proposed) and, for
    a new concept, its node with the definition.  reject: the edge goes, unless
    another tag of the pair is accepted.  reassign: the row is 'reassigned' and
    an accepted one for the other concept follows it, on which later actions of
    the batch can act (see ``spawned_id``).  Tags already resolved are not
    touched.
    """
    pending = tags.filter("status = 'pending'")
    folded = stored(fold_tag_actions(pending, queue), "folded")  # read for tags, edges and nodes alike
    own = folded.filter("parent IS NULL").select(F.col("root").alias("id"), F.col("verb").alias("__verb"), F.col("reviewer").alias("__who"))
    named = lambda verb: F.when(verb == "accept", "accepted").when(verb == "reject", "rejected").when(verb == "reassign", "reassigned")
    a = tags.join(own, "id", "left")
    done = a.withColumns({"__new": named(F.col("__verb")), "status": F.coalesce(named(F.col("__verb")), "status"), "reviewed_by": F.coalesce("__who", "reviewed_by")}).drop("__verb", "__who")
    child = folded.filter("parent IS NOT NULL").select(F.col("root").alias("__root"), F.col("id").alias("__id"), F.col("concept_id").alias("__concept"), F.col("verb").alias("__verb"), F.col("reviewer").alias("__who"))
    state = F.coalesce(named(F.col("__verb")), F.lit("accepted"))
    spawned = pending.join(child, F.col("id") == F.col("__root")).withColumns({"id": F.col("__id"), "concept_id": F.col("__concept"), "__new": state, "status": state, "is_new_concept": F.lit(False), "reviewed_by": F.col("__who")})
    done = done.unionByName(spawned.select(*done.columns))
    tier = F.when(F.col("score") >= 2, "verified").otherwise("proposed")
    key = ["source_id", "target_id", "type"]
    pair = [F.col("chunk_id").alias("source_id"), F.concat(F.lit("concept."), "concept_id").alias("target_id"), F.lit("EXPRESSES").alias("type")]
    made = done.filter("__new = 'accepted'").select(*pair, tier.alias("tier")).groupBy(*key).agg(F.max("tier").alias("tier"))
    gone = done.filter("__new = 'rejected'").select(*pair).distinct().join(done.filter("status = 'accepted'").select(*pair), key, "left_anti")
    new_edges = edges.join(gone, key, "left_anti").join(made.select(*key), key, "left_anti").select(*key, "tier").unionByName(made)
    concept = done.filter("__new = 'accepted' AND is_new_concept").select(F.concat(F.lit("concept."), "concept_id").alias("id"), F.lit("concept").alias("type"), F.col("concept_id").alias("label"), F.col("new_concept_def").alias("definition")).dropDuplicates(["id"])
    new_nodes = nodes.unionByName(concept.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return done.select(*tags.columns), new_edges, new_nodes


def apply_edges(staged: DataFrame, queue: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next staged_edges and edges.

    accept: verified, and live.  reclassify to a negative type: rejected, the
    type kept, the live edge gone; to another: accepted as that type.  reject:
    the tier stays as it was.
    """
    a = staged.join(_last(queue, "edge"), "id", "left").withColumn("__on", (F.col("status") == "pending") & F.col("act").isNotNull())
    verb, to = F.col("act.action"), F.col("act.reclassify_to")
    kind = F.when(F.col("__on") & (verb == "reclassify"), to).otherwise(F.col("edge_type"))
    bad = (verb == "reject") | ((verb == "reclassify") & to.isin(NEGATIVE))
    status = F.when(~F.col("__on"), F.col("status")).when(bad, "rejected").otherwise("accepted")
    tier = F.when(F.col("__on") & ~bad, "verified").otherwise(F.col("tier"))
    done = a.withColumns({"edge_type": kind, "status": status, "tier": tier})
    pair = [F.col("source_chunk").alias("source_id"), F.col("target_chunk").alias("target_id")]
    made = done.filter("__on AND status = 'accepted'").select(*pair, F.col("edge_type").alias("type"), F.lit("verified").alias("tier")).dropDuplicates(["source_id", "target_id", "type"])
    gone = done.filter("__on AND status = 'rejected'").select(*pair).distinct().join(made, ["source_id", "target_id"], "left_anti")
    mine = edges.filter(F.col("type").isin("PARALLELS", "CONTRASTS")).join(gone, ["source_id", "target_id"], "left_anti")
    rest = edges.filter(~F.col("type").isin("PARALLELS", "CONTRASTS"))
    kept = rest.unionByName(mine).join(made.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti")
    return done.select(*staged.columns), kept.select("source_id", "target_id", "type", "tier").unionByName(made)


def apply_cleanups(cleanups: DataFrame, queue: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """The next staged_cleanups: statuses only; an accept that does not preserve the words is refused,
    and with ``bodies`` (id, body) one whose body has changed since."""
    if bodies is not None:
        stale = fresh_cleanups(cleanups, bodies).filter("stale").select("id")
        no = queue.filter("target_table = 'cleanup' AND action = 'accept'").join(stale.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("id")
        queue = queue.join(no, "id", "left_anti")
    a = cleanups.join(_last(queue, "cleanup"), "id", "left")
    on = (F.col("status") == "pending") & F.col("act").isNotNull()
    verb = F.col("act.action")
    status = F.when(~on, F.col("status")).when((verb == "accept") & F.coalesce("words_preserved", F.lit(False)), "accepted").when(verb == "reject", "rejected").when(verb == "reclassify", "apparatus").otherwise(F.col("status"))
    return a.withColumn("status", F.coalesce(status, F.col("status"))).select(*cleanups.columns)


def refused(tables: dict[str, DataFrame], queue: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """``id, error`` of unapplied actions that a batch cannot carry out."""
    live = queue.filter("applied_at IS NULL AND action <> 'skip'")
    key = {"tag": "staged_tags", "edge": "staged_edges", "cleanup": "staged_cleanups"}
    parts = []
    for table, name in key.items():
        mine = live.filter(F.col("target_table") == table)
        at = tables[name].select(F.col("id").alias("target_id"), "status")
        if table == "tag":  # rows that the batch itself spawns are open to it
            born = mine.filter("action = 'reassign'").select(spawned_id(F.col("target_id"), F.col("reassign_to")).alias("target_id"), F.lit("pending").alias("status")).distinct()
            at = at.unionByName(born.join(at, "target_id", "left_anti"))
        rows = mine.join(at, "target_id", "left")
        parts.append(rows.select("id", F.when(F.col("status").isNull(), "unknown target").when(F.col("status") != "pending", "already resolved").alias("error")))
    accepts = live.filter("target_table = 'cleanup' AND action = 'accept'").select("id", "target_id")
    c = tables["staged_cleanups"]
    lost = c.filter(~F.coalesce("words_preserved", F.lit(False))).select(F.col("id").alias("target_id"))
    parts.append(accepts.join(lost, "target_id", "left_semi").select("id", F.lit("words not preserved").alias("error")))
    if bodies is not None:
        stale = fresh_cleanups(c, bodies).filter("stale").select(F.col("id").alias("target_id"))
        parts.append(accepts.join(stale, "target_id", "left_semi").select("id", F.lit("stale body").alias("error")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.filter("error IS NOT NULL").groupBy("id").agg(F.min("error").alias("error"))


def apply_batch(store, at: Column, commit: bool = False, bodies: DataFrame | None = None, queue: DataFrame | None = None, **how) -> dict:
    """Apply the queue (``queue``, or the store's) to the store's tables; with ``commit``, all of them are published
    at once (``how``: see ``Store.commit``).

    Returns ``errors`` (DataFrame id, error), ``tables`` (the next versions) and
    ``versions`` (what was published; none without ``commit``).  Refused actions
    are not marked as applied.  What the tables are made from stays in the shared
    folder until they are written.
    """
    t = {n: store.read(n) for n in ("staged_tags", "staged_edges", "staged_cleanups", "edges", "nodes")}
    queue = store.read("review_actions") if queue is None else queue
    errors = stored(refused(t, queue, bodies), "refused")
    good = stored(queue.join(errors.select("id"), "id", "left_anti"), "good")  # each of the tables reads it
    tags, edges, nodes = apply_tags(t["staged_tags"], good, t["edges"], t["nodes"])
    staged, edges = apply_edges(t["staged_edges"], good, edges)
    done = mark_applied(good, at).unionByName(queue.join(errors.select("id"), "id", "left_semi"))
    out = {"staged_tags": tags, "staged_edges": staged, "staged_cleanups": apply_cleanups(t["staged_cleanups"], good, bodies), "edges": edges, "nodes": nodes, "review_actions": done}
    return {"errors": errors, "tables": out, "versions": store.commit(out, **how) if commit else {}}


def mark_applied(queue: DataFrame, at: Column) -> DataFrame:
    return queue.withColumn("applied_at", F.coalesce("applied_at", at))


def apply_result(tags: DataFrame, queue: DataFrame, new_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """``applied, edges_created, skipped_already_resolved, already_applied``: one row."""
    live = queue.filter("applied_at IS NULL")
    resolved = live.filter("target_table = 'tag'").join(tags.filter("status <> 'pending'").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    created = new_edges.select("source_id", "target_id", "type").subtract(edges.select("source_id", "target_id", "type"))
    out = live.agg(F.count("*").alias("applied")).crossJoin(created.agg(F.count("*").alias("edges_created"))).crossJoin(resolved.agg(F.count("*").alias("skipped_already_resolved")))
    return out.withColumn("already_applied", F.col("applied") == 0)


def verb_for_chunk(tags: DataFrame, queue: DataFrame, chunk_id: str, verb: str, reviewer: str) -> DataFrame:
    """One action for each tag of a chunk that is pending and not queued yet; never reassign."""
    if verb not in ("accept", "reject", "skip"):
        raise ValueError(f"not a verb for a whole chunk: {verb}")
    queued = queue.filter("target_table = 'tag' AND applied_at IS NULL").select(F.col("target_id").alias("id"))
    rest = tags.filter((F.col("chunk_id") == chunk_id) & (F.col("status") == "pending")).join(queued, "id", "left_anti")
    return rest.select(F.col("id").alias("target_id"), F.lit("tag").alias("target_table"), F.lit(verb).alias("action"), F.lit(reviewer).alias("reviewer"), F.concat_ws(":", F.lit(reviewer), F.lit(verb), "id").alias("client_action_id"))


def auto_promote(staged: DataFrame, floor: float = 0.85) -> DataFrame:
    """The plan of a promotion by confidence: pending edges at or over the floor."""
    return staged.filter((F.col("status") == "pending") & (F.col("confidence") >= floor))
