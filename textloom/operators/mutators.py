"""Changes of the store's tables as scripts run them: a plan unless told to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, review
from .tables import plan_or_apply

EDGE = ["source_id", "target_id", "type"]


def repair_edges(store, commit: bool = False) -> dict:
    """The EXPRESSES edges that accepted tags lack are inserted."""
    return plan_or_apply(store, {"edges": graph.repair_edges(store.read("staged_tags"), store.read("edges"))}, {"edges": EDGE}, commit)


def auto_promote(store, floor: float = 0.85, commit: bool = False) -> dict:
    """Pending staged edges at or over the floor are accepted, verified and live."""
    staged, edges = store.read("staged_edges"), store.read("edges")
    up = review.auto_promote(staged, floor).select("id", F.lit(True).alias("__up"))
    done = staged.join(up, "id", "left").withColumns({"status": F.when(F.col("__up"), "accepted").otherwise(F.col("status")), "tier": F.when(F.col("__up"), "verified").otherwise(F.col("tier"))})
    made = done.filter("__up").select(F.col("source_chunk").alias("source_id"), F.col("target_chunk").alias("target_id"), F.col("edge_type").alias("type"), F.lit("verified").alias("tier")).dropDuplicates(EDGE)
    live = edges.join(made.select(*EDGE), EDGE, "left_anti").select(*EDGE, "tier").unionByName(made)
    return plan_or_apply(store, {"staged_edges": done.select(*staged.columns), "edges": live}, {"staged_edges": ["id"], "edges": EDGE}, commit)


def merge_concepts(store, alias: DataFrame, commit: bool = False) -> dict:
    """Concepts (alias, canonical) become one, in edges, tags, nodes and names."""
    t = {n: store.read(n) for n in ("edges", "staged_tags", "nodes", "concept_aliases")}
    edges, tags, nodes, names = graph.merge_concept(t["edges"], t["staged_tags"], t["nodes"], alias, t["concept_aliases"])
    new = {"edges": edges, "staged_tags": tags, "nodes": nodes, "concept_aliases": names}
    return plan_or_apply(store, new, {"edges": EDGE, "staged_tags": ["id"], "nodes": ["id"], "concept_aliases": ["alias"]}, commit)
