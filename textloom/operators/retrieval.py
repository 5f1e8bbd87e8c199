"""A retrieval query as one plan: vector search, concept walk, fusion, caps, bodies."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, vectors


#: Edges that a task of the concept walk joins and counts.
TASK_EDGES = 500_000


@dataclass(frozen=True)
class Ranking:
    """The ranking configuration; the defaults are the reference's published settings."""

    top_k: int = 10
    min_similarity: float = 0.5
    max_per_tradition: int = 3
    max_concepts: int = 5
    min_word_len: int = 3
    vector: float = 0.7
    graph: float = 0.3
    bonus: float = 0.1


def matched_concepts(questions: DataFrame, concepts: DataFrame, most: int = 5, min_word_len: int = 3) -> DataFrame:
    """``query_id, concept_id``: concepts that a question (query_id, question) names, at most ``most`` (0: all)."""
    hit = graph.match_concepts(questions, concepts.select("concept_id"), "question", "concept_id", min_word_len)
    w = Window.partitionBy("query_id").orderBy("concept_id")
    ranked = hit.select("query_id", "concept_id", F.row_number().over(w).alias("r"))
    return (ranked.filter(F.col("r") <= most) if most else ranked).select("query_id", "concept_id")


def graph_walk(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, id, tier_weight, graph_score``: chunks one EXPRESSES edge away from matched concepts.

    The graph score is the share of the matched concepts that the chunk expresses.
    Edges meet the concepts in tasks of about ``TASK_EDGES``: a partition that is
    large enough by its bytes holds millions of these short rows.
    """
    n = matched.groupBy("query_id").agg(F.count("*").alias("of"))
    e = edges.filter("type = 'EXPRESSES'").select(F.col("source_id").alias("id"), F.expr("substr(target_id, 9)").alias("concept_id"), graph.tier_weight(F.col("tier")).alias("w"))
    tasks = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // TASK_EDGES))  # fewer than the setting would be dealt anew by the join
    e = e.repartition(tasks, "concept_id")
    hit = e.join(matched, "concept_id").groupBy("query_id", "id").agg(F.max("w").alias("tier_weight"), F.count_distinct("concept_id").alias("hits"))
    return hit.join(n, "query_id").select("query_id", "id", "tier_weight", (F.col("hits") / F.col("of")).alias("graph_score"))


def retrieve(questions: DataFrame, stored: DataFrame, edges: DataFrame, concepts: DataFrame, chunks: DataFrame, r: Ranking = Ranking()) -> DataFrame:
    """The ranked chunks of every question, with their bodies.

    ``questions``: query_id, question, vector; ``stored``: id, vector;
    ``chunks``: id, tradition, body.  Returns ``query_id, rank, id, tradition,
    score, body``; a chunk without a body has ''.
    """
    top = vectors.top_k(stored, questions.withColumnRenamed("query_id", "__question"), r.top_k, r.min_similarity, "id", "vector", query_key="__question").drop("rank")
    walked = graph_walk(matched_concepts(questions, concepts, r.max_concepts, r.min_word_len), edges)
    both = top.join(walked, ["query_id", "id"], "full_outer").join(chunks.select("id", "tradition"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.withColumn("base", r.vector * zero("similarity") + r.graph * F.greatest(zero("tier_weight"), zero("graph_score")))
    place = F.row_number().over(Window.partitionBy("query_id", "tradition").orderBy(F.desc("base"), "id"))
    both = both.withColumn("place", place)
    if r.max_per_tradition:
        both = both.filter(F.col("place") <= r.max_per_tradition)
    both = both.withColumn("score", F.col("base") + F.when(F.col("place") == 1, r.bonus).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = both.withColumn("rank", rank).filter(F.col("rank") <= r.top_k).join(chunks.select("id", "body"), "id", "left")
    return out.select("query_id", "rank", "id", "tradition", "score", F.coalesce("body", F.lit("")).alias("body"))


def picker(nodes: DataFrame, text: str, current: str | None = None) -> DataFrame:
    """Nodes whose label (in any case) or id contains the text, without the current one."""
    hit = F.lower("label").contains(text.lower()) | F.lower("id").contains(text.lower())
    return nodes.filter(hit & ~F.col("id").eqNullSafe(F.lit(current))).orderBy("label", "id")


class Remembered:
    """Results of an expensive count, by key, for some seconds."""

    def __init__(self, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._kept = seconds, clock, {}

    def get(self, key: str, make: Callable[[], object]) -> object:
        at, now = self._kept.get(key), self.clock()
        if at is None or now - at[0] >= self.seconds:
            at = self._kept[key] = (now, make())
        return at[1]

    def forget(self) -> None:
        self._kept.clear()
