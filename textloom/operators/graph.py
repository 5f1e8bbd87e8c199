"""The knowledge graph: nodes and edges, works, repairs, concept search, derived parallels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .tables import insert_ignore

TIER_WEIGHTS = {"verified": 1.0, "proposed": 0.7, "inferred": 0.4}


def tier_weight(c: Column) -> Column:
    w = F.lit(0.0)
    for k, v in TIER_WEIGHTS.items():
        w = F.when(c == k, v).otherwise(w)
    return w


def resolve_chunk_id(c: Column) -> Column:
    """``tradition, text_id, seq`` of a chunk id; null where it has fewer parts."""
    p = F.split(c, r"\.", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("tradition"), p[1].alias("text_id"), p[2].alias("seq")))


def chunk_path(c: Column) -> Column:
    r = resolve_chunk_id(c)
    return F.concat(F.lit("corpus/"), r["tradition"], F.lit("/"), r["text_id"], F.lit("/chunks/"), r["seq"], F.lit(".toml"))


def lookup_paths(ids: DataFrame, files: DataFrame, column: str = "id") -> DataFrame:
    """Adds ``path``: the chunk's file in the listing ``files`` (path); null where there is none."""
    listed = files.select("path").distinct().withColumn("__there", F.col("path"))
    own = ids.withColumn("path", chunk_path(F.col(column)))
    return own.join(listed, "path", "left").withColumn("path", F.col("__there")).select(*ids.columns, "path")


def bootstrap(chunks: DataFrame, only_text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes for chunks and traditions, and BELONGS_TO edges; a filter nothing matches gives none."""
    c = chunks.withColumn("ref", resolve_chunk_id(F.col("id"))).filter("ref IS NOT NULL")
    if only_text is not None:
        c = c.filter(F.col("ref.text_id") == only_text)
    own = c.select("id", F.lit("chunk").alias("type"), F.col("ref.tradition").alias("tradition_id"), F.col("section").alias("label"), F.to_json(F.struct(F.col("ref.text_id").alias("text_id"))).alias("metadata_json"))
    trad = c.select(F.col("ref.tradition").alias("id"), F.lit("tradition").alias("type"), F.col("ref.tradition").alias("tradition_id"), F.col("tradition").alias("label"), F.lit(None).cast("string").alias("metadata_json")).dropDuplicates(["id"])
    edges = c.select(F.col("id").alias("source_id"), F.col("ref.tradition").alias("target_id"), F.lit("BELONGS_TO").alias("type"), F.lit("verified").alias("tier"))
    return own.unionByName(trad), edges


def concepts_for(edges: DataFrame, nodes: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """EXPRESSES targets of chunks: ``chunk_id, concept_id, label``."""
    e = edges.filter(F.col("type") == "EXPRESSES").join(chunk_ids, edges["source_id"] == chunk_ids["id"], "left_semi")
    n = nodes.filter(F.col("type") == "concept").select(F.col("id").alias("target_id"), "label")
    return e.join(n, "target_id").select(F.col("source_id").alias("chunk_id"), F.expr("substr(target_id, 9)").alias("concept_id"), "label")


def missing_edges(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Accepted tags without their EXPRESSES edge."""
    want = tags.filter("status = 'accepted'").select(F.col("chunk_id").alias("source_id"), F.concat(F.lit("concept."), "concept_id").alias("target_id")).distinct()
    return want.join(edges.filter("type = 'EXPRESSES'"), ["source_id", "target_id"], "left_anti")


def repair_edges(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with the missing ones inserted as verified."""
    new = missing_edges(tags, edges).withColumns({"type": F.lit("EXPRESSES"), "tier": F.lit("verified")})
    return insert_ignore(edges.select("source_id", "target_id", "type", "tier"), new, ["source_id", "target_id", "type"])


def redundant_rejects(tags: DataFrame, model: str) -> DataFrame:
    """Rejected tags of a model whose pair another tag has accepted."""
    ok = tags.filter("status = 'accepted'").select("chunk_id", "concept_id")
    return tags.filter((F.col("status") == "rejected") & (F.col("model") == model)).join(ok, ["chunk_id", "concept_id"], "left_semi")


def retarget_concept(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges moved to canonical concepts (alias, canonical), one a key."""
    m = alias.select(F.col("alias").alias("target_id"), "canonical")
    moved = edges.join(F.broadcast(m) if alias.limit(10_001).count() <= 10_000 else m, "target_id", "left")
    return moved.withColumn("target_id", F.coalesce("canonical", "target_id")).select(*edges.columns).dropDuplicates(["source_id", "target_id", "type"])


def merge_concept(edges: DataFrame, tags: DataFrame, nodes: DataFrame, alias: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The next edges, tags, nodes and alias rows once concepts (alias, canonical) are one.

    Edges and tags move to the canonical concept, the old name becomes an
    alias, and a concept node that nothing names any more goes.  Aliases may be
    given as node ids ('concept.x') or as concept ids ('x').
    """
    bare = lambda c: F.regexp_replace(c, r"^concept\.", "")
    alias = alias.select(*[F.concat(F.lit("concept."), bare(c)).alias(c) for c in ("alias", "canonical")])
    moved = retarget_concept(edges, alias)
    m = alias.select(bare("alias").alias("concept_id"), bare("canonical").alias("__to"))
    new_tags = tags.join(m, "concept_id", "left").withColumn("concept_id", F.coalesce("__to", "concept_id")).select(*tags.columns)
    rows = alias.select(bare("alias").alias("alias"), bare("canonical").alias("concept_id"))
    left = nodes.join(alias.select(F.col("alias").alias("id")), "id", "left_anti")
    return moved, new_tags, left, insert_ignore(aliases, rows, ["alias"])


def canonical_pairs(pairs: DataFrame, a: str = "source_chunk", b: str = "target_chunk") -> DataFrame:
    """Adds ``pair_a, pair_b`` (sorted) and ``presentation_order`` ('ab', or 'ba' where they were turned)."""
    return pairs.withColumns({"pair_a": F.least(a, b), "pair_b": F.greatest(a, b), "presentation_order": F.when(F.col(a) <= F.col(b), "ab").otherwise("ba")})


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, id, depth``: all nodes within ``depth`` edges (source_id to target_id) of each seed (id), at their least depth.

    Each step goes on from the nodes that the step before has found, and a node
    seen from a seed is not seen again: cycles end.  The steps' tables stay in the
    shared folder, which the result reads.
    """
    e = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct()
    new = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0))
    seen = new
    for k in range(1, depth + 1):
        step = new.join(e, "id").select("seed", F.col("to").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        new = stored(step.withColumn("depth", F.lit(k)), "frontier")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def works(texts: DataFrame, declared: DataFrame) -> DataFrame:
    """``work_id, label, tradition, members, grouped``: declared works, and each other text on its own."""
    member = declared.select("id", F.explode("members").alias("text_id"))
    single = texts.join(member, "text_id", "left_anti")
    return declared.select(F.col("id").alias("work_id"), "label", "tradition", "members", F.lit(True).alias("grouped")).unionByName(
        single.select(F.col("text_id").alias("work_id"), F.col("text_name").alias("label"), "tradition", F.array("text_id").alias("members"), F.lit(False).alias("grouped"))
    )


def work_faults(texts: DataFrame, declared: DataFrame) -> DataFrame:
    """``work_id, fault, detail``: unknown or doubly claimed members, mixed or wrong traditions, and ids
    that a text of no work has (a work may be named like its own member)."""
    m = declared.select("id", F.col("tradition").alias("said"), F.explode("members").alias("text_id")).join(texts.select("text_id", F.col("tradition").alias("found")), "text_id", "left")
    unknown = m.filter("found IS NULL").select("id", F.lit("not in corpus").alias("fault"), F.col("text_id").alias("detail"))
    twice = m.groupBy("text_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1").select("id", F.lit("claimed twice").alias("fault"), F.col("text_id").alias("detail"))
    per = m.filter("found IS NOT NULL").groupBy("id").agg(F.count_distinct("found").alias("n"), F.min("found").alias("found"), F.first("said").alias("said"))
    mixed = per.filter("n > 1").select("id", F.lit("span traditions").alias("fault"), F.col("n").cast("string").alias("detail"))
    wrong = per.filter("n = 1 AND said <> found").select("id", F.lit("wrong tradition").alias("fault"), F.col("found").alias("detail"))
    single = texts.select(F.col("text_id").alias("id")).join(m.select(F.col("text_id").alias("id")), "id", "left_anti")
    taken = declared.join(single, "id", "left_semi").select("id", F.lit("id is a text's").alias("fault"), F.col("id").alias("detail"))
    return unknown.unionAll(twice).unionAll(mixed).unionAll(wrong).unionAll(taken).withColumnRenamed("id", "work_id")


def work_of(w: DataFrame) -> DataFrame:
    return w.select(F.explode("members").alias("text_id"), "work_id")


def concept_matches(query: Column, concept: Column, min_len: int = 3) -> Column:
    """Whether a query names a concept: its whole name, or a word of it that is long enough."""
    q = F.lower(query)
    return (F.instr(q, F.replace(F.lower(concept), F.lit("_"), F.lit(" "))) > 0) | F.exists(F.split(F.lower(concept), "_"), lambda w: (F.char_length(w) >= min_len) & q.contains(w))


#: Letters of a name or word by which concepts and queries are brought together.
GRAM = 3


def match_concepts(queries: DataFrame, concepts: DataFrame, query: str = "query", concept: str = "concept", min_len: int = 3) -> DataFrame:
    """All rows of both tables in which the query names the concept (see ``concept_matches``).

    A query that holds a name or a word holds its first letters: an equi-join on
    these finds the candidates, each checked once.  Both tables are whole rows;
    a pair of rows that meets in several words comes out once.
    """
    begin = lambda c: F.substring(c, 1, GRAM)
    name = F.lower(concept)
    words = F.filter(F.split(name, "_"), lambda w: F.char_length(w) >= min_len)
    keys = F.array_distinct(F.concat(F.array(begin(F.replace(name, F.lit("_"), F.lit(" ")))), F.transform(words, begin)))
    c = concepts.withColumn("__gram", F.explode(keys))
    text = F.lower(query)
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    q = queries.withColumn("__gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[grams(n) for n in range(1, GRAM + 1)]))))
    met = q.join(c, "__gram").filter(concept_matches(F.col(query), F.col(concept), min_len))
    # of the grams by which a pair meets, the first of the concept's own counts
    held = F.filter(keys, lambda g: F.instr(text, g) > 0)
    return met.filter(F.col("__gram") == F.try_element_at(held, F.lit(1))).drop("__gram")


def top_of_group(df: DataFrame, by: str, order: list[Column | str], n: int) -> DataFrame:
    """At most n rows of each group; 0: all."""
    return df if not n else df.withColumn("group_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("group_rank") <= n)
