"""Row-level table operators: upserts, dedupes, remaps, set differences, checks.

Tables are immutable: each operator gives the next version of a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not taken, one a key, join the old ones."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def selective_upsert(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """On a taken key only ``update`` columns change; other new rows are inserted."""
    o, n = old.withColumn("__old", F.lit(True)), new.select(*key, *[F.col(c).alias(f"__{c}") for c in old.columns if c not in key])
    both = o.join(n, key, "full_outer")
    pick = [F.col(c) if c in key else (F.coalesce(f"__{c}", c) if c in update else F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}"))).alias(c) for c in old.columns]
    return both.select(*pick)


def update_or_ignore(df: DataFrame, column: str, mapping: DataFrame, unique: list[str], order: str = "id") -> DataFrame:
    """Re-point ``column`` through ``mapping`` (old, new); a moved row whose unique key is taken goes."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("__new"))
    moved = df.join(m, column, "left").withColumn("__moved", F.col("__new").isNotNull()).withColumn(column, F.coalesce("__new", column)).drop("__new")
    w = Window.partitionBy(*unique).orderBy("__moved", order)
    return moved.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*df.columns)


def dedupe_where(df: DataFrame, condition: Column, key: list[str], order: str = "id") -> DataFrame:
    """One row a key (the first by ``order``) among the rows that meet the condition; all others stay."""
    w = Window.partitionBy("__in", *key).orderBy(order)
    rows = df.withColumn("__in", F.coalesce(condition, F.lit(False)))
    return rows.withColumn("__r", F.row_number().over(w)).filter("NOT __in OR __r = 1").select(*df.columns)


def match_by_body(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old_id, new_id``: the i-th old id of a body with the i-th new id of the same; no partner: null."""

    def ranked(df, name):
        h = F.sha2(strip(F.col("body")), 256).alias("h")
        rows = df.select(F.col("id").alias(name), h)
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy(name)))

    return ranked(old, "old_id").join(ranked(new, "new_id"), ["h", "k"], "left").select("old_id", "new_id")


def remap_faults(mapping: DataFrame, new: DataFrame) -> DataFrame:
    """New ids that no old one maps to, and those that several do."""
    count = mapping.filter("new_id IS NOT NULL").groupBy("new_id").count()
    rows = new.select(F.col("id").alias("new_id")).join(count, "new_id", "left")
    return rows.select("new_id", F.when(F.col("count").isNull(), "unmapped").when(F.col("count") > 1, "ambiguous").alias("fault")).filter("fault IS NOT NULL")


def rewrite_refs(df: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    """Ids in ``columns`` replaced through ``mapping`` (old_id, new_id); rows that name a deleted id go."""

    def one(d: DataFrame, c: str) -> DataFrame:
        m = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"), F.lit(True).alias("__hit"))
        d = d.join(m, c, "left").filter("__hit IS NULL OR __new IS NOT NULL")
        return d.withColumn(c, F.coalesce("__new", c)).drop("__new", "__hit")

    return reduce(one, columns, df).select(*df.columns)


def residual(df: DataFrame, columns: list[str], deleted: DataFrame) -> DataFrame:
    """Rows that still name a deleted id: none, or the change must not be published."""
    hits = [df.join(deleted.select(F.col("id").alias(c)), c, "left_semi").select(*df.columns) for c in columns]
    return reduce(DataFrame.unionByName, hits).distinct()


def parity(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on one side only, as sets of ``columns``; ``side`` tells which."""
    a, b = a.select(*columns), b.select(*columns)
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def drift(planned: DataFrame, live: DataFrame, corpus: DataFrame, key: str = "id") -> DataFrame:
    """Live rows that are off plan (still in the corpus) or orphaned, and planned ones that are missing."""
    off = live.select(key).join(planned.select(key), key, "left_anti")
    known = corpus.select(key).distinct().withColumn("__known", F.lit(True))
    off = off.join(known, key, "left").select(key, F.when(F.col("__known"), "off_plan").otherwise("orphaned").alias("state"))
    return off.unionByName(planned.select(key).join(live.select(key), key, "left_anti").withColumn("state", F.lit("missing")))


def count_gate(declared: DataFrame, files: DataFrame, key: str = "text_id") -> DataFrame:
    """Texts whose declared count is not the number of files: ``key, declared, found``."""
    n = files.groupBy(key).agg(F.count("*").alias("found"))
    both = declared.join(n, key, "full_outer").select(key, F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("declared <> found")


def backfill(df: DataFrame, column: str, bound: int, below: str, above: str, id_col: str = "id") -> DataFrame:
    """Null values filled by id range."""
    return df.withColumn(column, F.coalesce(column, F.when(F.col(id_col) < bound, below).otherwise(above)))


def page_after(df: DataFrame, cursor, n: int, key: str = "id") -> DataFrame:
    """Keyset pagination: the n rows after the cursor (null: from the top)."""
    rows = df if cursor is None else df.filter(F.col(key) > cursor)
    return rows.orderBy(key).limit(n)


def remaining(df: DataFrame, cursor, key: str = "id") -> DataFrame:
    """``ahead, behind``: rows after and up to the cursor."""
    behind = F.lit(False) if cursor is None else F.col(key) <= cursor
    return df.agg(F.count_if(~behind).alias("ahead"), F.count_if(behind).alias("behind"))


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("rank") <= n)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """``label, n`` for each table."""
    return reduce(DataFrame.unionAll, [d.agg(F.lit(k).alias("label"), F.count("*").alias("n")) for k, d in tables.items()])


def conditional_manifest(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """``label, n``: conditional counts of one table, in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return one.unpivot([], list(counts), "label", "n")


def latest(df: DataFrame, n: int, by: str, key: str = "id") -> DataFrame:
    """The n newest rows, the newest first; of equal times the larger key."""
    return df.orderBy(F.desc(by), F.desc(key)).limit(n)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; a name that is not there, or that is taken, is an error."""
    gone, taken = set(names) - set(df.columns), set(names.values()) & (set(df.columns) - set(names))
    if gone or taken:
        raise ValueError(f"cannot rename: missing {sorted(gone)}, taken {sorted(taken)}")
    return df.withColumnsRenamed(names)


def add_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns (name, type) added as null where they are not there yet."""
    return df.withColumns({k: F.lit(None).cast(t) for k, t in kinds.items() if k not in df.columns})


def missing_tables(spark, expected: list[str], found: list[str]) -> list[str]:
    """Expected tables that are not there; raise on them before use."""
    return sorted(set(expected) - set(found))


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``change, n``: how many rows of a table are added, removed and changed, told by its key."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("__a"), F.lit(True).alias("__old"))
    b = new.select(*key, F.struct(*rest).alias("__b"), F.lit(True).alias("__new"))
    same = [a[c].eqNullSafe(b[c]) for c in key]
    what = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, same, "full_outer").select(what.alias("change")).filter("change IS NOT NULL").groupBy("change").agg(F.count("*").alias("n"))


def plan_or_apply(store, new: dict[str, DataFrame], keys: dict[str, list[str]], commit: bool = False) -> dict:
    """What a change of the store's tables would do: ``plan`` (table, change, n); with ``commit``, it is published at once.

    Without ``commit`` nothing is written.  ``versions``: what was published.
    """
    parts = [changes(store.read(t), df, keys[t]).select(F.lit(t).alias("table"), "change", "n") for t, df in new.items()]
    plan = parts[0]
    for p in parts[1:]:
        plan = plan.unionByName(p)
    rows = [tuple(r) for r in plan.orderBy("table", "change").collect()]  # three rows a table
    return {"plan": rows, "versions": store.commit(new) if commit else {}}
