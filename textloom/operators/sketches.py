"""Distinct and quantile sketches that are stored by version and merged over versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 ** 12 registers: a relative error of about 1.6 % (one standard deviation).
LG_K = 12
#: The quantile sketch's size: a rank error of about 1.3 %.
KLL_K = 200


def sketched(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """``by, n, distinct_sketch, value_sketch``: a row a group, a few kB whatever the group's size."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("value_sketch"))


def merged(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """``by, n, n_distinct, quantiles``: from sketches of any finer grouping, or of several versions."""
    m = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("value_sketch").alias("v"))
    return m.select(*by, "n", F.hll_sketch_estimate("d").alias("n_distinct"), F.kll_sketch_get_quantile_double("v", F.array(*map(F.lit, shares))).alias("quantiles"))


def append_version(store, table: str, df: DataFrame, version: str, by: list[str], distinct: str, value: str) -> int:
    """Sketch a version's rows and add them to the stored sketches; a version that is there already is replaced."""
    new = sketched(df, by, distinct, value).withColumn("version", F.lit(version))
    if store.current(table):
        new = store.read(table).filter(F.col("version") != version).unionByName(new)
    return store.write(table, new)
