"""Joins by time without a theta join: as-of, and points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, take: list[str], width: int = 24 * 3600, within: int | None = None, tie: str | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``on`` that is not later: adds ``take`` and ``right_at``.

    Of right rows at one time the largest ``tie`` counts (default: the columns
    taken, in order).  ``within``: seconds after which a right row is too old.
    Without one, nulls.

    Both sides are sorted together in bins of ``width`` seconds of a key, and a bin
    takes the last right row of the bins before it from a table with a row a bin:
    a key with any number of rows is spread over its bins.
    """
    order = [tie] if tie else take
    got = F.struct(F.col(right_at).alias("at"), *[F.col(c).alias(f"tie{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"take{k}") for k, c in enumerate(take)])
    bin_of = lambda c: F.expr(f"{{}} div {width * 1_000_000}".format(f"unix_micros(cast(`{c}` as timestamp))"))
    r = right.filter(F.col(right_at).isNotNull()).select(*on, F.col(right_at).cast("timestamp").alias("__t"), F.lit(0).alias("__side"), got.alias("__got"), bin_of(right_at).alias("__bin"))
    mine = F.struct(*left.columns)
    x = left.select(*on, F.col(at).cast("timestamp").alias("__t"), F.lit(1).alias("__side"), mine.alias("__row"), bin_of(at).alias("__bin"))
    both = r.unionByName(x, allowMissingColumns=True)
    sort = [F.col("__t"), F.col("__side"), F.col("__got")]
    in_bin = Window.partitionBy(*on, "__bin").orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("__got", ignorenulls=True)
    rows = both.withColumn("__in", last.over(in_bin)).filter("__side = 1")
    ends = both.groupBy(*on, "__bin").agg(F.max("__got").alias("__last"))
    before = Window.partitionBy(*on).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("__bin").alias("__b"), F.last("__last", ignorenulls=True).over(before).alias("__before"))
    same = [F.col(c) == F.col(f"__{c}") for c in on] + [F.col("__bin") == F.col("__b")]
    found = rows.join(ends, same, "left").withColumn("__found", F.coalesce("__in", "__before"))
    if within is not None:
        young = _micros(F.col("__t")) - _micros(F.col("__found.at")) <= within * 1_000_000
        found = found.withColumn("__found", F.when(young, F.col("__found")))
    return found.select("__row.*", F.col("__found.at").alias(right_at), *[F.col(f"__found.take{k}").alias(c) for k, c in enumerate(take)])


def in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """All pairs of a point and an interval of the same ``on`` with start <= at < end; the columns of both, ``on`` once.

    An interval falls into one or two bins of a width that is the power of two of
    microseconds next to its length, and a point is looked up once for each width that
    occurs, so that neither long intervals nor short ones make many rows.  Intervals
    that end where they start, or before, or lack an end hold nothing.
    """
    i = intervals.withColumns({"__s": _micros(F.col(start)), "__e": _micros(F.col(end))}).filter("__e > __s")
    level = F.ceil(F.log2(F.col("__e") - F.col("__s"))).cast("int")
    i = i.withColumn("__level", level)
    bin_of = lambda c: F.expr(f"shiftright({c}, __level)")
    i = i.withColumn("__bin", F.explode(F.array_distinct(F.array(bin_of("__s"), bin_of("__e - 1")))))
    levels = i.select("__level").distinct()  # at most 63
    p = points.withColumn("__p", _micros(F.col(at))).join(F.broadcast(levels)).withColumn("__bin", bin_of("__p"))
    met = p.join(i, [*on, "__level", "__bin"]).filter("__s <= __p AND __p < __e")
    return met.drop("__s", "__e", "__p", "__level", "__bin")
