"""Connected components of a link table, by alternating large and small stars.

Every round is two joins and two aggregations of the links; each round's links
are written to the shared folder, so the lineage stays short.  No adjacency
list is ever gathered: a node's smallest neighbour is an aggregate, and the
join that hands it to the node's links has one row a node on its other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: pairs (u, v) of one orderable type.  Returns ``node, root`` for
    every node that has a link to another; root is the smallest node reachable.

    Null ends and self-links make no link; repeats and both directions are
    allowed; no links give no rows.
    """
    spark = links.sparkSession
    cur = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(cur)
    if not before[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(large)
        after = _state(nxt)
        discard(cur)
        cur = nxt
        if after == before:
            break
        before = after
    roots = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
