"""Operator 10: sharding by extendible hashing.

A shard is a prefix of the key's hash bits.  A shard over its byte limit splits
on the next bit, and only that one, until every shard fits.  The directory is
computed a block of bits at a time: one aggregation gives the bytes of every
prefix that is a block longer; the sums of all shorter prefixes follow from
these cells (at most 2 ** BLOCK of them for each prefix carried on), and a
shard is the shortest prefix that fits.  Only cells that are still too large
go on to the next block.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

BLOCK = 15
BITS = 120  # 60 of the key, then 60 that tell equal keys apart
LIMIT = 2 << 20


def _bits(hex_text):
    """60 bits, as text, of a hex text's first 15 digits."""
    return F.lpad(F.bin(F.conv(F.substring(hex_text, 1, 15), 16, 10).cast("long")), 60, "0")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, row: str | None = None) -> DataFrame:
    """The shard of every row: ``doc_id, n_bytes, shard, shard_bytes, shard_docs``.

    With ``row``, a column that tells rows apart, that column comes first.

    ``shard`` is the bit prefix ('' for a single shard).  Its bytes (UTF-8 of
    the text) are at most ``limit`` unless it is one row alone that is larger.
    A null key hashes as ''; a null text has 0 bytes; rows with equal keys are
    told apart by 60 bits drawn for each row, once all the key's bits are used.
    Other columns are ignored; an empty table gives no rows; of a text, however
    long, only the length is read.
    """
    extra = [row] if row else []
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    own = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    slim = written(docs.select(*extra, F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.concat(_bits(h), _bits(own)).alias("bits")), "keys")
    todo, parts = slim.withColumn("path", F.lit("")), []
    for at in range(0, BITS, BLOCK):
        cells = todo.groupBy("path", F.expr(f"substring(bits, {at + 1}, {BLOCK})").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
        up = cells.select("path", "cell", "bytes", "docs", F.explode(F.sequence(F.lit(0 if at == 0 else 1), F.lit(BLOCK))).alias("d")).withColumn("prefix", F.expr("substring(cell, 1, d)"))
        sums = up.groupBy("path", "d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
        mine = up.select("path", "cell", "d", "prefix").join(sums.withColumn("fits", fits), ["path", "d", "prefix"])
        first = mine.groupBy("path", "cell").agg(F.min_by(F.struct("prefix", "shard_bytes", "shard_docs"), F.when(F.col("fits"), F.col("d"))).alias("s"))
        first = written(first.select("path", "cell", "s.*"), "directory")
        more = first.filter("prefix IS NULL").limit(1).count() > 0
        # the first block's directory has 2 ** BLOCK rows at most, whatever the input
        joined = todo.withColumn("cell", F.expr(f"substring(bits, {at + 1}, {BLOCK})")).join(F.broadcast(first) if at == 0 else first, ["path", "cell"])
        parts.append(joined.filter("prefix IS NOT NULL").select(*extra, "doc_id", "n_bytes", F.concat("path", "prefix").alias("shard"), "shard_bytes", "shard_docs"))
        if not more:
            break
        todo = joined.filter("prefix IS NULL").select(*extra, "doc_id", "n_bytes", "bits", F.concat("path", "cell").alias("path"))
    else:
        raise ValueError(f"rows that {BITS} bits do not tell apart")
    return reduce(DataFrame.unionByName, parts)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, tasks: int = 2000) -> DataFrame:
    """Write ``docs`` as one folder of Parquet a shard (``shard=b<bits>``), and return the directory.

    Every row is written once: the shard travels by a row number that a table
    in the shared folder fixes, so null and repeated ids are allowed.  A task
    writes several shards, each whole, where there are more than ``tasks``.  All
    columns are kept as they are; where one is named ``shard``, the folders are
    named ``shard_``.  An empty table writes no folders.
    """
    row, folder = f"row-{uuid.uuid4().hex}", "shard"
    while folder.lower() in map(str.lower, docs.columns):
        folder += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    at = written(assign_shards(rows, limit=limit, row=row), "shards")
    whole = rows.join(at.select(row, F.concat(F.lit("b"), "shard").alias(folder)), row).drop(row)
    n = max(1, at.select("shard").distinct().count())
    whole.repartition(min(n, tasks), folder).write.partitionBy(folder).parquet(path)
    discard(rows)
    return at.groupBy("shard").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_docs").alias("shard_docs"))
