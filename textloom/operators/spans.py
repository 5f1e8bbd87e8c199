"""Span plans: chunks packed in reading order, in parallel within a work too.

Packing is a walk: a span starts at a chunk, and the next one at the first chunk
that no longer fits.  With the running sums of tokens that successor is found by
binary search, from every chunk at once.  A work is cut into bins of a width in
tokens; a chunk's walk inside its bin is followed there, and gives the chunk of a
later bin at which it comes out.  Walks from different chunks soon meet, so a bin
has few such entries, and the pointers among entries are doubled until those that
the walk from the work's beginning passes are known (pointer jumping).  Then every
bin lists its spans from its entry.  No work is gathered: a task holds a bin, with
the next bin's chunks up to one span further.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import dropped, stored

#: The width of a bin, in spans.
BIN_SPANS = 512
#: Works with more chunks than this are numbered by ranges, each in a task of its own.
LARGE = 1_000_000


def _placed(chunks: DataFrame, unit: list[str], tie: list[str]) -> DataFrame:
    """Adds ``pos`` (from 1) and ``start`` (tokens before it): the running count and sum of each unit, in order."""
    whole = Window.partitionBy(*unit).orderBy(*tie)
    sofar = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    largest = chunks.groupBy(*unit).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= LARGE:
        return chunks.withColumns({"pos": F.row_number().over(whole).cast("long"), "start": F.sum("tok").over(sofar) - F.col("tok")})
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(chunks.repartitionByRange(parts, *unit, *tie).withColumn("part", F.spark_partition_id()), "ranged")
    total = ranged.groupBy(*unit, "part").agg(F.count("*").alias("n"), F.sum("tok").alias("t"))
    before = Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    total = total.select(*unit, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    w = Window.partitionBy(*unit, "part").orderBy(*tie)
    own = ranged.withColumns({"r": F.row_number().over(w), "s": F.sum("tok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    same = [own[c].eqNullSafe(total[c]) for c in (*unit, "part")]
    out = own.join(total, same).select(*[own[c] for c in chunks.columns], (F.col("r") + F.col("n0")).alias("pos"), (F.col("s") - own["tok"] + F.col("t0")).alias("start"))
    return out


def numbered(rows: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``: the place of each row in its unit, from 1."""
    return _placed(rows.withColumn("tok", F.lit(0).cast("long")), unit, order).drop("tok", "start")


def _successors(pos: np.ndarray, start: np.ndarray, tok: np.ndarray, own: int, target: int) -> np.ndarray:
    """For each of the first ``own`` chunks, the index of the chunk after its span."""
    end = start + tok
    return np.maximum(np.searchsorted(end, start[:own] + target, side="right"), np.arange(1, own + 1))


def _exits(t: pa.Table, target: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pos, to_pos, to_bin`` of a bin's chunks: where their walks come out."""
    pos, start, tok = (t[c].to_numpy() for c in ("pos", "start", "tok"))
    own = int((~t["halo"].to_numpy(zero_copy_only=False)).sum())
    nxt = _successors(pos, start, tok, own, target)
    to, at = np.empty(own, np.int64), np.empty(own, np.int64)
    ends = start + tok
    for i in range(own - 1, -1, -1):
        j = nxt[i]
        if j < own:
            to[i], at[i] = to[j], at[j]
        else:
            to[i], at[i] = pos[0] + j, ends[j - 1] // width
    return pos[:own], to, at


def _entries(bins: DataFrame, unit: list[str], kinds: str, target: int, width: int) -> DataFrame:
    """``unit, bin, pos``: the chunks at which the walk from each unit's first chunk comes into its bins."""
    root = bins.filter("pos = 1 AND NOT halo").select(*[F.col(c).alias(c) for c in (*unit, "bin", "pos")])  # aliased: it meets bins in a cogroup
    most = bins.agg(F.max("bin")).first()[0] or 0
    if not most:
        return root
    names = [*unit, "bin", "pos", "to_pos", "to_bin"]
    fixed = {c: to_arrow_type(bins.schema[c].dataType) for c in unit}

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, to, at = _exits(t, target, width)
        n = len(pos)
        return pa.table([*[t[c].slice(0, n).cast(fixed[c]) for c in unit], t["bin"].slice(0, n), pa.array(pos), pa.array(to), pa.array(at)], names=names)

    local = stored(bins.groupBy(*unit, "bin").applyInArrow(follow, f"{kinds}, bin long, pos long, to_pos long, to_bin long"), "exits")
    equal = lambda a, b, x, y: [a[c].eqNullSafe(b[c]) for c in unit] + [a[x] == b[y]]
    into = local.select(*unit, F.col("to_pos").alias("pos")).distinct()
    jump = stored(local.join(into, equal(local, into, "pos", "pos"), "left_semi").unionByName(local.filter("pos = 1")).distinct(), "jumps")
    reached = root
    for _ in range(math.ceil(math.log2(most + 1)) + 1):
        r, j = reached.alias("r"), jump.alias("j")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"j.{c}")) for c in unit] + [F.col("r.pos") == F.col("j.pos")]
        new = r.join(j, same).select(*[F.col(f"r.{c}").alias(c) for c in unit], F.col("j.to_bin").alias("bin"), F.col("j.to_pos").alias("pos"))
        more = stored(reached.unionByName(new).distinct(), "reached")
        a, b = jump.alias("a"), jump.alias("b")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in unit] + [F.col("a.to_pos") == F.col("b.pos")]
        twice = stored(a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in unit], "a.bin", "a.pos", "b.to_pos", "b.to_bin"), "jumps")
        dropped(reached)
        dropped(jump)
        reached, jump = more, twice
    dropped(jump)
    dropped(local)
    return reached


def span_plan(chunks: DataFrame, target: int = 6000, work: str = "work", order: str = "seq", tokens: str = "token_count", member: str | None = None) -> DataFrame:
    """``work, [member,] span, first_seq, last_seq, chunks, tokens``: chunks packed in reading order.

    A chunk opens a new span if the open one would exceed the target with it; a
    chunk over the target is a span of its own.  With ``member``, the texts of a
    grouped work come in the order of that column and no span crosses from one to
    the next.  Spans are numbered within a work.  A chunk without a count, or with
    one below zero, has 0 tokens; chunks of equal order come by their tokens.
    """
    unit = [work, member] if member else [work]
    rows = chunks.select(*[F.col(c) for c in unit], F.col(order).alias("seq"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("tok"))
    width = BIN_SPANS * max(target, 1)
    placed = _placed(rows, unit, ["seq", "tok"])
    placed = placed.withColumn("bin", F.expr(f"start div {width}"))
    # a chunk that a span of the bin before may reach
    seen = F.when((F.col("bin") > 0) & (F.col("start") - F.col("bin") * width < target), F.array(F.struct("bin", F.lit(False).alias("halo")), F.struct((F.col("bin") - 1).alias("bin"), F.lit(True).alias("halo"))))
    seen = seen.otherwise(F.array(F.struct("bin", F.lit(False).alias("halo"))))
    bins = placed.select(*unit, "seq", "tok", "pos", "start", F.inline(seen))
    if (placed.agg(F.max("bin")).first()[0] or 0) > 0:
        bins = stored(bins, "bins")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in unit)
    kind = rows.schema["seq"].dataType
    entries = _entries(bins, unit, kinds, target, width)
    fixed = [to_arrow_type(rows.schema[c].dataType) for c in unit]
    schema = pa.schema([*zip(unit, fixed), ("bin", pa.int64()), ("nth", pa.int64()), ("first_seq", to_arrow_type(kind)), ("last_seq", to_arrow_type(kind)), ("chunks", pa.int64()), ("tokens", pa.int64())])

    def pack(t: pa.Table, entry: pa.Table) -> pa.Table:
        if not (t.num_rows and entry.num_rows):
            return schema.empty_table()
        t = t.sort_by("pos")
        pos, start, tok = (t[c].to_numpy() for c in ("pos", "start", "tok"))
        own = int((~t["halo"].to_numpy(zero_copy_only=False)).sum())
        nxt = _successors(pos, start, tok, own, target)
        i, at = min(entry["pos"].to_pylist()) - int(pos[0]), []
        while 0 <= i < own:
            at.append(i)
            i = int(nxt[i])
        first = np.array(at, np.int64)
        last = nxt[first] - 1 if len(at) else first
        cols = [t[c].take(pa.array(first)) for c in unit]
        return pa.table([*cols, t["bin"].take(pa.array(first)), pa.array(np.arange(1, len(first) + 1)), t["seq"].take(pa.array(first)), t["seq"].take(pa.array(last)), pa.array(last - first + 1), pa.array(start[last] + tok[last] - start[first])], schema=schema)

    sql = f"{kinds}, bin long, nth long, first_seq {kind.simpleString()}, last_seq {kind.simpleString()}, chunks long, tokens long"
    packed = bins.groupBy(*unit, "bin").cogroup(entries.groupBy(*unit, "bin")).applyInArrow(pack, sql)
    # spans are numbered over a work by the counts of its bins
    count = packed.groupBy(*unit, "bin").agg(F.max("nth").alias("n"))
    before = Window.partitionBy(work).orderBy(*unit[1:], "bin").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*[F.col(c).alias(f"__{c}") for c in unit], F.col("bin").alias("__bin"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*unit, "bin")]
    return packed.join(count, same).select(*unit, (F.col("nth") + F.col("before")).cast("int").alias("span"), "first_seq", "last_seq", "chunks", "tokens")


def plan_summary(plan: DataFrame, work: str = "work") -> DataFrame:
    """``work, spans, tokens, degenerate``; pairs to call = spans of works that are not degenerate."""
    return plan.groupBy(work).agg(F.count("*").alias("spans"), F.sum("tokens").alias("tokens")).withColumn("degenerate", F.col("spans") == 1)


def fold_spans(plan: DataFrame, input_budget: int, work: str = "work") -> DataFrame:
    """Second-level groups of spans under a budget; without one, none."""
    if input_budget <= 0:
        return plan.limit(0).select(work, F.col("span").alias("fold"), F.col("span").alias("first_seq"), F.col("span").alias("last_seq"), F.lit(0).cast("long").alias("chunks"), "tokens")
    return span_plan(plan, input_budget, work, "span", "tokens").withColumnRenamed("span", "fold")


def plan_hash(plan: DataFrame) -> DataFrame:
    """One row: a digest of all spans in any order: the sums of four 60-bit pieces of each span's digest, digested."""
    h = F.sha2(F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}")
    total = plan.agg(F.count("*").alias("n"), *[piece(k) for k in range(4)])
    return total.select(F.sha2(F.concat_ws("-", "n", *[f"s{k}" for k in range(4)]), 256).alias("plan_hash"))


def plan_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Spans that only one plan has, or that changed: ``key, state``."""
    rest = [c for c in a.columns if c not in key]
    x = a.select(*key, F.struct(*rest).alias("x"))
    y = b.select(*key, F.struct(*rest).alias("y"))
    state = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return x.join(y, key, "full_outer").select(*key, state.alias("state")).filter("state IS NOT NULL")


def freeze(plan: DataFrame, path: str, target: int = 6000, work: str = "work") -> str:
    """Write a plan as it ships, under ``path``: ``spans`` (JSON, a row a span, in order) and ``summary`` (Markdown, a
    row a work), both headed by the plan's digest, which is returned.  A plan is written once: an existing one is kept."""
    digest = plan_hash(plan).first()[0]
    plan.withColumn("plan_hash", F.lit(digest)).repartitionByRange(work, "span").sortWithinPartitions(work, "span").write.mode("errorifexists").json(f"{path}/spans")
    s = plan_summary(plan, work).orderBy(work)
    flag = F.when(F.col("degenerate"), "degenerate").otherwise("")
    line = F.concat(F.lit("| "), F.col(work).cast("string"), F.lit(" | "), F.col("spans"), F.lit(" | "), F.format_number("tokens", 0), F.lit(" | "), flag, F.lit(" |"))
    total = s.agg(F.count("*").alias("works"), F.sum("spans").alias("spans"), F.sum(F.col("degenerate").cast("int")).alias("degenerate")).first()
    calls = (total["spans"] or 0) - (total["degenerate"] or 0)
    head = [f"plan_hash `{digest}`, span_target {target}", "", f"**{total['works']} works, {total['spans'] or 0} spans**, {total['degenerate'] or 0} degenerate, call pairs: {calls}", "", f"| {work} | spans | tokens | flags |", "|---|---|---|---|"]
    lines = plan.sparkSession.createDataFrame([(i, "", x) for i, x in enumerate(head)], "at long, work string, value string")
    body = s.select(F.lit(len(head)).cast("long").alias("at"), F.col(work).cast("string").alias("work"), line.alias("value"))
    lines.unionByName(body).orderBy("at", "work").select("value").write.mode("errorifexists").text(f"{path}/summary")
    return digest
