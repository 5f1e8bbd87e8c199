"""Operator 13: exact top-k search by a Voronoi join.

Inner products become distances: with M the largest norm in the table, a stored
vector x gets one more component, sqrt(M^2 - |x|^2), and a query a zero there, so
that the squared distance is |q|^2 + M^2 - 2 q.x and the highest score is the
nearest vector.  Stored vectors and queries are grouped by their nearest pivot
(the pivots are rows of the table).  Summaries then bound the search:

- a cell of stored vectors: its radius, and the k + 1 members nearest to its pivot;
- a group of queries: its radius U, and a distance T within which each of its
  queries has k other rows, because k pivots or members named in the summaries
  are that near.

A stored vector further than U + T from a group's pivot is in no answer of the
group, and a cell is passed over as a whole if its pivot is further than that and
its radius.  What is left is copied to the group and solved there, a bounded
chunk of stored vectors against a bounded part of the group in one matrix product
of exact integers; the parts' results meet in one ranking.  Bounds are in doubles
and are widened by more than their rounding, scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .integer_blocks import finite_vectors, floors, largest, longest, matrix, pack, unpack

#: The number of pivots follows the square root of the queries, up to this: they are sent to all tasks.
PIVOTS = 256
#: Queries in a part of a group, about.
PART = 4096
#: Components of stored vectors in a block, and in a chunk that one task solves.
BLOCK = 1 << 19
CHUNK = 1 << 21
#: Scores that are held at once.
SCORES = 1 << 21
#: Components are cut off here, where scores have long left 64 bits.
FAR = 1 << 58
LOW = 62

RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(floors(x, scale), -FAR, FAR).astype(np.int64)


class Pivots:
    """The pivots and the distances of vectors to them."""

    def __init__(self, ids: list[int], x: np.ndarray, most: float):
        self.ids, self.x, self.most = np.array(ids, np.int64), x.astype(float), most
        self.more = self._last(self.x)
        self.between = np.sqrt(np.maximum(((self.x[:, None] - self.x[None]) ** 2).sum(2) + (self.more[:, None] - self.more[None]) ** 2, 0))

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))

    def _root(self, x: np.ndarray, last: np.ndarray, only) -> np.ndarray:
        p, more = self.x[only], self.more[only]
        own = (x * x).sum(1) + last * last
        return np.sqrt(np.maximum(own[:, None] + ((p * p).sum(1) + more * more)[None] - 2 * (x @ p.T + np.outer(last, more)), 0))

    def of_stored(self, x: np.ndarray, only=slice(None)) -> np.ndarray:
        x = x.astype(float)
        return self._root(x, self._last(x), only)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._root(x.astype(float), np.zeros(len(x)), slice(None))

    @property
    def slack(self) -> float:
        """More than the rounding of a distance."""
        return 1e-6 * self.most**0.5 + 1e-9


def _norm(rows: DataFrame, width: int, scale: int) -> float:
    """The largest squared norm."""

    def run(batches):
        for b in batches:
            x = integers(matrix(b.column(0), width), scale).astype(float)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(1).max())])], names=["norm"])

    return rows.select("v").mapInArrow(run, "norm double").agg(F.max("norm")).first()[0] or 0.0


def _cells(rows: DataFrame, pivots: Pivots, width: int, scale: int, k: int) -> DataFrame:
    """``cell, n, radius, near, ids, q``: blocks of stored vectors of one cell.

    Of equal vectors in a block the k + 1 smallest ids stay: a query's answer
    names no more of them.
    """
    step = max(1, BLOCK // max(width, 1))
    near_type = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))

    def run(batches):
        kept, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                kept.append((part.column(0).to_numpy(), integers(matrix(part.column(1), width), scale)))
                n += part.num_rows
                if n >= step:
                    yield from cut(*map(np.concatenate, zip(*kept)))
                    kept, n = [], 0
        if n:
            yield from cut(*map(np.concatenate, zip(*kept)))

    def cut(ids, x):
        d = pivots.of_stored(x)
        cell = d.argmin(1)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            at = at[np.lexsort((ids[at], *x[at].T))] if width else at[np.argsort(ids[at])]
            new = np.append(True, (x[at[1:]] != x[at[:-1]]).any(1))
            begins = np.flatnonzero(new)
            at = at[np.arange(len(at)) - begins[np.cumsum(new) - 1] <= k]
            own = d[at, c]
            near: dict[int, float] = {}
            for i in np.lexsort((ids[at], own)):
                near.setdefault(int(ids[at][i]), float(own[i]))
                if len(near) > k:
                    break
            near_rows = [{"d": v, "id": i} for i, v in near.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(c)], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([float(own.max())]), pa.array([near_rows], near_type), pa.array([ids[at].astype("<i8").tobytes()], pa.binary()), pa.array([pack(x[at])], pa.binary())],
                names=["cell", "n", "radius", "near", "ids", "q"],
            )

    return rows.select("vec_id", "v").mapInArrow(run, "cell int, n long, radius double, near array<struct<d:double,id:long>>, ids binary, q binary")


def _asked(queries: DataFrame, pivots: Pivots, width: int, scale: int, k: int) -> DataFrame:
    """``query_id, cell, d, enough, q``: queries with their pivot, their distance to it, and to the k-th nearest pivot that is another row."""

    def run(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), integers(matrix(b.column(1), width), scale)
            d = pivots.of_queries(x)
            cell = d.argmin(1)
            own = d[np.arange(len(x)), cell]
            d[ids[:, None] == pivots.ids[None]] = np.inf
            enough = np.sort(d, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array(own), pa.array(enough), pa.array([pack(r) for r in x], pa.binary())], names=["query_id", "cell", "d", "enough", "q"])

    return queries.select("vec_id", "v").mapInArrow(run, "query_id long, cell int, d double, enough double, q binary")


def _reach(groups: dict, near: list, pivots: Pivots, k: int) -> dict[int, float]:
    """How far from its pivot a stored vector may lie that a group of queries needs."""
    out = {}
    for g, (radius, enough, _) in groups.items():
        best: dict[int, float] = {}
        for c, i, d in near:
            far = radius + pivots.between[g, c] + d
            best[i] = min(best.get(i, far), far)
        bound = sorted(best.values())[k] if len(best) > k else np.inf
        out[g] = (radius + min(enough, bound)) * (1 + 1e-9) + 4 * pivots.slack
    return out


def _copies(cells: DataFrame, pivots: Pivots, reach: dict[int, float], radius: dict[int, float], parts: dict[int, int], width: int) -> DataFrame:
    """``cell`` (of queries), ``part, ids, q``: the stored vectors that each part of a group needs."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                c, ids, q = (b.column(x)[r].as_py() for x in ("cell", "ids", "q"))
                needed = [g for g in reach if pivots.between[g, c] - radius[c] <= reach[g]]
                if not needed:
                    continue
                ids = np.frombuffer(ids, "<i8")
                x = unpack(q).reshape(len(ids), width)
                d = pivots.of_stored(x, needed)
                for at, g in enumerate(needed):
                    there = np.flatnonzero(d[:, at] <= reach[g])
                    if len(there):
                        own = pa.array([ids[there].tobytes()], pa.binary()), pa.array([pack(x[there])], pa.binary())
                        for p in range(parts[g]):
                            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([p], pa.int64()), *own], names=["cell", "part", "ids", "q"])

    return cells.select("cell", "ids", "q").mapInArrow(run, "cell int, part long, ids binary, q binary")


def _scores(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, object]:
    """All inner products, exactly, and a number below any."""
    bound = q.shape[1] * largest(q) * largest(x)
    if bound < 1 << 24:
        return q.astype(np.float32) @ x.T.astype(np.float32), -np.inf
    if bound < 1 << 53:
        return q.astype(float) @ x.T.astype(float), -np.inf
    if bound < 1 << 62:
        return q @ x.T, np.iinfo(np.int64).min
    return q.astype(object) @ x.T.astype(object), -(1 << 200)


def best_of(qid: np.ndarray, q: np.ndarray, blocks, k: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """``place, score, id`` of each query's k best over blocks of (ids, vectors), ties to the smaller id; its own id is left out."""
    place, score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(qid, kind="stable")
    for xid, x in blocks:
        step = max(k + 1, SCORES // max(1, len(qid)))
        for lo in range(0, len(xid), step):
            i, s = xid[lo : lo + step], None
            s, none = _scores(q, x[lo : lo + step])
            at = np.minimum(np.searchsorted(qid[order], i), len(qid) - 1)
            own = np.flatnonzero(qid[order[at]] == i)
            s[order[at[own]], own] = none
            m = min(k, len(i))
            last = np.partition(s, len(i) - m, axis=1)[:, len(i) - m] if s.dtype != object else np.sort(s, axis=1)[:, len(i) - m]
            row, col = np.nonzero((s >= last[:, None]) & (s > none))
            new = s[row, col] if s.dtype == object else s[row, col].astype(np.int64)
            place, score, ids = np.append(place, row), np.append(score, new), np.append(ids, i[col])
            if len(place):
                by = np.lexsort((ids, -score, place))
                place, score, ids = place[by], score[by], ids[by]
                begins = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                top = np.arange(len(place)) - np.repeat(begins, np.diff(np.append(begins, len(place)))) < k
                place, score, ids = place[top], score[top], ids[top]
    return place, [int(v) for v in score], ids


def search(rows: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows with the highest inner products with each row for which ``is_query`` holds.

    ``rows``: ``vec_id`` and ``embedding``, each component x taken as floor(scale * x).
    Ties go to the smaller id; a query's own id is no candidate; with fewer
    candidates, all of them.  Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; shorter vectors count as
    filled up with zeros.  Rows that repeat an id are candidates each; as a query
    the id is searched with the least of its vectors.  Scores are exact; one
    beyond 64 bits is null but ranks as it is, and components are cut off at 2^58.
    Other columns are ignored; an empty table, or one without queries, gives no rows.
    """
    v = finite_vectors(rows, "vec_id").filter("vec_id IS NOT NULL").withColumn("vec_id", F.col("vec_id").cast("long"))
    width = longest(v)
    queries = v.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    count = min(PIVOTS, max(4 * (k + 1), int(n**0.5)))
    picked = v.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(count).collect() if n else []  # at most PIVOTS rows
    if not picked:
        return v.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    picked = list({r["vec_id"]: r["v"] for r in reversed(picked)}.items())
    points = integers(matrix(pa.array([p for _, p in picked], pa.list_(pa.float64())), width), scale)
    pivots = Pivots([i for i, _ in picked], points, _norm(v, width, scale) * (1 + 1e-12))

    cells = written(_cells(v, pivots, width, scale, k), "cells")
    asked = written(_asked(queries, pivots, width, scale, k), "asked")
    sizes = {r["cell"]: (r["radius"], r["n"]) for r in cells.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
    nearest = cells.select("cell", F.explode("near").alias("m")).groupBy("cell", F.col("m.id").alias("id")).agg(F.min("m.d").alias("d"))
    nearest = nearest.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id"))).filter(F.col("r") <= k + 1)
    near = [(r["cell"], r["id"], r["d"]) for r in nearest.collect()]  # k + 1 rows a cell
    groups = {r["cell"]: (r["u"], r["t"], r["n"]) for r in asked.groupBy("cell").agg(F.max("d").alias("u"), F.max("enough").alias("t"), F.count("*").alias("n")).collect()}
    reach = _reach(groups, near, pivots, k)
    radius = {c: r + pivots.slack for c, (r, _) in sizes.items()}
    parts = {g: -(-size // PART) for g, (_, _, size) in groups.items()}
    chunks = -(-sum(m for _, m in sizes.values()) * max(width, 1) // CHUNK)

    copies = _copies(cells, pivots, reach, radius, parts, width).withColumn("chunk", F.pmod(F.xxhash64("ids"), F.lit(chunks)))
    split = F.create_map(*[F.lit(x) for g in parts.items() for x in g])[F.col("cell")]
    own = asked.select("query_id", "q", "cell", F.pmod(F.xxhash64("query_id"), split).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        qid = left.column("query_id").to_numpy()
        q = np.array([unpack(r) for r in left.column("q").to_pylist()], np.int64).reshape(len(qid), width)

        def blocks():
            for ids, raw in zip(right.column("ids"), right.column("q")):
                ids = np.frombuffer(ids.as_py(), "<i8")
                yield ids, unpack(raw.as_py()).reshape(len(ids), width)

        place, score, ids = best_of(qid, q, blocks(), k) if len(qid) and right.num_rows else ([], [], [])
        return pa.table([qid[place] if len(place) else [], ids, [s >> LOW for s in score], [s & (1 << LOW) - 1 for s in score]], schema=RESULT)

    key = ["cell", "part", "chunk"]
    found = own.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, hi long, lo long")
    w = Window.partitionBy("query_id").orderBy(F.desc("hi"), F.desc("lo"), "vec_id")
    score = F.when(F.col("hi").between(-2, 1), F.shiftleft("hi", LOW) + F.col("lo"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    out = written(best.select("query_id", "rank", "vec_id", score.alias("score")), "best")
    discard(cells)
    discard(asked)
    return out
