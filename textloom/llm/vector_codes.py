"""Operator 11: vector code compression with exact integer codebooks, assigned by exponion search.

Vectors become integers and are cut into equal parts, each with its own
codebook.  They are packed in blocks, one row a block, and a round is one pass
over the blocks: it assigns every part and writes the blocks with their new codes
and the sums that the next codebooks need; those sums are a column of their own,
so that reading them reads little else.  Nothing but the sums is shuffled.

Exponion search: a part starts at the entry it had (in the first round, at entry
0), at squared distance u.  An entry that lies further than 2 sqrt(u) from that
one is further than sqrt(u) from the part, by the triangle inequality, so only
entries inside this radius are looked at, in the order of their distance from the
start.  All of it is in exact integers: squared gaps are compared with 4 u, ends
of the radius included, so that a tie still goes to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .integer_blocks import finite_vectors, floors, largest, longest, matrix, pack, unpack

#: Components in a block, about.
BLOCK = 1 << 18
LIMB = 32


def nearest_entries(x: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index, by exponion search from ``start``."""
    gaps = ((entries[:, None] - entries[None]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    best, least = start.copy(), ((x - entries[start]) ** 2).sum(1)
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        radius = 4 * least[rows]
        for j in order[a]:
            inside = radius >= gaps[a, j]
            rows, radius = rows[inside], radius[inside]
            if not len(rows):
                break
            if j == a:
                continue
            d = ((x[rows] - entries[j]) ** 2).sum(1)
            better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            least[rows[better]], best[rows[better]] = d[better], j
    return best, least


def assign(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors (rows) of a block; ``books``: parts x entries x components."""
    parts, _, width = books.shape
    if 16 * x.shape[1] * max(largest(x), largest(books)) ** 2 >= 1 << 62:
        x, books = x.astype(object), books.astype(object)
    out = np.zeros((len(x), parts), np.int64)
    error = np.zeros(len(x), x.dtype)
    for p in range(parts):
        start = np.zeros(len(x), np.int64) if codes is None else codes[:, p].astype(np.int64)
        out[:, p], d = nearest_entries(x[:, p * width : (p + 1) * width], books[p], start)
        error += d
    return out, error


def sums_of(x: np.ndarray, codes: np.ndarray, parts: int, entries: int) -> np.ndarray:
    """The number of each entry's parts, then the sums of their components, in a row."""
    width = x.shape[1] // parts
    if len(x) * largest(x) >= 1 << 62:
        x = x.astype(object)
    count, total = np.zeros((parts, entries), x.dtype), np.zeros((parts, entries, width), x.dtype)
    for p in range(parts):
        np.add.at(count[p], codes[:, p], 1)
        np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
    return np.concatenate((count.ravel(), total.ravel()))


def _blocks(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """``ids, labels, n, q, codes, sums``: about BLOCK components a row, not assigned yet."""
    step = max(1, BLOCK // max(width, 1))
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches):
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= step:
                yield from cut(pa.Table.from_batches(kept).combine_chunks())
                kept, n = [], 0
        if n:
            yield from cut(pa.Table.from_batches(kept).combine_chunks())

    def cut(t):
        for lo in range(0, t.num_rows, step):
            own = t.slice(lo, step).combine_chunks().to_batches()[0]
            ends = pa.array([0, own.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, own.column(c)) for c in ("vec_id", "label")]
            q = pack(floors(matrix(own.column("v"), width), scale))
            yield pa.RecordBatch.from_arrays([*lists, pa.array([own.num_rows], pa.int64()), pa.array([q], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["ids", "labels", "n", "q", "codes", "sums"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<{ids}>, labels array<{labels}>, n long, q binary, codes binary, sums binary")


def _assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """The blocks with the codes under these codebooks, and the sums for the next."""
    parts, entries, _ = books.shape

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                n, q, codes = (one.column(c)[0].as_py() for c in ("n", "q", "codes"))
                x = unpack(q).reshape(n, -1)
                codes, _ = assign(x, books, None if codes is None else np.frombuffer(codes, np.uint8).reshape(n, parts))
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([codes.astype(np.uint8).tobytes()], pa.binary()), pa.array([pack(sums_of(x, codes, parts, entries))], pa.binary())], names=one.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def _replaced(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks.  The driver gets a few numbers for each component of the codebooks, however long the table."""
    parts, entries, width = books.shape

    def run(batches):
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                own = unpack(raw).astype(object)
                total = own if total is None else total + own
        limb = 0
        while total is not None:  # in limbs, so that the sums of sums stay within 64 bits
            last = all(-(1 << LIMB - 1) <= v < 1 << LIMB - 1 for v in total)
            low = total if last else total & (1 << LIMB) - 1
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([limb] * len(total), pa.int32()), pa.array(list(low), pa.int64())], names=["place", "limb", "s"])
            total, limb = (None, limb) if last else (total >> LIMB, limb + 1)

    rows = blocks.select("sums").mapInArrow(run, "place int, limb int, s long").groupBy("place", "limb").agg(F.sum("s").alias("s")).collect()
    flat = [0] * (parts * entries * (1 + width))
    for r in rows:
        flat[r["place"]] += r["s"] << LIMB * r["limb"]
    count, total = flat[: parts * entries], flat[parts * entries :]
    out = books.astype(object).reshape(parts * entries, width)
    for e, n in enumerate(count):
        if n:
            out[e] = [s // n for s in total[e * width : (e + 1) * width]]
    return _narrow(out.reshape(books.shape))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if largest(x) < 1 << 62 else x


def encode(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every row with a usable vector.

    ``rows``: ``vec_id``, ``embedding``, ``label``; other columns are ignored.
    Vectors that are null or hold null or non-finite components take no part.
    Shorter vectors count as filled up with zeros to the longest, and that to a
    multiple of ``parts``.  Rows without an id come last in the order of ids, and
    of equal ids the vectors' order decides; repeated rows count each.  With fewer
    rows than ``entries`` the codebooks are as short.  An entry that no part uses
    stays as it is.  Components of any finite size are exact; an error beyond 64
    bits, or its label's, is null.  An empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    v = finite_vectors(rows, "vec_id", "label")
    width = -(-longest(v) // parts) * parts
    seeds = v.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # as many rows as entries
    if not seeds:
        return v.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    first = floors(matrix(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), width), scale)
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    blocks = _blocks(v, width, scale)
    for _ in range(rounds):
        nxt = written(_assigned(blocks, books), "coded_blocks")
        books = _replaced(nxt, books)
        discard(blocks)
        blocks = nxt
    coded = written(_codes(blocks, books), "codes")
    discard(blocks)
    fits = F.count("*") == F.count("error")
    total = coded.groupBy(F.col("label").alias("__label")).agg(F.when(fits, F.try_sum("error")).alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = coded.join(total, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: the rows of the blocks, assigned a last time."""
    parts = len(books)
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                own, n = b.slice(k, 1), b.column("n")[k].as_py()
                before = own.column("codes")[0].as_py()
                codes, error = assign(unpack(own.column("q")[0].as_py()).reshape(n, -1), books, None if before is None else np.frombuffer(before, np.uint8).reshape(n, parts))
                text = [bytes(r).hex() for r in codes.astype(np.uint8)]
                fits = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([own.column("ids").flatten(), own.column("labels").flatten(), pa.array(text, pa.string()), pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {ids}, label {labels}, code string, error long")
