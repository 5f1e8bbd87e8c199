"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, every bit position p gets a non-zero code m(p) of r + 1 bits.
Table v (one for each non-zero v of r + 1 bits) keeps the positions where
<m(p), v> is odd.  Any r positions' codes leave some v orthogonal to all of
them, so two fingerprints that differ in at most r bits agree in that table:
no pair within the radius is missed, unlike with random bit samples.

Buckets are not expanded into pairs.  Within a bucket with several different
fingerprints each emits itself and its copies with one free bit flipped (r = 2):
two of them share such a value exactly if they differ in at most two bits.
A value is shared by 65 fingerprints at most, so the links are linear in the
bucket's size however large it is.

``similar_groups`` links by the shingle sets' Jaccard similarity instead.  Texts
of similarity 0.8 differ in about 10 of 64 bits, and a family that covers this
radius has thousands of tables.  So the covering tables give the near pairs only,
and MinHash buckets the others: BANDS keys of ROWS minima put two texts of
similarity s into a common bucket with probability 1 - (1 - s ** ROWS) ** BANDS
(0.99997 at 0.8).  Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import connected_components

RADIUS = 2
SEED = 42
#: Of ``similar_groups``: MinHash keys and the minima in each,
BANDS, ROWS = 20, 4
#: the bytes of a longer sketch and how many of them pairs must share to be confirmed (at similarity
#: 0.8, 205 are expected with a deviation of 6.4), and the bytes of shingle sets compared in one task.
SKETCH, AGREE = 256, 176
BLOCK_BYTES = 4 << 20
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 63, (BANDS * ROWS + SKETCH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, (BANDS * ROWS + SKETCH, 1), np.uint64)


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering family's masks as signed 64-bit integers."""
    codes = [1 + p % (2 ** (radius + 1) - 1) for p in range(bits)]
    out = [sum(1 << p for p, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles in order, repeats included; of fewer words, of the
    whole sequence; of none, nothing.  On bytes: A-Z lowered, split at 0x20 and 0x09-0x0D."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) < width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def _bits(hashes: np.ndarray) -> int:
    """The signed fingerprint: bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles (see ``fingerprints``)."""
    return _bits(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row: lower-cased A-Z, words split at ASCII white
    space, ``width``-word shingles with repeats, XXH64 with seed 42; a bit is set
    if it is in over half the hashes.  Fewer words: the whole sequence is one
    shingle; none, or a null text: zero."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x or b"", width) for x in texts], pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) among the distinct values of ``fp``: each joins two that differ
    in at most two bits, and any two such are connected through links."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    rows = rows.join(shared, ["t", "key"], "left_semi")
    free = F.array(*[F.array(*[F.lit(1 << p if p < 63 else -(1 << 63)) for p in range(64) if not m >> p & 1]) for m in masks()])
    flips = F.concat(F.array(F.col("fp")), F.transform(F.element_at(free, F.col("t") + 1), lambda b: F.col("fp").bitwiseXOR(b)))
    near = rows.select("fp", F.explode(flips).alias("near")).distinct()
    balls = near.groupBy("near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    links = balls.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).filter("u <> v")
    return links.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Components of documents whose fingerprints differ in at most two bits.

    Returns one row per input row: ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (the smallest doc_id reachable, its own included).  Null
    and empty texts have fingerprint zero and link like any other; null ids
    take part, but a component's id is null only if all its ids are; repeated
    rows each give a row; other columns are ignored; an empty table gives none.
    Whole texts, of any length.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    each = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(covering_links(each)).select(F.col("node").alias("fp"), "root")
    rooted = each.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _set(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted; none: one that stands for no words."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    x = np.sort(hashes)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _minima(hashes: np.ndarray, part: slice) -> np.ndarray:
    low = np.full(len(_ODD[part]), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1024):
        x = (hashes[a : a + 1024] ^ _FLIP[part]) * _ODD[part]
        low = np.minimum(low, (x ^ x >> np.uint64(31)).min(1))
    return low


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS bucket keys of a set, as signed 64-bit integers."""
    h = xxhash.xxh64_intdigest
    low = _minima(hashes, slice(0, BANDS * ROWS)).reshape(BANDS, ROWS)
    return np.array([h(r.tobytes(), k) for k, r in enumerate(low)], np.uint64).view(np.int64)


def _prints(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            all_ = [shingle_hashes(x, width) for x in b.column(1).cast(pa.binary()).to_pylist()]
            sets = [_set(x) for x in all_]
            cols = [pa.array([_bits(x) for x in all_], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["tx", "fp", "n", "bands"])

    return texts.select("tx", "text").mapInArrow(run, "tx binary, fp long, n int, bands array<long>")


def _sets(texts: DataFrame, width: int, sketch: bool = False) -> DataFrame:
    """``tx, hashes``: the packed shingle sets, with ``sketch`` also a byte of each of SKETCH minima."""
    top = np.uint64(56)

    def run(batches):
        for b in batches:
            sets = [_set(shingle_hashes(x, width)) for x in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), pa.array([x.tobytes() for x in sets], pa.binary())]
            if sketch:
                low = [_minima(x, slice(BANDS * ROWS, None)) * np.uint64(0x9E3779B97F4A7C15) >> top for x in sets]
                cols.append(pa.array([x.astype(np.uint8).tobytes() for x in low], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["tx", "hashes", "sketch"][: len(cols)])

    return texts.select("tx", "text").mapInArrow(run, "tx binary, hashes binary" + ", sketch binary" * sketch)


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of different texts whose shingle sets have the Jaccard similarity."""

    def run(batches):
        for b in batches:
            x, y = ([np.frombuffer(h, np.uint64) for h in b.column(k).to_pylist()] for k in (2, 3))
            keep = [_alike(p, q, similarity) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("tx")).distinct()
    sets = written(_sets(texts.join(asked, "tx", "left_semi").dropDuplicates(["tx"]), width), "sets")
    of = lambda c: sets.select(F.col("tx").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    whole = pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "u_hashes", "v_hashes")
    out = written(whole.mapInArrow(run, "u binary, v binary"), "confirmed")
    discard(pairs)
    discard(sets)
    return out


def _linked_within(t: pa.Table, similarity: float) -> pa.Table:
    """Links that join the roots of one bucket (or of two blocks of it): pairs that share
    enough of the sketch, the most alike first, are confirmed unless joined already."""
    names = t.column("tx").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    roots = t.column("root").to_pylist()
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root, up = np.array([number[r] for r in roots], np.int64), list(range(len(number)))
    side, two = t.column("block").to_numpy(), t.column("a")[0].as_py() != t.column("b")[0].as_py()
    n = np.array([len(x) for x in sets])

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    out = []
    for lo in range(0, len(names), 256):
        i = np.arange(lo, min(lo + 256, len(names)))
        j = np.arange(lo, len(names))
        shared = np.zeros((len(i), len(j)), np.int16)
        for c in range(SKETCH):
            shared += sketch[i, c][:, None] == sketch[j, c]
        less, more = np.minimum(n[i][:, None], n[j]), np.maximum(n[i][:, None], n[j])
        on = (shared >= AGREE) & (i[:, None] < j) & (root[i][:, None] != root[j]) & (less >= similarity * more)
        if two:
            on &= side[i][:, None] != side[j]
        p, q = np.nonzero(on)
        for k in np.argsort(-shared[p, q], kind="stable").tolist():
            x, y = int(i[p[k]]), int(j[q[k]])
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b and _alike(sets[x], sets[y], similarity):
                up[a] = b
                out.append((names[x], names[y]))
    cols = list(zip(*out, strict=True)) if out else [()] * 2
    return pa.table([pa.array(x, pa.binary()) for x in cols], names=["u", "v"])


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of their shingle sets.

    Returns one row per input row: ``doc_id``, ``tx`` (MD5 of the text),
    ``root`` (equal for the rows of a component) and ``first`` (the doc_id and
    tx of its first row: the one with the smallest doc_id, of these with the
    smallest tx; null ids come last).  Null and empty texts are equal; null and
    repeated ids take part; other columns are ignored; an empty table gives
    none.  Whole texts: a very long one is one row with one set.

    Pairs that cannot change a component are not made.  Equal texts are one.
    Linear many links come first: of covering tables, and of every bucket's
    texts with its smallest one.  Where a bucket's texts then still are in
    different components, they are compared with each other in one task, or in
    blocks of about BLOCK_BYTES, and only links that join two components come out.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tx", F.unhex(F.md5(F.col("text").cast("binary"))))
    each = written(_prints(keyed.dropDuplicates(["tx"]), width), "prints")

    by_fp = written(each.groupBy("fp").agg(F.min("tx").alias("lead")), "leads")
    fp_links = covering_links(by_fp.select("fp"))
    at = lambda c: by_fp.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    near = fp_links.join(at("u"), "u").join(at("v"), "v").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    near = near.unionByName(each.join(by_fp, "fp").filter("tx <> lead").select(F.col("lead").alias("u"), F.col("tx").alias("v")))

    rows = each.select("tx", "n", F.explode("bands").alias("key"))
    lead = rows.groupBy("key").agg(F.min(F.struct("tx", "n")).alias("l"), F.count("*").alias("c")).filter("c > 1")
    rows = written(rows.join(lead, "key").select("key", "tx", "n", F.col("l.tx").alias("lead"), F.col("l.n").alias("lead_n")), "buckets")
    enough = F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n")
    star = rows.filter(F.col("tx") != F.col("lead")).filter(enough).select(F.col("lead").alias("u"), F.col("tx").alias("v"))
    links = _confirmed(near.unionByName(star).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), keyed, width, similarity)

    roots = connected_components(links).select(F.col("node").alias("tx"), "root")
    rows = written(rows.join(roots, "tx", "left").select("key", "tx", "n", F.coalesce("root", "tx").alias("root")), "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.col("n").cast("long") * 8 + SKETCH).alias("size"))
    mixed = mixed.filter("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    rest = written(rows.join(mixed, "key"), "mixed")
    sets = written(_sets(keyed.join(rest.select("tx").distinct(), "tx", "left_semi").dropDuplicates(["tx"]), width, True), "sets")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("tx"), "blocks").cast("int"))
    dealt = dealt.select("key", "tx", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "tx", "root")
    more = dealt.join(sets, "tx").groupBy("key", "a", "b").applyInArrow(lambda t: _linked_within(t, similarity), "u binary, v binary")
    links = written(links.unionByName(more), "links")
    for t in (by_fp, rest, sets, each):
        discard(t)

    roots = connected_components(links).select(F.col("node").alias("tx"), "root")
    rooted = written(keyed.select("doc_id", "tx").join(roots, "tx", "left").select("doc_id", "tx", F.coalesce("root", "tx").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("first"))
    return rooted.join(first, "root").select("doc_id", "tx", "root", F.struct("first.doc_id", "first.tx").alias("first"))
