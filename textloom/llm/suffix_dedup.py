"""Operator 6: removal of long byte strings that occur more than once, by suffix arrays.

Every 200-byte window of a text is assigned to the least hash among its 64-byte
grams (its anchor); equal windows have equal anchors.  The windows of one
anchor are consecutive and make one string.  Strings whose anchor hash occurs
once in the corpus hold no repeated window.  The rest are reduced to distinct
strings with their number of occurrences and dealt to shards by anchor; each
shard's suffix array (induced sorting) and permuted common prefixes tell which
windows occur again.  That a string as a whole occurs again is told by two
64-bit hashes, of its anchor and of its bytes.

Anchors with very many different strings are dealt finer: by the window's
offset to the anchor and the bytes that all windows of a block of offsets
share, which equal windows share too.  Equal pieces are then one piece, and a
block that still has very many different ones is dealt by single windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 64
#: Bytes that one buffer of positions may have (a position takes 24 bits).
BUFFER = 1 << 19
#: Bytes of distinct strings in a shard, about.
SHARD = 1 << 20
#: An anchor with more different strings than this is dealt finer, by blocks of OFFSETS.
HOT = 500
OFFSETS = 8


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte grams, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchored(data: np.ndarray, length: int = LENGTH):
    """Of all windows of ``data``: each position's anchor place, and the grams' hashes."""
    h = _gram_hashes(data)
    width = length - GRAM + 1
    m = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: -(width - step)], m[width - step :])
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64), h


def _runs(texts: list[bytes], length: int = LENGTH):
    """(text index, anchor hash, first window, windows) of every anchored string."""
    out = []
    for group in _buffers(texts, length):
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in group), np.uint8)
        place, h = anchored(data, length)
        size = np.array([b - a for _, a, b in group])
        start = np.cumsum(size) - size
        windows = size - length + 1
        own = np.repeat(np.arange(len(group)), windows)
        at = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        p = place[start[own] + at]
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (own[1:] != own[:-1]))))
        n = np.diff(np.append(new, len(p)))
        first = np.array([a for _, a, _ in group])[own[new]] + at[new]
        index = np.array([i for i, _, _ in group])[own[new]]
        out.append((index, h[p[new]].view(np.int64), first, n))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def _buffers(texts: list[bytes], length: int):
    """Pieces (text index, start, end) that fill buffers; the pieces of a longer text overlap by a window."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, BUFFER):
            b = min(len(t), a + BUFFER + length - 1)
            group.append((i, a, b))
            size += b - a
            if size >= BUFFER:
                yield group
                group, size = [], 0
    if group:
        yield group


def _text_id(t: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(t), np.int64).tolist())


def repeated_windows(strings: list[bytes], copies: list[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each string the runs (first, past the last) of windows that occur elsewhere
    in ``strings``, or all of them where ``copies`` says that the string recurs."""
    if not strings:
        return []
    raw = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8).astype(np.int32) + 2
    size = np.array([len(s) for s in strings])
    start = np.cumsum(size + 1) - size - 1
    raw[start + size] = 1
    t = np.append(raw, np.int32(0))
    used = np.bincount(t) > 0  # the characters that occur, numbered in order
    t = (np.cumsum(used) - 1).astype(np.int32)[t]
    sa = suffix_array(t, int(used.sum()))
    again = np.flatnonzero(permuted_lcp(t, sa)[sa] >= length)
    mark = np.zeros(len(t) + 1, np.int8)
    mark[sa[again]] = 1
    mark[sa[again - 1]] = 1
    for a, n, c in zip(start.tolist(), size.tolist(), copies, strict=True):
        mark[a + n - length + 1 : a + n + 1] = 0  # a common prefix over the string's end is none
        if c:
            mark[a : a + n - length + 1] = 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark)).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    own = np.searchsorted(start, lo, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for k, a, b in zip(own.tolist(), (lo - start[own]).tolist(), (hi - start[own]).tolist(), strict=True):
        out[k].append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """``d`` (hash of the id), the text's id t1, t2, and the packed text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            ids = [_text_id(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), pa.array([pack(t) for t in texts], pa.binary()), *b.columns[2:]], names=["d", "t1", "t2", "packed", *b.schema.names[2:]])

    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = "d long, t1 long, t2 long, packed binary" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.select(F.xxhash64("doc_id").alias("d"), "text", *[f.name for f in rest]).mapInArrow(run, schema)


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            index, fp, at, n = _runs(texts, length)
            ids = np.array([(d, *_text_id(t)) for d, t in zip(b.column(0).to_pylist(), texts, strict=True)], np.int64).reshape(-1, 3)[index]
            h = xxhash.xxh3_64_intdigest
            same = np.array([h(texts[i][a : a + m + length - 1]) for i, a, m in zip(index.tolist(), at.tolist(), n.tolist(), strict=True)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[:, 0].copy(), ids[:, 1].copy(), ids[:, 2].copy(), fp, same)), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["d", "t1", "t2", "fp", "h", "at", "n"])

    return docs.select(F.xxhash64("doc_id").alias("d"), "text").filter(F.octet_length("text") >= length).mapInArrow(run, "d long, t1 long, t2 long, fp long, h long, at int, n int")


PIECES = "key long, p1 long, p2 long, fp long, h long, skip int, hot boolean, many boolean, size int, bytes binary"


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of the chosen strings; of hot anchors, in blocks of offsets.

    ``key`` is equal for pieces that may share a window; ``p1, p2`` name the
    piece: of whole strings fp and h, of blocks two hashes of the bytes.
    """
    names = [x.rpartition(" ")[0] for x in PIECES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.rpartition(" ")[2]] for x in PIECES.split(", ")]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out, held = [], 0
            for packed, strings in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = unpack(packed)
                for s in strings:
                    piece = text[s["at"] : s["at"] + s["n"] + length - 1]
                    for row in blocks(s, piece) if s["hot"] else [(s["fp"], s["fp"], s["h"], s["fp"], s["h"], 0, False, s["many"], len(piece), piece)]:
                        out.append(row)
                        held += len(row[-1])
                    if held > BUFFER:
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def blocks(s, piece):
        p = int(anchored(np.frombuffer(piece[:length], np.uint8), length)[0][0])
        for r in range(-(-(p + 1) // OFFSETS) * OFFSETS - OFFSETS, -1, -OFFSETS):
            # windows whose anchor lies r .. r + OFFSETS - 1 bytes after their start
            a, z = max(0, p - r - OFFSETS + 1), min(s["n"], p - r + 1)
            if a < z:
                own, core = piece[a : z + length - 1], piece[p - r : p - r - OFFSETS + 1 + length]
                key = np.uint64(xxhash.xxh3_64_intdigest(core, seed=r)).view(np.int64) ^ np.int64(s["fp"])
                yield (int(key), *_text_id(own), s["fp"], s["h"], a, True, s["many"], len(own), own)

    return rows.select("packed", "strings").mapInArrow(run, PIECES)


def _sorted_shards(strings: DataFrame, shards: int, length: int) -> DataFrame:
    """``kind, p1, p2, found``: of the strings (kind, key, p1, p2, many, bytes) the runs of windows that occur again."""

    def sort(t: pa.Table) -> pa.Table:
        keys = list(zip(*(t.column(c).to_pylist() for c in ("kind", "p1", "p2")), strict=True))
        first = {k: i for i, k in reversed(list(enumerate(keys)))}  # equal rows of the input give a string twice
        pick = sorted(first.values(), key=lambda i: keys[i])
        data, many = t.column("bytes").to_pylist(), t.column("many").to_pylist()
        runs = repeated_windows([data[i] for i in pick], [many[i] for i in pick], length)
        rows = [(*keys[i], [x for ab in r for x in ab]) for i, r in zip(pick, runs, strict=True) if r]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["kind", "p1", "p2", "found"])

    dealt = strings.select(F.pmod("key", F.lit(shards)).alias("shard"), "kind", "p1", "p2", "many", "bytes")
    return dealt.groupBy("shard").applyInArrow(sort, "kind int, p1 long, p2 long, found array<int>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``t1, t2, spans``: by text id, the byte ranges (flat, not merged) that repeated windows cover."""
    occ = written(_occurrences(docs, length), "windows")
    # a table of its own, and dealt anew after the join: so that a hot anchor's rows can be split in it
    again = written(occ.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp"), "recurring")
    cand = written(occ.join(again, "fp", "left_semi").repartition("t1", "t2", "fp", "at").groupBy("t1", "t2", "fp", "h", "at", "n").agg(F.count("*").alias("c"), F.min("d").alias("d")), "again")
    discard(occ)
    discard(again)
    reps = cand.groupBy("fp", "h").agg(F.sum("c").alias("c"), F.min(F.struct("t1", "t2", "d", "at", "n")).alias("at"))
    reps = written(reps.select("fp", "h", "c", "at.*"), "strings")
    by_fp = reps.groupBy("fp").agg(F.count("*").alias("kinds"))
    chosen = reps.join(by_fp, "fp").select("t1", "t2", "d", F.struct("fp", "h", "at", "n", (F.col("c") > 1).alias("many"), (F.col("kinds") > HOT).alias("hot")).alias("s"))
    chosen = chosen.groupBy("t1", "t2", "d").agg(F.collect_list("s").alias("strings"))
    pieces = written(_pieces(_keyed(docs.select("doc_id", "text")).join(chosen, ["t1", "t2", "d"]), length), "pieces")
    discard(reps)

    whole, owners = pieces.filter("NOT hot"), pieces.filter("hot")
    strings, size = whole.select(F.lit(0).alias("kind"), "key", "p1", "p2", "many", "bytes"), whole.agg(F.sum("size")).first()[0] or 0
    rows = lambda x: F.transform("found", lambda y: y + F.col(x)).alias("found")
    blocks = None
    if not owners.isEmpty():
        one = owners.groupBy("key", "p1", "p2").agg((F.max("many") | (F.count("*") > 1)).alias("many"), F.min("bytes").alias("bytes"))
        blocks = written(one, "blocks")
        crowded = written(blocks.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "crowded")
        single = blocks.join(crowded, "key", "left_semi").select("p1", "p2", "many", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("off"), "bytes")
        single = single.select("p1", "p2", "many", "off", F.expr(f"substring(bytes, off + 1, {length})").alias("w"))
        single = single.select(F.col("p1").alias("o1"), F.col("p2").alias("o2"), "off", F.xxhash64("w").alias("p1"), F.xxhash64("w", F.lit(1)).alias("p2"), "many", "w")
        windows = single.groupBy("p1", "p2").agg((F.max("many") | (F.count("*") > 1)).alias("many"), F.min("w").alias("bytes"))
        finer = blocks.join(crowded, "key", "left_anti").select(F.lit(1).alias("kind"), "key", "p1", "p2", "many", "bytes")
        finer = written(finer.unionByName(windows.select(F.lit(2).alias("kind"), F.col("p1").alias("key"), "p1", "p2", "many", "bytes")), "finer")
        size += finer.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        strings = strings.unionByName(finer)
    found = written(_sorted_shards(strings, max(1, -(-int(size) // SHARD)), length), "found")
    own = found.filter("kind = 0").select(F.col("p1").alias("fp"), F.col("p2").alias("h"), "found")
    if blocks is not None:
        at_window = found.filter("kind = 2").select("p1", "p2", "found").join(single.select("o1", "o2", "off", "p1", "p2"), ["p1", "p2"])
        of_block = found.filter("kind = 1").select("p1", "p2", "found").unionByName(at_window.select(F.col("o1").alias("p1"), F.col("o2").alias("p2"), rows("off")))
        own = written(own.unionByName(of_block.join(owners.select("fp", "h", "skip", "p1", "p2"), ["p1", "p2"]).select("fp", "h", rows("skip"))), "own")
        for t in (blocks, crowded, finer, found):
            discard(t)
    discard(pieces)
    # a row a string, or a row a block or window of a hot one; on the other side, its occurrences
    spans = cand.join(own, ["fp", "h"]).select("t1", "t2", rows("at"))
    return spans.groupBy("t1", "t2").agg(F.flatten(F.collect_list("found")).alias("spans"))


def _merged(spans: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows starting in the (first, past the last) runs cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        b += length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns one row per input row: the columns ``keep`` (default doc_id),
    ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``; with
    ``with_text`` also ``kept_text`` (the remaining bytes; of a character cut
    in two, nothing) and ``removed`` (array of start, end).  A null text counts
    as empty; ids may be null or repeat (equal rows are copies of one
    another); other columns are ignored; an empty table gives no rows.  A text
    may be of any length: its windows are dealt apart, its bytes are cut in one
    task.
    """
    keep = keep or ["doc_id"]
    spans = repeated_spans(docs, length)
    names = [f"kept_{k}" for k in range(len(keep))]
    own = docs.select("doc_id", "text", *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)])
    whole = _keyed(own).join(spans, ["t1", "t2"], "left").select(*names, "packed", "spans")
    n = len(keep)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for packed, found in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                text, at, left = unpack(packed), 0, []
                gone = _merged(found or [], length)
                for a, z in gone:
                    left.append(text[at:a])
                    at = z
                kept = b"".join([*left, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([b"".join(x.decode(errors="ignore").encode() for x in [*left, text[at:]]).decode(), [x for ab in gone for x in ab]] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string(), pa.list_(pa.int32())] * with_text]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text", "removed"] * with_text]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, removed array<int>" * with_text
    return whole.mapInArrow(cut, schema)
