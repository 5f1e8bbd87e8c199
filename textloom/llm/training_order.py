"""Operator 5: token ids as fixed-stride binary shards in a training order.

Every text becomes sequences of a fixed number of token ids.  Sequences are
numbered 0 .. N - 1 in the order of their documents' ids; a keyed Feistel
permutation with cycle-walking turns a number into its global slot.  A shard
holds a range of slots, one record of fixed length each, so slot s lies in
shard s // per_shard at byte (s % per_shard) * stride: a reader may start, or
go on, at any slot, and knows which document it reads without an index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, shuffles_dropped, written

TOKENIZER = "byte_bpe_50k.tiktoken"
END = 50256  # the free id after the vocabulary: ends a document and fills its last sequence
LENGTH = 512
PER_SHARD = 8192
ROUNDS = 6
PASSES = 4  # ranges of shards that are dealt and written one after another
WIDTH = 2  # bytes of an id; END is below 2 ** 16
#: A record ends in a line feed: 2 * LENGTH bytes of ids, and one byte that marks the record's end.
STRIDE = LENGTH * WIDTH + 1

_library: dict[str, object] = {}


def library(name: str = TOKENIZER):
    if name not in _library:
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _library[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _library[name]


class Permutation:
    """A keyed permutation of 0 .. n - 1: a balanced Feistel network over the next
    even number of bits, walked until it lands below n."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.frombuffer(hashlib.sha512(key.encode()).digest(), np.uint64)[:ROUNDS]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = np.array(x, np.uint64)
        out = step(x)
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = step(out[far])
        return out.astype(np.int64)

    def _step(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys:
            a, b = b, a ^ self._f(b, k)
        return a << self.half | b

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            a, b = b ^ self._f(a, k), a
        return a << self.half | b

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._step)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def tokenized(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, doc_id, th, n_seqs, n_ids, packed``: the ids of every row, and how many records they fill.

    ``uid`` tells rows apart, ``th`` is a hash of the text, ``packed`` has the
    16-bit ids, compressed.
    """

    def run(batches):
        t, pack = library(), zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows = []
            for text in b.column(2).to_pylist():
                own = np.array(t.encode_ordinary(text or ""), "<u2")
                th = xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63)
                rows.append((th, -(-(len(own) + 1) // length), len(own), pack(own.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names=["uid", "doc_id", "th", "n_seqs", "n_ids", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, th long, n_seqs int, n_ids long, packed binary")


class Order:
    """The numbers and global slots of all sequences of ``docs``.

    Slots 0 .. N - 1, each once.  The order depends on the ids, the texts and
    the key alone.  A null or empty text is one sequence of END; null ids come
    first; equal rows are told apart, whichever comes first; other columns are
    ignored; an empty table gives no sequences.  A very long text is one row of
    packed ids, and many records.
    """

    def __init__(self, docs: DataFrame, key: str = "textloom", length: int = LENGTH, per_shard: int = PER_SHARD):
        spark = docs.sparkSession
        self.key, self.length, self.per_shard, self.stride = key, length, per_shard, length * WIDTH + 1
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        self.seqs = written(tokenized(docs, length), "sequences")
        # numbers: ranges of documents, a running count in each, and the ranges' own running count
        first = self.seqs.select("uid", "doc_id", "th", "n_seqs", "n_ids")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = written(first.repartitionByRange(parts, "doc_id", "th", "uid").withColumn("part", F.spark_partition_id()), "ranges")
        count = ranges.groupBy("part").agg(F.sum("n_seqs").alias("n"))
        before = count.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
        self.total = int(count.agg(F.sum("n")).first()[0] or 0)
        within = F.sum("n_seqs").over(Window.partitionBy("part").orderBy("doc_id", "th", "uid")) - F.col("n_seqs")
        self.starts = ranges.withColumn("within", within).join(F.broadcast(before), "part").select("uid", "doc_id", "n_seqs", "n_ids", (F.col("before") + F.col("within")).alias("start"))

    def index(self) -> DataFrame:
        """``slot, shard, byte_offset, doc_id, seq, n_tokens`` of every sequence."""
        length, per_shard, stride, total, key = self.length, self.per_shard, self.stride, self.total, self.key

        def run(batches):
            p = Permutation(max(1, total), key)
            for b in batches:
                n = b.column(2).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                slot = p.slot(b.column(0).to_numpy()[row] + seq)
                size = np.minimum(length, b.column(3).to_numpy()[row] - seq * length)
                cols = [pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride), b.column(1).take(pa.array(row)), pa.array(seq, pa.int32()), pa.array(size, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens"])

        schema = f"slot long, shard long, byte_offset long, doc_id {self.kind}, seq int, n_tokens int"
        return self.starts.select("start", "doc_id", "n_seqs", "n_ids").mapInArrow(run, schema)

    def numbered(self) -> DataFrame:
        """``start, n_seqs, packed``: every row's ids, with the number of its first sequence."""
        return self.seqs.join(self.starts.select("uid", "start"), "uid").select("start", "n_seqs", "packed")

    @property
    def shards(self) -> int:
        return max(1, -(-self.total // self.per_shard))

    def records(self, numbered: DataFrame, first: int, last: int) -> DataFrame:
        """``slot, shard, ids`` (16-bit little-endian) of shards first .. last - 1: dealt to tasks by ranges of slots, in slot order."""
        length, per_shard, total, key = self.length, self.per_shard, self.total, self.key

        def place(batches):
            p = Permutation(max(1, total), key)
            open_, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
            for b in batches:
                n = b.column(1).to_numpy().astype(np.int64)
                start = np.cumsum(n) - n
                slot = p.slot(np.repeat(b.column(0).to_numpy() - start, n) + np.arange(n.sum()))
                shard = slot // per_shard
                mine = np.flatnonzero((shard >= first) & (shard < last))
                bounds = np.searchsorted(mine, [start, start + n]).T.tolist()
                ids = []
                for k, lo, (i, j), raw in zip(n.tolist(), start.tolist(), bounds, b.column(2).to_pylist(), strict=True):
                    if i < j:
                        own = np.frombuffer(open_(raw), "<u2")
                        full = np.full(k * length, END, "<u2")
                        full[: len(own)] = own
                        ids += [pack(x.tobytes()) for x in full.reshape(k, length)[mine[i:j] - lo]]
                yield pa.RecordBatch.from_arrays([pa.array(slot[mine]), pa.array(shard[mine]), pa.array(ids, pa.binary())], names=["slot", "shard", "ids"])

        def unpack(batches):
            open_ = zstandard.ZstdDecompressor().decompress
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([open_(x) for x in b.column(2).to_pylist()], pa.binary())], names=b.schema.names)

        placed = numbered.mapInArrow(place, "slot long, shard long, ids binary")
        tasks = min(last - first, 100_000)
        dealt = placed.repartitionById(tasks, F.floor((F.col("shard") - first) * tasks / (last - first)).cast("int"))
        return dealt.mapInArrow(unpack, dealt.schema).sortWithinPartitions("shard", "slot")


def training_order(docs: DataFrame, key: str = "textloom", length: int = LENGTH, per_shard: int = PER_SHARD, path: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` to ``path`` (default: in the shared folder), and return what they hold.

    Returns ``slot, shard, byte_offset, doc_id, seq, n_tokens, ids_sha256``: offset
    and digest are read from the written records.
    See ``Order`` for nulls, repeats and empty tables.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    order = Order(docs, key, length, per_shard)
    write_shards(order, path)
    return order.index().join(read_digests(docs.sparkSession, path, length, per_shard), ["slot", "byte_offset"])


def write_shards(order: Order, path: str) -> None:
    """Write ``shard=<k>/part-*`` files of fixed-length records, in slot order, by Spark's own writer.

    The bytes go through the text source: a record is its ids and a line feed.
    Every pass writes a range of the shards, so that beside the numbered ids
    and the shards the disk holds one pass's shuffle alone.  Uses up ``order.seqs``.
    """
    with shuffles_dropped(order.seqs.sparkSession):
        numbered = written(order.numbered(), "numbered")
        discard(order.seqs)
        step = -(-order.shards // PASSES)
        for first in range(0, order.shards, step):
            rows = order.records(numbered, first, min(first + step, order.shards)).select("shard", F.col("ids").cast("string").alias("value"))
            rows.write.mode("append").partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(path)
        discard(numbered)


def _read(spark, paths: list[str] | str, stride: int, per_shard: int, rows, schema: str) -> DataFrame:
    """``rows(base, raw, records)`` of every shard's file: at most ``per_shard`` records each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(paths)
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard")
    if not files.select(shard, "length").groupBy("shard").agg(F.count("*").alias("n"), F.max("length").alias("size")).filter((F.col("n") > 1) | (F.col("size") % stride != 0) | (F.col("size") > stride * per_shard)).isEmpty():
        raise ValueError("a shard is not one file of whole records")

    def run(batches):
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield rows(k * per_shard, raw, len(raw) // stride)

    return files.select(shard, "content").mapInArrow(run, schema)


def read_digests(spark, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, byte_offset, ids_sha256`` of every written record."""
    stride = length * WIDTH + 1

    def rows(base, raw, n):
        at = np.arange(n)
        sha = [hashlib.sha256(raw[s * stride : s * stride + stride - 1]).hexdigest() for s in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(at * stride), pa.array(sha, pa.string())], names=["slot", "byte_offset", "ids_sha256"])

    return _read(spark, path, stride, per_shard, rows, "slot long, byte_offset long, ids_sha256 string")


def read_slots(spark, path: str, first: int, last: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, ids`` (array<int>) of slots first .. last - 1: only their shards' files are read."""
    stride = length * WIDTH + 1

    def rows(base, raw, n):
        at = [s for s in range(n) if first <= base + s < last]
        ids = [np.frombuffer(raw, "<u2", length, s * stride).astype(np.int32) for s in at]
        return pa.RecordBatch.from_arrays([pa.array([base + s for s in at], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "ids"])

    shards = [f"{path}/shard={k}" for k in range(first // per_shard, -(-last // per_shard))]
    return _read(spark, shards, stride, per_shard, rows, "slot long, ids array<int>").orderBy("slot")
