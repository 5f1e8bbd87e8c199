"""Operator 2: BPE encoding and decoding through a distinct-word table.

No token of the vocabulary spans white space, so a text's ids are those of its
words, one after another.  Texts are split into words block by block; a block
keeps its distinct words and each text as positions into them.  All blocks'
words meet in one table, where every distinct word is encoded once, and the
ids go back to the blocks by position.  Decoding joins ids with the table of
pieces.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A block ends at this many distinct words or characters of text: about 100 MB of a worker's memory.
BLOCK_WORDS = 500_000
BLOCK_CHARS = 48 << 20
#: Units whose words' places are remembered at a time, and texts that are Python strings at a time.
UNITS_KEPT = 100_000
SLICE = 256
TOKENIZER = "word_bpe_49k.json"

_library: dict[str, object] = {}


def library(name: str):
    if name not in _library:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _library[name] = t
    return _library[name]


def _units(text: str) -> list[str]:
    """Split at space, tab and line ends, which every version of the splitting pattern cuts at."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _plain(w: str) -> bool:
    """Letters only, of blocks that all versions of Unicode's tables agree on."""
    return w.isascii() or max(w) < "\u0250" and "\u0130" not in w


def _words(unit: str) -> list[str]:
    """The words of a unit, as they are encoded: a plain word is lower-cased, as the
    library does first, and a mark after it is a word of its own."""
    if unit.isalpha() and _plain(unit):
        return [unit.lower()]
    if unit[-1:] in tuple(".,;:!?") and unit[:-1].isalpha() and _plain(unit[:-1]):
        return [unit[:-1].lower(), unit[-1]]
    return [unit] if unit else []


class _Places(dict):
    """Units to the places of their words in a block's list of distinct words."""

    def __init__(self):
        super().__init__()
        self.index: dict[str, int] = {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        index = self.index
        if len(self) >= UNITS_KEPT:
            self.clear()
        at = self[unit] = tuple([index.setdefault(w, len(index)) for w in _words(unit)])
        return at


def _pack(a: np.ndarray) -> bytes:
    """Positions as four byte planes, compressed: most upper bytes are zero."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _kind(docs: DataFrame) -> tuple[str, pa.DataType]:
    kind = docs.schema["doc_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _slices(batches):
    """Pairs (doc_id, text) of Arrow batches; only SLICE texts at a time become strings."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def split_blocks(docs: DataFrame, texts: bool) -> DataFrame:
    """One row a block: ``block, words``, or with ``texts`` ``block, ids, lengths, positions``.

    ``block`` is a hash of all the block's words and positions, so both forms
    of a block have the same; blocks with equal content share it, and their words.
    """
    kind, id_type = _kind(docs)

    def run(batches):
        places, ids, lengths, flat, size = _Places(), [], [], [], 0
        for i, text in _slices(batches):
            own = list(chain.from_iterable(map(places.__getitem__, _units(text or ""))))
            flat.append(np.array(own, np.uint32).tobytes())
            ids.append(i)
            lengths.append(len(own))
            size += len(text or "")
            if size > BLOCK_CHARS or len(places.index) > BLOCK_WORDS:
                yield block(ids, lengths, flat, places.index)
                places, ids, lengths, flat, size = _Places(), [], [], [], 0
        if ids:
            yield block(ids, lengths, flat, places.index)

    def block(ids, lengths, flat, index):
        flat = np.frombuffer(b"".join(flat), np.uint32)
        h = hashlib.blake2b(flat, digest_size=8)
        h.update("\0".join(index).encode())
        key = pa.array([int.from_bytes(h.digest(), "little", signed=True)], pa.int64())
        if not texts:
            return pa.RecordBatch.from_arrays([key, pa.array([list(index)], pa.list_(pa.string()))], names=["block", "words"])
        cols = [key, pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([_pack(flat)], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "lengths", "positions"])

    schema = f"block long, ids array<{kind}>, lengths array<int>, positions binary" if texts else "block long, words array<string>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_words(places: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``block, at, ids`` from ``word, block, at``: the distinct-word table.

    All places of a word lie next to one another, so each distinct word is
    encoded once; a word has at most one place in a block.  ``ids`` are
    unsigned 16-bit integers where the vocabulary allows, else 32-bit.
    """
    together = places.select("word", "block", "at").repartition("word").sortWithinPartitions("word")

    def run(batches):
        t = library(tokenizer)
        dtype, last = _id_type(tokenizer), {}
        for b in batches:
            own = b.column(0).to_pylist()
            new = [w for w in dict.fromkeys(own) if w not in last]
            got = t.encode_batch_fast(new, add_special_tokens=False)
            table = last | {w: np.array(e.ids, dtype).tobytes() for w, e in zip(new, got, strict=True)}
            last = {own[-1]: table[own[-1]]} if own else last
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([table[w] for w in own], pa.binary())], names=["block", "at", "ids"])

    return together.mapInArrow(run, "block long, at int, ids binary")


def _id_type(tokenizer: str) -> str:
    return "<u2" if library(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def pieces(spark, tokenizer: str = TOKENIZER) -> DataFrame:
    """The id-to-piece table of a vocabulary: a fixed number of rows."""
    t = library(tokenizer)
    return spark.createDataFrame([(i, t.id_to_token(i)) for i in range(t.get_vocab_size(with_added_tokens=True))], "id int, piece string")


def _joined(spark, tokenizer: str):
    """The pieces in id order, for broadcast joins: as long as the vocabulary."""
    t = library(tokenizer)
    return spark.sparkContext.broadcast([t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))])


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, digests: bool = False) -> DataFrame:
    """The ids of every whole text, as the tokenizers library gives them without added tokens.

    Returns one row per input row: ``doc_id``, ``n_tokens`` and ``ids``
    (array<int>), or with ``digests`` ``ids_sha256`` and ``decoded_sha256``
    instead, of the ids as unsigned 32-bit little-endian integers and of the
    decoded text in UTF-8.  A null text counts as empty; ids may be null or
    repeat, and have any type; other columns are ignored; an empty table gives
    no rows; a text is in one block, so a very long one takes memory in proportion.

    ``docs`` is read twice, for the words and for their positions.  Blocks are
    named by their content: where the two readings differ (rows that come in
    another order), the run fails, and no wrong ids come out.
    """
    kind, id_type = _kind(docs)
    places = split_blocks(docs, texts=False).select("block", F.posexplode("words").alias("at", "word"))
    back = encode_words(places, tokenizer)
    piece = _joined(docs.sparkSession, tokenizer) if digests else None

    def gather(texts: pa.Table, own: pa.Table) -> pa.Table:
        raw = own.column("ids").to_pylist()
        dtype = np.dtype(_id_type(tokenizer))
        at, order = np.unique(own.column("at").to_numpy(), return_index=True)  # equal blocks share a key and words
        if len(at) and at[-1] != len(at) - 1:
            raise ValueError("a block's words are not those that its texts were split into")
        width = np.array([len(raw[k]) // dtype.itemsize for k in order], np.int64)
        flat = np.frombuffer(b"".join([raw[k] for k in order]), dtype).astype("<u4")
        first = np.cumsum(width) - width
        pieces_of = np.array(piece.value, object) if digests else None
        out_id, out_n, out_a, out_b = [], [], [], []
        for r in texts.to_pylist():
            at, lengths = _unpack(r["positions"]), np.array(r["lengths"], np.int64)
            for i, a, n in zip(r["ids"], np.cumsum(lengths) - lengths, lengths, strict=True):
                p = at[a : a + n]
                w = width[p]
                ids = flat[np.repeat(first[p] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
                out_id.append(i)
                out_n.append(len(ids))
                if digests:
                    out_a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out_b.append(hashlib.sha256(" ".join(pieces_of[ids].tolist()).encode()).hexdigest())
                else:
                    out_a.append(ids.astype(np.int32))
        cols = {"doc_id": pa.array(out_id, id_type), "n_tokens": pa.array(out_n, pa.int64())}
        cols |= {"ids_sha256": pa.array(out_a, pa.string()), "decoded_sha256": pa.array(out_b, pa.string())} if digests else {"ids": pa.array(out_a, pa.list_(pa.int32()))}
        return pa.table(cols)

    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return split_blocks(docs, texts=True).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(gather, schema)


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: ids joined with their pieces, in order.

    The pieces are joined by spaces, as the library's decode does where the
    file names no decoder and special tokens are kept.  No ids, or null: ''.
    An id outside the vocabulary adds nothing.  Rows keep their ids array as
    they are; each gives one row.
    """
    rows = encoded.withColumn("row", F.xxhash64("doc_id", "ids"))
    flat = rows.select("row", F.posexplode("ids").alias("at", "id")).distinct()
    text = flat.join(F.broadcast(pieces(encoded.sparkSession, tokenizer)), "id").groupBy("row")
    text = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return rows.join(text, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
