"""Operator 12: fill-in-middle transformation by big integers as bit masks.

A text is a row of bytes, and a mask is one integer with a bit a byte, the first
byte's highest.  ``bytes.translate`` marks a class of bytes with digits that
``int(..., 2)`` reads; a shifted mask, joined with others by boolean operations,
marks where units begin; ``bit_count`` counts them, and the bits of given ranks
are found by halving the mask, so that a text costs time in proportion to its
length.  No unit begins inside a code point, so bytes can be cut where units begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of output that a worker hands on at once.
BATCH = 8 << 20


def _class(inside) -> bytes:
    return bytes(49 if inside(b) else 48 for b in range(256))


NEWLINE = _class(lambda b: b == 10)
LEAD = _class(lambda b: b & 0xC0 != 0x80)
WORD = _class(lambda b: b not in b" \t\n\v\f\r")


def _mask(raw: bytes, of: bytes) -> int:
    return int(raw.translate(of), 2) if raw else 0


def unit_starts(raw: bytes, unit: str = "line") -> int:
    """The mask of the bytes at which units begin; none for an empty text.

    line: ``[^\\n]*\\n|[^\\n]+``.  word: a run without white space and the white
    space after it (before it too, for the first).  char: a code point.
    """
    if not raw:
        return 0
    first = 1 << (len(raw) - 1)
    if unit == "line":
        return _mask(raw, NEWLINE) >> 1 | first
    if unit == "char":
        return _mask(raw, LEAD) | first
    if unit == "word":
        inside = _mask(raw, WORD)
        begins = inside & ~(inside >> 1)
        return begins ^ 1 << begins.bit_length() - 1 | first if begins else first
    raise ValueError(f"unknown unit: {unit}")


def places(mask: int, width: int, ranks: list[int]) -> list[int]:
    """How far from the left the set bits of these ranks (from 1, ascending) are in a mask of ``width`` bits."""
    if not ranks:
        return []
    if width == 1:
        return [0] * len(ranks)
    right = width // 2
    left = width - right
    high = mask >> right
    inside = high.bit_count()
    out = places(high, left, [r for r in ranks if r <= inside])
    if beyond := [r - inside for r in ranks if r > inside]:
        out += [left + p for p in places(mask & (1 << right) - 1, right, beyond)]
    return out


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes, sentinels) -> bytes:
    p, s, m = sentinels
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def rebuild(output: bytes, form: str, sentinels) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (p, s) if form == "psm" else (s, p)
    a, _, rest = output[len(one) :].partition(two)
    b, _, middle = rest.partition(m)
    return a + middle + b if form == "psm" else b + middle + a


def transform(raw: bytes, key: str, unit: str, rate: int, spm_rate: int, sentinels) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text; see ``fill_in_middle``."""
    starts = unit_starts(raw, unit)
    n = starts.bit_count()
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not raw or h3 % 100 >= rate or any(x in raw for x in sentinels):
        return n, "plain", None, None, raw
    ends = sorted((h1 % (n + 1), h2 % (n + 1)))  # units in the prefix, and in it and the middle
    found = iter(places(starts, len(raw), [u + 1 for u in ends if u < n]))
    a, b = (next(found) if u < n else len(raw) for u in ends)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    output = arrange(form, raw[:a], raw[a:b], raw[b:], sentinels)
    if rebuild(output, form, sentinels) != raw:  # only where sentinels overlap each other or the text's borders
        return n, "plain", None, None, raw
    lead = _mask(raw, LEAD)
    before, both = ((lead >> len(raw) - x).bit_count() for x in (a, b))
    return n, form, before, both - before, output


def _in_batches(rows: Iterator[tuple], size_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += size_of(row)
        if size >= BATCH or len(kept) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, sentinels=SENTINELS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every whole text.

    A text of n units is cut at two unit borders that the digest of
    ``<seed>:<doc_id>`` picks, and written as prefix, suffix, middle (form psm)
    or suffix, prefix, middle (spm), each after its sentinel.  ``rate`` percent
    of the texts are cut, and ``spm_rate`` percent of those as spm; the others
    are plain: as they are, their two counts null.  A text that is empty or holds
    a sentinel is plain.  A null text counts as empty and a null id as the text
    ''; repeated rows each give a row, equal ones equal rows; an empty table
    gives no rows.  A long text costs time and memory in proportion to its length.
    Bytes that are not UTF-8 pass as they are.  Other columns are ignored.
    """
    marks = tuple(x.encode() for x in sentinels)
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different sentinels that are not empty")
    rows = docs.select(F.col("doc_id"), F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        schema = None
        for b in batches:
            schema = schema or pa.schema([("doc_id", b.schema.field("doc_id").type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])
            ids, keys, raws = (b.column(c) for c in ("doc_id", "key", "raw"))
            made = ((i.as_py(), *transform(r.as_py(), k.as_py(), unit, rate, spm_rate, marks)) for i, k, r in zip(ids, keys, raws))
            yield from _in_batches(made, lambda row: len(row[-1]), schema)

    out = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """Adds ``text``: what each row's ``output`` was made of, told by its ``form``; null where either is null."""
    marks = tuple(x.encode() for x in sentinels)
    rest = [c for c in made.columns if c not in ("output", "text")]

    def run(batches):
        for b in batches:
            outs, forms = b.column("output"), b.column("form")
            n, step = b.num_rows, max(1, b.num_rows * BATCH // max(1, outs.nbytes))
            for lo in range(0, n, step):
                part = b.slice(lo, step)
                texts = [None if o is None or f is None else rebuild(o, f, marks) for o, f in zip(outs.slice(lo, step).to_pylist(), forms.slice(lo, step).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "text"])

    rows = made.select(*rest, F.col("output").cast("binary").alias("output"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    out = rows.mapInArrow(run, f"{kinds}, text binary")
    return out.select(*rest, F.col("output").cast("string").alias("output"), F.col("text").cast("string").alias("text"))


def digests(made: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of the output and of the text rebuilt from it, in their place."""
    both = restored(made, sentinels)
    return both.withColumns({"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(F.col("text").cast("binary"), 256)}).drop("output", "text")
