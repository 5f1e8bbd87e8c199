"""Operator 3 (native): benchmark decontamination by size-partitioned containment search.

A test item is its set of distinct word shingles, ordered by a hash.  Items are
partitioned by size (powers of two); all items of a partition get MinHash
sketches of one length m: as many of their smallest hashes as the partition's
largest item may miss at the threshold, plus one.  A document that contains the
threshold's share of an item's shingles therefore contains one of its sketch,
whatever the document's length, so the search over whole long documents loses
nothing.  Candidates are verified by exact shingle containment.

DataFrame functions only: documents stream once through a generator of
shingles that stays in generated code, against the sketches' table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
THRESHOLD = 0.8
#: A sketch or shingle table up to this many rows is broadcast (about 10 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def _shingles(df: DataFrame, ids: list[str], text, width: int) -> DataFrame:
    """A row for each shingle position: ``ids``, and the shingle's words w0, w1, ...

    Words are lower-cased runs of letters and digits; a text with fewer words
    than ``width`` is one shingle of all of them, one without words none.
    """
    words = df.select(*ids, F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("at")
    return words.filter(F.size("words") > 0).select(*ids, "words", at).select(*ids, *[F.get("words", F.col("at") + k).alias(f"w{k}") for k in range(width)])


def _hash(width: int):
    return F.xxhash64(*[f"w{k}" for k in range(width)])


def _text(width: int):
    return F.concat_ws(" ", *[f"w{k}" for k in range(width)])


def find_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item it contains.

    Returns ``doc_id, text_hash, item_id, n_shingles`` (distinct, of the item),
    ``n_found`` (of these, in the document) and ``containment``, at least
    ``threshold``.  ``text_hash`` (xxhash64 of the text) tells rows with equal
    or null ids apart; rows equal in both are one.  Null or wordless texts on
    either side match nothing, null ids are kept as null, other columns are
    ignored, and empty tables give no rows.  An item of fewer than ``width``
    words is found as a whole text alone, not inside a longer one; a very long
    text is read whole, a shingle at a time.
    """
    own = _shingles(items.filter("text IS NOT NULL"), ["item_id"], F.col("text"), width)
    own = own.select("item_id", _hash(width).alias("h"), _text(width).alias("shingle")).distinct()
    n = own.groupBy(F.col("item_id").alias("of")).agg(F.count("*").alias("n_shingles"))
    # sizes from 2 ** c to 2 ** (c + 1) - 1 share a sketch length
    largest = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1
    ranked = own.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"), F.count("*").alias("n_shingles"))
    sketch = ranked.select("item_id", F.explode(F.slice("hs", 1, (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int"))).alias("h"))
    small = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    maybe = F.broadcast if small else (lambda x: x)

    docs = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ids = ["doc_id", "text_hash"]
    hashed = _shingles(docs, ids, F.col("text"), width).select(*ids, _hash(width).alias("h"))
    found = hashed.join(maybe(sketch), "h").select(*ids, "item_id").distinct()

    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    hit = found.select(*ids).distinct()
    whole = docs.join(hit, same(docs, hit, ids), "left_semi")
    texts = _shingles(whole, ids, F.col("text"), width).select(*ids, _text(width).alias("shingle"))
    match = texts.join(maybe(own.select("item_id", "shingle")), "shingle").distinct()
    counts = match.groupBy(*ids, "item_id").agg(F.count("*").alias("n_found"))
    counts = counts.join(found, same(counts, found, [*ids, "item_id"]), "left_semi")
    done = counts.join(F.broadcast(n) if small else n, counts["item_id"].eqNullSafe(n["of"]))
    return done.select(*ids, "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")).filter(F.col("containment") >= threshold)
