"""Chunking: raw texts to labelled, citation-addressable chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letter_suffix, replace_all, strip, token_estimate
from .spans import numbered

STRATEGIES = {
    "paragraph": "paragraph",
    "paragraph-group": "paragraph",
    "heading": "heading",
    "regex": "regex",
    "regex-section-split": "regex",
    "page-as-chunk": "page",
}


@dataclass(frozen=True)
class ChunkConfig:
    """A text's chunking configuration, as in its TOML file."""

    strategy: str = "paragraph"
    pattern: str | None = None
    heading_pattern: str | None = None
    section_label_format: str = "Section {n}"
    section_label_format_no_number_match: str | None = None
    max_tokens: int = 800
    group_size: int = 1
    paragraphs_per_chunk: int | None = None
    number_source: str = "filename"
    number_pattern: str | None = None
    pre_strip_patterns: tuple[str, ...] = ()
    drop_chunk_patterns: tuple[str, ...] = ()
    drop_before_marker: str | None = None
    drop_after_marker: str | None = None
    require_drop_before_marker: bool = False
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> ChunkConfig:
        own = dict(d.get("chunking", {}))
        kind = own.get("strategy", "paragraph")
        if kind not in STRATEGIES:
            raise ValueError(f"unknown strategy: {kind}")
        own["strategy"] = STRATEGIES[kind]
        if own["strategy"] == "paragraph" and own.get("paragraphs_per_chunk") is None:
            own["paragraphs_per_chunk"] = own.get("group_size", 3)
        if unknown := sorted(set(own) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown settings: {unknown}")
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in cls.__dataclass_fields__}
        return cls(**known, metadata=d.get("metadata", {}))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """The stripped, non-empty paragraphs of a text."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), f"\\Q{separator}\\E"), strip)
    return F.filter(parts, lambda p: p != "")


def split_lines(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """``key, pos, line``: a row for each paragraph."""
    return df.select(key, F.posexplode(paragraphs(F.col(text), separator)).alias("pos", "line"))


def group_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n\n", target: int = 3, max_tokens: int = 800, label: str = "Section {n}") -> DataFrame:
    """``key, n, section, body, token_count``: greedy groups in reading order.

    A paragraph opens a new chunk if the open one would exceed ``max_tokens``
    with it (counted over the joined text), and closes its chunk once that
    holds ``target`` paragraphs.  A paragraph is never split; a text without
    one gives a single empty chunk.
    """
    # the fold is over lengths: it keeps where chunks end, and every body is joined once
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def add(s, size):
        joined = s["size"] + len(separator) + size
        over = (s["n"] > 0) & (F.floor(joined / 4) > max_tokens)
        new = over | (s["n"] == 0)
        ends = F.when(over, F.array_append(s["ends"], s["at"])).otherwise(s["ends"])
        full = F.when(new, 1).otherwise(s["n"] + 1) >= target
        n = F.when(full, 0).when(new, 1).otherwise(s["n"] + 1)
        return F.struct(F.when(full, F.array_append(ends, s["at"] + 1)).otherwise(ends).alias("ends"), (s["at"] + 1).alias("at"), n.alias("n"), F.when(new, size).otherwise(joined).alias("size"))

    def end(s):
        return F.when((s["n"] > 0) | (F.size(s["ends"]) == 0), F.array_append(s["ends"], s["at"])).otherwise(s["ends"])

    cut = df.select(key, paragraphs(F.col(text), separator).alias("p"))
    cut = cut.select(key, "p", F.aggregate(F.transform("p", F.char_length), start, add, end).alias("ends"))
    body = lambda e, k: F.array_join(F.slice("p", F.coalesce(F.get("ends", k - 1), F.lit(0)) + 1, e - F.coalesce(F.get("ends", k - 1), F.lit(0))), separator)
    rows = cut.select(key, F.posexplode(F.transform("ends", body)).alias("at", "body"))
    n = F.col("at") + 1
    named = F.replace(F.replace(F.lit(label), F.lit("{heading}"), F.concat(F.lit("Section "), n.cast("string"))), F.lit("{n}"), n.cast("string"))
    return rows.select(key, n.alias("n"), named.alias("section"), "body", token_estimate(F.col("body")).alias("token_count"))


def split_headings(df: DataFrame, heading: str, key: str = "doc_id", text: str = "text", group_size: int = 1, label: str = "{heading}") -> DataFrame:
    """``key, n, section, body``: sections that start at heading lines, bundled.

    Lines before the first heading are a section with an empty heading; the
    heading line is not in the body; a bundle takes its first section's
    heading, and bodies that are empty do not join.
    """
    cut = df.select(key, F.split(F.coalesce(F.col(text), F.lit("")), r"\R").alias("l"))
    at = F.transform("l", lambda x, i: F.when(strip(x).rlike(f"^(?:{heading})"), i))
    cut = cut.select(key, "l", F.filter(at, lambda i: i.isNotNull()).alias("h"))
    joined = lambda lo, n: strip(F.array_join(F.slice("l", lo, n), "\n"))
    one = lambda x, k: F.struct(strip(F.get("l", x)).alias("heading"), joined(x + 2, F.coalesce(F.get("h", k + 1), F.size("l")) - x - 1).alias("body"))
    before = joined(F.lit(1), F.coalesce(F.get("h", F.lit(0)), F.size("l")))
    cut = cut.select(key, F.transform("h", one).alias("own"), before.alias("before"))
    first = F.when(F.col("before") != "", F.array(F.struct(F.lit("").alias("heading"), F.col("before").alias("body")))).otherwise(F.array().cast("array<struct<heading:string,body:string>>"))
    cut = cut.select(key, F.concat(first, "own").alias("secs")).filter(F.size("secs") > 0)
    bundles = F.transform(F.sequence(F.lit(1), F.size("secs"), F.lit(group_size)), lambda k: F.slice("secs", k, group_size))
    out = cut.select(key, F.posexplode(bundles).alias("at", "parts")).withColumn("n", F.col("at") + 1)
    body = F.array_join(F.filter(F.transform("parts", lambda p: p["body"]), lambda b: b != ""), "\n\n")
    named = F.replace(F.replace(F.lit(label), F.lit("{n}"), F.col("n").cast("string")), F.lit("{heading}"), F.get("parts", F.lit(0))["heading"])
    return out.select(key, "n", named.alias("section"), body.alias("body"))


def split_regex(df: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", label: str = "{n}", group_size: int = 1) -> DataFrame:
    """``key, n, section, body``: sections that start at a pattern whose group is their number.

    Python's regular expressions, multi-line; text before the first match
    goes, the match itself too; a bundle is labelled by its first section.
    """
    rx = re.compile(pattern, re.MULTILINE)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(rx.finditer(t or ""))
                ends = [*(m.start() for m in found[1:]), len(t or "")][: len(found)]
                parts = [(m.group(1) if rx.groups else m.group(0), (t[m.end() : e]).strip()) for m, e in zip(found, ends, strict=True)]
                for n, at in enumerate(range(0, len(parts), group_size)):
                    own = parts[at : at + group_size]
                    out.append((k, n + 1, label.replace("{n}", (own[0][0] or "").strip()), "\n\n".join(x for _, x in own if x)))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=[key, "n", "section", "body"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n int, section string, body string")


def pages_as_chunks(pages: DataFrame, label: str = "Page {n}", number_pattern: str | None = None, no_match: str | None = None, page_no: str = "page", text: str = "text") -> DataFrame:
    """A chunk a page, numbered by its file's ordinal or by a pattern in its text."""
    num = F.regexp_extract(text, number_pattern, 1) if number_pattern else F.col(page_no).cast("string")
    named = F.replace(F.lit(label), F.lit("{n}"), num)
    other = F.replace(F.lit(no_match or label), F.lit("{n}"), F.col(page_no).cast("string"))
    return pages.withColumn("section", F.when(num != "", named).otherwise(other)).withColumn("body", strip(F.col(text)))


def subsplit(chunks: DataFrame, max_tokens: int, style: str = "letter", keys: tuple[str, ...] = ("doc_id", "n")) -> DataFrame:
    """Chunks over the budget at their nearest paragraph ends, else sentence ends.

    The parts' labels end in a, b, ... ('letter') or ' (part i)' ('part').
    """
    paras = paragraphs(F.col("body"))
    split = F.when(F.size(paras) > 1, paras).otherwise(F.split("body", r"(?<=[.!?])\s+"))
    sep = F.when(F.size(paras) > 1, F.lit("\n\n")).otherwise(F.lit(" "))
    tokens = lambda c: F.floor(F.char_length(c) / 4)

    def add(s, p):
        last = F.element_at(s, -1)
        joined = F.concat(last, F.col("sep"), p)
        return F.when(F.size(s) == 0, F.array(p)).when(tokens(joined) > max_tokens, F.array_append(s, p)).otherwise(F.array_append(F.slice(s, 1, F.size(s) - 1), joined))

    cut = chunks.withColumn("sep", sep).withColumn("units", split)
    parts = F.when(tokens(F.col("body")) > max_tokens, F.aggregate("units", F.array().cast("array<string>"), add)).otherwise(F.array("body"))
    rows = cut.withColumn("parts", parts).select(*keys, "section", F.size("parts").alias("of"), F.posexplode("parts").alias("part", "body"))
    suffix = letter_suffix(F.col("part")) if style == "letter" else F.concat(F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))
    return rows.select(*keys, "part", F.when(F.col("of") > 1, F.concat("section", suffix)).otherwise(F.col("section")).alias("section"), "body", token_estimate(F.col("body")).alias("token_count"))


def pre_strip(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    return df.withColumn(text, replace_all(F.col(text), patterns))


class MarkerMissing(ValueError):
    """A required marker is in no page of some text."""


def drop_pages(pages: DataFrame, before: str | None = None, after: str | None = None, drop: list[str] | None = None, require: bool = False, key: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Pages from the first that matches ``before`` up to the first after it that matches ``after``,
    without those that match ``drop``.  A text without the marker keeps all pages, or with
    ``require`` ends the run before anything is written."""
    w = Window.partitionBy(key)
    out = pages
    if before:
        out = out.withColumn("from_page", F.min(F.when(F.col(text).rlike(before), F.col(page))).over(w))
        if require and not out.filter("from_page IS NULL").isEmpty():
            raise MarkerMissing(f"no page matches {before!r}")
        out = out.filter(F.col("from_page").isNull() | (F.col(page) >= F.col("from_page"))).drop("from_page")
    if after:
        out = out.withColumn("to_page", F.min(F.when(F.col(text).rlike(after), F.col(page))).over(w))
        out = out.filter(F.col("to_page").isNull() | (F.col(page) < F.col("to_page"))).drop("to_page")
    for p in drop or []:
        out = out.filter(~F.coalesce(F.col(text).rlike(p), F.lit(False)))
    return out


def chunk_texts(df: DataFrame, config: ChunkConfig, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks by the configured strategy (not pages, which have ordinals)."""
    df = pre_strip(df, list(config.pre_strip_patterns), text)
    if config.strategy == "heading":
        return split_headings(df, config.heading_pattern or "", key, text, config.group_size, config.section_label_format)
    if config.strategy == "regex":
        return split_regex(df, config.pattern or "", key, text, config.section_label_format, config.group_size)
    return group_paragraphs(df, key, text, "\n\n", config.paragraphs_per_chunk or 3, config.max_tokens, config.section_label_format)


def enumeration_faults(chunks: DataFrame, expected: dict[str, int] | DataFrame, template: str, text_id: str = "text_id", seq: str = "seq", label: str = "section") -> DataFrame:
    """Texts whose count is not the canon's, and chunks whose label is not their ordinal's.

    ``expected``: the count of each text of the canon, as a dictionary or a table
    (``text_id``, expected); other texts are not looked at, and a text without
    chunks has 0.  Ordinals of long texts are counted by ranges (see ``spans``).
    """
    canon = expected if isinstance(expected, DataFrame) else chunks.sparkSession.createDataFrame(list(expected.items()), f"{text_id} string, expected int")
    own = chunks.join(canon.select(text_id), text_id, "left_semi")
    count = own.groupBy(text_id).agg(F.count("*").alias("found"))
    wrong = canon.join(count, text_id, "left").filter(F.coalesce("found", F.lit(0)) != F.col("expected"))
    named = numbered(own.select(text_id, seq, label), [text_id], [seq])
    want = F.replace(F.lit(template), F.lit("{n}"), F.col("pos").cast("string"))
    labels = named.filter(~F.col(label).eqNullSafe(want))
    return wrong.select(text_id, F.lit("count").alias("fault"), F.lit(None).cast("int").alias("ordinal")).unionByName(labels.select(text_id, F.lit("label").alias("fault"), F.col("pos").cast("int").alias("ordinal")))


def shared_bodies(df: DataFrame, body: str = "body", key: str = "id") -> DataFrame:
    """Bodies that more than one row has: ``digest, n, first_id``."""
    return df.filter(F.col(body).isNotNull()).groupBy(F.sha2(body, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).filter("n > 1")
