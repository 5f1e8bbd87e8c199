"""Corpus preparation: five stages from ``documents`` to token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
rereads as the next stage's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontamination, language, simhash, suffix_dedup
from textloom.llm.common import discard, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if its words' mean marginal for its language is lower.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; ``lang`` becomes the predicted one.

    Goes: texts that are null or have no letter, and those that no language
    explains (score under LEAST_SCORE).
    """
    crf = language.train(docs)
    scored = language.identify(docs, crf, keep=["doc_id", "text", "source", "n_chars"])
    kept = scored.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard 0.8 or more stays: the one with the smallest id.

    Different texts may share an id: each is a document of its own.  Rows
    without an id count as any others, and come after those with one.  Of rows
    equal in id and text one stays, with the smallest lang, source and n_chars.
    Null and empty texts are equal; an empty table gives no rows.
    """
    groups = simhash.similar_groups(docs)
    key = lambda i, t: F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(i).cast("string")), F.lit("")), F.hex(t)).cast("binary"))
    first = groups.select(key("first.doc_id", F.col("first.tx")).alias("row_key")).distinct()
    keyed = docs.withColumn("row_key", key("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    kept = keyed.join(first, "row_key", "left_semi").groupBy("row_key")
    kept = kept.agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return kept.select("doc_id", "text", "rest.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once; all documents stay.

    Null texts become empty, whole texts count however long; null and repeated
    ids, repeated rows (copies of one another) and an empty table are allowed.
    """
    cut = suffix_dedup.remove_repeats(docs, keep=["doc_id", "lang", "source"], with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and wordless texts hold none and stay; rows are told apart by id (null
    included) and text, and of equal rows all go or all stay; an empty table on
    either side drops nothing.
    """
    found = decontamination.find_contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["text_hash"] == found["text_hash"])
    return keyed.join(found, same, "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every text, as counts and digests of the ids and of what they decode to.

    One row per input row; a null text counts as empty; ids may be null or repeat.
    """
    return bpe.encode(docs, digests=True)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]

#: The classifier, the suffix arrays and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is a table in the shared folder."""

    def step(docs: DataFrame, stage) -> DataFrame:
        out = written(stage[1](spark, docs, sf_dir), "stage")
        discard(docs)
        return out

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
