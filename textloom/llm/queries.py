"""The registered queries of the training-data operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontamination, fill_in_middle, language, nn_descent, quality, sharding, simhash, suffix_dedup, training_order, vector_codes, voronoi
from .common import crc_remainder, table
from .token_counts import count_tokens


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), digests=True)


def op3_decontamination(spark, sf_dir):
    found = decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", F.round("containment", 6).alias("containment"))


def op4_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(crc_remainder("doc_id", 3) != 1))
    return quality.score_quality(docs, model).withColumn("held_out", crc_remainder("doc_id", 3) == 1)


def op5_training_order(spark, sf_dir):
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crf = language.train(docs.filter(crc_remainder("doc_id", 5) != 0))
    return language.identify(docs, crf).withColumn("held_out", crc_remainder("doc_id", 5) == 0)


def op9_nearest(spark, sf_dir):
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_exact_top_k(spark, sf_dir):
    return voronoi.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP3_SQL = """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT side, id, array_to_string(words[k:k + 4], ' ') AS shingle
  FROM (SELECT side, id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n_shingles, count(*) AS n_found, round(count(*) / n.n_shingles, 6) AS containment
FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_shingles HAVING count(*) / n.n_shingles >= 0.8
"""

OP10_SQL = f"""
WITH k AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents
), s AS (
  SELECT doc_id, n_bytes, d, left(bits, d) AS shard,
         sum(n_bytes) OVER (PARTITION BY d, left(bits, d)) AS shard_bytes, count(*) OVER (PARTITION BY d, left(bits, d)) AS shard_docs
  FROM k, range(0, 61) AS t(d)
)
SELECT doc_id, n_bytes, arg_min(shard, d) AS shard, arg_min(shard_bytes, d)::BIGINT AS shard_bytes, arg_min(shard_docs, d) AS shard_docs
FROM s WHERE shard_bytes <= {sharding.LIMIT} OR shard_docs = 1
GROUP BY doc_id, n_bytes
"""


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id::VARCHAR) AS h
  FROM documents
), k AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql(parts=8, entries=16, rounds=6, scale=4096):
    """Every round a pair of tables: each part's nearest entry, and the entries that follow."""
    sql = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {USABLE})",
        f"x AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS x FROM v, range(0, {parts}) AS t(part))",
        f"c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM x) WHERE entry < {entries})",
    ]
    for r in range(rounds + 1):
        d = f"d{r} AS (SELECT vec_id, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} USING (part))"
        sql += [d, f"a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY vec_id, part)"]
        if r < rounds:
            sql += [
                f"s{r} AS (SELECT part, entry, k, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM a{r} JOIN x USING (vec_id, part)) GROUP BY ALL)",
                f"m{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM s{r} GROUP BY ALL)",
                f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))",
            ]
    return f"""WITH {", ".join(sql)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN v USING (vec_id)"""


OP13_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE {USABLE}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def oracle_sql():
    return {"op11_vector_codes": _op11_sql(), "op13_exact_top_k": OP13_SQL, "op12_fill_in_middle": OP12_SQL, "op3_decontamination": OP3_SQL, "op10_sharding": OP10_SQL}
