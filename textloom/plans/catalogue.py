"""Query catalogue: name -> Spark callable, and the oracle SQL beside it.

The test tables stand in for the engine's own: documents for chunks and texts
(source: text, lang: tradition), embeddings for stored vectors, labels for
staged tags, events for review actions, lineitem and orders for tags.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models, splitters
from ..functions.html import html_main_text
from ..functions.llm_output import json_elements, overflowed, repaired_json
from ..functions.text import elide, natural_key, slug, token_estimate
from ..operators import chunking, cleaning, graph, parallels, retrieval, review, sketches, spans, tables, temporal, vectors
from ..sources import chunk_writer
from ..sources.files import downloader, read_chunks, scoped_links
from ..sources.shared import shared_dir
from ..sources.store import Store
from ..streaming.review_stream import sessions, tumbling

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = r"""lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, line FROM (
    SELECT doc_id, k, regexp_replace(parts[k], '^\s+|\s+$', '', 'g') AS line
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
  WHERE line <> '')"""


# --- chunking ---


@_query(f"WITH {LINES} SELECT doc_id, (i - 1)::INT AS pos, line FROM lines")
def chunk_lines(spark, sf_dir):
    return chunking.split_lines(_t(spark, sf_dir, "documents"))


@_query(f"""WITH RECURSIVE {LINES}, fold AS (
  SELECT doc_id, i, line, 1 AS chunk, 1 AS cnt, line AS txt FROM lines WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.line,
    CASE WHEN f.cnt >= 3 OR length(f.txt || chr(10) || l.line) // 4 > 200 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.cnt >= 3 OR length(f.txt || chr(10) || l.line) // 4 > 200 THEN 1 ELSE f.cnt + 1 END,
    CASE WHEN f.cnt >= 3 OR length(f.txt || chr(10) || l.line) // 4 > 200 THEN l.line ELSE f.txt || chr(10) || l.line END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1
), out AS (SELECT doc_id, chunk, arg_max(txt, i) AS body FROM fold GROUP BY doc_id, chunk)
SELECT doc_id, chunk::INT AS n, 'Section ' || chunk AS section, body, (length(body) // 4)::BIGINT AS token_count FROM out
UNION ALL SELECT doc_id, 1, 'Section 1', '', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lines)""")
def chunk_paragraph_group(spark, sf_dir):
    return chunking.group_paragraphs(_t(spark, sf_dir, "documents"), separator="\n", target=3, max_tokens=200)


@_query(r"""WITH lines AS (
  SELECT doc_id, k, parts[k] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), h AS (SELECT *, regexp_matches(trim(line), '^[^ ]+\.$') AS head FROM lines),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY k) AS sec FROM h),
g AS (SELECT doc_id, sec, max(CASE WHEN head THEN trim(line) END) AS heading, coalesce(regexp_replace(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY k), '^\s+|\s+$', '', 'g'), '') AS body FROM s GROUP BY doc_id, sec),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS rn FROM g WHERE sec > 0 OR body <> ''),
b AS (SELECT *, ((rn - 1) // 2 + 1)::INT AS n FROM r)
SELECT doc_id, n, arg_min(coalesce(heading, ''), rn) AS section, coalesce(string_agg(CASE WHEN body <> '' THEN body END, chr(10) || chr(10) ORDER BY rn), '') AS body FROM b GROUP BY doc_id, n""")
def chunk_headings(spark, sf_dir):
    return chunking.split_headings(_t(spark, sf_dir, "documents"), r"[^ ]+\.$", group_size=2)


@_query()
def chunk_regex(spark, sf_dir):
    return chunking.split_regex(_t(spark, sf_dir, "documents"), r"^(\w+)[.,]", label="Sutra {n}", group_size=2)


NUMBERED = r"""l AS (SELECT doc_id, k, regexp_replace(parts[k], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


@_query(f"WITH {NUMBERED} SELECT doc_id, ((k + 1) // 2)::INT AS n, 'Part ' || min(k) AS section, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY k) FILTER (line <> ''), '') AS body FROM l GROUP BY doc_id, (k + 1) // 2")
def chunk_regex_numbered(spark, sf_dir):
    """Documents whose lines are numbered sections, in bundles of two."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("#"), i + 1, F.lit("# "), x))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("before\n"), F.array_join(line, "\n")).alias("text"))
    return chunking.split_regex(d, r"^#(\d+)#", label="Part {n}", group_size=2)


@_query(_SQL["chunk_regex_numbered"])
def split_by_table_function(spark, sf_dir):
    """The same sections from SQL: the configuration decides the columns."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("#"), i + 1, F.lit("# "), x))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("before\n"), F.array_join(line, "\n")).alias("text"))
    return splitters.split_by(d, kind="regex", pattern=r"^#(\d+)#", label="Part {n}", group_size=2)


@_query(f"WITH {LINES} SELECT doc_id, i::INT AS n, line AS body FROM lines")
def lines_by_table_function(spark, sf_dir):
    return splitters.split_by(_t(spark, sf_dir, "documents"), kind="lines")


@_query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@_query("SELECT doc_id, regexp_replace(text, '(?s)(Licensed under|Copyright \\(c\\)|This work is licensed).*$', '') AS body, length(text)::INT AS n_before FROM documents")
def pre_strip_patterns(spark, sf_dir):
    d = chunking.pre_strip(_t(spark, sf_dir, "documents").select("doc_id", "text", F.char_length("text").alias("n_before")), [r"(Licensed under|Copyright \(c\)|This work is licensed).*$"])
    return d.select("doc_id", F.col("text").alias("body"), "n_before")


@_query("""WITH m AS (SELECT source, min(CASE WHEN contains(text, 'ation') THEN doc_id END) AS lo FROM documents GROUP BY source),
k AS (SELECT d.* FROM documents d JOIN m USING (source) WHERE lo IS NULL OR doc_id >= lo),
e AS (SELECT source, min(CASE WHEN contains(text, 'licensed') THEN doc_id END) AS hi FROM k GROUP BY source)
SELECT k.doc_id, k.source FROM k JOIN e USING (source) WHERE (hi IS NULL OR doc_id < hi) AND NOT contains(text, '###')""")
def drop_pages_by_marker(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return chunking.drop_pages(d, before="ation", after="licensed", drop=["###"], key="source", page="doc_id").select("doc_id", "source")


@_query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return chunking.shared_bodies(_t(spark, sf_dir, "documents"), "text", "doc_id")


@_query("""WITH n AS (SELECT source, count(*) AS found FROM documents GROUP BY source), d AS (SELECT source, max(doc_id) // 20 AS declared FROM documents GROUP BY source)
SELECT source, declared, found FROM n JOIN d USING (source) WHERE declared <> found""")
def count_gate(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return tables.count_gate(d.groupBy("source").agg(F.expr("max(doc_id) div 20").alias("declared")), d, "source")


# --- cleaning and readability ---


@_query(r"SELECT doc_id, regexp_replace(text, '\s*\[\d{1,3}\]', '', 'g') AS body FROM documents")
def clean_footnotes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", cleaning.FOOTNOTE, "").alias("body"))


#: What a text gets by its id's remainder, so that every cleaning step has work; (before, after).
RESIDUE = [
    ("", "\n\nNext: Chapter 3"),
    ("Sacred-Texts Home\n\n", ""),
    ("", " scanned at a library by hand."),
    ("left [Pg 12] right ", ""),
    ("", "\n\nEnd of the Project Gutenberg EBook\nmore"),
    ("Errata\n\n", ""),
    ("the river {p. xiv} bends ", ""),
    ("xiii} ", " {p. "),
    ("p. 304\n\n", ""),
    ("see [3], and [44]. ", " J.B. Hare, redactor of it."),
    ("", ""),
]
_PLANTED = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{a}' || text || '{z}'" for i, (a, z) in enumerate(RESIDUE)) + " END"


@_query(rf"""WITH d AS (SELECT doc_id, {_PLANTED} AS text FROM documents),
p AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS parts FROM d),
k AS (SELECT doc_id, text, parts, list_filter(parts, lambda x, i: NOT regexp_matches(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^(Next:\s.{{0,120}}$|Errata\b|p\.\s*\d+$)') AND NOT (i = 1 AND regexp_matches(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^(Sacred-[Tt]exts?\b|Index\s+Previous\s+Next\b)'))) AS kept FROM p),
c0 AS (SELECT doc_id, text, CASE WHEN len(kept) = len(parts) THEN text ELSE coalesce(array_to_string(kept, chr(10) || chr(10)), '') END AS c FROM k),
c1 AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(c, '(?s)End of the Project Gutenberg.*$', ''), '((?i:scanned|digitized|transcribed|proofed) (at|by|and)|J\.\s?B\. Hare, redactor)[^.]{{0,120}}(\.com[^.]{{0,120}})?\.', '', 'g'), '\s*\[Pg \d+\]\s*', ' ', 'g') AS c FROM c0),
c2 AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '\s*\{{p\.\s*[0-9ivxlcdm]+\}}\s*', ' ', 'g'), '\s*\{{p\.\s*$', ''), '^\s*[0-9ivxlcdm]+\}}\s*', ''), '\s*\[\d{{1,3}}\]', '', 'g') AS cleaned FROM c1)
SELECT doc_id, CASE WHEN 1 - length(cleaned) / length(text) > 0.25 THEN text ELSE cleaned END AS cleaned, round(1 - length(cleaned) / length(text), 6) AS shrink, 1 - length(cleaned) / length(text) > 0.25 AS refused FROM c2""")
def clean_bodies(spark, sf_dir):
    planted = F.col("text")
    for i, (a, z) in enumerate(RESIDUE):
        planted = F.when(F.col("doc_id") % 11 == i, F.concat(F.lit(a), "text", F.lit(z))).otherwise(planted)
    d = _t(spark, sf_dir, "documents").select("doc_id", planted.alias("body"))
    return cleaning.clean_guarded(d, key="doc_id").select("doc_id", "cleaned", F.round("shrink", 6).alias("shrink"), "refused")


@_query(r"SELECT doc_id, regexp_replace(text, '[\s\-]+', '', 'g') = regexp_replace(replace(text, ' ', chr(10)), '[\s\-]+', '', 'g') AS same FROM documents")
def words_preserved(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", cleaning.words_preserved(F.col("text"), F.replace("text", F.lit(" "), F.lit("\n"))).alias("same"))


@_query("SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:150] || '…' || right(text, 150) ELSE text END AS body FROM documents")
def head_tail_elide(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", elide(F.col("text"), 300).alias("body"))


def _signals_sql() -> str:
    pats = {
        "hyphen_break": (r"[a-z]-\n[a-z]", "b"),
        "caps_runs": (r"\b[A-Z]{4,}(?:\s+[A-Z]{2,})+\b", "h"),
        "page_marks": (r"\[(?:p\.|Pg) ?\d+\]|(?m:^\s*\d{1,4}\s*$)", "h"),
        "footnotes": (r"\[\d{1,3}\]|\{\d{1,3}\}|\^\d{1,3}", "h"),
        "brackets": (r"\[\.\.\.\]|\[sic\]|\(\?\)", "h"),
        "dot_leaders": (r"\.{4,}", "h"),
    }
    cols = [f"least(1.0::DOUBLE, len(regexp_extract_all(text, '{p}')) / greatest({v}, 1)) AS {k}" for k, (p, v) in pats.items()]
    hard = r"CASE WHEN b >= 2 THEN least(1.0::DOUBLE, len(regexp_extract_all(text, '[a-z,;]\n[a-z]')) / greatest(b, 1)) ELSE 0.0 END AS hard_wrap"
    total = " + ".join(f"{k} * {w}" for k, w in cleaning.WEIGHTS.items())
    names = ", ".join(f"round({k}, 6) AS {k}" for k in cleaning.WEIGHTS)
    return f"WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '\\n'))::DOUBLE AS b, length(text) / 100.0::DOUBLE AS h FROM documents), s AS (SELECT doc_id, source, {hard}, {', '.join(cols)} FROM d), q AS (SELECT doc_id, source, {names}, round({total}, 6) AS score FROM s)"


@_query(_signals_sql() + " SELECT * EXCLUDE (source) FROM q")
def readability(spark, sf_dir):
    return cleaning.audit(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@_query(_signals_sql() + " SELECT doc_id, source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM q) WHERE rank <= 3")
def worst_n_per_source(spark, sf_dir):
    d = cleaning.audit(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return cleaning.worst(d, 3, "source", key="doc_id").select("doc_id", "source", "score", "rank")


# --- pages ---


@_query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def html_title_host(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@_query(r"""WITH l AS (SELECT url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS base, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href FROM pages),
r AS (SELECT DISTINCT url, base, href, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^[a-z]+://[^/]+') || href ELSE base || href END AS link FROM l)
SELECT url, link FROM r WHERE starts_with(link, base) AND NOT starts_with(href, '..') AND NOT contains(split_part(link, '/', -1), '..')""")
def html_scoped_links(spark, sf_dir):
    return scoped_links(_t(spark, sf_dir, "pages"))


@_query()
def html_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html_main_text("html").alias("body"))


@_query(f"WITH {NUMBERED} SELECT doc_id, string_agg(regexp_replace(line, '[ \\t\\r\\f\\v]+', ' ', 'g'), chr(10) ORDER BY k) AS body FROM l WHERE line <> '' GROUP BY doc_id")
def html_planted(spark, sf_dir):
    """Documents as pages: a paragraph a line, with a menu, unclosed anchors, small print and footnotes that go."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda x, i: F.concat(F.lit("<a name='n"), i, F.lit("'><p>"), x, F.lit("<sup>7</sup></p>"))), "")
    page = F.concat(F.lit("<html><head><style>a{}</style></head><body><nav>menu</nav><main>"), body, F.lit("<font size=1>small</font><a href='#'></a></main><article><h3>Footnotes:</h3><p>gone</p></article></body></html>"))
    return _t(spark, sf_dir, "documents").select("doc_id", html_main_text(page).alias("body")).filter("body <> ''")


@_query(r"""SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\.)gnosis\.org$') THEN 'gnosis_org' WHEN page_id % 4 = 0 THEN 'sacred_texts' WHEN page_id % 4 = 1 THEN 'generic_html' WHEN page_id % 4 = 2 THEN 'sefaria' END AS module FROM pages""")
def downloader_dispatch(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ["html_multi", "html", "sefaria_api", "pdf"])), (F.col("page_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", downloader(F.col("url"), kind).alias("module"))


# --- tables ---


@_query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def tagged_semi(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "source")


@_query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def untagged_anti(spark, sf_dir):
    return tables.drop_ids(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@_query("""WITH o AS (SELECT doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h, row_number() OVER (PARTITION BY sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h, row_number() OVER (PARTITION BY sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1)
SELECT o.doc_id AS old_id, coalesce(n.doc_id, -1) AS new_id FROM o LEFT JOIN n USING (h, k)""")
def body_remap(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return tables.match_by_body(d.filter("id % 2 = 0"), d.filter("id % 2 = 1")).fillna(-1, ["new_id"])


@_query("""WITH m AS (SELECT doc_id AS old_id, CASE WHEN doc_id % 10 <> 0 THEN doc_id + 1000000 END AS new_id FROM documents)
SELECT m.new_id AS doc_id, quality, toxic FROM labels l JOIN m ON m.old_id = l.doc_id WHERE m.new_id IS NOT NULL""")
def rewrite_references(spark, sf_dir):
    m = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("old_id"), F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") + 1000000).alias("new_id"))
    return tables.rewrite_refs(_t(spark, sf_dir, "labels"), ["doc_id"], m)


@_query("""WITH m AS (SELECT user_id, user_id // 2 AS new FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 1),
r AS (SELECT event_id, coalesce(m.new, e.user_id) AS user_id, event_type, m.new IS NOT NULL AS moved FROM events e LEFT JOIN m ON m.user_id = e.user_id)
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY moved, event_id) AS k FROM r) WHERE k = 1""")
def many_to_one_remap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    m = e.select("user_id").distinct().filter("user_id % 2 = 1").select(F.col("user_id").alias("old"), F.expr("user_id div 2").alias("new"))
    return tables.update_or_ignore(e, "user_id", m, ["user_id", "event_type"], "event_id")


@_query("""SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'orphaned' ELSE 'off_plan' END AS state FROM (SELECT doc_id FROM labels UNION SELECT -1) l LEFT JOIN documents d USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def drift_report(spark, sf_dir):
    d, live = _t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id")
    live = live.unionAll(spark.range(1).select((F.col("id") - 1).alias("doc_id"))).distinct()
    return tables.drift(d.filter("doc_id % 3 = 0"), live, d, "doc_id")


@_query("""WITH a AS (SELECT doc_id, source FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 11 <> 0)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def parity_diff(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    b = d.filter("doc_id % 11 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source")))
    return tables.parity(d, b, ["doc_id", "source"])


@_query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id + 5000000, quality, toxic FROM labels WHERE doc_id % 50 = 0""")
def upsert_by_key(spark, sf_dir):
    old = _t(spark, sf_dir, "labels")
    new = old.filter("doc_id % 5 = 0").withColumn("quality", (1 - F.col("quality")).cast("int"))
    return tables.upsert(old, new.unionByName(old.filter("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 5000000)), ["doc_id"])


@_query("SELECT doc_id, quality, toxic FROM labels UNION ALL SELECT doc_id, -1, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_or_ignore(spark, sf_dir):
    new = _t(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return tables.insert_ignore(_t(spark, sf_dir, "labels"), new, ["doc_id"])


@_query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 9 ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE 7 END AS toxic
FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) d ON d.doc_id = l.doc_id""")
def selective_upsert(spark, sf_dir):
    new = _t(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(7).alias("toxic"))
    return tables.selective_upsert(_t(spark, sf_dir, "labels"), new, ["doc_id"], ["quality"])


@_query("""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type = 'click', user_id, event_type ORDER BY event_id) AS k FROM events) WHERE event_type <> 'click' OR k = 1""")
def pending_dedupe(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return tables.dedupe_where(e, F.col("event_type") == "click", ["user_id", "event_type"], "event_id")


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id < 1000 THEN 'model-a' ELSE 'model-b' END AS model FROM events")
def backfill_by_range(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("model"))
    return tables.backfill(e, "model", 1000, "model-a", "model-b", "event_id")


@_query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 20")
def keyset_page(spark, sf_dir):
    return tables.page_after(_t(spark, sf_dir, "documents").select("doc_id", "source"), 100, 20, "doc_id")


@_query("SELECT count(*) FILTER (doc_id > 100) AS ahead, count(*) FILTER (doc_id <= 100) AS behind FROM documents")
def remaining_count(spark, sf_dir):
    return tables.remaining(_t(spark, sf_dir, "documents"), 100, "doc_id")


@_query("SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE rank <= 20")
def first_n_per_group(spark, sf_dir):
    d = tables.drop_ids(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), "doc_id")
    return tables.first_n(d, "lang", "doc_id", 20)


@_query("SELECT 'documents' AS label, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'pending', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'large', count(*) FROM events WHERE value > 50")
def manifest_counts(spark, sf_dir):
    m = tables.manifest({n: _t(spark, sf_dir, n) for n in ("documents", "labels", "pages")})
    return m.unionByName(tables.conditional_manifest(_t(spark, sf_dir, "events"), {"pending": F.col("event_type") == "view", "large": F.col("value") > 50}))


@_query("SELECT source, 'part-' || doc_id AS member, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def natural_order(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", F.concat(F.lit("part-"), "doc_id").alias("member"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(natural_key(F.col("member"))))
    return d.select("source", "member", place.cast("long").alias("place"))


@_query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def span_slug(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


# --- review queue ---


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS action, max(ts) AS at FROM events GROUP BY user_id")
def queue_latest_action(spark, sf_dir):
    return review.latest_action(_t(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@_query("SELECT event_type AS action, (user_id % 3)::VARCHAR AS target_table, count(*) AS n, count(DISTINCT user_id) AS targets FROM events GROUP BY GROUPING SETS ((), (event_type), ((user_id % 3)::VARCHAR))")
def apply_preview(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("action"), (F.col("user_id") % 3).cast("string").alias("target_table"), F.col("user_id").alias("target_id"))
    return review.apply_preview(e)


@_query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts)::DATE FROM events) GROUP BY event_type")
def applied_today(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    today = e.agg(F.max("ts").cast("date").cast("timestamp_ntz").alias("today"))
    return e.join(F.broadcast(today), F.col("ts") >= F.col("today")).groupBy("event_type").agg(F.count("*").alias("n"))


@_query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return _t(spark, sf_dir, "events").filter(k.isNotNull()).select("event_id", k.cast("int").alias("k"))


@_query("""WITH a AS (SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'tag' WHEN 1 THEN 'edge' ELSE 'cleanup' END AS target_table, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'reassign' ELSE 'skip' END AS action, 'c' || (event_id % 9000) AS client_action_id FROM events),
v AS (SELECT *, action <> 'reassign' AS ok, row_number() OVER (PARTITION BY client_action_id ORDER BY id) AS r FROM a)
SELECT CASE WHEN NOT ok THEN 'invalid' WHEN r > 1 THEN 'duplicate' ELSE 'queued' END AS outcome, count(*) AS n FROM v GROUP BY 1""")
def enqueue_outcomes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    null = F.lit(None).cast("string")
    a = e.select(
        F.col("event_id").alias("id"),
        F.element_at(F.array(F.lit("tag"), F.lit("edge"), F.lit("cleanup")), (F.col("user_id") % 3 + 1).cast("int")).alias("target_table"),
        F.col("user_id").alias("target_id"),
        F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "reject").when(F.col("event_type") == "purchase", "reassign").otherwise("skip").alias("action"),
        null.alias("reassign_to"),
        null.alias("reclassify_to"),
        F.concat(F.lit("c"), F.col("event_id") % 9000).alias("client_action_id"),
    )
    _, outcome = review.enqueue(a.limit(0), a)
    return outcome.groupBy("outcome").agg(F.count("*").alias("n"))


# --- vectors ---

COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@_query(f"SELECT query_id, vec_id, similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id WHERE {COS} >= 0.1) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return vectors.top_k(e, e.filter("vec_id % 20 = 0"), 10, 0.1).withColumn("similarity", F.round("similarity", 6))


@_query(f"SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b, round(s, 6) AS similarity FROM (SELECT q.vec_id AS a, v.vec_id AS b, {COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.vec_id) AS r FROM embeddings q JOIN embeddings v ON q.label <> v.label AND q.vec_id % 20 = 0) WHERE r <= 5")
def cross_group_pairs(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return vectors.cross_group_pairs(e, e.filter("vec_id % 20 = 0"), 5, -1.0).withColumn("similarity", F.round("similarity", 6))


FUSED = f"""WITH f AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, {COS} AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id WHERE {COS} >= 0.0),
w AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, CASE v.vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS tier_weight, (v.vec_id % 5) / 5.0::DOUBLE AS graph_score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND v.label = q.label AND v.vec_id <> q.vec_id),
b AS (SELECT coalesce(f.query_id, w.query_id) AS query_id, coalesce(f.vec_id, w.vec_id) AS vec_id, coalesce(f.label, w.label) AS label, 0.7::DOUBLE * coalesce(similarity, 0) + 0.3::DOUBLE * greatest(coalesce(tier_weight, 0), coalesce(graph_score, 0)) AS base FROM f FULL JOIN w ON f.vec_id = w.vec_id AND f.query_id = w.query_id),
s AS (SELECT query_id, vec_id, label, base + CASE WHEN row_number() OVER (PARTITION BY query_id, label ORDER BY base DESC, vec_id) = 1 THEN 0.1::DOUBLE ELSE 0 END AS score FROM b)"""


def _walk():
    """Tier weight and graph score of a vector that is walked to: all of a label are, from its queries."""
    tier = F.element_at(F.array(F.lit("verified"), F.lit("proposed"), F.lit("inferred")), (F.col("vec_id") % 3 + 1).cast("int"))
    return graph.tier_weight(tier), (F.col("vec_id") % 5) / 5.0


@_query(FUSED + " SELECT query_id, vec_id, label, round(score, 6) AS score FROM s")
def fusion_rank(spark, sf_dir):
    """All candidates: vectors at or over the floor, and all that are walked to; the first of each label is found beforehand."""
    e = _t(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    first = vectors.best_of_groups(e, q, 1, 0.0, "label", F.greatest(*_walk()))
    found = vectors.candidates(e, q, 0.0, "label", marked=first)
    base = vectors.base_score(F.col("similarity"), *[F.when(F.col("walked"), w) for w in _walk()])
    score = base + F.when(F.col("marked"), 0.1).otherwise(0.0)
    return found.select("query_id", "vec_id", "label", F.round(score, 6).alias("score"))


@_query(FUSED + " SELECT query_id, vec_id, label, round(score, 6) AS score, group_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS group_rank FROM s) WHERE group_rank <= 3")
def knn_label_cap(spark, sf_dir):
    """The bonus goes to the first of a group, so the order within groups is that of ``base``."""
    e = _t(spark, sf_dir, "embeddings")
    capped = vectors.best_of_groups(e, e.filter("vec_id % 20 = 0"), 3, 0.0, "label", F.greatest(*_walk()))
    score = F.col("base") + F.when(F.col("group_rank") == 1, 0.1).otherwise(0.0)
    return capped.select("query_id", "vec_id", "label", F.round(score, 6).alias("score"), "group_rank")


@_query("""SELECT a.vec_id AS id_a, b.vec_id AS id_b, CASE WHEN a.vec_id <= b.vec_id THEN 'ab' ELSE 'ba' END AS presentation_order, least(a.vec_id, b.vec_id) AS pair_a, greatest(a.vec_id, b.vec_id) AS pair_b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)""")
def similarity_backfill(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    p = e.select(F.col("vec_id").alias("id_a"), ((F.col("vec_id") * 7 + 3) % e.count()).alias("id_b"))
    p = vectors.backfill_similarity(p, e, "id_a", "id_b", "vec_id", "embedding")
    return graph.canonical_pairs(p, "id_a", "id_b").withColumn("similarity", F.round("similarity", 6))


# --- graph ---

EXPRESSES = "x AS (SELECT DISTINCT o_custkey AS chunk_id, l_partkey AS concept_id, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT chunk_id, concept_id, CASE min(l_linenumber) WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS w FROM x GROUP BY ALL), e AS (SELECT t.*, c_nationkey AS tradition FROM t JOIN customer ON c_custkey = chunk_id)"


def _expressed(spark, sf_dir):
    li, o, c = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("chunk_id"), F.col("l_partkey").cast("string").alias("concept_id"), F.when(F.col("l_linenumber") == 1, "verified").when(F.col("l_linenumber") == 2, "proposed").otherwise("inferred").alias("tier"))
    return x, c.select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("tradition"))


@_query(f"WITH {EXPRESSES} SELECT a.chunk_id AS source, b.chunk_id AS target, round(sum(least(a.w, b.w)), 6) AS weight, string_agg(a.concept_id, ',' ORDER BY a.concept_id::VARCHAR) AS annotation FROM e a JOIN e b ON a.concept_id = b.concept_id AND a.chunk_id < b.chunk_id AND a.tradition <> b.tradition GROUP BY 1, 2 HAVING count(*) >= 2")
def derived_parallels(spark, sf_dir):
    return parallels.derived_parallels(*_expressed(spark, sf_dir), 2)


@_query(f"WITH {EXPRESSES}, k AS (SELECT DISTINCT concept_id::VARCHAR AS concept_id FROM e ORDER BY 1 LIMIT 500) SELECT a.chunk_id AS source, b.chunk_id AS target, round(sum(least(a.w, b.w)), 6) AS weight, string_agg(a.concept_id, ',' ORDER BY a.concept_id::VARCHAR) AS annotation FROM e a JOIN e b ON a.concept_id = b.concept_id AND a.chunk_id < b.chunk_id AND a.tradition <> b.tradition WHERE a.concept_id::VARCHAR IN (FROM k) GROUP BY 1, 2")
def derived_parallels_limited(spark, sf_dir):
    """A run limited to 500 concepts: the limit is the feature."""
    return parallels.derived_parallels(*_expressed(spark, sf_dir), limit_concepts=500)


HOT = "x AS (SELECT doc_id, lang, source AS concept, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS w FROM documents UNION ALL SELECT d.doc_id, d.lang, 'item ' || (d.doc_id % 97), 0.7::DOUBLE FROM documents d)"


@_query(f"""WITH {HOT}, p AS (SELECT a.doc_id AS source, b.doc_id AS target, bool_or(a.concept NOT LIKE 'item %') AS implied, bool_or(a.concept LIKE 'item %') AS light FROM x a JOIN x b ON a.concept = b.concept AND a.doc_id < b.doc_id AND a.lang <> b.lang GROUP BY 1, 2)
SELECT count(*) FILTER (light) AS rows, count(*) FILTER (implied)::BIGINT AS implied, count(*)::BIGINT AS links FROM p""")
def derived_links(spark, sf_dir):
    """Documents' sources as heavy concepts: the links are counted without a row a pair."""
    d = _t(spark, sf_dir, "documents")
    tier = F.element_at(F.array(F.lit("verified"), F.lit("proposed"), F.lit("inferred")), (F.col("doc_id") % 3 + 1).cast("int"))
    e = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("concept_id"), tier.alias("tier"))
    e = e.unionAll(d.select("doc_id", F.concat(F.lit("item "), F.col("doc_id") % 97), F.lit("proposed")))
    mean = d.count() // 40  # sources have more documents than this, items fewer
    return parallels.link_counts(parallels.factored(e, d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("tradition")), heavy=mean))


@_query("""WITH c AS (SELECT DISTINCT p_type AS concept FROM part), q AS (SELECT DISTINCT p_name AS query FROM part)
SELECT query, concept FROM q, c WHERE contains(lower(query), replace(lower(concept), '_', ' ')) OR len(list_filter(string_split(lower(concept), '_'), lambda w: length(w) >= 3 AND contains(lower(query), w))) > 0""")
def concept_match(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    c = p.select(F.col("p_type").alias("concept")).distinct()
    q = p.select(F.col("p_name").alias("query")).distinct()
    return graph.match_concepts(q, c).select("query", "concept")


@_query("""WITH d AS (SELECT source, count(DISTINCT lang) AS langs FROM documents WHERE doc_id % 7 <> 0 GROUP BY source),
a AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi, arg_min(source, doc_id) AS lo_source, arg_max(source, doc_id) AS hi_source, arg_max(lang, doc_id) AS hi_lang FROM documents WHERE doc_id % 7 <> 0)
SELECT source AS work_id, 'span traditions' AS fault, langs::VARCHAR AS detail FROM d WHERE langs > 1
UNION ALL SELECT 'ghost', 'not in corpus', 'no-such-text'
UNION ALL SELECT least(lo_source, 'twice'), 'claimed twice', lo::VARCHAR FROM a
UNION ALL SELECT least(hi_source, 'odd'), 'claimed twice', hi::VARCHAR FROM a
UNION ALL SELECT 'odd', 'wrong tradition', hi_lang FROM a
UNION ALL SELECT min(doc_id)::VARCHAR, 'id is a text''s', min(doc_id)::VARCHAR FROM documents WHERE doc_id % 7 = 0""")
def works_faults(spark, sf_dir):
    """Sources as works, and planted works with each kind of fault."""
    all_ = _t(spark, sf_dir, "documents")
    texts = all_.select(F.col("doc_id").cast("string").alias("text_id"), F.col("lang").alias("tradition"), "source")
    d = texts.filter("cast(text_id AS long) % 7 <> 0")
    declared = d.groupBy(F.col("source").alias("id")).agg(F.min("tradition").alias("tradition"), F.array_sort(F.collect_list("text_id")).alias("members"))
    a = all_.filter("doc_id % 7 <> 0").agg(F.min(F.struct("doc_id", "lang")).alias("lo"), F.max(F.struct("doc_id", "lang")).alias("hi"))
    one = lambda name, tradition, member: F.struct(F.lit(name).alias("id"), tradition.alias("tradition"), F.array(member.cast("string")).alias("members"))
    planted = a.select(F.explode(F.array(one("ghost", F.lit("x"), F.lit("no-such-text")), one("twice", F.col("lo.lang"), F.col("lo.doc_id")), one("odd", F.lit("xx"), F.col("hi.doc_id")))).alias("w")).select("w.*")
    like = all_.filter("doc_id % 7 = 0").agg(F.min("doc_id").cast("string").alias("id")).select("id", F.lit("x").alias("tradition"), F.array().cast("array<string>").alias("members"))
    return graph.work_faults(texts, declared.unionByName(planted).unionByName(like))


@_query("""SELECT source AS work_id, true AS grouped, count(*) AS members FROM documents WHERE doc_id % 2 = 0 GROUP BY source
UNION ALL SELECT doc_id::VARCHAR, false, 1 FROM documents WHERE doc_id % 2 = 1""")
def works_grouping(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    texts = d.select(F.col("doc_id").cast("string").alias("text_id"), F.col("source").alias("text_name"), F.col("lang").alias("tradition"))
    declared = d.filter("doc_id % 2 = 0").groupBy(F.col("source").alias("id")).agg(F.min("source").alias("label"), F.min("lang").alias("tradition"), F.collect_list(F.col("doc_id").cast("string")).alias("members"))
    return graph.works(texts, declared).select("work_id", "grouped", F.size("members").cast("long").alias("members"))


SPANS = """WITH RECURSIVE c AS (SELECT source AS work, doc_id AS seq, (length(text) // 4)::BIGINT AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT work, seq, tok, i, 1 AS span, tok AS acc FROM c WHERE i = 1 UNION ALL
SELECT c.work, c.seq, c.tok, c.i, CASE WHEN f.acc + c.tok <= 6000 THEN f.span ELSE f.span + 1 END, CASE WHEN f.acc + c.tok <= 6000 THEN f.acc + c.tok ELSE c.tok END FROM f JOIN c ON c.work = f.work AND c.i = f.i + 1),
p AS (SELECT work, span::INT AS span, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS chunks, sum(tok)::BIGINT AS tokens FROM f GROUP BY work, span)"""


def _plan(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("seq"), token_estimate(F.col("text")).alias("token_count"))
    return spans.span_plan(d)


@_query(SPANS + " SELECT * FROM p")
def span_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@_query(SPANS.replace("AS work, doc_id", "AS work, lang AS member, doc_id").replace("PARTITION BY source ORDER BY", "PARTITION BY source, lang ORDER BY").replace("f AS (SELECT work,", "f AS (SELECT work, member,").replace("SELECT c.work,", "SELECT c.work, c.member,").replace("c.work = f.work AND", "c.work = f.work AND c.member IS NOT DISTINCT FROM f.member AND").replace("p AS (SELECT work, span::INT", "p AS (SELECT work, member, row_number() OVER (PARTITION BY work ORDER BY member, span)::INT").replace("GROUP BY work, span)", "GROUP BY work, member, span)") + " SELECT * FROM p")
def span_plan_members(spark, sf_dir):
    """A span never crosses from one member of a grouped work to the next."""
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("work"), F.col("lang").alias("member"), F.col("doc_id").alias("seq"), token_estimate(F.col("text")).alias("token_count"))
    return spans.span_plan(d, member="member")


@_query(SPANS + """, o AS (SELECT work, span, tokens, row_number() OVER (PARTITION BY work ORDER BY span) AS i FROM p),
g AS (SELECT work, span, tokens, i, 1 AS fold, tokens AS acc FROM o WHERE i = 1 UNION ALL
SELECT o.work, o.span, o.tokens, o.i, CASE WHEN g.acc + o.tokens <= 20000 THEN g.fold ELSE g.fold + 1 END, CASE WHEN g.acc + o.tokens <= 20000 THEN g.acc + o.tokens ELSE o.tokens END FROM g JOIN o ON o.work = g.work AND o.i = g.i + 1)
SELECT work, fold::INT AS fold, min(span) AS first_seq, max(span) AS last_seq, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM g GROUP BY work, fold""")
def span_folds(spark, sf_dir):
    return spans.fold_spans(_plan(spark, sf_dir), 20_000)


@_query(SPANS + " SELECT work, count(*) AS spans, sum(tokens)::BIGINT AS tokens, count(*) = 1 AS degenerate FROM p GROUP BY work")
def span_summary(spark, sf_dir):
    return spans.plan_summary(_plan(spark, sf_dir))


@_query("""WITH t AS (SELECT o_custkey AS id, l_partkey AS concept, max(CASE l_linenumber WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 ELSE 0.4 END::DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT q.query_id, c.concept FROM (SELECT unnest([0, 1, 2]) AS query_id) q JOIN (SELECT DISTINCT concept FROM t) c ON c.concept % 3 = q.query_id),
n AS (SELECT query_id, count(*) AS n_of FROM m GROUP BY query_id)
SELECT m.query_id, t.id::VARCHAR AS id, max(w) AS tier_weight, round(count(DISTINCT t.concept) / any_value(n_of), 6) AS graph_score FROM t JOIN m USING (concept) JOIN n USING (query_id) GROUP BY 1, 2""")
def graph_walk(spark, sf_dir):
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    tier = F.when(F.col("l_linenumber") == 1, "verified").when(F.col("l_linenumber") == 2, "proposed").otherwise("inferred")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").cast("string").alias("source_id"), F.concat(F.lit("concept."), "l_partkey").alias("target_id"), F.lit("EXPRESSES").alias("type"), tier.alias("tier"))
    m = e.select(F.expr("substr(target_id, 9)").alias("concept_id")).distinct().select((F.col("concept_id").cast("int") % 3).alias("query_id"), "concept_id")
    return retrieval.graph_walk(m, e).withColumn("graph_score", F.round("graph_score", 6))


@_query("SELECT p_partkey::VARCHAR AS id, p_name AS label FROM part WHERE (contains(lower(p_name), '1') OR contains(p_partkey::VARCHAR, '1')) AND p_partkey <> 1")
def picker_filter(spark, sf_dir):
    n = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("label"))
    return retrieval.picker(n, "1", "1")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_embedded(spark, sf_dir):
    done = _t(spark, sf_dir, "labels").select("doc_id")
    return models.missing(_t(spark, sf_dir, "documents"), done, "doc_id").select("doc_id")


# --- the store and chunk files, in the shared folder ---


@_query("""SELECT 'customer' AS name, count(*) AS rows, 'restored' AS state FROM customer UNION ALL SELECT 'nation', count(*), 'kept' FROM nation
UNION ALL SELECT 'part', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0), 'replaced' UNION ALL SELECT 'swept', 2, 'versions'""")
def snapshot_restored(spark, sf_dir):
    """Tables are pinned, replaced and published again; what nothing names is swept."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    t = {n: _t(spark, sf_dir, n) for n in ("customer", "nation", "part")}
    s.commit(t)
    s.snapshot(["customer", "nation"], "first", {"balances": ("customer", "c_acctbal > 0")})
    s.commit({"customer": t["customer"].filter("c_acctbal > 0"), "part": t["part"].filter("p_partkey % 2 = 0")})
    s.restore("first")
    gone = sum(map(len, s.sweep().values()))
    states = {"customer": "restored", "nation": "kept", "part": "replaced"}
    found = tables.manifest({n: s.read(n) for n in states}).select(F.col("label").alias("name"), F.col("n").alias("rows"))
    named = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    return found.withColumn("state", named[F.col("name")]).unionByName(spark.range(1).select(F.lit("swept").alias("name"), F.lit(gone).cast("long").alias("rows"), F.lit("versions").alias("state")))


def _chunk_files(spark, sf_dir):
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    c = _t(spark, sf_dir, "documents").select(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("tradition"), F.col("text").alias("body"))
    chunk_writer.write_chunks(c, root, commit=True)
    return root


CHUNKS_SQL = "SELECT source || '.' || lang || '.' || doc_id AS id, source AS tradition, length(text) // 4 AS token_count, md5(text) AS digest FROM documents"


@_query(CHUNKS_SQL)
def chunk_files(spark, sf_dir):
    """Documents written as a TOML file a chunk, and read back."""
    back = read_chunks(spark, _chunk_files(spark, sf_dir))
    return back.select("id", "tradition", F.col("token_count").cast("long").alias("token_count"), F.md5(F.col("body").cast("binary")).alias("digest"))


@_query(CHUNKS_SQL.replace("documents", "documents WHERE doc_id % 10 <> 3") + " UNION ALL SELECT source || '.' || lang || '.' || doc_id, source, (length(text) + 1) // 4, md5(text || '!') FROM documents WHERE doc_id % 10 = 3")
def bodies_refreshed(spark, sf_dir):
    """A tenth of the chunk files changes; the body table rereads those alone."""
    root = _chunk_files(spark, sf_dir)
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    first = chunk_writer.refresh_bodies(spark, s, root)
    c = _t(spark, sf_dir, "documents").filter("doc_id % 10 = 3").select(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("tradition"), F.concat("text", F.lit("!")).alias("body"))
    chunk_writer.write_chunks(c, root, commit=True)
    again = chunk_writer.refresh_bodies(spark, s, root)
    if again["parsed"] + again["kept"] != first["parsed"] or again["gone"]:
        raise ValueError(f"files parsed: {first}, then {again}")
    return s.read("chunk_bodies").select("id", "tradition", F.col("token_count").cast("long").alias("token_count"), F.md5(F.col("body").cast("binary")).alias("digest"))


# --- model output ---


@_query()
def json_repair(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", repaired_json("text").alias("fixed"))


@_query("""WITH p AS (SELECT user_id, list(json_extract_string(props, '$.k')::INT ORDER BY event_id) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY user_id)
SELECT user_id, len(kept)::INT AS n, coalesce(list_sum(kept), 0)::BIGINT AS total FROM (SELECT user_id, CASE WHEN user_id % 4 = 2 THEN k[1:len(k) // 2] WHEN user_id % 4 = 3 THEN [] ELSE k END AS kept FROM p)""")
def json_planted(spark, sf_dir):
    """A user's events as model output: a whole array, one cut off in an element, one with a broken element half-way, one closed but broken."""
    k = F.get_json_object("props", "$.k")
    e = _t(spark, sf_dir, "events").filter(k.isNotNull()).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("e"))
    own = F.transform("e", lambda x: x["props"])
    half = (F.size("e") / 2).cast("int")
    joined = lambda a: F.array_join(a, ", ")
    broken = F.concat(joined(F.slice(own, F.lit(1), half)), F.when(half > 0, ", ").otherwise(""), F.lit("{oops}, "), joined(F.slice(own, half + 1, F.size("e"))))
    kind = F.col("user_id") % 4
    tail = F.when(kind == 0, F.concat(joined(own), F.lit("]\n```"))).when(kind == 1, F.concat(joined(own), F.lit(', {"k": "cut ]'))).when(kind == 2, broken).otherwise(F.concat(broken, F.lit("]")))
    fixed = json_elements(F.concat(F.lit("Here it is:\n["), tail), "struct<k:int>")
    return e.select("user_id", fixed.alias("x")).select("user_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["k"]).alias("total"))


@_query("SELECT conv_id, turn, length(text) > 5000 AND regexp_matches(text, 'Thinking Process|Final list') AND NOT regexp_matches(text, '[\\]}]') AS overflow FROM conversations")
def overflow_canary(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", overflowed(F.col("text")).alias("overflow"))


# --- joins by time, walks ---


@_query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click')
SELECT event_id, user_id, ts, click_id, click_ts FROM (SELECT p.*, click_id, click_ts, row_number() OVER (PARTITION BY event_id ORDER BY click_ts DESC, click_id DESC) AS r FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.click_ts <= p.ts) WHERE r = 1""")
def as_of_click(spark, sf_dir):
    """Each purchase with the user's last click before it."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    out = temporal.as_of(p, c, ["user_id"], "ts", "click_ts", ["click_id"], width=7 * 86400)
    return out.withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("ts", "click_ts")})


@_query("""WITH i AS (SELECT event_id AS purchase_id, user_id, ts AS s, ts + INTERVAL 1 MINUTE * (60 + event_id % 5 * 2000) AS e FROM events WHERE event_type = 'purchase')
SELECT v.event_id, i.purchase_id, v.user_id FROM events v JOIN i ON v.user_id = i.user_id AND v.ts >= i.s AND v.ts < i.e WHERE v.event_type = 'view'""")
def views_after_purchase(spark, sf_dir):
    """Views within one hour to six days of a purchase, as the purchase says."""
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("s"), F.expr("ts + make_dt_interval(0, 0, 60 + event_id % 5 * 2000)").alias("e"))
    v = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return temporal.in_intervals(v, i, ["user_id"], "ts", "s", "e").select("event_id", "purchase_id", "user_id")


@_query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id AS a, (vec_id * 7 + 3) % n AS b FROM embeddings, n UNION SELECT vec_id, (vec_id * vec_id + 1) % n FROM embeddings, n),
w AS (SELECT vec_id AS seed, vec_id AS id, 0 AS depth FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT w.seed, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.id WHERE w.depth < 4)
SELECT seed, id, min(depth)::INT AS depth FROM w GROUP BY seed, id""")
def walk_four_edges(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    n, i = v.count(), F.col("vec_id")
    to = F.explode(F.array((i * 7 + 3) % n, (i * i + 1) % n))
    return graph.walk(v.select(i.alias("source_id"), to.alias("target_id")), v.filter("vec_id % 20 = 0").select(i.alias("id")), 4)


@_query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact, true AS distinct_holds, true AS quantiles_hold FROM events GROUP BY event_type")
def sketches_over_versions(spark, sf_dir):
    """Sketches of each week, merged: distinct users within 6 % and quantiles within 0.04 of their rank."""
    e = _t(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts"))
    shares = [0.1, 0.5, 0.9]
    m = sketches.merged(sketches.sketched(e, ["event_type", "week"], "user_id", "value"), ["event_type"], shares)
    rank = [F.avg((F.col("value") <= F.col("quantiles")[k]).cast("double")) - s for k, s in enumerate(shares)]
    near = F.greatest(*[F.abs(r) for r in rank]) <= 0.04
    off = F.abs(F.first("n_distinct") / F.count_distinct("user_id") - 1) <= 0.06
    both = e.join(m.withColumnRenamed("n", "counted"), "event_type").groupBy("event_type")
    return both.agg(F.first("counted").alias("n"), F.count_distinct("user_id").alias("exact"), off.alias("distinct_holds"), near.alias("quantiles_hold"))


# --- extensions beyond the reference ---


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_daily(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return tumbling(e, "ts", "1 day", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INT AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY user_id, sess""")
def ext_sessions(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return sessions(e, "ts", "6 hours", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


from . import review_queries as _review_queries  # noqa: E402, F401  (registers itself)
