"""Cleaning, readability, chunking and model-output operators, by example."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import html, llm_output, models, text
from textloom.operators import chunking, cleaning


def one(spark, value, column, *more):
    df = spark.createDataFrame([(value,)], "body string")
    return df.select(column(F.col("body"), *more).alias("x")).first().x


def numeral(n):
    """A small Roman numeral, to nineteen."""
    return "x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]


def planted(r):
    """A body with residue between its words and paragraphs, and the body without."""
    word = lambda: "".join(r.choice("abdegkmnorstu") for _ in range(r.randrange(2, 8)))
    dirty, plain, last = [], [], ""
    for _ in range(r.randrange(1, 5)):
        a = b = word()
        for _ in range(r.randrange(6)):
            n, w = r.randrange(1, 20), word()
            mark, left = r.choice([(" ", " "), (f" {{p. {numeral(n)}}} ", " "), (f" {{p.\n\n{n}}} ", " "), (f" [Pg {n * 31}] ", " "), (f" [{n}] ", " "), (f"[{n * 50}] ", " "), (f" [{w}] ", f" [{w}] "), (f" [{2000 + n}] ", f" [{2000 + n}] ")])
            a, b = a + mark + w, b + left + w
        dirty.append(a)
        plain.append(b)
        last = a
        if r.random() < 0.4:
            dirty.append(r.choice([f"Next: {word()} {word()}", f"p. {r.randrange(900)}", f"Errata {word()}"]))
    if r.random() < 0.3:
        dirty.insert(0, f"Sacred-texts {word()}")
    a, b = "\n\n".join(dirty), "\n\n".join(plain)
    if r.random() < 0.3 and dirty[-1] is last:
        a += r.choice([" {p.", f" {{p. {numeral(r.randrange(1, 20))}}}"])
        b += "" if a.endswith("{p.") else " "
    if r.random() < 0.2 and not a.startswith("Sacred"):
        a = f"{numeral(r.randrange(1, 20))}}} {a}"
    return a, b


def test_cleaning_of_planted_residue(spark):
    r = random.Random(11)
    pairs = [planted(r) for _ in range(300)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "id int, body string")
    got = {x.id: x.c for x in df.select("id", cleaning.clean_body(F.col("body")).alias("c")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(pairs)}


@pytest.mark.parametrize("body", [None, "", "One line.", "It goes on: xiv} was carved there.", "p. 7 is torn, and p. 8 is lost", "Two lines.\n\nSacred-texts is not a header here."])
def test_what_is_no_residue_stays(spark, body):
    assert one(spark, body, cleaning.clean_body) == body


def test_site_lines(spark):
    for body, want in {"Ends. End of the Project Gutenberg EBook\nlegal": "Ends. ", "Kept. scanned at some-site.com, in May. Kept too.": "Kept.  Kept too.", "Kept. J. B. Hare, redactor of it. Kept too.": "Kept.  Kept too."}.items():
        assert one(spark, body, cleaning.clean_body) == want


def test_footnotes_can_stay(spark):
    got = one(spark, "ratios [3] and [44] hold\n\np. 305", cleaning.clean_body, False)
    assert got == "ratios [3] and [44] hold"


def test_shrink_guard(spark):
    df = spark.createDataFrame([("a", "x [1]" * 3), ("b", "some long text that stays [1]"), ("c", "x [1]" * 3)], "id string, body string")
    rows = {r.id: r for r in cleaning.clean_guarded(df, allowed=["c"]).collect()}
    assert rows["a"].refused and rows["a"].cleaned == rows["a"].body
    assert not rows["b"].refused and rows["b"].cleaned.endswith("stays")
    assert not rows["c"].refused and rows["c"].cleaned == "xxx"


def signals(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    return cleaning.audit(df).first()


WRAPPED = "\n".join(["the line was broken in the", "middle of what the author had", "meant to say, and again", "and again until nobody could", "read it with any ease at all"])


def test_readability(spark):
    clean = signals(spark, "A first sentence that reads well. A second follows it.\n\nAnother paragraph, as clean as the first one was.")
    assert clean.score < 5 and clean.hard_wrap == clean.page_marks == 0
    wrapped = signals(spark, WRAPPED)
    assert wrapped.hard_wrap > 0.5 and wrapped.score > 15
    hyphens = signals(spark, "ever-\nlasting glory and splen-\ndour")
    assert hyphens.hyphen_break > 0 and hyphens.hard_wrap == 0
    caps = "THE BOOK OF THE DEAD\nand so it was told"
    assert signals(spark, caps).caps_runs > 0
    assert signals(spark, caps).caps_runs == signals(spark, caps.replace("\n", " ")).caps_runs
    assert signals(spark, "x [p. 143] y\n27\nz [Pg 12]").page_marks > 0
    assert signals(spark, "a [1] b {2} c ^3").footnotes > 0
    assert signals(spark, "a [...] b [sic] c (?)").brackets > 0
    assert signals(spark, "Chapter I ........ 12").dot_leaders > 0
    for b in ("", None, WRAPPED * 9, "[1]" * 500):
        s = signals(spark, b)
        assert all(0 <= s[k] <= 1 for k in cleaning.WEIGHTS) and 0 <= s.score <= 100
    assert signals(spark, "").score == 0


def test_group_paragraphs_keeps_text_and_budget(spark):
    paras = ["p" * (i * 37 % 400 + 1) for i in range(60)]
    df = spark.createDataFrame([(1, "\n\n".join(paras)), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.group_paragraphs(df, target=4, max_tokens=150).orderBy("doc_id", "n").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert "\n\n".join(r.body for r in own) == "\n\n".join(paras)
    assert all(r.token_count <= 150 or "\n\n" not in r.body for r in own)
    assert all(len(r.body.split("\n\n")) <= 4 for r in own)
    assert [(r.doc_id, r.section, r.body) for r in rows if r.doc_id > 1] == [(2, "Section 1", ""), (3, "Section 1", "")]
    single = chunking.group_paragraphs(df.filter("doc_id = 1"), target=1)
    assert single.count() == 60


def test_headings_and_bundles(spark):
    t = "before\nChapter 1\none\ntwo\nChapter 2\nChapter 3\nthree"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = [(r.n, r.section, r.body) for r in chunking.split_headings(df, r"Chapter \d+").orderBy("n").collect()]
    assert got == [(1, "", "before"), (2, "Chapter 1", "one\ntwo"), (3, "Chapter 2", ""), (4, "Chapter 3", "three")]
    two = [(r.n, r.section, r.body) for r in chunking.split_headings(df, r"Chapter \d+", group_size=2, label="{n}: {heading}").orderBy("n").collect()]
    assert two == [(1, "1: ", "before\n\none\ntwo"), (2, "2: Chapter 2", "three")]


def test_regex_pages_and_subsplit(spark):
    df = spark.createDataFrame([(1, "lost\n[12] first\n[13] second"), (2, "none")], "doc_id long, text string")
    got = [(r.doc_id, r.n, r.section, r.body) for r in chunking.split_regex(df, r"^\[(\d+)\]", label="Saying {n}").collect()]
    assert got == [(1, 1, "Saying 12", "first"), (1, 2, "Saying 13", "second")]
    pages = spark.createDataFrame([("a", 1, "title"), ("a", 2, "START here no. 7"), ("a", 3, "junk"), ("a", 4, "text"), ("a", 5, "NOTES"), ("b", 1, "x")], "doc_id string, page int, text string")
    kept = chunking.drop_pages(pages, "START", "NOTES", ["junk"])
    assert sorted((r.doc_id, r.page) for r in kept.collect()) == [("a", 2), ("a", 4), ("b", 1)]
    with pytest.raises(chunking.MarkerMissing):
        chunking.drop_pages(pages, "START", require=True)
    named = chunking.pages_as_chunks(kept, "No. {n}", r"no\. (\d+)", "Page {n}")
    assert sorted(r.section for r in named.collect()) == ["No. 7", "Page 1", "Page 4"]
    long = spark.createDataFrame([(1, 1, "Ch", "aaaa. " * 30), (1, 2, "Ok", "b")], "doc_id long, n int, section string, body string")
    parts = chunking.subsplit(long, 10).orderBy("n", "part").collect()
    assert parts[0].section == "Cha" and parts[-1].section == "Ok" and all(r.token_count <= 10 for r in parts)


def test_chunk_config_aliases():
    a = chunking.ChunkConfig.from_dict({"chunking": {"strategy": "paragraph-group", "group_size": 5}})
    assert (a.strategy, a.paragraphs_per_chunk, a.max_tokens) == ("paragraph", 5, 800)
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.ChunkConfig.from_dict({"chunking": {"strategy": "no"}})


def test_enumeration_faults(spark):
    rows = [("yoga-1", f"{i:03}", f"Sutra {i}") for i in range(1, 6)] + [("yoga-2", "001", "Sutra 9")]
    df = spark.createDataFrame(rows, "text_id string, seq string, section string")
    got = {(r.text_id, r.fault) for r in chunking.enumeration_faults(df, {"yoga-1": 5, "yoga-2": 2, "yoga-3": 1}, "Sutra {n}").collect()}
    assert got == {("yoga-2", "count"), ("yoga-2", "label"), ("yoga-3", "count")}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"a": [1, 2]}', {"a": [1, 2]}),
        ('Here it is:\n```json\n[{"a": 1}]\n```', [{"a": 1}]),
        ('[{"a": 1}, {"b": 2}, {"c":', [{"a": 1}, {"b": 2}]),
        ('{"a": 1, "b"', []),
        ("", []),
        (None, []),
        ('[{"t": "say \\"hi\\" }]"}]', [{"t": 'say "hi" }]'}]),
        ("no json", []),
    ],
)
def test_json_repair(spark, body, want):
    assert json.loads(one(spark, body, llm_output.repaired_json)) == want


def test_overflow_keys_and_templates(spark):
    mark = "Thinking Process: "
    cases = {"short": False, mark + "x" * 6000: True, mark + "x" * 6000 + "]": False, "x" * 6001: False, "x" * 6000 + "Final list": True}
    assert all(one(spark, k, llm_output.overflowed) == v for k, v in cases.items())
    assert one(spark, '{"a": 1, "b": null}', llm_output.has_keys, ["a", "b"]) and not one(spark, '{"a": 1}', llm_output.has_keys, ["b"])
    assert one(spark, "there", lambda c: text.render("Hi {{who}}, {who}", {"who": c})) == "Hi there, {who}"
    assert one(spark, "there", lambda c: text.render("Hi {who}", {"who": c}, double=False)) == "Hi there"
    assert one(spark, "x", lambda c: text.canonical_params(F.create_map(F.lit("b"), c, F.lit("a"), F.lit("")))) == '{"b":"x"}'
    assert [one(spark, str(i), lambda c: text.letter_suffix(c.cast("int"))) for i in (0, 25, 26, 53)] == ["a", "z", "aa", "bb"]
    assert one(spark, "part-10b2", text.natural_key) > one(spark, "part-9b3", text.natural_key)


def test_html():
    nested = "<body><nav>menu</nav><main>A<article>B</article></main><article>C</article><script>'</p>'</script></body>"
    assert html.main_text(nested).split() == ["A", "B", "C"]
    page = "<body><p>Text<font size='1'>1</font> here<sup>2</sup><a name='x'></a>.</p><h3>Footnotes</h3><p>1. gone</p></body>"
    assert html.main_text(page) == "Text here." and html.main_text(None) == ""


def test_models(spark):
    embed = models.hashed_embedder(8)
    calls = []
    counted = lambda x: calls.append(len(x)) or embed(x)
    assert len(models.embed_batch(counted, ["a"] * 8, 8)) == 8 and calls == [8]
    assert models.embed_batch(counted, []) == [] and calls == [8]
    with pytest.raises(ValueError, match="vectors"):
        models.embed_batch(lambda x: embed(x)[:-1], ["a", "b"])
    df = spark.createDataFrame([(str(i), f"text {i}") for i in range(70)], "id string, body string")
    out = models.embed_column(df, embed, "stub/hash", 8).collect()
    assert len(out) == 70 and all(len(r.vector) == r.dim == 8 for r in out)
    assert models.missing(df, df.limit(0)).count() == 70
    assert models.bytes_to_vector(models.vector_to_bytes([1.0, -2.5])) == [1.0, -2.5]
    pairs = spark.createDataFrame([("q", "body"), ("q", None)], "query string, body string")
    assert models.rerank(pairs, lambda p: [-4.0 if not b else 1.0 for _, b in p]).count() == 1
    p = models.Providers()
    p.register("llamacpp", lambda *a: a)
    assert p.call("llamacpp", "m", "s", "p", max_tokens=5)[3] == 5
    with pytest.raises(TypeError):
        p.call("llamacpp", "m", "s", "p")
    with pytest.raises(ValueError, match="unknown"):
        p.call("no", "m", "s", "p", max_tokens=5)
    assert models.ProviderConfig.from_toml('[model]\nmodel = "x"') == models.ProviderConfig("x", "llamacpp", 2048, 1200)
    with pytest.raises(ValueError, match="no model"):
        models.ProviderConfig.from_toml("[model]\nmodel = ''")


def test_odd_html_and_json_do_not_crash(spark):
    n = 100_000
    for page in ("<p>a" * n, "<ul>" + "<li>b" * n, "<div>" * n + "c", "</em>" * n + "d" + "<b>" * n, "<span>" * n + "</i>" * n):
        assert html.main_text(page).replace("\n", "")[:1] in ("a", "b", "c", "d", "")
    assert html.main_text("<p>one<p>two<ul><li>x<li>y</ul>") == "one\ntwo\nx\ny"
    assert html.main_text("<body><h2>Footnotes</h2><p>kept</p><font size='-2'>small</font></body>") == "Footnotes\nkept\nsmall"
    assert llm_output.repair_json("[" * n) == [] and llm_output.repair_json("[" * n + "]" * n) == []
    assert llm_output._dumped('[{"a": 1}, {"b"') == '[{"a": 1}]'


def test_html_and_json_in_linear_time():
    n = 100_000
    began = time.perf_counter()
    page = html.main_text("<main>" + "".join(f"<a name=x{i}>w{i} <b>" for i in range(n)))
    assert len(page.split()) == n
    assert html.main_text("<main>" + "<h3>t<a>" * 20_000).split() == ["t"] * 20_000
    half = ",".join(['{"k":1}'] * (n // 2))
    assert len(llm_output.repair_json(f"[{half},{{oops}},{half}")) == n // 2
    assert len(llm_output.repair_json(f"[{half},{half},{{")) == n
    assert time.perf_counter() - began < 60  # quadratic, it takes many minutes


@pytest.mark.parametrize("name", ["readability", "worst_n_per_source"])
def test_readability_of_odd_texts_is_that_of_its_sql(spark, tmp_path, name):
    """Missing texts, vertical tabs, line ends and letters of other scripts, ties at the seventh place."""
    import duckdb

    from textloom.plans import catalogue

    texts = [None, "", "ABCD\x0bEFG", "éABCD EFG", "ABCD EFGé", "ABCD EF́", "x\r12\ry", "x 12 y", "\x0b12", "12\r\n", "12\x0c\n7\n"]
    texts += ["a-\nb" * k + "Z\n" * (b - k) for b in (640, 3200) for k in range(1, 8)] + ["...." + "y" * (n - 4) for n in (64_000, 128_000)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = [tuple(r[c] for c in cols) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.fetchall())


def test_pages_are_python_objects_one_at_a_time():
    import pyarrow as pa

    assert html.html_main_text.evalType == html.F.arrow_udf(lambda s: s, "string").evalType
    assert html.html_main_text.func(pa.array(["<main><p>a</p></main>", None])).to_pylist() == ["a", ""]
