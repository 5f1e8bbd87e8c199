import hashlib
import random
import re

from textloom.llm import fill_in_middle as fim


def plain_way(doc_id, text, rate=100, spm_rate=50):
    """The contract, by regular expression and lists."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "a\r\nb\r", "<P>", "x<S>y\nz", "a\n<M", "<P\n<S\n<M\n", ">\n<", "ü\n漢字\n😀 a\n", "a" * 300_000, "ab\n" * 100_000, "\n" * 70_000, "é" * 50_000 + "\n" + "漢" * 50_000]
    out += ["".join(r.choice("ab \n\t<PSM>é漢😀") for _ in range(r.randrange(60))) for _ in range(400)]
    return out


def test_equals_the_plain_way(spark):
    rows = list(enumerate(texts())) + [(None, "no\nid\n"), (5, "again\n5\n"), (5, "again\n5\n"), (-12, "below\nzero\nthree\n")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    made = fim.fill_in_middle(df)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    order = lambda x: [str(v) for v in x]
    assert sorted(map(tuple, made.collect()), key=order) == sorted(((i, *plain_way(i, t)) for i, t in rows), key=order)
    back = fim.restored(made).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=order) == sorted(((i, t or "") for i, t in rows), key=order)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((sha(plain_way(i, t)[-1]), sha(t or "")) for i, t in rows))
    assert sorted((r.output_sha256, r.restored_sha256) for r in fim.digests(made).collect()) == want


def test_rates(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in fim.fill_in_middle(df, rate=40, spm_rate=10).collect()}
    assert got == {i: plain_way(i, "a\nb\nc\n", 40, 10) for i in range(300)}
    assert 80 < sum(v[1] != "plain" for v in got.values()) < 160


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.fill_in_middle(none)).collect() == []


def test_units_and_places():
    r = random.Random(5)
    split = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A[ \n]*[^ \n]+[ \n]*|[^ \n]+[ \n]*|\A[ \n]+\Z", "char": r"(?s)."}
    for _ in range(500):
        text = "".join(r.choice("ab \né漢") for _ in range(r.randrange(1, 40)))
        raw = text.encode()
        for unit, pattern in split.items():
            starts = fim.unit_starts(raw, unit)
            want = [len(text[: m.start()].encode()) for m in re.finditer(pattern, text)]
            assert fim.places(starts, len(raw), list(range(1, starts.bit_count() + 1))) == want, (text, unit)


def test_other_sentinels_that_overlap(spark):
    df = spark.createDataFrame([(i, "xa\nab\naa b\n") for i in range(60)], "doc_id long, text string")
    made = fim.fill_in_middle(df, sentinels=("aaa", "aab", "baa"))
    assert {r.text for r in fim.restored(made, ("aaa", "aab", "baa")).collect()} == {"xa\nab\naa b\n"}


def test_query_over_whole_tables(spark, sf_dir):
    from textloom.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d.doc_id: (*plain_way(d.doc_id, d.text)[:-1], sha(plain_way(d.doc_id, d.text)[-1]), sha(d.text or "")) for d in docs}
    got = queries()["op12_fill_in_middle"](spark, sf_dir).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)
