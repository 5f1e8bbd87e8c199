import pytest
from pyspark.sql import functions as F

from textloom.functions import splitters
from textloom.operators import sketches
from textloom.sources.store import Store


def split(spark, texts, **config):
    return splitters.split_by(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", **config).orderBy(*range(1, 3))


def test_from_plain_sql(spark):
    splitters.register(spark)
    rows = spark.sql("""SELECT t.id, s.page, s.body FROM VALUES (1, 'a|b'), (2, NULL) AS t(id, x), LATERAL split_text(t.x, '{"kind": "pages", "mark": "|"}') s ORDER BY page""").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "a"), (1, 2, "b")]


def test_the_configuration_picks_the_columns(spark):
    texts = ["1. one\nmore\n2. two\n3.\n", None, "", "no number"]
    got = split(spark, texts, kind="regex", pattern=r"^(\d+)\.", label="S{n}", group_size=2)
    assert got.columns == ["id", "n", "section", "body"] and [tuple(r) for r in got.collect()] == [(0, 1, "S1", "one\nmore\n\ntwo"), (0, 2, "S3", "")]
    got = split(spark, [" a \n\n\tb", None, "\n"], kind="lines")
    assert got.columns == ["id", "n", "body"] and [tuple(r) for r in got.collect()] == [(0, 1, "a"), (0, 2, "b")]
    got = split(spark, ["aa\n\nbb\n \ncccc"], kind="paragraphs", target=6)
    assert [tuple(r) for r in got.collect()] == [(0, 1, "aa\n\nbb"), (0, 2, "cccc")]
    got = split(spark, ["one\ftwo\f", ""], kind="pages")
    assert got.columns == ["id", "page", "body"] and [tuple(r) for r in got.collect()] == [(0, 1, "one"), (0, 2, "two"), (0, 3, ""), (1, 1, "")]


@pytest.mark.parametrize(("config", "said"), [({"kind": "chapters"}, "kind is one of"), ({"kind": "lines", "target": 3}, "has no option target"), ({"kind": "regex"}, "needs a pattern")])
def test_a_wrong_configuration_is_refused_before_the_query_runs(spark, config, said):
    with pytest.raises(Exception, match=said):
        split(spark, ["x"], **config).schema


def test_sketches_are_merged_over_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    rows = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 1000).alias("v"))
    sketches.append_version(s, "sk", rows(0, 30_000), "one", ["g"], "id", "v")
    sketches.append_version(s, "sk", rows(20_000, 60_000), "two", ["g"], "id", "v")
    sketches.append_version(s, "sk", rows(20_000, 60_000), "two", ["g"], "id", "v")  # again: replaced
    assert s.read("sk").count() == 6
    for r in sketches.merged(s.read("sk"), ["g"], [0.25, 0.5]).collect():
        assert r.n == 10_000 + 13_333 + (r.g == 2) or r.n in (23_333, 23_334)
        assert abs(r.n_distinct / 20_000 - 1) < 0.06  # the versions overlap
        assert abs(r.quantiles[0] - 250) < 40 and abs(r.quantiles[1] - 500) < 40
    whole = sketches.merged(s.read("sk"), [], [0.5]).first()
    assert abs(whole.n_distinct / 60_000 - 1) < 0.06 and whole.n == 70_000
