"""Splitters as table functions: a configuration picks the kind of split and the columns that come out.

    SELECT d.doc_id, s.* FROM documents d, LATERAL split_text(d.text, '{"kind": "regex", "pattern": "^(\\\\d+)\\\\."}') s
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

KINDS = {"lines": ["n", "body"], "paragraphs": ["n", "body"], "regex": ["n", "section", "body"], "pages": ["page", "body"]}
OPTIONS = {"lines": set(), "paragraphs": {"target"}, "regex": {"pattern", "label", "group_size"}, "pages": {"mark"}}


def configured(text: str | None) -> dict:
    """A split's configuration, checked: its kind, and only options that the kind has."""
    try:
        c = json.loads(text or "")
    except ValueError as e:
        raise ValueError(f"split_text: the configuration is not JSON: {e}") from None
    if not isinstance(c, dict) or c.get("kind") not in KINDS:
        raise ValueError(f"split_text: kind is one of {', '.join(KINDS)}")
    if odd := set(c) - OPTIONS[c["kind"]] - {"kind"}:
        raise ValueError(f"split_text: {c['kind']} has no option {', '.join(sorted(odd))}")
    if c["kind"] == "regex":
        if "pattern" not in c:
            raise ValueError("split_text: regex needs a pattern")
        re.compile(c["pattern"])
    return c


class SplitText:
    """``split_text(text, configuration)``; the configuration is a constant, so that the columns are known.

    lines: ``n, body``, lines that are not blank.  paragraphs: the same, by blank
    lines, joined up to ``target`` characters.  regex: ``n, section, body``, sections
    that start at a multi-line pattern whose group numbers them, in bundles of
    ``group_size`` labelled ``label``.  pages: ``page, body``, cut at ``mark`` (a form
    feed).  A null text gives no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, config: AnalyzeArgument) -> AnalyzeResult:
        if config.value is None:
            raise ValueError("split_text: the configuration is a constant text")
        schema = StructType()
        for c in KINDS[configured(config.value)["kind"]]:
            schema = schema.add(c, IntegerType() if c in ("n", "page") else StringType())
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.known: dict[str, dict] = {}

    def eval(self, text: str, config: str):
        if text is None:
            return
        if config not in self.known:
            self.known[config] = configured(config)
        c = self.known[config]
        yield from getattr(self, c["kind"])(text, c)

    def lines(self, text, c):
        yield from enumerate((x for y in text.split("\n") if (x := y.strip())), 1)

    def paragraphs(self, text, c):
        n, open_, size = 0, [], 0
        for p in (x for y in re.split(r"\n\s*\n", text) if (x := y.strip())):
            if open_ and size + 2 + len(p) > c.get("target", 0):
                n += 1
                yield n, "\n\n".join(open_)
                open_, size = [], 0
            size += len(p) + 2 * bool(open_)
            open_.append(p)
        if open_:
            yield n + 1, "\n\n".join(open_)

    def regex(self, text, c):
        found = list(re.finditer(c["pattern"], text, re.MULTILINE))
        ends = [m.start() for m in found[1:]] + [len(text)]
        step = max(1, int(c.get("group_size", 1)))
        for n, at in enumerate(range(0, len(found), step), 1):
            first = found[at]
            own = [text[m.end() : e].strip() for m, e in zip(found[at : at + step], ends[at : at + step])]
            number = (first.group(1) if first.re.groups else first.group(0)) or ""
            yield n, c.get("label", "{n}").replace("{n}", number.strip()), "\n\n".join(x for x in own if x)

    def pages(self, text, c):
        yield from enumerate((x.strip() for x in text.split(c.get("mark", "\f"))), 1)


def register(spark: SparkSession) -> None:
    """Make ``split_text`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("split_text", udtf(SplitText))


def split_by(df: DataFrame, key: str = "doc_id", text: str = "text", **config) -> DataFrame:
    """``key`` and the columns of ``split_text`` under this configuration."""
    register(df.sparkSession)
    sql = f"SELECT d.`{key}`, s.* FROM {{d}} d, LATERAL split_text(d.`{text}`, :config) s"
    return df.sparkSession.sql(sql, args={"config": json.dumps(config)}, d=df.select(key, text))
