"""Column functions on text: trimming, token estimates, slugs, natural order, elision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.btrim(c, F.lit(WHITE))


def token_estimate(c: Column) -> Column:
    """A token for every four characters; null counts as none."""
    return F.coalesce(F.floor(F.char_length(c) / 4), F.lit(0)).cast("long")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def natural_key(c: Column) -> Column:
    """A string that sorts digit runs as numbers: each padded with zeros."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def elide(c: Column, budget: int) -> Column:
    """Head and tail of a text longer than the budget, with a mark between."""
    half = budget // 2
    return F.when(F.char_length(c) > budget, F.concat(F.substring(c, 1, half), F.lit("…"), F.right(c, F.lit(half)))).otherwise(c)


def letter_suffix(i: Column) -> Column:
    """0, 1, ... as a, ..., z, aa, ab, ..."""
    letter = lambda k: F.char(F.lit(97) + k.cast("int"))
    return F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


def replace_all(c: Column, patterns: list[str]) -> Column:
    """Ordered removal of patterns, '.' matching line ends too."""
    return reduce(lambda x, p: F.regexp_replace(x, f"(?s){p}", ""), patterns, c)


def canonical_params(m: Column) -> Column:
    """A filter map as JSON: empty and null values dropped, keys sorted."""
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def render(template: str, values: dict[str, Column], double: bool = True) -> Column:
    """``{{name}}`` (or ``{name}``) of a template replaced by columns."""
    mark = (lambda k: "{{" + k + "}}") if double else (lambda k: "{" + k + "}")
    return reduce(lambda x, kv: F.replace(x, F.lit(mark(kv[0])), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(template))
