"""Functions on language-model output: JSON repair, overflow canary, contracts.

Named for what they read; nothing here calls a model.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

OVERFLOW_FLOOR = 5000


#: A string, whole or cut off by the end, or a bracket.
MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[\[\]{}]', re.DOTALL)
SPACE = re.compile(r"[ \t\n\r]*")
DECODE = json.JSONDecoder().raw_decode


def _elements(text: str, at: int) -> list:
    """The elements of an array that begins at ``at``, up to the last object or array before the first that cannot be read."""
    out, whole = [], 0
    i = SPACE.match(text, at + 1).end()
    while i < len(text):
        try:
            x, i = DECODE(text, i)
        except ValueError:
            break
        out.append(x)
        if isinstance(x, (dict, list)):
            whole = len(out)
        i = SPACE.match(text, i).end()
        if text[i : i + 1] != ",":
            break
        i = SPACE.match(text, i + 1).end()
    return out[:whole]


def repair_json(text: str | None):
    """The first JSON object or array in a text; of one that is never closed, if it is an array, the elements before the
    first that is broken or cut off; else [].  Takes time in proportion to the text."""
    text = text or ""
    at = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if at < 0:
        return []
    depth = 0
    try:
        for m in MARKS.finditer(text, at):
            c = m.group()
            if c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
                if depth == 0:
                    return json.loads(text[at : m.end()])
        return _elements(text, at) if text[at] == "[" else []
    except (ValueError, RecursionError):
        return []


def _dumped(x: str | None) -> str:
    try:
        return json.dumps(repair_json(x))
    except RecursionError:  # read, but nested too deep to write
        return "[]"


@F.pandas_udf(StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    return s.map(_dumped)


def json_elements(c: Column, schema: str) -> Column:
    """Repaired output as an array of structs; an object counts as one element."""
    fixed = repaired_json(c)
    return F.from_json(F.when(fixed.startswith("{"), F.concat(F.lit("["), fixed, F.lit("]"))).otherwise(fixed), f"array<{schema}>")


def overflowed(c: Column) -> Column:
    """Long reasoning text that never closed a bracket."""
    return F.coalesce((F.char_length(c) > OVERFLOW_FLOOR) & c.rlike("Thinking Process|Final list") & ~c.rlike(r"[\]}]"), F.lit(False))


def has_keys(c: Column, required: list[str]) -> Column:
    """A single JSON object with all required keys."""
    keys = F.json_object_keys(F.get_json_object(c, "$"))
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0, F.lit(False)) if required else keys.isNotNull()
