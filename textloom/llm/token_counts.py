"""Operator 1: exact token counts at every prefix, by dynamic programming.

Byte-level BPE never merges across the pieces that its splitting pattern cuts,
so the count at a prefix of a text is the count of the finished pieces before
it plus the count of the piece that the prefix cuts.  Inside a piece, dynamic
programming over its byte prefixes gives both: the last token of the encoding
of ``w[:i]`` is the one token ``t`` that ends there and may follow the last
token of ``w[:i - len(t)]`` (their concatenation encodes to just these two), so
``count[i] = count[i - len(t)] + 1``.

Pieces recur, so each worker keeps the finished tables of recent words.  What is
stored for a text is how the count changes at each character (mostly 0 or 1),
compressed; its sums are the counts of all prefixes.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import compress
from operator import sub

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from .common import Recent

#: Characters whose classes and spacing no Unicode version changes; a text with
#: any other is cut by the tokenizer library itself.
PLAIN = re.compile(r"[^\n\r\t -~¡-įı-ɏ]")
#: Spaces in any other arrangement than one between words or one line end.
SPACED = re.compile(r"[\t\r]|[ \n][ \n]|^[ \n]|[ \n]$")
#: The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS_KEPT = 400_000
PAIRS_KEPT = 1_000_000
SLICE = 256  # texts that are Python strings at a time


class PrefixCounter:
    """Prefix counts for one byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.from_alphabet = _alphabet()
        to_bytes = lambda s: s.translate(self.from_alphabet)
        self.token = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[to_bytes(a), to_bytes(b)] = r
        self.pairs = Recent(self._may_follow, PAIRS_KEPT)
        self.pieces = Recent(self._prefixes, WORDS_KEPT)
        self.words = Recent(self._word, WORDS_KEPT)
        self.steps = Recent(self._steps, WORDS_KEPT)
        self.ending = ahocorasick.Automaton()
        for t in self.token:
            if self._merge(t) == [t]:
                self.ending.add_word(t, t)
        self.ending.make_automaton()

    def _merge(self, s: str) -> list[str]:
        """The plain merge loop; only for the short strings of one or two tokens."""
        parts = list(s)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, pair: tuple[str, str]) -> bool:
        return self._merge(pair[0] + pair[1]) == list(pair)

    def _prefixes(self, s: str) -> tuple[int, ...]:
        """Token counts of s[:1], s[:2], ... (s: bytes as Latin-1)."""
        last, count, pairs = [""] + [None] * len(s), [0] * (len(s) + 1), self.pairs
        for end, t in self.ending.iter(s):  # of the tokens that end at a place, the longest first
            i = end + 1
            if last[i] is None:
                j = i - len(t)
                if j == 0 or pairs[last[j], t]:
                    last[i] = t
                    count[i] = count[j] + 1
        return tuple(count[1:])

    def _steps(self, state: tuple[str, int, str]) -> tuple[bytes, str, int]:
        """How the count changes at each character of a piece, the white space that the text
        then ends in, and the tokens of the latter.

        ``state``: the white space before the piece, its tokens, and the piece.  The white
        space that a prefix ends in is one piece, whatever the text goes on with.
        """
        run, tokens, x = state
        counts = self.pieces[x.encode().decode("latin-1")]
        white = len(x) - len(x.lstrip(WHITE))
        whole = self.pieces[(run + x[:white]).encode().decode("latin-1")] if white else ()
        ends = np.cumsum([len(c.encode()) for c in x])
        out = counts if len(counts) == len(x) else [counts[e - 1] for e in ends]
        if x[0] == "'" and x[1:2].isalpha():  # a contraction that is cut short is split in another way
            out = [self._plain(x[: i + 1]) for i in range(len(x))]
        last = 0  # the count at the character before, less that of the finished pieces
        if run:
            before = len(run.encode())
            last = (whole or self.pieces[run.encode().decode("latin-1")])[before - 1] - tokens
            out = [whole[before + e - 1] - tokens for e in ends[:white]] + list(out[white:])
        steps = np.diff(np.array(out, np.int64), prepend=last).astype(np.int32).tobytes()
        return (steps, run + x, tokens + counts[-1]) if white == len(x) else (steps, "", 0)

    def _plain(self, text: str) -> int:
        return sum(self.pieces[x.encode().decode("latin-1")][-1] for x in self.cut.findall(text))

    def _word(self, word: str) -> bytes:
        """The changes of the count along a word with the space before it, if any."""
        out: list[int] = []
        for x in self.cut.findall(word):
            if x.isascii():
                counts = self.pieces[x]
            else:
                raw = x.encode()
                counts = self.pieces[raw.decode("latin-1")]
                starts = [c & 0xC0 != 0x80 for c in raw[1:]]  # the last byte of a character is before these
                counts = [*compress(counts, starts), counts[-1]]
            if x[0] == "'" and x[1:2].isalpha():
                counts = [self._plain(x[: i + 1]) for i in range(len(x))]
            out.append(counts[0])
            out += map(sub, counts[1:], counts)
        return array("i", out).tobytes()

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if PLAIN.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut.findall(text)

    def _parts(self, text: str) -> list[str]:
        return [text] if self.special_cut is None else self.special_cut.split(text)

    def changes(self, text: str) -> np.ndarray:
        """How the token count changes at each character; sums give the count of each prefix
        as if it were the whole text."""
        out: list[bytes] = []
        parts = self._parts(text)
        for k, part in enumerate(parts):
            if k % 2:  # a prefix that ends inside a special string is ordinary text
                own = self._along(parts[k - 1])
                done = int(own.sum())
                inside = [int(self._along(parts[k - 1] + part[:i]).sum()) - done for i in range(1, len(part))]
                out.append(np.diff(np.array([*inside, 1], np.int64), prepend=0).astype(np.int32).tobytes())
            elif part:
                out.append(self._along(part).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def _along(self, part: str) -> np.ndarray:
        out: list[bytes] = []
        if SPACED.search(part) or PLAIN.search(part):
            run, tokens, steps = "", 0, self.steps
            for x in self._cut(part):
                # long white space before a piece is not a key to keep
                own, run, tokens = steps[run, tokens, x] if len(run) + len(x) < 128 else self._steps((run, tokens, x))
                out.append(own)
        elif part:
            words = self.words
            for k, line in enumerate(part.split("\n")):
                if k:
                    out.append(words["\n"])
                first, *rest = line.split(" ")
                out.append(words[first])
                out += [words[" " + x] for x in rest]
        return np.frombuffer(b"".join(out), np.int32)

    def count(self, text: str) -> int:
        """Tokens of a whole text: the last of its prefix counts."""
        return int(self.changes(text).sum())

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:1], text[:2], ..., each as if that prefix were the whole text."""
        return np.cumsum(self.changes(text)).tolist()


def _alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE, back to bytes as Latin-1."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {256 + i: chr(b) for i, b in enumerate(other)}


_counters: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """This worker's counter for a vocabulary file, loaded once."""
    if name not in _counters:
        _counters[name] = PrefixCounter(public_tokenizers.path(name))
    return _counters[name]


#: Comes before changes of 32 bits; changes of 16 begin with the compressor's own first byte.
WIDE = b"W"


def _packed(changes: np.ndarray, compress) -> bytes:
    """Changes in 16 bits each, or in 32 where one is too large."""
    if len(changes) and max(int(changes.max()), -int(changes.min())) >= 1 << 15:
        return WIDE + compress(changes.tobytes())
    return compress(changes.astype(np.int16).tobytes())


def _changes(packed: bytes) -> np.ndarray:
    if packed[:1] == WIDE:
        return np.frombuffer(zstandard.decompress(packed[1:]), np.int32)
    return np.frombuffer(zstandard.decompress(packed), np.int16)


def _longest(changes: np.ndarray, budget: int) -> int:
    """The most characters whose count fits the budget (counts can fall again when a merge completes)."""
    fits = np.flatnonzero(np.cumsum(changes, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", budget: int = 1024) -> DataFrame:
    """Exact token count of every text and of every prefix of it.

    Returns one row per input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (n_tokens > budget), ``fit_chars`` (the most characters that
    fit the budget) and ``prefix_changes``: the changes of the count at each
    character, in 16 bits or, for a text with a larger one, 32, compressed (see
    ``prefix_counts``).  A null text counts as empty
    (0 tokens, no changes); a null doc_id stays null; repeated rows each give a
    row; columns other than doc_id and text are neither read nor kept; an empty
    table gives none.  Whole texts: memory is a few bytes a character of the
    longest one, and long pieces are not remembered.  One pass, no shuffle.
    """

    def count(batches):
        c, pack = counter(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            size, n, fit, packed = [], [], [], []
            for at in range(0, b.num_rows, SLICE):
                for x in b.column(1).slice(at, SLICE).to_pylist():
                    own = c.changes(x or "")
                    size.append(len((x or "").encode()))
                    n.append(int(own.sum()))
                    fit.append(_longest(own, budget) if n[-1] > budget else len(x or ""))
                    packed.append(_packed(own, pack))
            cols = [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > budget for x in n], pa.bool_()), pa.array(fit, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_changes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_changes binary")


def _answered(counted: DataFrame, names: list[str], answer, name: str, kind: str, type_: pa.DataType) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [answer(_changes(x)) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(got, type_)], names=[*names, name])

    schema = ", ".join(f"{c} {counted.schema[c].dataType.simpleString()}" for c in names)
    return counted.select(*names, "prefix_changes").mapInArrow(run, f"{schema}, {name} {kind}")


def prefix_counts(counted: DataFrame) -> DataFrame:
    """``doc_id, prefix_counts``: element i is the token count of the first i + 1 characters."""
    return _answered(counted, ["doc_id"], lambda x: np.cumsum(x, dtype=np.int32), "prefix_counts", "array<int>", pa.list_(pa.int32()))


def truncation_points(counted: DataFrame, budget: int) -> DataFrame:
    """From stored changes: the most characters of each text that fit the budget.

    0 where not even one character fits or the text is empty.
    """
    return _answered(counted, ["doc_id", "n_tokens"], lambda x: _longest(x, budget), "n_chars_kept", "int", pa.int32())


def window_tokens(counted: DataFrame, chars: int) -> DataFrame:
    """From stored changes: the token count of the first ``chars`` characters."""
    return _answered(counted, ["doc_id"], lambda x: int(x[: max(0, chars)].sum(dtype=np.int64)), "n_tokens", "long", pa.int64())
