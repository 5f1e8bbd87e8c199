"""Operator 8: language identification by a linear-chain conditional random field.

Words are labelled with languages.  A word's features are its affixes, its
character n-grams and itself (the lexicon); the transitions between languages
are learned too, on sequences in which the sampled rows' passages follow one
another as in code-switched text.  Forward-backward gives every word's
marginals; a document's language is the one with the largest mean marginal.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
#: At most this many labelled rows for each language, those with the smallest hash, are learned from, whole.
SAMPLE = 400
#: Languages that are learned, the most frequent ones, and the bytes of text that they are learned from.
LABELS = 64
SAMPLE_BYTES = 64 << 20
STEP = 64  # words in a segment of the chain
WORDS_KEPT = 150_000
SLICE = 1024  # texts that are Python strings at a time
UNDETERMINED = "und"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, one word's after another's, and how many each has.

    Character n-grams of two to four between word marks (those that touch a
    mark are the affixes), and the word itself.
    """
    code = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), n)
    flat, own = [], []
    h, mix = code, np.uint64(0x9E3779B97F4A7C15)
    for k in (2, 3, 4):
        h = h[:-1] * mix + code[k - 1 :] + np.uint64(k)
        same = of[: len(of) - k + 1] == of[k - 1 :]
        flat.append(h[same])
        own.append(of[: len(of) - k + 1][same])
    flat.append(np.array([zlib.crc32(w.encode()) for w in words], np.uint64))
    own.append(np.arange(len(words)))
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return (np.concatenate(flat) * mix >> np.uint64(64 - BITS)).astype(np.int64)[order], np.bincount(own, minlength=len(words))


def lettered(text: str) -> list[str]:
    """The lower-cased words of a text that have a letter, without the marks around them."""
    out = []
    for w in text.lower().split():
        if not w.isalpha():
            w = w.strip("0123456789.,;:!?\"'()[]{}<>|*#$%&@+-=/\\_~^`")
            if not any(map(str.isalpha, w)):
                continue
        out.append(w)
    return out


class Crf:
    """Emission weights (features x languages), transitions, and the languages."""

    def __init__(self, langs: list[str], emit: np.ndarray, move: np.ndarray):
        self.langs, self.emit, self.move = langs, emit, move

    def words(self, words: list[str]) -> np.ndarray:
        """Emission scores of words."""
        flat, n = features(words)
        return np.add.reduceat(self.emit[flat], np.cumsum(n) - n) / np.sqrt(n)[:, None]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact marginals of every word (N x L); ``scores`` holds the texts one after another.

        Texts are cut into segments; products of a segment's step matrices
        carry the messages over its ends, so all segments run side by side.
        """
        n_lang = scores.shape[1]
        used = lengths[lengths > 0]
        per = -(-used // STEP)
        n_seg = int(per.sum())
        e = np.ones((n_seg, STEP, n_lang))
        valid = np.zeros((n_seg, STEP), bool)
        first = np.concatenate(([0], np.cumsum(per)[:-1]))
        row = np.repeat(first, used) + (within := np.arange(len(scores)) - np.repeat(np.cumsum(used) - used, used)) // STEP
        col = within % STEP
        e[row, col] = np.exp(scores - scores.max(1, keepdims=True))
        valid[row, col] = True
        move = np.exp(self.move)
        norm = lambda a, axis: a / a.sum(axis, keepdims=True)

        through = np.broadcast_to(np.eye(n_lang), (n_seg, n_lang, n_lang)).copy()
        for t in range(STEP):
            nxt = (through @ move) * e[:, t, None, :]
            nxt /= nxt.sum((1, 2), keepdims=True)
            through = np.where(valid[:, t, None, None], nxt, through)
        into, out_of = np.empty((n_seg, n_lang)), np.empty((n_seg, n_lang))
        a, b = np.full((len(used), n_lang), 1 / n_lang), np.full((len(used), n_lang), 1 / n_lang)
        for k in range(int(per.max())):
            on = per > k
            s = first[on] + k
            into[s] = a[on]
            a[on] = norm((a[on][:, None, :] @ through[s])[:, 0], 1)
            s = first[on] + per[on] - 1 - k
            out_of[s] = b[on]
            b[on] = norm((through[s] @ b[on][:, :, None])[:, :, 0], 1)
        alpha, a = np.empty_like(e), into
        for t in range(STEP):
            a = np.where(valid[:, t, None], norm((a @ move) * e[:, t], 1), a)
            alpha[:, t] = a
        b = out_of
        for t in reversed(range(STEP)):
            alpha[:, t] *= b
            b = np.where(valid[:, t, None], norm((b * e[:, t]) @ move.T, 1), b)
        return norm(alpha[row, col], 1)


def fit(rows: list[tuple[str, list[str]]], steps: int = 260, batch: int = 32, length: int = 48, rate: float = 0.3) -> Crf:
    """AdaGrad on the log-likelihood of sequences joined from the rows' passages."""
    langs = sorted({x for x, _ in rows}) or [UNDETERMINED]
    n_lang, rng = len(langs), np.random.default_rng(0)
    emit, move = np.zeros((1 << BITS, n_lang)), np.zeros((n_lang, n_lang))
    sum_e, sum_m = np.full(emit.shape, 1e-2), np.full(move.shape, 1.0)
    by_lang = [[words for x, words in rows if x == k and words] for k in langs]
    known = [k for k, x in enumerate(by_lang) if x]
    for _ in range(steps if len(known) > 1 else 0):
        words, gold = [], np.zeros((length, batch), np.int64)
        for b in range(batch):
            seq: list[np.ndarray] = []
            while len(seq) < length:
                k = known[int(rng.integers(len(known)))]
                own = by_lang[k][int(rng.integers(len(by_lang[k])))]
                at = int(rng.integers(len(own)))
                piece = _each(own[at : at + int(rng.integers(4, length))][: length - len(seq)])
                gold[len(seq) : len(seq) + len(piece), b] = k
                seq += piece
            words += seq
        n = np.array([len(f) for f in words])
        flat = np.concatenate(words)
        scale = 1 / np.sqrt(n)
        s = (np.add.reduceat(emit[flat], np.cumsum(n) - n) * scale[:, None]).reshape(batch, length, n_lang).transpose(1, 0, 2)
        e, m = np.exp(s - s.max(2, keepdims=True)), np.exp(move)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = np.full((batch, n_lang), 1 / n_lang)
        for t in range(length):
            a = (a @ m) * e[t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = a
        for t in range(length - 2, -1, -1):
            b = (beta[t + 1] * e[t + 1]) @ m.T
            beta[t] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        after = e[1:] * beta[1:]  # the chance of a transition is before * m * after, normed at each place
        before = alpha[:-1] / ((alpha[:-1] @ m) * after).sum(2, keepdims=True)
        g_m = -m * (before.reshape(-1, n_lang).T @ after.reshape(-1, n_lang)) / batch
        np.add.at(g_m, (gold[:-1].ravel(), gold[1:].ravel()), 1 / batch)
        g = -p
        np.put_along_axis(g, gold[:, :, None], np.take_along_axis(g, gold[:, :, None], 2) + 1, 2)
        g = g.transpose(1, 0, 2).reshape(-1, n_lang) * scale[:, None] / batch
        rep = np.repeat(g, n, 0)
        touched, inv = np.unique(flat, return_inverse=True)
        g_e = np.stack([np.bincount(inv, rep[:, k], len(touched)) for k in range(n_lang)], 1)
        sum_e[touched] += g_e**2
        emit[touched] += rate * g_e / np.sqrt(sum_e[touched])
        sum_m += g_m**2
        move += rate * g_m / np.sqrt(sum_m)
    return Crf(langs, emit.astype(np.float32), move)


def _each(words: list[str]) -> list[np.ndarray]:
    flat, n = features(words)
    return np.split(flat, np.cumsum(n)[:-1])


def train(docs: DataFrame, sample: int = SAMPLE, labels: int = LABELS, size: int = SAMPLE_BYTES) -> Crf:
    """Fit on at most ``sample`` whole rows a language of ``docs`` (text, lang), for the ``labels`` most frequent
    languages (ties: by name), in all at most ``size`` bytes of text.

    Rows of other labels count as not labelled, as do null labels and null texts.  A
    language gets an equal share of the bytes; a row longer than it is not learned
    from.  Repeated rows may be drawn each; a table without labels gives a model that
    answers ``und``.
    """
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    # a row's hash falls under the bound for about ``sample`` rows of its language; a row a language
    n = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(labels).select(F.col("lang").alias("of"), (1.3 * sample / F.col("n")).alias("share"))
    rows = rows.join(F.broadcast(n), F.col("lang") == F.col("of")).filter((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < F.col("share"))
    most = size // max(1, n.count())
    rows = rows.withColumn("bytes", F.octet_length("text")).filter(F.col("bytes") <= most)
    sofar = F.sum("bytes").over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("sofar", sofar).filter(F.col("sofar") <= most)

    def lettered_rows(batches):
        for b in batches:
            words = [lettered(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(w) for w in words], pa.string())], names=["lang", "h", "words"])

    rows = rows.select("lang", "h", "text").mapInArrow(lettered_rows, "lang string, h long, words string")
    got: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["words"])):
        got.setdefault(r["lang"], []).append((r["lang"], r["words"].split()))
    return fit([x for v in got.values() for x in v[:sample]])


class Labeller:
    """Scores batches of texts; keeps the emission scores of recent words."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(crf.langs)), np.float32)

    def _scores(self, words: list[str]) -> np.ndarray:
        get = self.index.get
        at = np.array([get(w, -1) for w in words])
        if (at < 0).any():
            new = list({w for w, i in zip(words, at.tolist(), strict=True) if i < 0})
            if self.index and len(self.index) + len(new) > WORDS_KEPT:
                self.index.clear()
                self.table = self.table[:0]
                return self._scores(words)
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            more = [self.crf.words(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *more]).astype(np.float32)
            at = np.array([get(w) for w in words])
        return self.table[at].astype(float)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        todo: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            if words := lettered(t or ""):
                todo.append((i, words))
                size += len(words)
            if todo and (size > 100_000 or i == len(texts) - 1):
                self._label(todo, out)
                todo, size = [], 0
        if todo:
            self._label(todo, out)
        return out

    def _label(self, todo, out) -> None:
        lengths = np.array([len(w) for _, w in todo])
        p = self.crf.marginals(self._scores([w for _, own in todo for w in own]), lengths)
        mean = np.add.reduceat(p, np.cumsum(lengths) - lengths) / lengths[:, None]
        best = mean.argmax(1)
        for (i, _), k, m in zip(todo, best.tolist(), mean.max(1).tolist(), strict=True):
            out[i] = (self.crf.langs[k], min(1.0, m))


def identify(docs: DataFrame, crf: Crf, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the columns ``keep`` (default: doc_id).

    Whole texts, of any length: segments are labelled side by side, in memory in
    proportion to the text; ``und`` with score 0 if the text is null, empty or has no
    letter, or nothing was learned.  Ids may be null or repeat; an empty table
    gives no rows; the labels of ``docs`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # 2 ** BITS weights a language
    keep = keep or ["doc_id"]
    text = keep.index("text") if "text" in keep else len(keep)  # sent once

    def run(batches):
        label = Labeller(shared.value)
        for b in batches:
            got = []
            for at in range(0, b.num_rows, SLICE):
                got += label(b.column(text).slice(at, SLICE).to_pylist())
            cols = [*b.columns[: len(keep)], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *["text"] * (text == len(keep))).mapInArrow(run, f"{schema}, lang_pred string, score double")
