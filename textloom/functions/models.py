"""Pluggable model calls: embedders, scorers and providers, with offline stand-ins."""

from __future__ import annotations

import hashlib
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dim: int = 64) -> Embedder:
    """A deterministic bag-of-words stand-in, unit length; not a model's quality."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embed_batch(embed: Embedder, texts: list[str], dim: int | None = None) -> list[list[float]]:
    """One call for the whole batch, in order; none for an empty one; lengths and dimension checked."""
    if not texts:
        return []
    got = embed(list(texts))
    if len(got) != len(texts):
        raise ValueError(f"{len(texts)} texts, but {len(got)} vectors")
    if dim is not None and any(len(v) != dim for v in got):
        raise ValueError(f"a vector's dimension is not {dim}")
    return got


def embed_column(df: DataFrame, embed: Embedder, model: str, dim: int, key: str = "id", text: str = "body", batch: int = 32) -> DataFrame:
    """``id, dim, model, vector``, ``batch`` texts a call."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = embed_batch(embed, [x or "" for x in part.column(1).to_pylist()], dim)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([dim] * len(v), pa.int32()), pa.array([model] * len(v)), pa.array(v, pa.list_(pa.float32()))], names=[key, "dim", "model", "vector"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, dim int, model string, vector array<float>")


def missing(df: DataFrame, done: DataFrame, key: str = "id", again: bool = False) -> DataFrame:
    """Rows not embedded yet, or all of them to embed again."""
    return df if again else df.join(done.select(key), key, "left_anti")


def vector_to_bytes(v: list[float]) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def bytes_to_vector(b: bytes) -> list[float]:
    return np.frombuffer(b, "<f4").tolist()


def rerank(pairs: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], chars: int = 2400, batch: int = 8, least: float = -3.8) -> DataFrame:
    """``score_logit`` of (query, body) pairs by a pluggable scorer; rows below the threshold go."""

    def run(batches):
        for b in batches:
            got: list[float] = []
            rows = [(q or "", (t or "")[:chars]) for q, t in zip(b.column("query").to_pylist(), b.column("body").to_pylist(), strict=True)]
            for at in range(0, len(rows), batch):
                got += score(rows[at : at + batch])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "score_logit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", score_logit double"
    return pairs.mapInArrow(run, schema).filter(f"score_logit >= {least}")


@dataclass(frozen=True)
class ProviderConfig:
    model: str
    provider: str = "llamacpp"
    max_tokens: int = 2048
    timeout: int = 1200
    base_url: str | None = None

    @classmethod
    def from_toml(cls, text: str) -> ProviderConfig:
        own = tomllib.loads(text).get("model", {})
        if not own.get("model"):
            raise ValueError("the configuration names no model")
        return cls(**{k: v for k, v in own.items() if k in cls.__dataclass_fields__})


class Providers:
    """Named callables (model, system, prompt, max_tokens, base_url, timeout) -> text."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def register(self, name: str, call: Callable) -> None:
        self.known[name] = call

    def call(self, provider: str, model: str, system: str, prompt: str, *, max_tokens: int, base_url: str | None = None, timeout: int = 1200) -> str:
        if provider not in self.known:
            raise ValueError(f"unknown provider: {provider}")
        if base_url is not None and provider != "llamacpp":
            raise ValueError("only llamacpp takes a base_url")
        return self.known[provider](model, system, prompt, max_tokens, base_url, timeout)
