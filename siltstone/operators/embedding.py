"""Vectors of texts. Models are not part of this package: an embedder is any function from texts to a matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltstone.functions.text import index_tokens

Embedder = Callable[[list[list[str]]], np.ndarray]


def hashed(dim: int = 384) -> Embedder:
    """A stand-in for a model: each word adds a direction that its hash gives; unit length."""

    def embed(texts: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        known: dict[str, np.ndarray] = {}
        for row, words in zip(out, texts, strict=True):
            for w in words:
                if w not in known:
                    known[w] = np.random.default_rng(list(w.encode())).standard_normal(dim, np.float32)
                row += known[w]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(passages: DataFrame, embed: Embedder = hashed(), key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(embed(b["w"].to_pylist()), np.float32)
            yield pa.RecordBatch.from_arrays([b[key], pa.array(list(x), pa.list_(pa.float32()))], names=[key, "embedding"])

    return passages.select(key, index_tokens(F.col(text)).alias("w")).mapInArrow(run, f"{key} {passages.schema[key].dataType.simpleString()}, embedding array<float>")
