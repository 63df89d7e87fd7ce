"""Text embedding: each distinct text once, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic embedder that needs no model: signed counts of hashed words, scaled to unit length.

    Where the words of a text cancel out they are counted without signs, so that every text with words has a direction.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            codes = [int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") for word in text.lower().split()]
            for code in codes:
                out[i, code % dims] += 1.0 if code >> 63 else -1.0
            if not out[i].any():
                for code in codes:
                    out[i, code % dims] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed_text(texts: DataFrame, embedder: Embedder | None, column: str = "text") -> DataFrame:
    """Adds embed, the vector of ``column``; null without an embedder, and for null text."""
    if embedder is None:
        return texts.withColumn("embed", F.lit(None).cast("array<float>"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            vectors = iter(embedder(batch[known].tolist()) if known.any() else ())
            yield pd.Series([next(vectors) if own else None for own in known], index=batch.index, dtype=object)

    return texts.withColumn("embed", F.pandas_udf(run, "array<float>")(F.col(column)))


def embed_distinct(texts: DataFrame, embedder: Embedder | None, column: str = "text") -> DataFrame:
    """The same, but each distinct text goes to the embedder once and is joined back."""
    vectors = embed_text(texts.select(column).where(F.col(column).isNotNull()).distinct(), embedder, column)
    return texts.join(vectors, column, "left")
