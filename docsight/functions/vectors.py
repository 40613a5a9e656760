"""Vector functions: cosine over array columns, and a deterministic text embedding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+")
_WORDS_KEPT = 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """In doubles; 0 for a zero vector. ``epsilon`` is added to the denominator where asked for."""
    below = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(below == 0, F.lit(0.0)).otherwise(dot(a, b) / below)


class Hasher:
    """Feature hashing: a token counts in the bucket of its md5's first 28 bits modulo the dimension."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def counts(self, text: str) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        buckets = []
        for t in _TOKEN.findall(text.lower()):
            if t not in self.known:
                self.known[t] = int(md5(t.encode()).hexdigest()[:7], 16) % self.dim
            buckets.append(self.known[t])
        return np.bincount(buckets, minlength=self.dim).astype(float) if buckets else np.zeros(self.dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Unit vectors; texts without tokens give zero vectors."""
        m = np.stack([self.counts(t) for t in texts]) if texts else np.zeros((0, self.dim))
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return m / np.where(n == 0, 1, n)


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding array<double>): hashed bags of words of unit length; zero vectors for null and empty texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Hasher(dim)
        for b in batches:
            m = embed([t or "" for t in b.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<double>")
