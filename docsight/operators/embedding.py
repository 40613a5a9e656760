"""Embedding back ends by name, and a cache table keyed by model and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsight.functions.vectors import Hasher

#: name -> maker of a function from texts to a matrix; made once in each task.
BACKENDS: dict[str, Callable[[int], Callable[[list[str]], np.ndarray]]] = {"hashed": Hasher}
BATCH = 64


def register(name: str, maker: Callable[[int], Callable[[list[str]], np.ndarray]]) -> None:
    BACKENDS[name] = maker


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the hidden states of real tokens, (n, tokens, dim) and (n, tokens), for encoders that give one state for each token."""
    m = mask[:, :, None].astype(float)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def embed(df: DataFrame, id_col: str, text_col: str, backend: str = "hashed", dim: int = 64) -> DataFrame:
    """(id, embedding array<float>) in batches of 64 texts; each distinct text is embedded once. Null texts count as empty."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown embedding provider {backend!r}; register it first")
    maker = BACKENDS[backend]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = maker(dim)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                m = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["__key", "embedding"])

    keyed = df.select(id_col, key(F.col(text_col), backend, dim).alias("__key"), F.col(text_col).alias("__t"))
    texts = keyed.groupBy("__key").agg(F.first("__t").alias("t"))
    return keyed.select(id_col, "__key").join(texts.mapInArrow(run, "__key string, embedding array<float>"), "__key").select(id_col, "embedding")


def key(text, backend: str, dim: int):
    """What the cache knows a text by: model, dimension and text."""
    return F.sha2(F.concat_ws("\u0001", F.lit(f"{backend}/{dim}"), F.coalesce(text, F.lit(""))), 256)


def misses(df: DataFrame, cache: DataFrame | None, text_col: str, backend: str = "hashed", dim: int = 64) -> DataFrame:
    """(key, text) of the distinct texts that the cache table (key, embedding) lacks."""
    wanted = df.select(key(F.col(text_col), backend, dim).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
    return wanted if cache is None else wanted.join(cache.select("key"), "key", "left_anti")


def embed_cached(df: DataFrame, id_col: str, text_col: str, path: str, backend: str = "hashed", dim: int = 64) -> DataFrame:
    """``embed`` with a Parquet cache at ``path``: misses are embedded and appended, then everything is read back."""
    spark = df.sparkSession
    try:
        cache = spark.read.schema("key string, embedding array<float>").parquet(path)
        cache.limit(1).count()
    except Exception:  # noqa: BLE001 - there is no cache yet
        cache = None
    new = misses(df, cache, text_col, backend, dim)
    embed(new, "key", "text", backend, dim).write.mode("append").parquet(path)
    stored = spark.read.parquet(path).dropDuplicates(["key"])
    return df.select(id_col, key(F.col(text_col), backend, dim).alias("key")).join(stored, "key").select(id_col, "embedding")


def clear_cache(spark, path: str) -> int:
    """Empties the cache; how many vectors it held."""
    held = spark.read.parquet(path)
    n = held.count()
    held.limit(0).write.mode("overwrite").parquet(path + ".empty")
    spark.read.parquet(path + ".empty").write.mode("overwrite").parquet(path)
    return n
