"""Exact vector search for sets of queries, in blocks.

Queries are cut into blocks of bounded size and stored vectors into buckets; a unit of work is one block
against one bucket, a matrix product in an Arrow batch that keeps the best k of each query. Only those
are shuffled again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that callers use for stored columns.
ALIASES = {"company": "company_name"}


def where(filters: dict | None, columns: list[str]) -> Column:
    """All keys must be equal; a section also matches as parent section, ``filing_year`` the year of filing_date, and a pair of (low, high) a closed range. A key that is not stored matches nothing."""
    tests = [F.lit(True)]
    for key, value in (filters or {}).items():
        name = ALIASES.get(key, key)
        if name == "filing_year":
            tests.append(F.substring("filing_date", 1, 4) == str(value))
        elif name not in columns:
            tests.append(F.lit(False))
        elif isinstance(value, tuple):
            tests.append(F.col(name).between(*value))
        elif name == "section" and "parent_section" in columns:
            tests.append((F.col("section") == value) | (F.col("parent_section") == value))
        else:
            tests.append(F.col(name) == value)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _by_length(rows: pa.Table, column: str, id_column: str):
    """(length, matrix, ids) of the vectors of each length."""
    lists, ids = rows[column].combine_chunks(), np.array(rows[id_column].to_pylist(), object)
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        yield int(n), lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), int(n)), ids[own]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", query_col: str = "query_id", query_vector_col: str = "embedding", block: int = 2_048, bucket_rows: int = 65_536, digits: int = 9) -> DataFrame:
    """(query, id, score, rank): the ``k`` most cosine-similar vectors of each query, best first, equal scores by id.

    Scores below ``threshold`` are dropped after the cut to ``k``, so a query may keep fewer. Null vectors and
    vectors of another length than the query's take no part; a zero vector has similarity 0 to all. Repeated
    rows of an id count once. Metadata filters belong on ``vectors``. Scores are rounded to ``digits`` before they are compared.
    """
    qkind, ikind = queries.schema[query_col].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    vectors = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    queries = queries.filter(F.col(query_vector_col).isNotNull())
    n, nq = vectors.count(), queries.count()
    if not n or not nq:
        return queries.sparkSession.createDataFrame([], f"`{query_col}` {qkind}, `{id_col}` {ikind}, score double, rank int")
    buckets, blocks = -(-n // bucket_rows), -(-nq // block)
    v = vectors.groupBy(F.col(id_col).alias("vid")).agg(F.first(F.col(vector_col).cast("array<double>")).alias("v"))
    v = v.select("vid", "v", F.pmod(F.xxhash64("vid"), F.lit(buckets)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vq"))
    q = queries.select(F.col(query_col).alias("qid"), F.col(query_vector_col).cast("array<double>").alias("q"))
    q = q.select("qid", "q", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("qv"))

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        for dim, a, lids in _by_length(left, "q", "qid"):
            for other, b, ids in _by_length(right, "v", "vid"):
                if dim != other:
                    continue
                by_id = np.argsort(ids, kind="stable")
                ids, b = ids[by_id], b[by_id]
                na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
                for at in range(0, len(a), 256):
                    below = na[at : at + 256, None] * nb[None, :]
                    score = np.round(np.where(below == 0, 0.0, (a[at : at + 256] @ b.T) / np.where(below == 0, 1, below)), digits)
                    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    parts.append((np.repeat(lids[at : at + 256], order.shape[1]), ids[order].ravel(), np.take_along_axis(score, order, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] or [(), (), ()]
        return pa.table({query_col: pa.array(cols[0], left.schema.field("qid").type), id_col: pa.array(cols[1], right.schema.field("vid").type), "score": pa.array(cols[2], pa.float64())})

    found = q.groupBy("qb", "qv").cogroup(v.groupBy("vq", "vb")).applyInArrow(unit, f"`{query_col}` {qkind}, `{id_col}` {ikind}, score double")
    order = Window.partitionBy(query_col).orderBy(F.col("score").desc(), F.col(id_col))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)
