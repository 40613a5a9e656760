"""Weighted reciprocal-rank fusion of ranked legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsight.runtime import settle

RRF_K = 60


def fetch_depth(k: int) -> int:
    """How many results each leg gives for a final ``k``."""
    return min(3 * k, 50)


def fuse(legs: list[tuple[DataFrame, float]], k: int, query_col: str = "query_id", id_col: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """(query, id, score, rank): score is the sum of weight / (constant + rank) over the legs that hold the id; equal scores by id. Ranks count from 1."""
    settle(legs[0][0].sparkSession)
    parts = [leg.select(query_col, id_col, (F.lit(float(w)) / (F.lit(constant) + F.col("rank"))).alias("part")) for leg, w in legs]
    total = reduce(DataFrame.unionByName, parts).groupBy(query_col, id_col).agg(F.round(F.sum("part"), 12).alias("score"))
    order = Window.partitionBy(query_col).orderBy(F.col("score").desc(), F.col(id_col))
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
