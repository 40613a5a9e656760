"""One ranking from scores of different scale and direction: median rank aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsight.operators.ranking import positions
from docsight.runtime import checkpoint


def leg_ranks(scores: DataFrame, legs: DataFrame) -> DataFrame:
    """(query_id, leg, chunk_id, rank, n): competition rank of every candidate of a query's leg, best first, and how many there are.

    Candidates are range-partitioned by score, equal scores in one range, numbered inside their range and shifted by the size of the
    ranges before it, so a query that holds a large share of all rows is spread over tasks.
    """
    valid = (
        scores.filter(F.col("query_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("chunk_id").isNotNull())
        .join(F.broadcast(legs.groupBy("leg").agg(F.max("higher_is_better").alias("up"))), "leg")  # one row for each leg
        .select("query_id", "leg", "chunk_id", F.when(F.col("up"), -F.col("score")).otherwise(F.col("score")).alias("cost"))
        .groupBy("query_id", "leg", "chunk_id")
        .agg(F.min("cost").alias("cost"))
    )
    keys = ["query_id", "leg", "cost"]
    kinds = {c: valid.schema[c].dataType.simpleString() for c in ("query_id", "leg", "chunk_id")}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; ranks count from 1 within this range of a query's leg."""
        last, seen, rank = None, 0, 0
        for b in batches:
            ranks = np.empty(b.num_rows, np.int64)
            for i, row in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if last is None or row[:2] != last[:2]:
                    seen = 0
                seen += 1
                if last is None or row != last:
                    rank = seen
                last, ranks[i] = row, rank
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(ranks)], ["query_id", "leg", "chunk_id", "part", "inside"])

    ordered = valid.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "chunk_id", F.spark_partition_id().alias("part"))
    placed = checkpoint(ordered.mapInArrow(number, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", part int, inside bigint"))
    by_leg = Window.partitionBy("query_id", "leg")  # one row for each range here
    spans = placed.groupBy("query_id", "leg", "part").agg(F.count("*").alias("c"))
    spans = spans.select("query_id", "leg", "part", (F.sum("c").over(by_leg.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(by_leg).alias("n"))
    return placed.join(spans, ["query_id", "leg", "part"]).select("query_id", "leg", "chunk_id", (F.col("inside") + F.col("before")).alias("rank"), "n")


def _scored(scores: DataFrame, legs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(query_id, chunk_id, median_rank, mean_rank, legs)"""
    ranked = leg_ranks(scores, legs)
    weight = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, F.lit(float(w))).otherwise(weight)
    # A query has one entry for each leg, a candidate at most as many.
    sizes = ranked.groupBy("query_id", "leg").agg(F.max("n").alias("n")).withColumn("w", weight).groupBy("query_id").agg(F.collect_list(F.struct("leg", "n", "w")).alias("all"))
    own = ranked.groupBy("query_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("leg", "rank"))).alias("own"))
    filled = own.join(sizes, "query_id").select(
        "query_id",
        "chunk_id",
        F.size("own").alias("legs"),
        F.array_sort(F.transform("all", lambda x: F.struct(F.coalesce(F.try_element_at("own", x["leg"]), x["n"] + 1).cast("double").alias("rank"), x["w"].alias("w")))).alias("r"),
    )
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"])

    def median(strict: bool):
        def step(a, x):
            seen = a["seen"] + x["w"]
            reached = (seen > F.col("total") / 2) if strict else (seen >= F.col("total") / 2)
            return F.struct(seen.alias("seen"), F.when(a["m"].isNull() & reached, x["rank"]).otherwise(a["m"]).alias("m"))

        return F.aggregate("r", F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("m")), step, lambda a: a["m"])

    scored = filled.withColumn("total", total)
    return scored.select(
        "query_id",
        "chunk_id",
        ((median(False) + median(True)) / 2).alias("median_rank"),
        (F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"] * x["rank"]) / F.col("total")).alias("mean_rank"),
        "legs",
    )


def median_rank(scores: DataFrame, legs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, chunk_id, median_rank, mean_rank, legs, position): one ranking for each query.

    A candidate's rank in a leg is 1 plus the candidates with a better score; equal scores share a rank. A
    candidate that a leg lacks, or scores null or NaN, takes the rank after that leg's last one; a leg without
    any score for the query does not count. The weighted median is the mean of the lower and the upper
    median. Order: median, then mean rank, then chunk_id. Of repeated rows of a candidate in a leg the best
    score counts. Rows with a null query_id or chunk_id, or of a leg that ``legs`` does not list, are left out. The recorded
    positions are not used: they do not start alike in all legs. Positions come from ranges, so a query may have any number of candidates.
    """
    scored = _scored(scores, legs, weights)
    return positions(scored, ["query_id"], [F.col("median_rank"), F.col("mean_rank"), F.col("chunk_id")]).withColumn("position", F.col("position").cast("int"))


def best(scores: DataFrame, legs: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The first ``k`` of each query in ``median_rank``; every task drops what cannot be among them before anything is shuffled."""
    order = Window.partitionBy("query_id").orderBy("median_rank", "mean_rank", "chunk_id")
    return _scored(scores, legs, weights).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
