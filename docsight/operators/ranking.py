"""Positions of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsight.runtime import checkpoint


def positions(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with the 1-based position of each row within its group by ``order``, which must tell all rows of a group apart.

    Rows are cut into ranges of (group, order), numbered inside their range and shifted by what the ranges before hold of the
    group, so a group with a large share of all rows is spread over tasks. ``df`` is read twice: give a written table or a checkpoint
    where it is costly. Columns that begin with two underscores are taken.
    """
    keys = [*map(F.col, group), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ranged = checkpoint(ranged.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}))
    # One row for each range of a group.
    spans = ranged.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__n")
    spans = spans.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return ranged.join(spans, same).select(*df.columns, (F.col("__at") + F.col("__shift")).cast("bigint").alias(name))
