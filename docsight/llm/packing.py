"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

The corpus is reduced to its length histogram, which has at most ``capacity`` rows however large the
corpus is. On that histogram patterns of up to three items that fill a container exactly are fitted by
non-negative least squares, rounded, and the rest is packed best-fit decreasing in run-length form. The
resulting plan says which ranks of each length go to which containers; ranks are computed with salted
windows, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsight.runtime import checkpoint

from .tokens import BYTE_BPE, token_counts


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All sorted one- to three-item patterns over the lengths that sum to the capacity; 0 means no item."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    rows = [np.array([[0, 0, capacity]])] if have[capacity] else []
    small = np.flatnonzero(have)
    small = small[(small > 0) & (small < capacity)]
    other = capacity - small
    pairs = (small <= other) & have[other]
    rows.append(np.stack([np.zeros(pairs.sum(), int), small[pairs], other[pairs]], 1))
    for a in small[small <= capacity // 3]:
        b = small[(small >= a) & (small <= (capacity - a) // 2)]
        c = capacity - a - b
        fits = have[c]
        rows.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 minimising |A x - histogram|^2 by accelerated projected gradient; column j of A counts
    the lengths of pattern j, with weight 1/sqrt(count) by row so that rare and common lengths weigh alike."""
    if not len(patterns):
        return np.zeros(0)
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))
    weight[0] = 0.0
    size = len(histogram)

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(patterns[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / max(np.linalg.norm(back(forward(v))), 1e-12) / 1.05
    goal = weight * histogram
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - goal))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / u * (new - x)
        x, t = new, u
    return x


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, containers) pairs that use every item of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    x = fit_counts(patterns, left.astype(float))
    for j in np.argsort(-x, kind="stable"):
        n = int(np.floor(x[j] + 0.5))
        if n < 1:
            break
        items = [int(i) for i in patterns[j] if i]
        n = min([n, *(int(left[i]) // items.count(i) for i in items)])
        if n > 0:
            plan.append((tuple(items), n))
            for i in items:
                left[i] -= n
    room: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free space: [pattern, containers]
    free = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            spots = np.flatnonzero(free[length:])
            if len(spots):
                gap = length + int(spots[0])
                pattern, have = room[gap].pop()
                use = min(n, have)
                if have > use:
                    room[gap].append([pattern, have - use])
                free[gap] -= use
                fit = 1
            else:
                gap, pattern, fit = capacity, (), min(n, capacity // length)
                use = n // fit
            room[gap - fit * length].append([(*pattern, *[length] * fit), use])
            free[gap - fit * length] += use
            n -= use * fit
    return plan + [(p, n) for groups in room for p, n in groups]


class Slots:
    """Looks up the container of the r-th item of a length under a plan."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        seen: dict[int, int] = {}
        spans: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for pattern, n in plan:
            for length in dict.fromkeys(pattern):
                times = pattern.count(length)
                start = seen.get(length, 0)
                spans.setdefault(length, []).append((start, base, times))
                seen[length] = start + n * times
            base += n
        self.spans = {k: np.array(v, np.int64).T for k, v in spans.items()}
        self.containers = base

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                start, base, times = self.spans[int(lengths[own[0]])]
                at = np.searchsorted(start, ranks[own], side="right") - 1
                out[own] = base[at] + (ranks[own] - start[at]) // times[at]
        return out


def pack(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id", size_col: str = "n_tokens", salts: int = 64) -> DataFrame:
    """(container_id, id, piece, start_token, n_tokens): every item in containers of the capacity.

    Only items above the capacity are split, into full containers and one rest. Items of size null or 0
    take no space: one row with a null container. Repeated rows are separate items. Extra columns are not
    read. Container ids are 0, 1, ... without gaps. ``sizes`` is read several times: give a written table
    or a checkpoint.
    """
    cap = int(capacity)
    kind = sizes.schema[id_col].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(size_col).cast("int"), F.lit(0)), F.lit(0))
    rows = sizes.select(F.col(id_col).alias("id"), n.alias("n"))
    items = (
        rows.filter("n > 0")
        .select("id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / cap).cast("int"))).alias("piece"))
        .select("id", "piece", (F.col("piece") * cap).alias("start"), F.least(F.lit(cap), F.col("n") - F.col("piece") * cap).alias("len"))
        .withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    )
    by_salt = items.groupBy("len", "salt").agg(F.count("*").alias("c"))
    # At most capacity * salts rows.
    offsets = by_salt.select("len", "salt", (F.sum("c").over(Window.partitionBy("len").orderBy("salt")) - F.col("c")).alias("before"))
    # At most capacity rows reach the driver.
    histogram = {r["len"]: r["c"] for r in by_salt.groupBy("len").agg(F.sum("c").alias("c")).collect()}
    slots = Slots(pack_histogram(histogram, cap))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("len", "salt").orderBy("id", "piece")) - 1)
    ranked = ranked.join(offsets, ["len", "salt"]).select("id", "piece", "start", "len", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = slots.find(b.column(3).to_numpy(), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(where), *b.columns[:4]], ["container_id", id_col, "piece", "start_token", "n_tokens"])

    placed = ranked.mapInArrow(place, f"container_id bigint, `{id_col}` {kind}, piece int, start_token int, n_tokens int")
    empty = rows.filter("n = 0").select(F.lit(None).cast("bigint").alias("container_id"), F.col("id").alias(id_col), F.lit(0).alias("piece"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"))
    return placed.unionByName(empty)


def pack_documents(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """``pack`` over the token counts of texts; the counts are checkpointed, texts are read once."""
    return pack(checkpoint(token_counts(df, id_col, text_col, path)), capacity, id_col)
