"""Splitting items above a size limit at natural boundaries, with overlap and source offsets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_BPE, encoder

LIMIT, OVERLAP = 1500, 200
#: Boundaries from strong to weak; a cut falls behind the match.
_BOUNDARIES = tuple(re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"\n\s*", r"[.!?][\"')\]”’]*\s+", r"[;:,]\s+", r"\s+"))


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text.

    Sorted arrays of boundary positions, one for each strength, are searched for the last boundary under
    the limit. A stronger kind wins as long as it leaves a piece of at least half the limit; without any
    boundary the cut is hard, at the limit. The next piece starts ``overlap`` characters before the cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n, start, out = len(text), 0, []
    if n <= limit:
        return [(0, n)]
    levels = [[m.end() for m in p.finditer(text)] for p in _BOUNDARIES]
    least = max(overlap, limit // 2)
    while n - start > limit:
        end = 0
        for floor in (least, overlap):
            for ends in levels:
                k = bisect_right(ends, start + limit) - 1
                if k >= 0 and ends[k] > start + floor:
                    end = ends[k]
                    break
            if end:
                break
        end = end or start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    start_col: str | None = "start_char",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    path: str = BYTE_BPE,
) -> DataFrame:
    """(id, piece, pieces, start_char, end_char, token_count, text, offset_known): every item as pieces of at most ``limit`` characters.

    Pieces of one item overlap by exactly ``overlap`` characters and cover it without gap. Offsets are code
    points in the source (the item's own start plus the position); where the item's start is null or
    negative they count from the item's own beginning and ``offset_known`` is false. ``token_count`` is the
    number of tokens that begin in the piece, from the prefix sums of the item's token offsets; a piece of a
    single-piece item so gets the count of its whole text. Null and empty texts give one piece of 0
    characters. Repeated rows (same id, text and start) give one result. Extra columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    start = F.col(start_col).cast("int") if start_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), start.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts, starts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for i, t, s in zip(ids, texts, starts, strict=True):
                text, known = t or "", s is not None and s >= 0
                spans = cuts(text, limit, overlap)
                begins = token_starts(enc, text)
                at = s if known else 0
                for k, (a, b) in enumerate(spans):
                    out.append((i, k, len(spans), at + a, at + b, bisect_left(begins, b) - bisect_left(begins, a), text[a:b], known))
            cols = list(zip(*out, strict=True)) or [()] * 8
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names)

    names = [id_col, "piece", "pieces", "start_char", "end_char", "token_count", "text", "offset_known"]
    return rows.distinct().mapInArrow(run, f"`{id_col}` {kind}, piece int, pieces int, start_char int, end_char int, token_count int, text string, offset_known boolean")


def token_starts(enc, text: str) -> list[int]:
    """The sorted first characters of all tokens."""
    split = enc.pretokens([text])[0]
    if split is None:
        return enc.offsets(text)[1]
    out, at = [], 0
    for word in split:
        n = len(enc.known[word])
        if n == 1:
            out.append(at)
        else:
            out.extend(at + a for a in enc.offsets(word)[1])
        at += len(word)
    return out
