"""BM25 over an index of documents' words: a dictionary with weights, one row of statistics, and the words of each document.

A set of queries is cut into passes of bounded size. A pass sends the weighed query terms to the documents, which stay where
they are: every task scores its documents against blocks of queries as a matrix product and keeps the best of each query, so that
only those are shuffled, however common a term is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsight.functions.textops import tokens
from docsight.runtime import checkpoint, settle

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bounds of what is sent to every task at once: query terms of a pass, and of a block within it.
PASS_TERMS, BLOCK_TERMS = 400_000, 4_096
_DOCUMENTS = 1_024


@dataclass
class SparseIndex:
    words: DataFrame  # chunk_id, words: the tokens of every document, also of those without any
    dictionary: DataFrame  # term, df, idf
    documents: int
    mean_length: float

    def postings(self) -> DataFrame:
        """(chunk_id, term, tf, dl)"""
        each = self.words.select("chunk_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
        return each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))

    def save(self, folder: str) -> None:
        """Writes what ``load_index`` reads."""
        self.words.write.mode("overwrite").parquet(f"{folder}/words")
        self.dictionary.write.mode("overwrite").parquet(f"{folder}/dictionary")
        one = self.words.sparkSession.createDataFrame([(self.documents, self.mean_length)], "documents bigint, mean_length double")
        one.write.mode("overwrite").parquet(f"{folder}/statistics")


def load_index(spark: SparkSession, folder: str) -> SparseIndex:
    one = spark.read.parquet(f"{folder}/statistics").first()
    return SparseIndex(spark.read.parquet(f"{folder}/words"), spark.read.parquet(f"{folder}/dictionary"), one["documents"], one["mean_length"])


def build_index(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text", keep: bool = True, tokenizer=tokens) -> SparseIndex:
    """Statistics are those of the whole corpus, one document a row; a filter belongs behind the scores.

    With ``keep`` words and dictionary are written to the checkpoint folder, so texts are read once. ``tokenizer`` turns a text column into an array of tokens;
    a search must use the same one.
    """
    words = corpus.select(F.col(id_col).alias("chunk_id"), tokenizer(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    if keep:
        words = checkpoint(words)
    totals = words.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("length")).first()
    n, length = totals["n"], totals["length"] or 0
    counts = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + F.lit(0.5)))
    if keep:
        raw = checkpoint(raw)
    mean = raw.agg(F.avg("raw").alias("m")).first()["m"] or 0.0  # one row
    dictionary = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
    return SparseIndex(words, dictionary, n, length / n if n else 0.0)


def _weighed(index: SparseIndex, queries: DataFrame, query_cols: tuple[str, ...], text_col: str, tokenizer=tokens) -> DataFrame:
    """(query columns, term, weight): a token weighs as often as the query repeats it."""
    asked = queries.select(*query_cols, F.explode(tokenizer(F.col(text_col))).alias("term")).groupBy(*query_cols, "term").agg(F.count("*").alias("times"))
    return asked.join(index.dictionary, "term").select(*query_cols, "term", (F.col("times") * F.col("idf")).alias("weight"))


def scores(index: SparseIndex, queries: DataFrame, query_cols: tuple[str, ...] = ("query_id",), text_col: str = "query") -> DataFrame:
    """(query columns, chunk_id, score, share): BM25 of every document that shares a token with the query, and its share of the query's best score.

    All of them, so the result grows with queries times documents; ``best`` gives the first ones without that. The best score is taken over
    the whole corpus; where it is not positive the share is the score.
    """
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length or 1.0)))
    # Rounding settles the last bits, which depend on the order of the sum.
    found = _weighed(index, queries, query_cols, text_col).join(index.postings(), "term").groupBy(*query_cols, "chunk_id").agg(F.round(F.sum(part), 9).alias("score"))
    peak = found.groupBy(*query_cols).agg(F.max("score").alias("peak"))
    return found.join(peak, list(query_cols)).select(*query_cols, "chunk_id", "score", _share(F.col("score"), F.col("peak")).alias("share"))


def _share(score, peak):
    return F.round(score / F.when(peak > 0, peak).otherwise(1.0), 9)


class _Block:
    """Some queries of a pass: their numbers, where each term of the pass stands here, and the weights."""

    def __init__(self, numbers: list[int], rows: list[tuple[int, int, float]], vocabulary: int):
        own = sorted({t for _, t, _ in rows})
        self.numbers = np.array(numbers, np.int32)
        self.place = np.full(vocabulary, -1, np.int32)
        self.place[own] = np.arange(len(own))
        at = {q: k for k, q in enumerate(numbers)}
        self.weights, self.member = np.zeros((len(own), len(numbers))), np.zeros((len(own), len(numbers)), np.float32)
        for q, t, w in rows:
            self.weights[self.place[t], at[q]], self.member[self.place[t], at[q]] = w, 1
        self.positive = bool((self.weights[self.member > 0] > 0).all())
        # Scores nearer to each other than this may come out as equal shares, which the ids decide.
        self.margin = 2e-9 * (1 + np.abs(self.weights).sum(axis=0) * (K1 + 1))


def _blocks(rows: list[tuple[int, int, float]], vocabulary: int) -> list[_Block]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out, numbers, held = [], [], []
    for q, own in by.items():
        if numbers and (len(held) + len(own) > BLOCK_TERMS or len(numbers) >= 256):
            out.append(_Block(numbers, held, vocabulary))
            numbers, held = [], []
        numbers.append(q)
        held += own
    return [*out, _Block(numbers, held, vocabulary)] if numbers else out


def _counts(words: pa.ListArray, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count of it there) of the terms that some query has, by document; lengths of all documents."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    number = np.array([known.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)
    term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)[term >= 0]
    key, count = np.unique(doc * len(known) + term[term >= 0], return_counts=True)
    return key // max(1, len(known)), key % max(1, len(known)), count.astype(float), lengths


def _best_of(words: DataFrame, rows: list[tuple[int, str, float]], k: int, mean: float) -> DataFrame:
    """(number, chunk_id, score, peak): of every query the documents that may be among its best ``k``, and the best score of each task."""
    kind = words.schema["chunk_id"].dataType.simpleString()
    known: dict[str, int] = {}
    blocks = _blocks([(q, known.setdefault(t, len(known)), w) for q, t, w in rows], len({t for _, t, _ in rows}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.full((len(b.numbers), k), -np.inf) for b in blocks]
        peak = [np.full(len(b.numbers), -np.inf) for b in blocks]
        held: list[list[tuple]] = [[] for _ in blocks]
        id_type = None

        def few(n: int) -> None:
            """Drops what has fallen behind."""
            q, i, s = (np.concatenate(c) for c in zip(*held[n], strict=True))
            stay = s >= top[n].min(axis=1)[q] - blocks[n].margin[q]
            held[n] = [(q[stay], i[stay], s[stay])]

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, allowed = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            doc, term, tf, length = _counts(batch.column(1), known)
            value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            for at in range(0, batch.num_rows, _DOCUMENTS):
                own = slice(*np.searchsorted(doc, [at, at + _DOCUMENTS]))
                open_ = allowed[at : at + _DOCUMENTS]
                for n, block in enumerate(blocks):
                    place = block.place[term[own]]
                    use = place >= 0
                    d = np.zeros((len(open_), len(block.weights)))
                    d[doc[own][use] - at, place[use]] = value[own][use]
                    s = (d @ block.weights).T
                    hit = s > 0 if block.positive else ((d > 0).astype(np.float32) @ block.member).T > 0
                    s = np.where(hit, s, -np.inf)
                    peak[n] = np.maximum(peak[n], s.max(axis=1))
                    s[:, ~open_] = -np.inf
                    both = np.concatenate([top[n], s], axis=1)
                    top[n] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                    q, i = np.nonzero(np.isfinite(s) & (s >= (top[n].min(axis=1) - block.margin)[:, None]))
                    if len(q):
                        held[n].append((q, ids[at + i], s[q, i]))
                        if len(held[n]) > 32:
                            few(n)
        for n, block in enumerate(blocks):
            seen = np.flatnonzero(np.isfinite(peak[n]))
            if not len(seen) or id_type is None:
                continue
            none = pa.nulls(len(seen), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(block.numbers[seen]), pa.nulls(len(seen), id_type), none, pa.array(peak[n][seen])], ["number", "chunk_id", "score", "peak"])
            if held[n]:
                few(n)
                q, i, s = held[n][0]
                yield pa.RecordBatch.from_arrays([pa.array(block.numbers[q]), pa.array(i.tolist(), id_type), pa.array(s), pa.nulls(len(q), pa.float64())], ["number", "chunk_id", "score", "peak"])

    return words.select("chunk_id", "words", "allowed").mapInArrow(run, f"number int, chunk_id {kind}, score double, peak double")


def best(index: SparseIndex, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, query_cols: tuple[str, ...] = ("query_id",), text_col: str = "query", tokenizer=tokens) -> DataFrame:
    """(query columns, chunk_id, score, share, rank): the best ``k`` documents of each query that share a token with it, by share, equal ones by id.

    Scores and shares are those of ``scores``. ``allowed`` holds the chunk_ids that a metadata filter leaves; the best score is taken before it acts. Repeated
    rows of a query with other texts count as one longer query. Null texts find nothing.
    """
    spark = settle(queries.sparkSession)
    words = index.words.withColumn("allowed", F.lit(True))
    if allowed is not None:
        marked = allowed.select("chunk_id").distinct().withColumn("allowed", F.lit(True))
        words = index.words.join(marked, "chunk_id", "left").withColumn("allowed", F.col("allowed").isNotNull())
    asked = _weighed(index, queries, query_cols, text_col, tokenizer)
    size = queries.agg(F.sum(F.size(tokenizer(F.col(text_col))))).first()[0] or 0
    passes = max(1, -(-size // PASS_TERMS))
    key = F.struct(*query_cols)
    schema = queries.select(*query_cols).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = []
    for p in range(passes):
        mine = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == p)
        numbers: dict[tuple, int] = {}
        rows = [(numbers.setdefault(tuple(r[c] for c in query_cols), len(numbers)), r["term"], r["weight"]) for r in mine.collect()]  # about PASS_TERMS at most
        if not rows:
            continue
        found = _best_of(words, rows, k, index.mean_length or 1.0)
        whole = Window.partitionBy("number")
        scored = found.withColumn("peak", F.round(F.max("peak").over(whole), 9)).filter("score IS NOT NULL").withColumn("score", F.round("score", 9))
        ranked = scored.withColumn("share", _share(F.col("score"), F.col("peak"))).withColumn("rank", F.row_number().over(whole.orderBy(F.col("share").desc(), F.col("chunk_id")))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(*q, n) for q, n in numbers.items()], f"{kinds}, number int")
        part = ranked.join(F.broadcast(names), "number").select(*query_cols, "chunk_id", "score", "share", "rank")
        parts.append(part if passes == 1 else checkpoint(part))
    kind = index.words.schema["chunk_id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{kinds}, chunk_id {kind}, score double, share double, rank int")


def top(scored: DataFrame, k: int, query_cols: tuple[str, ...] = ("query_id",), score_col: str = "score") -> DataFrame:
    """The best ``k`` of each query with their ``rank`` from 1; equal scores by id."""
    order = Window.partitionBy(*query_cols).orderBy(F.col(score_col).desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: SparseIndex, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, query_cols: tuple[str, ...] = ("query_id",), text_col: str = "query", include_zero: bool = False) -> DataFrame:
    """(query columns, chunk_id, score, rank) with shares as scores; see ``best``. With ``include_zero`` documents without a common token fill up, by id; only up to ``k`` of them are made for a query."""
    found = best(index, queries, k, allowed, query_cols, text_col)
    found = found.select(*query_cols, "chunk_id", F.col("share").alias("score"), "rank")
    if not include_zero:
        return found
    # Of the first 2k ids by order at least k are not among a query's best k.
    ids = (allowed if allowed is not None else index.words).select("chunk_id").distinct().orderBy("chunk_id").limit(2 * k)
    first = [r["chunk_id"] for r in ids.collect()]
    few = index.words.filter(F.col("chunk_id").isin(first)).select("chunk_id", F.explode("words").alias("term")).distinct()
    hits = _weighed(index, queries, query_cols, text_col).join(F.broadcast(few), "term").select(*query_cols, "chunk_id")
    kind = index.words.schema["chunk_id"].dataType.simpleString()
    fill = queries.select(*query_cols).distinct().withColumn("ids", F.lit(first).cast(f"array<{kind}>")).select(*query_cols, F.explode("ids").alias("chunk_id"))
    fill = fill.join(hits, [*query_cols, "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(found.drop("rank").unionByName(fill), k, query_cols)
