"""Retrieval and grounding metrics over sets of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.functions.textops import content_words, let, number_value, numbers, sentences
from docsight.functions.vectors import cosine

from .guardrails import close, joined, overlap, values

RETRIEVAL = ("precision", "recall", "reciprocal_rank", "ndcg")
GENERATION = ("faithfulness", "answer_relevancy", "context_relevancy", "numerical_accuracy")


def retrieval_metrics(queries: DataFrame, run: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, ndcg) for every query; ``run`` has query_id, chunk_id and rank from 1, ``relevant`` the pairs that count.

    Precision divides by ``k`` even if fewer were retrieved; the reciprocal rank looks at the whole list; gains are
    binary. Queries without a relevant or a retrieved chunk score 0, as all do with ``k`` below 1. Repeated pairs count once.
    """
    truth = relevant.select("query_id", "chunk_id").distinct()
    hits = run.join(truth, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + F.lit(1.0)))).alias("gain")
    )
    rows = queries.select("query_id").distinct().join(truth.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(max(k, 1))).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    some = F.lit(k > 0)
    return rows.select(
        "query_id",
        zero(F.when(some, F.col("hits") / F.lit(float(max(k, 1))))).alias("precision"),
        zero(F.when(some, F.col("hits") / F.col("n"))).alias("recall"),
        zero(1 / F.col("first")).alias("reciprocal_rank"),
        zero(F.when(some & (F.col("n") > 0), F.col("gain") / best)).alias("ndcg"),
    )


def faithfulness(answers: DataFrame) -> DataFrame:
    """(answer_id, faithfulness): share of sentences above 15 characters of whose content words 0.3 or more are in the sources, or that have none; 1 without such sentences."""
    long = F.filter(sentences(F.coalesce("answer", F.lit(""))), lambda s: F.length(s) > 15)
    grounded = lambda src, found: F.size(F.filter(found, lambda s: F.coalesce(overlap(s, src) >= 0.3, F.lit(True))))
    share = let(long, lambda found: F.when(F.size(found) > 0, let(joined(F.col("sources"), lower=True), lambda src: grounded(src, found)) / F.size(found)).otherwise(1.0))
    return answers.select("answer_id", share.alias("faithfulness"))


def context_relevancy(questions: DataFrame) -> DataFrame:
    """(answer_id, context_relevancy) of answer_id, query and sources: share of sources that have 0.2 or more of the query's distinct content words; 0 without sources or words."""
    texts = F.coalesce("sources", F.array().cast("array<string>"))
    good = lambda words: F.size(F.filter(texts, lambda t: F.size(F.array_intersect(words, F.array_distinct(content_words(t)))) / F.size(words) >= 0.2))
    share = let(F.array_distinct(content_words(F.coalesce("query", F.lit("")))), lambda words: F.when((F.size(words) > 0) & (F.size(texts) > 0), good(words) / F.size(texts)).otherwise(0.0))
    return questions.select("answer_id", share.alias("context_relevancy"))


def numerical_accuracy(answers: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(answer_id, numerical_accuracy): share of the answer's numbers that the sources spell or come near to; 1 without numbers."""

    def check(src: Column, known: Column, spelled: Column) -> Column:
        good = F.size(F.filter(spelled, lambda n: F.contains(src, n) | F.coalesce(close(number_value(n), known, tolerance), F.lit(False))))
        return F.when(F.size(spelled) > 0, good / F.size(spelled)).otherwise(1.0)

    spelled = numbers(F.coalesce("answer", F.lit("")))
    share = let(joined(F.col("sources")), lambda src: let(values(numbers(src)), lambda known: let(spelled, lambda n: check(src, known, n))))
    return answers.select("answer_id", share.alias("numerical_accuracy"))


def answer_relevancy(pairs: DataFrame) -> DataFrame:
    """(answer_id, answer_relevancy) of answer_id, query_vector and answer_vector: their cosine; 0 for zero or null vectors."""
    return pairs.select("answer_id", F.coalesce(cosine(F.col("query_vector"), F.col("answer_vector")), F.lit(0.0)).alias("answer_relevancy"))


def averages(per_query: DataFrame, columns: tuple[str, ...] = RETRIEVAL) -> DataFrame:
    """One row: the mean of each metric and the number of questions; zeros for none."""
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in columns], F.count("*").alias("num_questions"))
