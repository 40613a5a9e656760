"""Prompts from retrieved sources, and answers by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.functions.textops import content_words, sentences

#: What a model is told; the user part has the sources and the question.
SYSTEM = "You answer questions about company filings. Use only the numbered sources, cite them as [Source N], and say so if they do not hold the answer."
NO_SOURCES = "No relevant passage was found in the indexed filings for this question."
MODELS: dict[str, Callable[[str, str], str]] = {}


def register(name: str, model: Callable[[str, str], str]) -> None:
    """``model`` gets the system and the user prompt and gives the answer."""
    MODELS[name] = model


def format_sources(results: DataFrame, most: int = 3000) -> DataFrame:
    """(query_id, sources, texts) of results with query_id, rank, text, section, company_name and filing_date: numbered blocks, each text cut to ``most`` characters, and the whole texts in order."""
    known = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    block = F.concat(F.lit("Section: "), known("section"), F.lit("\nCompany: "), known("company_name"), F.lit("\nFiling Date: "), known("filing_date"), F.lit("\nContent:\n"), F.substring(F.coalesce("text", F.lit("")), 1, most), F.lit("\n---"))
    # A query has as many rows as it was asked for.
    lists = results.select("query_id", "rank", block.alias("b"), F.coalesce("text", F.lit("")).alias("t")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "b", "t"))).alias("l"))
    numbered = F.transform("l", lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), x["b"]))
    return lists.select("query_id", F.array_join(numbered, "\n").alias("sources"), F.transform("l", lambda x: x["t"]).alias("texts"))


def prompts(queries: DataFrame, formatted: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(query_id, query, sources, texts, system_prompt, user_prompt) for every query, also those without sources; ``contexts`` (query_id, context) extends the system prompt."""
    rows = queries.select("query_id", "query").join(formatted, "query_id", "left")
    system = F.lit(SYSTEM)
    if contexts is not None:
        rows = rows.join(contexts.select("query_id", "context"), "query_id", "left")
        system = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(SYSTEM + "\n\nAdditional context from the knowledge graph:\n"), F.col("context"))).otherwise(SYSTEM)
    user = F.concat(F.lit("Sources:\n"), F.coalesce("sources", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nAnswer from the sources above, cite them, and show how numbers were computed."))
    return rows.select("query_id", "query", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), system.alias("system_prompt"), user.alias("user_prompt"))


def extract(query: Column, texts: Column, most: int = 3) -> Column:
    """An answer without a model: the sentences that share most distinct content words with the query, each with its source's number; of equals the earlier."""
    words = F.array_distinct(content_words(query))
    scored = F.flatten(F.transform(texts, lambda t, i: F.transform(sentences(t), lambda s, j: F.struct((-F.size(F.array_intersect(words, F.array_distinct(content_words(s))))).alias("o"), i.alias("i"), j.alias("j"), s.alias("s")))))
    best = F.slice(F.array_sort(scored), 1, most)
    return F.array_join(F.transform(best, lambda x: F.concat(x["s"], F.lit(" [Source "), (x["i"] + 1).cast("string"), F.lit("]"))), " ")


def generate(asked: DataFrame, model: str = "extractive") -> DataFrame:
    """(query_id, query, answer, texts, model, has_sources): questions without sources get a fixed answer; a model that raises gives "Generation failed: ..."."""
    has = F.size("texts") > 0
    if model == "extractive":
        answer = F.when(has, extract(F.col("query"), F.col("texts"))).otherwise(NO_SOURCES)
        return asked.select("query_id", "query", answer.alias("answer"), "texts", F.lit(model).alias("model"), has.alias("has_sources"))
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; register it first")
    call = MODELS[model]
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = []
            for s, u, t in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                try:
                    answers.append(call(s, u) if t else NO_SOURCES)
                except Exception as e:  # noqa: BLE001 - one failing call must not lose the others
                    answers.append(f"Generation failed: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(answers, pa.string()), b.column(4)], ["query_id", "query", "answer", "texts"])

    rows = asked.select("query_id", "query", "system_prompt", "user_prompt", "texts").mapInArrow(run, f"query_id {kind}, query string, answer string, texts array<string>")
    return rows.select("*", F.lit(model).alias("model"), has.alias("has_sources"))


def simple_generate(prompt: str, model: str) -> str:
    """What a registered model answers to one prompt without sources; the empty string if it raises."""
    try:
        return MODELS[model]("", prompt)
    except Exception:  # noqa: BLE001 - callers go on without an answer
        return ""


def preview(results: DataFrame, most: int = 200) -> DataFrame:
    """``results`` with ``preview``: the first ``most`` characters of the text, with dots where it goes on."""
    text = F.coalesce("text", F.lit(""))
    return results.withColumn("preview", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text))


def stream(answers: DataFrame) -> Iterator[tuple]:
    """(query_id, word) one after the other, without holding all answers on the driver; no checks run on this path."""
    for r in answers.select("query_id", F.explode(F.split("answer", "(?<= )")).alias("word")).toLocalIterator():
        yield r["query_id"], r["word"]
