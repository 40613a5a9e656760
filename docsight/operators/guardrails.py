"""Checks of answers against their sources.

Input rows: answer_id, answer and ``sources``, the texts that the answer was made from (a few each).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.functions.textops import META, claims, content_words, let, number_value, numbers, sentences

#: What a finding costs by severity.
PENALTY = {"low": 0.02, "medium": 0.08, "high": 0.15, "critical": 0.30}
OTHER_PENALTY = 0.05


def joined(sources: Column, lower: bool = False) -> Column:
    text = F.array_join(F.coalesce(sources, F.array().cast("array<string>")), " ")
    return F.lower(text) if lower else text


def overlap(sentence: Column, source: Column) -> Column:
    """Share of a sentence's content words that occur, also inside other words, in a lower-cased source; null without such words."""
    return let(content_words(sentence), lambda words: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(source, w))) / F.size(words)))


def values(texts: Column) -> Column:
    return F.filter(F.transform(texts, number_value), lambda v: v.isNotNull())


def close(value: Column, known: Column, tolerance: float) -> Column:
    return F.exists(known, lambda s: F.abs(value - s) / F.greatest(F.abs(s), F.lit(1e-10)) < F.lit(tolerance))


def _finding(check: str, severity: Column | str, message: Column, span: Column, evidence: Column | None = None) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(check).alias("check_name"), severity.alias("severity"), message.alias("message"), span.alias("span"), (F.lit("") if evidence is None else evidence).alias("evidence"))


def _rows(answers: DataFrame, findings: Column) -> DataFrame:
    return answers.select("answer_id", F.posexplode(findings).alias("no", "f")).select("answer_id", "no", "f.*")


def factual(answers: DataFrame) -> DataFrame:
    """Sentences of 20 characters or more, no remarks on the sources, of whose content words less than 0.3 are in the sources: medium, below 0.1 high."""
    percent = lambda o: F.rint(o * 100).cast("int").cast("string")

    def check(src: Column) -> Column:
        scored = F.transform(sentences(F.col("answer")), lambda s: F.struct(s.alias("s"), overlap(s, src).alias("o")))
        kept = F.filter(scored, lambda x: (F.length(x["s"]) >= 20) & ~x["s"].rlike(META) & (x["o"] < 0.3))
        return F.transform(kept, lambda x: _finding("factual_consistency", F.when(x["o"] < 0.1, "high").otherwise("medium"), F.concat(F.lit("Sentence may not be grounded in sources (overlap="), percent(x["o"]), F.lit("%).")), F.substring(x["s"], 1, 200)))

    return _rows(answers, let(joined(F.col("sources"), lower=True), check))


def hallucination(answers: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Numbers of financial claims that the sources neither spell nor come near to: high; medium where the sources have no number at all."""

    def check(src: Column, spelled: Column, known: Column) -> Column:
        valued = F.transform(claims(F.col("answer")), lambda c: F.struct(c.alias("c"), number_value(c).alias("v")))
        open_ = F.filter(valued, lambda x: ~F.contains(src, x["c"]) & x["v"].isNotNull() & ~close(x["v"], known, tolerance))
        some = F.size(known) > 0
        return F.transform(
            open_,
            lambda x: _finding(
                "hallucination_detection",
                F.when(some, "high").otherwise("medium"),
                F.when(some, F.concat(F.lit("Financial figure '"), x["c"], F.lit("' not found in source documents."))).otherwise(F.concat(F.lit("Could not verify figure '"), x["c"], F.lit("' against sources."))),
                x["c"],
                F.when(some, F.concat(F.lit("Source numbers: "), F.array_join(F.slice(spelled, 1, 5), "; "))).otherwise(""),
            ),
        )

    return _rows(answers, let(joined(F.col("sources")), lambda src: let(numbers(src), lambda n: let(values(n), lambda v: check(src, n, v)))))


def numerical(answers: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Numbers of the answer that the sources neither spell nor come near to: medium."""

    def check(src: Column, known: Column) -> Column:
        valued = F.transform(numbers(F.col("answer")), lambda n: F.struct(n.alias("n"), number_value(n).alias("v")))
        open_ = F.filter(valued, lambda x: x["v"].isNotNull() & ~F.contains(src, x["n"]) & ~close(x["v"], known, tolerance))
        return F.transform(open_, lambda x: _finding("numerical_validation", "medium", F.concat(F.lit("Number '"), x["n"], F.lit("' could not be verified in sources.")), x["n"]))

    return _rows(answers, let(joined(F.col("sources")), lambda src: let(values(numbers(src)), lambda v: check(src, v))))


def form(answers: DataFrame) -> DataFrame:
    """No citation or fewer than 20 words while there are sources, and code fences: low each."""
    has = F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0
    words = F.size(F.filter(F.split("answer", r"\s+"), lambda w: w != ""))
    tests = (
        (has & ~F.col("answer").rlike(r"\[Source\s+\d+\]"), "No source citations found in the response."),
        (has & (words < 20), "Response is unusually short given available sources."),
        (F.contains("answer", F.lit("```")), "Response contains code block markers."),
    )
    found = F.filter(F.array(*[F.when(t, _finding("format_check", "low", F.lit(m), F.lit(""))) for t, m in tests]), lambda f: f.isNotNull())
    return _rows(answers, found)


def findings(answers: DataFrame, check_hallucination: bool = True, check_numbers: bool = True) -> DataFrame:
    """(answer_id, check_no, no, check_name, severity, message, span, evidence) of all checks in order. A null answer has no finding."""
    checks = [factual(answers), form(answers)] + ([hallucination(answers)] if check_hallucination else []) + ([numerical(answers)] if check_numbers else [])
    return reduce(DataFrame.unionByName, [c.withColumn("check_no", F.lit(k)) for k, c in enumerate(checks)])


def of_severity(found: DataFrame, severity: str) -> DataFrame:
    """The findings of one severity: low, medium, high or critical."""
    if severity not in PENALTY:
        raise ValueError(f"unknown severity {severity!r}")
    return found.filter(F.col("severity") == severity)


def band(confidence: Column) -> Column:
    """How a confidence is shown: high from 0.8, medium from 0.6, else low."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def report(answers: DataFrame, found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(answer_id, confidence, passed, findings, high, warnings): one row for each answer; without a finding the confidence is 1."""
    cost = F.lit(OTHER_PENALTY)
    for severity, p in PENALTY.items():
        cost = F.when(F.col("severity") == severity, F.lit(p)).otherwise(cost)
    serious = F.col("severity").isin("high", "critical")
    # An answer has a few findings.
    per = found.groupBy("answer_id").agg(
        F.sum(cost).alias("cost"), F.count("*").alias("findings"), F.sum(serious.cast("int")).alias("high"),
        F.sort_array(F.collect_list(F.when(serious, F.struct("check_no", "no", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("message")).alias("w"))))).alias("w"),
    )
    rows = answers.select("answer_id").distinct().join(per, "answer_id", "left")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("cost", F.lit(0.0)))), 9)
    rows = rows.withColumn("confidence", confidence).withColumn("passed", F.col("confidence") >= threshold)
    below = F.when(~F.col("passed"), F.array(F.concat(F.lit("Confidence below threshold: "), F.round("confidence", 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.coalesce("w", F.array().cast("array<struct<check_no:int,no:int,w:string>>")), lambda x: x["w"])
    return rows.select("answer_id", "confidence", "passed", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"), F.coalesce("high", F.lit(0)).cast("bigint").alias("high"), F.concat(below, named).alias("warnings"))
