"""Text functions over columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it, the entities that cleaning replaces in this order.
SPACE = "\\s\\x0b\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8212;", " -- "))
#: What a number looks like, which claims carry one, and how a sentence that talks about the sources begins.
NUMBER = r"(?i)\$?\s*\d[\d,]*\.?\d*\s*(?:billion|million|thousand|trillion|%|percent)?"
CLAIM = (
    r"(?i)(?:revenue|income|profit|loss|earnings|ebitda|margin|growth|debt|assets|liabilities|equity|cash\s+flow|expense|cost|sales|dividend|eps|share\s+price)"
    r"\s*(?:of|was|were|is|totaled|totalled|reached|increased|decreased|grew|declined)[^.]*?(\$?\s*\d[\d,]*\.?\d*\s*(?:billion|million|thousand|trillion|%|percent)?)"
)
META = r"(?i)^(?:based on|according to|the sources|as mentioned)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used; the optimizer may otherwise repeat it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, so that every character keeps its place."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(c: Column) -> Column:
    """A filing's text without tags, entities, runs of spaces and blank lines, and rule lines; null stays null."""
    text = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.translate(text, " \t", "  ")
    for pattern, new in ((" {2,}", " "), ("\n{3,}", "\n\n"), ("\n[-=_]{3,}\n", "\n")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def header(c: Column) -> dict[str, Column]:
    """The four fields of a filing's header; the empty string where one is missing."""
    date = F.regexp_extract(c, r"(?i)FILED AS OF DATE:\s*(\d{8})", 1)
    return {
        "company_name": strip(F.regexp_extract(c, r"(?i)COMPANY CONFORMED NAME:\s*([^\n]+)", 1)),
        "cik": F.regexp_extract(c, r"(?i)CENTRAL INDEX KEY:\s*(\d+)", 1),
        "filing_date": F.when(date != "", F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))).otherwise(""),
        "accession_number": F.regexp_extract(c, r"(?i)ACCESSION NUMBER:\s*([\d-]+)", 1),
    }


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def content_words(c: Column) -> Column:
    """Tokens of four characters or more, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]{4,}"), F.lit(0))


def token_count(c: Column) -> Column:
    """Words and single signs; stands in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"), F.lit(0)))


def sentences(c: Column) -> Column:
    """The text cut behind . ! ? before white space; stripped, blank ones left out."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def numbers(c: Column) -> Column:
    """All numbers as written, with sign words and scale."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), strip), lambda s: s != "")


def claims(c: Column) -> Column:
    """The numbers of financial claims."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(CLAIM), F.lit(1)), strip), lambda s: s != "")


def number_value(c: Column) -> Column:
    """The value of a written number; a percentage keeps its number; null if it cannot be read."""

    def read(text: Column) -> Column:
        scale, word = F.lit(1.0), F.lit("%")
        for name, factor in (("thousand", 1e3), ("million", 1e6), ("billion", 1e9), ("trillion", 1e12)):
            has = F.contains(text, F.lit(name))
            scale, word = F.when(has, F.lit(factor)).otherwise(scale), F.when(has, F.lit(name)).otherwise(word)
        value = F.nullif(strip(F.regexp_replace(F.replace(text, word, F.lit("")), "%|percent", "")), F.lit("")).try_cast("double")
        return F.when(F.contains(text, F.lit("%")) | F.contains(text, F.lit("percent")), value).otherwise(value * scale)

    return let(strip(F.regexp_replace(F.lower(strip(c)), "[$,]", "")), read)
