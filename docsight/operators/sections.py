"""Sections of filings: found by their headings, sliced up to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.functions.textops import ascii_lower, clean, header, let, strip

#: The headings of the sections, in order; the first pattern that matches counts.
SECTIONS = {
    "Business": (r"(?i)item\s+1[\.\s]*[-—]?\s*business", r"(?i)part\s+i\s*[\n\r]+\s*item\s+1\b"),
    "Risk Factors": (r"(?i)item\s+1a[\.\s]*[-—]?\s*risk\s+factors",),
    "Properties": (r"(?i)item\s+2[\.\s]*[-—]?\s*properties",),
    "Legal Proceedings": (r"(?i)item\s+3[\.\s]*[-—]?\s*legal\s+proceedings",),
    "MD&A": (r"(?i)item\s+7[\.\s]*[-—]?\s*management'?s?\s+discussion",),
    "Financial Statements": (r"(?i)item\s+8[\.\s]*[-—]?\s*financial\s+statements",),
    "Controls and Procedures": (r"(?i)item\s+9a[\.\s]*[-—]?\s*controls?\s+and\s+procedures",),
}
WHOLE = "Full Document"


def boundaries(text: Column) -> Column:
    """array<struct<at, k, name>> of the first heading of each section, by position (from 1)."""

    def first(low: Column, pattern: str) -> Column:
        # What stands before the match; regexp_instr would count UTF-16 units, not characters.
        return let(F.split(low, pattern.removeprefix("(?i)"), 2), lambda s: F.when(F.size(s) > 1, F.length(s[0]) + 1))

    def all_(low: Column) -> Column:
        found = [F.struct(F.coalesce(*[first(low, p) for p in patterns]).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, patterns) in enumerate(SECTIONS.items())]
        return F.array_sort(F.filter(F.array(*found), lambda b: b["at"].isNotNull()))

    return let(ascii_lower(text), all_)


def cut_sections(text: Column) -> Column:
    """array<struct<name, body>>: the sections of a text, or all of it as "Full Document"."""

    def cut(b: Column) -> Column:
        body = lambda x, i: strip(F.substring(text, x["at"], F.coalesce(F.try_element_at(b, i + 2)["at"], F.length(text) + 1) - x["at"]))
        parts = F.filter(F.transform(b, lambda x, i: F.struct(x["name"].alias("name"), body(x, i).alias("body"))), lambda x: x["body"] != "")
        return F.when(F.size(b) == 0, F.array(F.struct(F.lit(WHOLE).alias("name"), text.alias("body")))).otherwise(parts)

    return let(boundaries(text), cut)


def parse_sections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one row for each section: ``section``, ``section_no`` (from 0) and its stripped ``section_text``.

    Without any heading the whole text is the section "Full Document"; text before the first heading and
    blank sections are left out; null texts give no row.
    """
    rows = df.filter(F.col(text_col).isNotNull()).select(*df.columns, F.posexplode(cut_sections(F.col(text_col))).alias("section_no", "__p"))
    return rows.select(*df.columns, "section_no", F.col("__p.name").alias("section"), F.col("__p.body").alias("section_text"))


def load_documents(raw: DataFrame, text_col: str = "text", company_name: str = "", filing_date: str = "") -> DataFrame:
    """Documents, one for each section, of raw filings: cleaned, with header fields; the caller's company and date win if not empty. Null texts give no row."""

    def read(text: Column) -> Column:
        fields = header(text)
        if company_name:
            fields["company_name"] = F.lit(company_name)
        if filing_date:
            fields["filing_date"] = F.lit(filing_date)
        return F.struct(*[c.alias(n) for n, c in fields.items()], cut_sections(text).alias("sections"))

    names = ["company_name", "cik", "filing_date", "accession_number"]
    kept = [c for c in raw.columns if c not in (text_col, *names, "filing_type", "section", "section_no")]
    rows = raw.filter(F.col(text_col).isNotNull()).select(*kept, let(clean(F.col(text_col)), read).alias("__r"))
    rows = rows.select(*kept, *[F.col(f"__r.{n}").alias(n) for n in names], F.lit("10-K").alias("filing_type"), F.posexplode("__r.sections").alias("section_no", "__p"))
    return rows.select(*kept, *names, "filing_type", "section_no", F.col("__p.name").alias("section"), F.col("__p.body").alias(text_col))
