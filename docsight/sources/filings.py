"""Filings from files, folders, streams of files, remote feeds and plain text."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsight.operators.sections import load_documents

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def read_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(source_file, text): whole files; bytes that are no UTF-8 become U+FFFD. A missing path is an error."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def load_directory(spark: SparkSession, path: str, glob: str = "*.txt", company_name: str = "", filing_date: str = "") -> DataFrame:
    """Documents, one for each section, of all files of a folder; unreadable files are left out."""
    files = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return load_documents(files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text")), "text", company_name, filing_date)


def from_text(spark: SparkSession, text: str, company_name: str = "", section: str = "", filing_date: str = "") -> DataFrame:
    """One document as given: neither cleaned nor cut into sections."""
    row = (text, company_name, "", filing_date, "10-K", section, "", "")
    return spark.createDataFrame([row], "text string, company_name string, cik string, filing_date string, filing_type string, section string, source_file string, accession_number string")


def feed_entries(feed: Column, count: int = 5) -> Column:
    """array<struct<accession_number, filing_date, index_url>> of an Atom feed's first ``count`` entries; those without number or link are left out."""
    entries = F.slice(F.regexp_extract_all(feed, F.lit(r"(?s)<entry>(.+?)</entry>"), F.lit(1)), 1, count)
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, r"accession-number.*?>([\d-]+)<", 1).alias("accession_number"),
            F.regexp_extract(e, r"<filing-date>(\d{4}-\d{2}-\d{2})</filing-date>", 1).alias("filing_date"),
            F.regexp_extract(e, r'<link[^>]+href="([^"]+)"', 1).alias("index_url"),
        ),
    )
    return F.filter(parsed, lambda p: (p["accession_number"] != "") & (p["index_url"] != ""))


def document_url(cik: Column, accession: Column) -> Column:
    """Where a filing's text lies: the number without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(ARCHIVE), F.regexp_replace(cik, "^0+", ""), F.replace(accession, F.lit("-"), F.lit("")), F.concat(accession, F.lit(".txt")))


class _Part(InputPartition):
    """Filings of one task, as (accession number, date), and how long it waits before each, so that all tasks together keep the rate."""

    def __init__(self, filings: list[tuple[str, str]], wait: float):
        self.filings, self.wait = filings, wait


class RemoteFilings(DataSource):
    """``spark.read.format("remote_filings")``: the filings of a feed.

    Options: ``cik``, ``company`` (given to every row if not empty), ``feed`` (the feed's text), ``count``, ``rate`` (requests a second of all tasks together), ``tasks`` (4) that the filings
    are dealt to. ``fetch`` is replaced by the caller, as there is no network here; a filing that it gives None for, or that raises, is left out.
    """

    fetch: Callable[[str], str | None] = staticmethod(lambda url: None)

    @classmethod
    def name(cls) -> str:
        return "remote_filings"

    def schema(self) -> str:
        return "source_file string, company_name string, cik string, accession_number string, filing_date string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).fetch)


class _Reader(DataSourceReader):
    def __init__(self, options, fetch):
        self.options, self.fetch = dict(options), fetch

    def partitions(self) -> list[InputPartition]:
        found = []
        for e in re.findall(r"<entry>(.+?)</entry>", self.options.get("feed", ""), re.S)[: int(self.options.get("count", 5))]:
            number, link, date = (re.search(p, e) for p in (r"accession-number.*?>([\d-]+)<", r'<link[^>]+href="([^"]+)"', r"<filing-date>(\d{4}-\d{2}-\d{2})</filing-date>"))
            if number and link:
                found.append((number[1], date[1] if date else ""))
        tasks = max(1, min(int(self.options.get("tasks", 4)), len(found)))
        return [_Part(found[k::tasks], tasks / float(self.options.get("rate", 10))) for k in range(tasks)]

    def read(self, part: _Part) -> Iterator[tuple]:
        cik = self.options.get("cik", "")
        for number, date in part.filings:
            time.sleep(part.wait)
            try:
                text = self.fetch(f"{ARCHIVE}/{cik.lstrip('0')}/{number.replace('-', '')}/{number}.txt")
            except Exception:  # noqa: BLE001 - a filing that cannot be had is left out
                text = None
            if text is not None:
                yield f"edgar://{cik}/{number}", self.options.get("company", ""), cik, number, date, text
