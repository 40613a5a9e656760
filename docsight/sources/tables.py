"""Question sets, and the stored tables of an index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "query string, ground_truth_answer string, relevant_chunk_ids array<string>, relevant_sections array<string>, expected_numbers array<string>, metadata map<string,string>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with a running query_id; only ``query`` is required, a row without it is an error when it is read."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    rows = rows.select(
        F.when(F.col("query").isNull(), F.raise_error(F.lit("a question has no query"))).otherwise(F.col("query")).alias("query"),
        F.coalesce("ground_truth_answer", F.lit("")).alias("ground_truth_answer"),
        *[F.coalesce(c, empty).alias(c) for c in ("relevant_chunk_ids", "relevant_sections", "expected_numbers")],
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    # One JSON array is one task, whose rows are numbered as they come; further files go on in numbers far behind.
    return rows.withColumn("query_id", F.monotonically_increasing_id() + 1)


def latest(df: DataFrame, key: str = "chunk_id", time_col: str = "loaded_at") -> DataFrame:
    """One row for each key, the one loaded last; of equally late ones the one with the greatest values. Null keys are left out."""
    rest = [c for c in df.columns if c not in (key, time_col)]
    plain = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    row = F.max(F.struct(F.col(time_col), *plain)).alias("r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *[F.col(f"r.{c}").alias(c) for c in (*plain, time_col)])


class Store:
    """Named collections of chunks and vectors as Parquet tables below a folder.

    An upsert appends a segment and a deletion a list of ids; of several segments the last one that holds an id wins, and a deletion
    takes the id out of all segments before it, so the sparse side never holds what the dense side has lost. After ``merge_at`` of them they are
    merged into one. What a merge replaces stays until the next merge, for plans that still read it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "filings", merge_at: int = 16):
        self.spark, self.folder, self.name, self.merge_at = spark, folder.rstrip("/"), name, merge_at

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _parts(self) -> list[tuple[int, str]]:
        """(number, kind) of what is complete, from the last merge on; kinds are merged, rows and gone."""
        fs, path = self._fs()
        base = path(f"{self.folder}/{self.name}/parts")
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base) if fs.exists(path(f"{s.getPath().toString()}/_SUCCESS"))]
        found = sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names)
        last = max((k for k, (_, kind) in enumerate(found) if kind == "merged"), default=0)
        return found[last:]

    def _at(self, number: int, kind: str) -> str:
        return f"{self.folder}/{self.name}/parts/{number:08d}-{kind}"

    def state(self) -> str:
        """Changes with every write; what is derived from the rows is kept under it."""
        return "-".join(f"{n}{kind[0]}" for n, kind in self._parts())

    def _next(self) -> int:
        parts = self._parts()
        return parts[-1][0] + 1 if parts else 1

    def rows(self) -> DataFrame | None:
        parts = self._parts()
        held = [(n, self.spark.read.parquet(self._at(n, kind))) for n, kind in parts if kind != "gone"]
        if not held:
            return None
        if len(parts) == 1:
            return held[0][1]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("__part", F.lit(n)) for n, df in held])
        gone = [self.spark.read.parquet(self._at(n, kind)).select("chunk_id", F.lit(n).alias("__part")) for n, kind in parts if kind == "gone"]
        last = reduce(DataFrame.unionByName, gone, rows.select("chunk_id", "__part")).groupBy("chunk_id").agg(F.max("__part").alias("__part"))
        return rows.join(last, ["chunk_id", "__part"]).drop("__part")

    def _settle(self) -> None:
        if len(self._parts()) >= self.merge_at:
            self.merge()

    def merge(self) -> None:
        """One part for all; what was merged before the last merge is dropped."""
        parts, rows = self._parts(), self.rows()
        if rows is None or len(parts) == 1:
            return
        rows.write.mode("overwrite").parquet(self._at(self._next(), "merged"))
        fs, path = self._fs()
        keep = parts[0][0] if parts[0][1] == "merged" else 0
        for s in fs.listStatus(path(f"{self.folder}/{self.name}/parts")):
            if int(s.getPath().getName().split("-")[0]) < keep:
                fs.delete(s.getPath(), True)

    def upsert(self, chunks: DataFrame, vectors: DataFrame) -> int:
        """Chunks with their vectors by chunk_id; how many there were. A chunk without a vector is an error, as a count that does not match would be, and nothing is stored."""
        new = chunks.dropDuplicates(["chunk_id"]).join(vectors.select("chunk_id", "embedding").dropDuplicates(["chunk_id"]), "chunk_id", "left")
        number = self._next()
        at = self._at(number, "rows")
        new.write.mode("overwrite").parquet(f"{at}.new")
        fs, path = self._fs()
        written = self.spark.read.parquet(f"{at}.new").agg(F.count("*").alias("n"), F.count("embedding").alias("with")).first()
        if written["n"] != written["with"]:
            fs.delete(path(f"{at}.new"), True)
            raise ValueError(f"{written['n'] - written['with']} chunks have no vector")
        fs.rename(path(f"{at}.new"), path(at))
        self._settle()
        return written["n"]

    def delete(self, ids: DataFrame) -> None:
        if self._parts():
            ids.select("chunk_id").distinct().write.mode("overwrite").parquet(self._at(self._next(), "gone"))
            self._settle()

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.folder}/{self.name}"), True)

    def count(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()

    def collections(self) -> list[str]:
        fs, path = self._fs()
        base = path(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()) if fs.exists(base) else []

    def stats(self) -> dict:
        return {"collection": self.name, "count": self.count(), "folder": self.folder}

    def derived(self, kind: str, make: Callable[[str], None]) -> str:
        """The folder of what ``make`` writes from the rows as they are now; made once for each state, that of other states is dropped."""
        fs, path = self._fs()
        base, at = f"{self.folder}/{self.name}/{kind}", f"{self.folder}/{self.name}/{kind}/{self.state()}"
        if not fs.exists(path(f"{at}/_SUCCESS")):
            make(at)
            fs.create(path(f"{at}/_SUCCESS")).close()
            for s in fs.listStatus(path(base)):
                if s.getPath().getName() != self.state():
                    fs.delete(s.getPath(), True)
        return at


def write_metrics(metrics: DataFrame, path: str, parameters: dict | None = None) -> None:
    """Appends a row of metrics with the run's parameters as JSON lines."""
    given = [F.lit(str(v)).alias(f"param_{k}") for k, v in (parameters or {}).items()]
    metrics.select("*", *given, F.current_timestamp().alias("logged_at")).write.mode("append").json(path)
