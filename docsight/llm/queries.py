"""The pN_ queries of this subpackage: each takes (spark, directory) and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsight.runtime import table

from . import languages, markup, names, near_duplicates, nearest_vectors, packing, rank_fusion, splitting, tokens


def _edited_copies(spark: SparkSession, d: str) -> near_duplicates.NearDuplicates:
    """Three words and 0.5, as TESTDATA.md states this problem."""
    return near_duplicates.NearDuplicates(table(spark, d, "chunks"), words=3, threshold=0.5, least=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _edited_copies(spark, d).pairs().toDF("chunk_id_a", "chunk_id_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _edited_copies(spark, d).groups().withColumnRenamed("id", "chunk_id")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank_fusion.median_rank(table(spark, d, "results"), table(spark, d, "score_legs"))
    return ranked.select("query_id", "chunk_id", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), "legs", "position")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best of each query: what the query asks for, not a cap."""
    return rank_fusion.best(table(spark, d, "results"), table(spark, d, "score_legs"), 5).select("query_id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.clean_documents(table(spark, d, "documents")).select("doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", "f.markup", "f.element").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_documents(table(spark, d, "documents")).select("doc_id", "text")


def p3_page_difference(spark: SparkSession, d: str) -> DataFrame:
    return markup.page_difference(table(spark, d, "documents"))


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of companies and persons; where the type is missing the node's id tells it."""
    kind = F.coalesce("entity_type", F.substring_index("node_id", "::", 1))
    entities = table(spark, d, "entities").select(F.lit("entity").alias("record_kind"), F.col("entity_id").cast("string").alias("record_id"), kind.alias("kind"), "name")
    filings = table(spark, d, "filings").select(F.lit("filing").alias("record_kind"), F.col("filing_id").cast("string").alias("record_id"), F.lit("company").alias("kind"), F.col("company_name").alias("name"))
    return entities.union(filings)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link_records(_typed_names(spark, d), table(spark, d, "registry"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the splitter cuts; those within the limit are one piece by definition and skip Python."""
    big = table(spark, d, "chunks").filter(F.length("text") > splitting.LIMIT)
    return splitting.split_oversized(big).filter("pieces > 1").select("chunk_id").distinct()


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest_vectors.NearestVectors(table(spark, d, "vectors")).neighbours().withColumnRenamed("id", "chunk_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every vector is a query here, as TESTDATA.md asks."""
    near = p7_neighbours(spark, d).filter("similarity >= 0.92")
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from the ids."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.identify(docs, languages.train(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong label or with passages in a second language, one row for each language."""
    rows = p10_languages(spark, d).filter("main != 'und'")
    return rows.filter("given IS NULL OR given != main OR passages > 0").select("doc_id", "lang").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_ranking, p3_found, p3_clean, p3_page_difference, p4_found, p5_found, p5_pieces, p7_found, p7_neighbours, p8_ids, p8_decoded, p9_containers, p10_found, p10_languages)}
