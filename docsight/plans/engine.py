"""The whole pipeline over stored tables: ingest, query, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsight.config import EngineConfig
from docsight.operators import chunking, dense, embedding, generate, graph, guardrails, metrics, retrieve, sparse
from docsight.runtime import checkpoint, settle
from docsight.sources.tables import Store


class Engine:
    """Ties the operators together; all state is in tables."""

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig | None = None, name: str = "filings"):
        settle(spark)
        self.spark, self.config, self.folder = spark, config or EngineConfig(), folder
        self.store = Store(spark, folder, name)
        self.log = self.config.configure_logging()

    def _embed(self, df: DataFrame) -> DataFrame:
        return embedding.embed(df, df.columns[0], df.columns[1], self.config.embedding_provider, self.config.embedding_dimension)

    def ingest(self, documents: DataFrame, id_col: str = "doc_id") -> int:
        """Chunks, embeds and stores documents with their metadata; how many chunks there were. The same documents give the same chunks again."""
        c = self.config
        chunks = chunking.chunk_documents(documents, id_col, "text", "section", c.chunking_strategy, c.chunk_size, c.chunk_overlap, vocabulary=c.vocabulary)
        kept = [x for x in ("company_name", "cik", "filing_date", "filing_type", "source_file", "accession_number") if x in documents.columns]
        chunks = checkpoint(chunks.join(documents.select(id_col, *kept).dropDuplicates([id_col]), id_col))
        n = self.store.upsert(chunks, self._embed(chunks.select("chunk_id", "text")))
        self.log.info("ingested %d chunks into %s", n, self.store.name)
        return n

    def index(self) -> sparse.SparseIndex:
        """The sparse index of what is stored, written once for each state of the store."""
        at = self.store.derived("sparse", lambda folder: sparse.build_index(self.store.rows()).save(folder))
        return sparse.load_index(self.spark, at)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of what is stored, written once for each state of the store."""

        def make(folder: str) -> None:
            rows = self.store.rows()
            for c in ("source_file", "company_name"):
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(""))
            section = "parent_section" if "parent_section" in rows.columns else None
            nodes, edges = graph.build_graph(graph.extract_entities(rows, "chunk_id", source_col="source_file"), graph.extract_relations(rows, "chunk_id", section_col=section), "chunk_id")
            nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
            edges.write.mode("overwrite").parquet(f"{folder}/edges")

        at = self.store.derived("graph", make)
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")

    def retrieve(self, queries: DataFrame, filters: dict | None = None, strategy: str | None = None, rewrite: Callable[[str], str] | None = None, reranked: bool = False) -> DataFrame:
        c = self.config
        rows = self.store.rows()
        allowed = rows.filter(dense.where(filters, rows.columns)).select("chunk_id") if filters else None
        return retrieve.retrieve(rows.select("chunk_id", "embedding"), self.index(), queries, self._embed, c.retrieval_top_k, strategy or c.retrieval_strategy, c.retrieval_score_threshold, c.mmr_diversity_score, c.dense_weight, c.sparse_weight, rewrite, reranked, allowed, digits=6)  # vectors are kept as floats

    def query(self, queries: DataFrame, filters: dict | None = None, use_graph: bool = True, validate: bool = True, strategy: str | None = None, run: DataFrame | None = None) -> DataFrame:
        """(query_id, query, answer, texts, model, has_sources, confidence, passed, warnings): one row for each query, also for those without sources, which keep confidence 1. ``run`` is what ``retrieve`` gave where that is at hand."""
        rows = self.store.rows()
        fields = [c for c in ("text", "section", "company_name", "filing_date") if c in rows.columns]
        found = (self.retrieve(queries, filters, strategy) if run is None else run).join(rows.select("chunk_id", *fields), "chunk_id")
        for c in ("section", "company_name", "filing_date"):
            if c not in fields:
                found = found.withColumn(c, F.lit(None).cast("string"))
        contexts = None
        if use_graph and filters and ("company" in filters or "company_name" in filters):
            nodes, edges = self.graph()
            start = self.spark.createDataFrame([(f"company::{filters.get('company', filters.get('company_name'))}",)], "node_id string")
            text = graph.context(graph.related(start, nodes, edges, 2, most=20), 20)
            contexts = queries.select("query_id", F.lit(start.first()["node_id"]).alias("seed")).join(text, "seed").select("query_id", "context")
        answers = checkpoint(generate.generate(generate.prompts(queries, generate.format_sources(found), contexts), self.config.llm_provider))
        if not validate:
            return answers.select("*", F.lit(1.0).alias("confidence"), F.lit(True).alias("passed"), F.array().cast("array<string>").alias("warnings"))
        checked = answers.filter("has_sources").select(F.col("query_id").alias("answer_id"), "answer", F.col("texts").alias("sources"))
        notes = guardrails.report(checked, guardrails.findings(checked, self.config.enable_hallucination_check, self.config.enable_numerical_validation), self.config.confidence_threshold)
        rows = answers.join(notes.select(F.col("answer_id").alias("query_id"), "confidence", "passed", "warnings"), "query_id", "left")
        return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "passed": F.coalesce("passed", F.lit(True)), "warnings": F.coalesce("warnings", F.array(F.lit("No relevant documents retrieved.")))})

    def evaluate(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, four retrieval and four generation metrics) of questions as ``load_questions`` gives them; ``metrics.averages`` sums them up."""
        run = checkpoint(self.retrieve(questions))
        answers = checkpoint(self.query(questions, run=run))
        truth = questions.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
        out = metrics.retrieval_metrics(questions, run, truth, k)
        given = answers.select(F.col("query_id").alias("answer_id"), "query", "answer", F.col("texts").alias("sources"))
        vectors = self._embed(given.select("answer_id", F.col("query").alias("text"))).toDF("answer_id", "query_vector").join(self._embed(given.select("answer_id", F.substring("answer", 1, 500).alias("text"))).toDF("answer_id", "answer_vector"), "answer_id")
        for part in (metrics.faithfulness(given), metrics.context_relevancy(given), metrics.numerical_accuracy(given), metrics.answer_relevancy(vectors)):
            out = out.join(part.withColumnRenamed("answer_id", "query_id"), "query_id", "left")
        return out

    def stats(self) -> dict:
        nodes, edges = self.graph() if self.store.count() else (None, None)
        return self.store.stats() | {"graph_nodes": nodes.count() if nodes else 0, "graph_edges": edges.count() if edges else 0, "embedding_provider": self.config.embedding_provider}

    def reset(self) -> None:
        self.store.drop()
