"""Retrieval strategies as plans over sets of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsight.functions.textops import sentences
from docsight.functions.vectors import Hasher, cosine

from . import dense, fusion, sparse

#: The variants of a query that need no model.
TEMPLATES = ("What does the 10-K filing say about: {}", "financial data related to {}", "SEC filing information: {}")


def expand(queries: DataFrame, rewrite: Callable[[str], str] | None = None, variants: int = 3, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, variant_no, query): the query itself as number 0, then its variants.

    ``rewrite`` is a model that answers a query with one variant on each line; blank lines are left out and the
    first ``variants`` kept. Without it, or where it raises, the three templates are used.
    """
    fixed = F.array(F.col(text_col), *[F.concat(*[p for part in zip(t.split("{}"), (F.col(text_col), None), strict=False) for p in ((F.lit(part[0]), part[1]) if part[1] is not None else (F.lit(part[0]),))]) for t in TEMPLATES])
    if rewrite is None:
        return queries.select(F.col(id_col), F.posexplode(fixed).alias("variant_no", text_col))

    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    more = [line.strip() for line in rewrite(q).split("\n") if line.strip()][:variants]
                except Exception:  # noqa: BLE001 - a failing model must not lose the query
                    more = [t.format(q) for t in TEMPLATES]
                rows += [(i, k, v) for k, v in enumerate([q, *more])]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], [id_col, "variant_no", text_col])

    return queries.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, variant_no int, {text_col} string")


def first_seen(ranked: DataFrame, k: int, id_col: str = "query_id") -> DataFrame:
    """(query_id, chunk_id, score, rank): of (query_id, variant_no, rank, chunk_id, score) each chunk keeps the score of its first variant; best ``k``, equal scores by id."""
    seen = ranked.groupBy(id_col, "chunk_id").agg(F.min(F.struct("variant_no", "rank", "score")).alias("f")).select(id_col, "chunk_id", F.col("f.score").alias("score"))
    return sparse.top(seen, k, (id_col,))


def multi_dense(vectors: DataFrame, variants: DataFrame, k: int, threshold: float | None = None, digits: int = 9) -> DataFrame:
    """``first_seen`` over dense results of every variant; ``variants`` has query_id, variant_no and embedding."""
    keyed = variants.select(F.struct("query_id", "variant_no").alias("key"), "embedding").select(F.concat_ws("\u0001", "key.query_id", "key.variant_no").alias("kid"), "key", "embedding")
    found = dense.search(vectors, keyed, k, threshold, query_col="kid", digits=digits)
    return first_seen(found.join(keyed.select("kid", "key"), "kid").select("key.query_id", "key.variant_no", "rank", "chunk_id", "score"), k)


def multi_sparse(index: sparse.SparseIndex, variants: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``first_seen`` over sparse results, each variant normalised by its own best."""
    return first_seen(sparse.search(index, variants, k, allowed, ("query_id", "variant_no")), k)


def hybrid(vectors: DataFrame, index: sparse.SparseIndex, queries: DataFrame, k: int = 5, dense_weight: float = 0.6, sparse_weight: float = 0.4, threshold: float | None = 0.3, allowed: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of the dense and the sparse leg, each fetched ``fetch_depth(k)`` deep; ``queries`` has query_id, query and embedding."""
    deep = fusion.fetch_depth(k)
    kept = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return fusion.fuse([(dense.search(kept, queries, deep, threshold, digits=digits), dense_weight), (sparse.search(index, queries, deep, allowed), sparse_weight)], k)


def rerank(results: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """The results re-scored by the cosine of query and chunk (1e-10 in the denominator), best ``n``; results without a vector are left out."""
    q = queries.select("query_id", F.col("embedding").alias("qv")).filter("qv IS NOT NULL").dropDuplicates(["query_id"])
    v = vectors.select("chunk_id", F.col("embedding").alias("cv")).filter("cv IS NOT NULL").dropDuplicates(["chunk_id"])
    scored = results.select("query_id", "chunk_id").distinct().join(v, "chunk_id").join(q, "query_id")
    return sparse.top(scored.select("query_id", "chunk_id", F.round(cosine(F.col("qv"), F.col("cv"), 1e-10), 9).alias("score")), n)


def diversify(results: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, trade: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, score, rank): greedy maximal marginal relevance.

    Each step takes the candidate with the greatest trade * sim(query) - (1 - trade) * greatest sim to those taken; of
    equals the one that came first. ``score`` is the similarity to the query. A query with ``k`` candidates or
    fewer keeps them as they were. Candidates are a query's fetched results, fifty at most, so a group is small.
    """
    v = vectors.select("chunk_id", "embedding").filter("embedding IS NOT NULL").dropDuplicates(["chunk_id"])
    q = queries.select("query_id", F.col("embedding").alias("qv")).filter("qv IS NOT NULL").dropDuplicates(["query_id"])
    kind = results.schema["query_id"].dataType.simpleString()
    rows = results.select("query_id", "chunk_id", "score", "rank").join(v, "chunk_id").join(q, "query_id")
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score", "embedding"))).alias("c"), F.first("qv").alias("qv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, c, qv in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if len(c) <= k:
                    out += [(i, r["chunk_id"], r["score"], n) for n, r in enumerate(c, 1)]
                    continue
                m = np.array([r["embedding"] for r in c], float)
                picks, near = marginal_relevance(np.array(qv, float), m, k, trade)
                out += [(i, c[j]["chunk_id"], float(near[j]), n) for n, j in enumerate(picks, 1)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32())], ["query_id", "chunk_id", "score", "rank"])

    return lists.mapInArrow(run, f"query_id {kind}, chunk_id string, score double, rank int")


def marginal_relevance(q: np.ndarray, m: np.ndarray, k: int, trade: float) -> tuple[list[int], np.ndarray]:
    """Positions picked, in order, and all similarities to the query."""
    norms = np.linalg.norm(m, axis=1)
    near = m @ q / (norms * np.linalg.norm(q) + 1e-10)
    among = m @ m.T / (np.outer(norms, norms) + 1e-10)
    taken: list[int] = []
    worst = np.zeros(len(m))
    for step in range(min(k, len(m))):
        value = np.round(trade * near - (1 - trade) * worst, 12)
        value[taken] = -np.inf
        j = int(value.argmax())
        taken.append(j)
        worst = among[j] if step == 0 else np.maximum(worst, among[j])
    return taken, near


def compress(results: DataFrame, queries: DataFrame, keep: int = 3, dim: int = 64, text_col: str = "text") -> DataFrame:
    """``results`` (query_id, chunk_id, text, ...) with the ``keep`` sentences nearest to the query, in their order, joined by a space. Texts of ``keep`` sentences or fewer stay unchanged. Null texts stay null."""
    rows = results.join(queries.select("query_id", F.col("query").alias("__q")).dropDuplicates(["query_id"]), "query_id")
    kinds = {c: results.schema[c].dataType.simpleString() for c in results.columns}
    columns = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Hasher(dim)
        for b in batches:
            texts, parts, asked = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (text_col, "__s", "__q"))
            new = []
            for t, s, q in zip(texts, parts, asked, strict=True):
                if t is None or len(s) <= keep:
                    new.append(t)
                    continue
                near = np.round(embed(s) @ embed([q or ""])[0], 12)
                best = sorted(np.argsort(-near, kind="stable")[:keep])
                new.append(" ".join(s[j] for j in best))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text_col else b.column(b.schema.get_field_index(c)) for c in columns], columns)

    rows = rows.withColumn("__s", sentences(F.col(text_col)))
    return rows.select(*results.columns, "__s", "__q").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def retrieve(vectors: DataFrame, index: sparse.SparseIndex, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 5, strategy: str = "ensemble", threshold: float | None = 0.3, trade: float = 0.3, dense_weight: float = 0.6, sparse_weight: float = 0.4, rewrite: Callable[[str], str] | None = None, reranked: bool = False, allowed: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score, rank, strategy): expand, embed, search by the strategy, optionally rerank on the query itself.

    ``embed`` turns (id, text) into (id, embedding). Unknown strategies are the ensemble, which uses the query alone. Cosines are compared to ``digits`` digits.
    """
    variants = expand(queries, rewrite)
    keyed = variants.withColumn("kid", F.concat_ws("\u0001", "query_id", "variant_no"))
    variants = keyed.join(embed(keyed.select("kid", F.col("query").alias("text"))), "kid").drop("kid")
    plain = variants.filter("variant_no = 0").select("query_id", "query", "embedding")
    kept = vectors if allowed is None else vectors.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if strategy == "dense":
        found = multi_dense(kept, variants, k, threshold, digits)
    elif strategy == "sparse":
        found = multi_sparse(index, variants, k, allowed)
    elif strategy == "mmr":
        found = diversify(multi_dense(kept, variants, fusion.fetch_depth(k), threshold, digits), kept, plain, k, trade)
    else:
        strategy = "ensemble"
        found = hybrid(vectors, index, plain, k, dense_weight, sparse_weight, threshold, allowed, digits)
    if reranked:
        found = rerank(found, vectors, plain, k)
    return found.select("query_id", "chunk_id", "score", "rank", F.lit(strategy).alias("strategy"))
