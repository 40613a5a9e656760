"""Knowledge graph of filings: entities and relations by patterns, a graph of the last writes, and walks over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsight.functions.textops import strip
from docsight.runtime import checkpoint

from .ranking import positions

#: The most edges of a graph that each task of a walk holds, in 10 bytes each and some 40 while they are read; larger graphs are walked by joins. Seeds that share a copy of it at most; edges looked at and rows given at once.
EDGES, SEEDS, CHUNK = 1 << 24, 512, 1 << 16

#: In walks by joins, the most rows of the front that are broadcast; parts that a hub is cut into beyond that.
FRONT, SALTS = 100_000, 16

#: Patterns of entities and relations, metric words, company suffixes.
MONEY = r"(?i)\$\s*[\d,]+\.?\d*\s*(?:billion|million|thousand|trillion)?"
PERCENT = r"(?i)\d+\.?\d*\s*(?:%|percent)"
DATE = r"(?i)(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|(?:fiscal\s+)?(?:year|quarter)\s+(?:ended?\s+)?\d{4}|(?:FY|Q[1-4])\s*\d{4})"
METRICS = (
    "revenue", "net income", "gross profit", "operating income", "ebitda", "total assets", "total liabilities", "shareholders equity", "cash flow", "operating cash flow", "free cash flow", "earnings per share", "eps", "gross margin",
    "operating margin", "net margin", "return on equity", "return on assets", "debt to equity", "current ratio", "cost of revenue", "research and development", "selling general and administrative", "depreciation", "amortization", "capital expenditures", "dividends",
)
METRIC = r"(?i)\b(?:" + "|".join(METRICS) + r")\b"
COMPANY = r"([A-Z][\p{L}\p{N}_\s&.-]+\s+(?:Inc\.|Corp\.|Corporation|Company|Ltd\.|LLC|L\.P\.|Group|Holdings))"
_NAME = r"([A-Z][\p{L}\p{N}_\s,]+?)(?:\.|,|\band\b)"
SUBSIDIARY = r"(?i)(?:subsidiary|subsidiaries|wholly[- ]owned)\s+(?:of\s+)?" + _NAME
COMPETES = r"(?i)(?:compet(?:e|es|ing|itor|itors|ition)\s+(?:with|from|include|including))\s+" + _NAME
OPERATES = r"(?i)(?:operat(?:e|es|ing)\s+in)\s+" + _NAME
#: Types of entities; those that relations tie, so that a walk can reach them.
KINDS, TIED = ("monetary_amount", "percentage", "date", "financial_metric", "company"), ("financial_metric", "company")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _entities(text: Column, kinds: tuple[str, ...]) -> Column:
    """array<struct<entity_type, name, raw>> in the order in which they are written to the graph."""

    def kind(name: str, found: Column, raw: bool) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("entity_type"), strip(m).alias("name"), (strip(m) if raw else F.lit(None).cast("string")).alias("raw")))

    metrics = F.array_distinct(F.transform(_all(text, METRIC), lambda m: F.lower(strip(m))))
    companies = F.filter(F.transform(_all(text, COMPANY, 1), strip), lambda m: F.length(m) > 3)
    found = {"monetary_amount": (_all(text, MONEY), True), "percentage": (_all(text, PERCENT), True), "date": (_all(text, DATE), True), "financial_metric": (metrics, False), "company": (companies, False)}
    return F.concat(*[kind(name, *found[name]) for name in KINDS if name in kinds])


def extract_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(id, seq, node_id, name, entity_type, source_document, raw): every mention, or those of the types that are asked; metrics once for each text. Null texts give none."""
    source = F.coalesce(F.col(source_col), F.lit("")) if source_col else F.lit("")
    rows = df.select(F.col(id_col), source.alias("source_document"), F.posexplode(_entities(F.col(text_col), kinds)).alias("seq", "e"))
    return rows.select(id_col, "seq", F.concat_ws("::", "e.entity_type", "e.name").alias("node_id"), "e.name", "e.entity_type", "source_document", "e.raw")


def extract_relations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", company_col: str = "company_name", section_col: str | None = "section") -> DataFrame:
    """(id, seq, src, dst, relation_type, source_text): subsidiaries, competitors, regions, reported metrics and the section, all tied to the row's own company; rows without a company give none."""
    text, company = F.col(text_col), F.concat(F.lit("company::"), F.col(company_col))
    empty = F.lit("")

    def found(pattern: str) -> Column:
        return F.filter(F.transform(F.arrays_zip(_all(text, pattern, 0).alias("m"), _all(text, pattern, 1).alias("n")), lambda x: F.struct(F.regexp_replace(strip(x["n"]), "[,. ]+$", "").alias("n"), F.substring(x["m"], 1, 200).alias("m"))), lambda x: F.length(x["n"]) > 2)

    def edge(src: Column, dst: Column, kind: str, written: Column) -> Column:
        return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relation_type"), written.alias("source_text"))

    subs = F.transform(found(SUBSIDIARY), lambda x: edge(F.concat(F.lit("company::"), x["n"]), company, "subsidiary_of", x["m"]))
    rivals = F.transform(found(COMPETES), lambda x: edge(company, F.concat(F.lit("company::"), x["n"]), "competes_with", x["m"]))
    regions = F.transform(found(OPERATES), lambda x: edge(company, F.concat(F.lit("location::"), x["n"]), "operates_in", x["m"]))
    metrics = F.transform(F.array_distinct(F.transform(_all(text, METRIC), lambda m: F.lower(strip(m)))), lambda m: edge(company, F.concat(F.lit("financial_metric::"), m), "reports", empty))
    parts = [subs, rivals, regions, metrics]
    if section_col:
        section = F.coalesce(F.col(section_col), empty)
        parts.append(F.when(section != "", F.array(edge(company, F.concat(F.lit("filing_section::"), section), "mentioned_in", empty))).otherwise(F.array().cast("array<struct<src:string,dst:string,relation_type:string,source_text:string>>")))
    rows = df.filter(F.coalesce(F.col(company_col), empty) != "").select(id_col, F.posexplode(F.concat(*parts)).alias("seq", "e"))
    return rows.select(id_col, "seq", "e.src", "e.dst", "e.relation_type", "e.source_text")


def build_graph(entities: DataFrame, relations: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name, entity_type, source_document, raw) and edges (src, dst, relation_type, source_text, seq), one row for each key.

    Of several writes the last in document and text order wins, attribute by attribute where later ones are null.
    Endpoints without an entity become nodes without name and type. ``seq`` orders edges by their first write.
    """
    edges = build_edges(relations, id_col)
    return build_nodes(entities, edges, id_col), edges


def build_edges(relations: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = F.struct(id_col, "seq")
    return relations.groupBy("src", "dst").agg(F.max_by("relation_type", order).alias("relation_type"), F.max_by("source_text", order).alias("source_text"), F.min(order).alias("seq"))


def build_nodes(entities: DataFrame, edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    order = F.struct(id_col, "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return entities.unionByName(ends, allowMissingColumns=True).groupBy("node_id").agg(*[last(c) for c in ("name", "entity_type", "source_document", "raw")])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges in and out; a loop counts twice."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(n, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def related(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1, relation: str | None = None, most: int | None = None) -> DataFrame:
    """(seed, node_id, name, entity_type, relation, distance, position): what a walk from each seed finds, with names. Seeds that are no nodes find nothing. Nodes are read twice: give a written table or a checkpoint."""
    start = seeds.select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    return named(walk(start, edges, depth, relation, most), nodes)


def named(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a walk found, with the names and types of its nodes."""
    names = nodes.select("node_id", F.coalesce("name", "node_id").alias("name"), F.coalesce("entity_type", F.lit("")).alias("entity_type"))
    return found.join(names, "node_id").select("seed", "node_id", "name", "entity_type", "relation", "distance", "position")


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 1, relation: str | None = None, most: int | None = None) -> DataFrame:
    """(seed, node_id, relation, distance, position): what a breadth-first walk from each seed finds, in its order.

    Edges are followed both ways, outgoing first; ``relation`` limits the edges followed; a walk ends after the first ``most`` nodes
    where those are all that is asked. A node is found once, by its first edge. Seeds without edges find nothing. What is found goes
    straight from the task of its seed to the output: only the graph, as packed numbers, is shuffled, one copy for each block of seeds.
    Edges are read several times: give a written table or a checkpoint.
    """
    followed = (edges if relation is None else edges.filter(F.col("relation_type") == relation)).select("src", "dst", "relation_type", "seq")
    start = seeds.select("node_id").distinct()
    if followed.count() > EDGES:
        found = _joined_walk(start, followed, depth)
        return found if most is None else found.filter(F.col("position") <= most)
    ends = followed.select(F.explode(F.array("src", "dst")).alias("node_id")).filter("node_id IS NOT NULL").distinct()
    numbers = checkpoint(positions(ends, [], [F.col("node_id")], "no").select("node_id", (F.col("no") - 1).cast("int").alias("no")))
    a, b = (numbers.select(F.col("node_id").alias(end), F.col("no").alias(no)) for end, no in (("src", "a"), ("dst", "b")))
    ways = F.array(*[F.struct(F.col(at).alias("at"), F.lit(way).alias("way"), F.col(to).alias("next")) for at, way, to in (("a", 0, "b"), ("b", 1, "a"))])
    steps = followed.join(a, "src").join(b, "dst").select(F.explode(ways).alias("e"), "relation_type", "seq").select("e.*", "relation_type", "seq")
    steps = steps.repartition("at").sortWithinPartitions("at", "way", "seq", "next", "relation_type").select("at", "next", "relation_type")
    packed = checkpoint(_packed(numbers, 0).union(_packed(steps, 1)))
    start = checkpoint(numbers.join(start, "node_id", "left_semi").select("no"))
    n = start.count()
    blocks = max(1, min(n, max(2 * start.sparkSession.sparkContext.defaultParallelism, -(-n // SEEDS))))
    copies = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = start.select(F.lit(2).alias("part"), F.col("no").cast("bigint").alias("first"), F.lit(None).cast("binary").alias("blob"), F.pmod("no", F.lit(blocks)).alias("block"))
    return copies.union(asked).repartitionById(blocks, F.col("block")).mapInArrow(_walker(depth, most, CHUNK), "seed string, node_id string, relation string, distance int, position bigint")


def _packed(df: DataFrame, part: int) -> DataFrame:
    """(part, first, blob): Arrow batches as one compressed value each; ``first`` puts them in the order of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first, kept = batch.column(0)[0].as_py(), pa.Table.from_batches([batch.select(names)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_table(kept)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "first", "blob"])

    names = df.columns
    return df.select(F.monotonically_increasing_id().alias("__row"), *names).mapInArrow(run, "part int, first bigint, blob binary")


def _walker(depth: int, most: int | None, chunk: int):
    """Walks from the seeds of one task, over the copy of the graph that it was given."""

    def load(blobs: list[tuple[int, bytes]]) -> tuple:
        """Names by number; where the edges of each number begin and how many there are; their far ends and relations, in the order of the walk; the relations."""
        numbers, names, at, to, kind, kinds = [], [], [], [], [], {}
        for part, blob in blobs:
            rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
            if part == 0:
                names.append(rows["node_id"].combine_chunks())
                numbers.append(rows["no"].to_numpy())
                continue
            at.append(rows["at"].to_numpy())
            to.append(rows["next"].to_numpy())
            codes = rows["relation_type"].combine_chunks().dictionary_encode(null_encoding="encode")
            known = np.array([kinds.setdefault(x, len(kinds)) for x in codes.dictionary.to_pylist()], np.int32)
            kind.append(known[codes.indices.to_numpy()].astype(np.uint8 if len(kinds) <= 256 else np.int32))
        names = pa.concat_arrays(names).take(pa.array(np.argsort(np.concatenate(numbers))))
        at, to, kind = np.concatenate(at), np.concatenate(to), np.concatenate(kind)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        begin, length = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        begin[at[first]], length[at[first]] = first, np.diff(np.r_[first, len(at)])
        return names, begin, length, to, kind, pa.array(list(kinds), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[tuple[int, int, bytes]]] = {}
        seeds: list[int] = []
        for batch in batches:
            for part, first, blob, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 2:
                    seeds.append(first)
                else:
                    blobs.setdefault(block, []).append((part, first, blob))
        if not seeds or depth < 1:
            return
        names, begin, length, to, kind, kinds = load([(part, blob) for part, _, blob in sorted(next(iter(blobs.values())), key=lambda x: x[:2])])
        blobs.clear()
        seen, slot = np.zeros(len(names), bool), np.empty(len(names), np.int64)

        def level(front: np.ndarray, wanted: int | None) -> tuple[np.ndarray, np.ndarray]:
            """The nodes that are first seen from the front, and the edges by which they are."""
            ends, a, found, edges, n = np.cumsum(length[front]), 0, [np.empty(0, to.dtype)], [np.empty(0, np.int64)], 0
            while a < len(front) and (wanted is None or n < wanted):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, "right")))
                many = length[front[a:b]]
                edge = np.arange(many.sum()) + np.repeat(begin[front[a:b]] - (np.cumsum(many) - many), many)
                edge = edge[~seen[to[edge]]]
                node, place = to[edge], np.arange(len(edge))
                slot[node[::-1]] = place[::-1]  # the first edge of each node is written last
                once = slot[node] == place
                found.append(node[once])
                edges.append(edge[once])
                seen[found[-1]] = True
                a, n = b, n + len(found[-1])
            return np.concatenate(found), np.concatenate(edges)

        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            seed, node, edge, hop, position = (np.concatenate(c) for c in zip(*held, strict=True))
            for a in range(0, len(seed), chunk):
                own = slice(a, a + chunk)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(seed[own])), names.take(pa.array(node[own])), kinds.take(pa.array(kind[edge[own]])), pa.array(hop[own]), pa.array(position[own])], ["seed", "node_id", "relation", "distance", "position"])

        for seed in sorted(seeds):
            front, n = np.array([seed], np.int64), 0
            seen[seed] = True
            walked = [front]
            for hop in range(1, depth + 1):
                wanted = None if most is None else most - n
                front, edge = level(front, wanted)
                walked.append(front)
                k = len(front) if wanted is None else min(wanted, len(front))
                if not k:
                    break
                held.append((np.full(k, seed), front[:k], edge[:k], np.full(k, hop, np.int32), np.arange(n + 1, n + k + 1)))
                n, size = n + k, size + k
            for nodes in walked:
                seen[nodes] = False
            if size >= chunk:
                yield from rows()
                held.clear()
                size = 0
        if held:
            yield from rows()

    return run


def _joined_walk(start: DataFrame, followed: DataFrame, depth: int) -> DataFrame:
    """``walk`` by joins, for graphs of any size: a join, and its shuffles and checkpoints of all that is found, for each step."""
    step = followed.select(F.col("src").alias("at"), F.col("dst").alias("next"), "relation_type", F.lit(0).alias("way"), "seq").union(followed.select(F.col("dst").alias("at"), F.col("src").alias("next"), "relation_type", F.lit(1).alias("way"), "seq"))
    seen = checkpoint(start.select(F.col("node_id").alias("seed"), "node_id", F.lit("").alias("relation"), F.lit(0).alias("distance"), F.lit(0).cast("bigint").alias("position")))
    if depth > 0:
        step = checkpoint(step.repartition("next"))
    for hop in range(1, depth + 1):
        front = seen.filter(F.col("distance") == hop - 1).select("seed", F.col("node_id").alias("at"), F.col("position").alias("parent"))
        if front.count() <= FRONT:
            reached = step.join(F.broadcast(front), "at")  # edges stay where their far ends are, so a hub is no single task
        else:
            salted = front.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            reached = step.withColumn("salt", F.pmod(F.xxhash64("next"), F.lit(SALTS)).cast("int")).join(salted, ["at", "salt"])
        once = reached.groupBy("seed", "next").agg(F.min(F.struct("parent", "way", "seq", "relation_type")).alias("f"))
        once = checkpoint(once.join(seen.select("seed", F.col("node_id").alias("next")), ["seed", "next"], "left_anti"))
        base = seen.groupBy("seed").agg(F.max("position").alias("base"))
        placed = positions(once, ["seed"], [F.col("f.parent"), F.col("f.way"), F.col("f.seq"), F.col("next")], "p").join(base, "seed")
        new = placed.select("seed", F.col("next").alias("node_id"), F.col("f.relation_type").alias("relation"), F.lit(hop).alias("distance"), (F.col("base") + F.col("p")).alias("position"))
        seen = checkpoint(seen.unionByName(new))
    return seen.filter("distance > 0")


def context(found: DataFrame, most: int = 20) -> DataFrame:
    """(seed, context): a head line and the first ``most`` nodes of each walk, one on a line."""
    line = F.concat(F.lit("  - ["), F.col("relation"), F.lit("] "), F.col("name"), F.lit(" (type: "), F.col("entity_type"), F.lit(", hops: "), F.col("distance").cast("string"), F.lit(")"))
    lines = found.filter(F.col("position") <= most).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("Knowledge Graph Context for "), F.regexp_replace("seed", "^[^:]*::", ""), F.lit(":"))
    return lines.select("seed", F.array_join(F.concat(F.array(head), F.transform("l", lambda x: x["line"])), "\n").alias("context"))


def summary(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node_id, direction, relation_type, other, other_name): what each node, or each seed, is tied to, a row for each tie, so that hubs need no list."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit("out").alias("direction"), "relation_type", F.col("dst").alias("other")).union(edges.select(F.col("dst"), F.lit("in"), F.col("relation_type"), F.col("src")))
    if seeds is not None:
        ends = ends.join(seeds.select("node_id").distinct(), "node_id", "left_semi")
    named = nodes.select(F.col("node_id").alias("other"), F.coalesce("name", "node_id").alias("other_name"))
    return ends.join(named, "other").select("node_id", "direction", "relation_type", "other", "other_name")


def serialise(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): one JSON object for each node and edge, ready to be written as text."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(F.col("node_id").alias("id"), "name", "entity_type", "source_document", "raw")).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation_type", "source_text"))))
