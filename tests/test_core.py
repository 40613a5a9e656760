"""The core against plain-Python models, invariants, SQL and hostile input."""

import json
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsight.config import EngineConfig
from docsight.functions import textops as t
from docsight.functions import vectors as v
from docsight.operators import chunking, dense, embedding, fusion, generate, graph, guardrails, metrics, retrieve, sections, sparse, units
from docsight.operators.ranking import positions
from docsight.plans import catalog
from docsight.plans.engine import Engine
from docsight.runtime import scratch
from docsight.sources import filings, tables
from docsight.streaming.ingest import event_counts, filing_stream, ingest_stream

DATA = Path("/root/testdata/sf0.001")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("<p>a</p>\n\n\n\nb", "a \n\nb"), ("x &amp;lt; y \tz", "x < y z"), ("a\n---\n===\nb", "a\n===\nb"), ("   hi\n", "hi"), ("", ""), (None, None), ("&#8217;&#8212;", "' --")],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, t.clean) == clean


def test_header(spark):
    text = "Company Conformed Name:  ACME Inc. \nCENTRAL INDEX KEY: 0001\nFILED AS OF DATE: 20240131\nACCESSION NUMBER: 1-2-3"
    for given, expected in ((text, ("ACME Inc.", "0001", "2024-01-31", "1-2-3")), ("nothing", ("", "", "", "")), ("", ("", "", "", ""))):
        row = spark.createDataFrame([(given,)], "t string").select(*[c.alias(n) for n, c in t.header(F.col("t")).items()]).first()
        assert tuple(row) == expected


@pytest.mark.parametrize(("text", "value"), [("$1.2 billion", 1.2e9), ("1,234,567", 1234567.0), ("12.5%", 12.5), ("5 percent", 5.0), ("2024.", 2024.0), ("3 Million", 3e6), ("abc", None), ("", None), (None, None)])
def test_number_value(spark, text, value):
    assert one(spark, text, t.number_value) == value


def test_numbers_keep_their_quirks(spark):
    assert one(spark, "In 2024. See [Source 1]: $3.5 million, 7%", t.numbers) == ["2024.", "1", "$3.5 million", "7%"]


def test_sections(spark):
    text = "preface 😀\nItem 1. Business\nWe sell.\nITEM 1A - Risk Factors\nRisk.\nItem 7. Management's Discussion\nFine."
    df = spark.createDataFrame([(1, text, "old"), (2, "no headings", "old"), (3, None, "old"), (4, "", "old")], "doc_id int, text string, own string")
    out = {(r["doc_id"], r["section"]): r["section_text"] for r in sections.parse_sections(df).collect()}
    assert out[1, "Business"] == "Item 1. Business\nWe sell." and out[1, "Risk Factors"].endswith("Risk.") and out[1, "MD&A"].endswith("Fine.")
    assert out[2, "Full Document"] == "no headings" and not any(k == 3 for k, _ in out)
    assert sections.parse_sections(df.limit(0)).count() == 0


# Chunking


@pytest.mark.parametrize("seed", range(5))
def test_recursive_split_invariants(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "end. ", "what? ", "\n", "\n\n", "x" * 30, ", "]) for _ in range(400))
    pieces = chunking.recursive_split(text, 120, 0)
    assert all(p.strip() for p in pieces) and max(map(len, pieces)) <= 120
    letters = lambda s: re.sub(r"[\s.?,]", "", s)
    assert letters("".join(pieces)) == letters(text)
    lapped = chunking.recursive_split(text, 120, 20)
    assert len(lapped) >= 2


def test_recursive_split_cases():
    assert chunking.recursive_split("", 100, 10) == [] and chunking.recursive_split("  ", 100, 10) == [] and chunking.recursive_split(" a ", 100, 10) == [" a "]
    assert [len(p) for p in chunking.recursive_split("y" * 250, 100, 20)] == [100, 100, 90, 10]
    assert chunking.recursive_split("aaaa|||bbbb", 5, 0, ("|||",)) == ["aaaa", "bbbb"]
    assert chunking.recursive_split("one two. three four. five six", 12, 3) == ["one two", "two three four", "our five six"]
    with pytest.raises(ValueError, match="overlap"):
        chunking.recursive_split("x", 10, 10)


def test_section_and_semantic_split():
    text = "intro line is long enough to stay and it goes on\nSupply Chain Risks\nWe depend on few vendors.\nRegulatory Risks\nRules change."
    labels = dict.fromkeys(label for label, _ in chunking.section_split(text, "Risk Factors", 400, 50))
    assert list(labels) == ["Risk Factors", "Risk Factors > Supply Chain Risks", "Risk Factors > Regulatory Risks"]
    embed = lambda s: np.array([[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in s])
    assert chunking.semantic_split("A cat sat. A cat ran. Dogs bark. Dogs run.", embed, 0.75, 5) == ["A cat sat. A cat ran.", "Dogs bark. Dogs run."]
    assert chunking.semantic_split("Only one.", embed) == ["Only one."] and chunking.semantic_split(" ", embed) == []


def test_chunk_documents(spark):
    rows = [(1, "Supply Risks Here\n" + "word " * 300, "Risk Factors"), (2, None, "x"), (3, " ", None), (4, "short", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, section string, chunk_index string")
    for strategy in ("recursive", "semantic", "section_aware", "other"):
        out = chunking.chunk_documents(df, strategy=strategy, size=400, overlap=50).collect()
        assert {r["doc_id"] for r in out} == {1, 4}
        assert sorted(r["chunk_index"] for r in out if r["doc_id"] == 1) == list(range(sum(r["doc_id"] == 1 for r in out)))
        assert len({r["chunk_id"] for r in out}) == len(out) and all(r["token_count"] > 0 for r in out)
    assert chunking.chunk_documents(df.limit(0)).count() == 0
    windows = chunking.hard_windows(df, size=400, overlap=100)
    assert {r["doc_id"] for r in windows.collect()} == {1, 4} and chunking.hard_windows(df.limit(0)).count() == 0


# Retrieval

CORPUS = [("a", "net income rose in the winter"), ("b", "income income fell"), ("c", "storms hit the fleet"), ("d", None), ("e", "")]


def test_bm25_model(spark):
    df = spark.createDataFrame(CORPUS, "chunk_id string, text string")
    index = sparse.build_index(df)
    got = {r["chunk_id"]: r["score"] for r in sparse.scores(index, spark.createDataFrame([(1, "Income income the")], "query_id int, query string")).collect()}
    docs = {k: (x or "").split() for k, x in CORPUS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df_ = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df_.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else floor for w, x in raw.items()}
    model = {k: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in ("income", "income", "the") if w in d) for k, d in docs.items()}
    assert got == {k: pytest.approx(s, abs=1e-8) for k, s in model.items() if any(w in docs[k] for w in ("income", "the"))}
    asked = spark.createDataFrame([(1, "income"), (2, "zzz"), (3, None)], "query_id int, query string")
    top = sparse.search(index, asked, 2).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 1), (1, 2)] and top[0]["score"] <= 1
    filled = sparse.search(index, asked.limit(1), 4, include_zero=True).collect()
    assert len(filled) == 4 and sum(r["score"] == 0 for r in filled) == 2
    assert sparse.search(sparse.build_index(df.limit(0)), asked, 2).count() == 0


def test_the_best_are_the_first_of_all_scores(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"c{k:04d}", " ".join(["the", *rng.choices(words, k=rng.randint(0, 12))])) for k in range(1500)] + [("null", None), ("z", "w1 " * 20_000)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    index = sparse.build_index(df)
    asked = spark.createDataFrame([(q, v, " ".join(["the", *rng.choices([*words, "absent"], k=5)])) for q in range(40) for v in range(2)] + [(99, 0, None), (98, 0, "")], "query_id int, variant_no int, query string")
    allowed = df.filter("chunk_id < 'c0900'").select("chunk_id")
    cols = ("query_id", "variant_no")
    whole = {k: [tuple(r) for r in sparse.top(x, 7, cols, "share").select(*cols, "rank", "chunk_id", "score", "share").collect()] for k, x in (("all", sparse.scores(index, asked, cols)), ("some", sparse.scores(index, asked, cols).join(allowed, "chunk_id", "left_semi")))}
    for limit in (400_000, 100):
        monkeypatch.setattr(sparse, "PASS_TERMS", limit)
        for k, some in (("all", None), ("some", allowed)):
            got = [tuple(r) for r in sparse.best(index, asked, 7, some, cols).select(*cols, "rank", "chunk_id", "score", "share").collect()]
            assert sorted(got) == sorted(whole[k]) and len(got) == 80 * 7


def test_index_is_read_back(spark, tmp_path):
    index = sparse.build_index(spark.createDataFrame(CORPUS, "chunk_id string, text string"))
    index.save(str(tmp_path))
    asked = spark.createDataFrame([(1, "income in the fleet")], "query_id int, query string")
    assert sorted(sparse.best(sparse.load_index(spark, str(tmp_path)), asked, 3).collect()) == sorted(sparse.best(index, asked, 3).collect())
    halves = lambda c: F.split(F.lower(c), "(?<=^..)")  # noqa: E731 - any tokenizer will do
    own = sparse.build_index(spark.createDataFrame([("a", "abxx"), ("b", "cdyy")], "chunk_id string, text string"), tokenizer=halves)
    assert [r["chunk_id"] for r in sparse.best(own, spark.createDataFrame([(1, "ABzz")], "query_id int, query string"), 3, tokenizer=halves).collect()] == ["a"]


def test_positions_in_a_crowded_group(spark):
    df = spark.range(3000).selectExpr("if(id < 2500, null, id % 3) AS g", "id", "'x' AS part").repartition(4)
    got = {}
    for r in positions(df, ["g"], [F.col("id").desc()]).collect():
        got.setdefault(r["g"], []).append((r["position"], r["id"]))
    assert set(got) == {None, 0, 1, 2}
    for rows in got.values():
        assert [p for p, _ in sorted(rows)] == list(range(1, len(rows) + 1)) and [i for _, i in sorted(rows)] == sorted((i for _, i in rows), reverse=True)
    assert positions(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_a_walk_beyond_the_broadcast_bound_is_the_same(spark, monkeypatch):
    edges = spark.range(300).selectExpr("concat('n', id) AS src", "if(id % 3 = 0, 'hub', concat('n', id + 1)) AS dst", "'x' AS relation_type", "'' AS source_text", "named_struct('doc_id', id, 'seq', 0) AS seq")
    nodes = edges.selectExpr("explode(array(src, dst)) AS node_id").distinct().selectExpr("node_id", "node_id AS name", "'t' AS entity_type")
    seeds = nodes.filter("node_id IN ('n3', 'n7', 'hub')")
    small = sorted(graph.related(seeds, nodes, edges, 2).collect())
    monkeypatch.setattr(graph, "FRONT", 0)
    assert sorted(graph.related(seeds, nodes, edges, 2).collect()) == small and len(small) > 300


def test_dense_search(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id int, embedding array<double>")
    for bucket in (1, 65_536):
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in dense.search(df, q, 2, block=1, bucket_rows=bucket).collect()}
        assert got == {(1, 1): ("a", 1.0), (1, 2): ("b", 0.6), (2, 1): ("c", 1.0), (2, 2): ("b", 0.8)}
    assert dense.search(df, q, 2, 0.9).count() == 2 and dense.search(df.limit(0), q, 2).count() == 0 and dense.search(df, q.limit(0), 2).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "A", "Risk > x", "Risk", "2020-05-01"), (2, "B", "Risk", "Risk", "2021-01-01"), (3, None, "MD&A", None, None)], "id int, company_name string, section string, parent_section string, filing_date string")
    ids = lambda f: {r["id"] for r in df.filter(dense.where(f, df.columns)).collect()}
    assert ids(None) == {1, 2, 3} and ids({"section": "Risk"}) == {1, 2} and ids({"company": "A"}) == {1} and ids({"filing_year": 2021}) == {2}
    assert ids({"filing_date": ("2020-01-01", "2020-12-31")}) == {1} and ids({"nowhere": 1}) == set()


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(1, i, k) for k, i in enumerate(ids, 1)], "query_id int, chunk_id string, rank int")
    out = {r["chunk_id"]: (r["rank"], r["score"]) for r in fusion.fuse([(leg("abc"), 0.6), (leg("cd"), 0.4)], 3).collect()}
    assert out["c"] == (1, pytest.approx(0.6 / 63 + 0.4 / 61)) and out["a"] == (2, pytest.approx(0.6 / 61)) and len(out) == 3
    assert [fusion.fetch_depth(k) for k in (1, 5, 30)] == [3, 15, 50]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "cash")], "query_id int, query string")
    plain = [r["query"] for r in retrieve.expand(q).orderBy("variant_no").collect()]
    assert plain == ["cash", *(x.format("cash") for x in retrieve.TEMPLATES)]
    assert [r["query"] for r in retrieve.expand(q, lambda s: f"{s} one\n\n {s} two\nthree\nfour").orderBy("variant_no").collect()] == ["cash", "cash one", "cash two", "three"]

    def broken(s):
        raise RuntimeError(s)

    assert [r["query"] for r in retrieve.expand(q, broken).orderBy("variant_no").collect()] == plain


def test_marginal_relevance_ends():
    rng = np.random.default_rng(4)
    m, q = rng.normal(size=(12, 6)), rng.normal(size=6)
    picks, near = retrieve.marginal_relevance(q, m, 5, 1.0)
    assert picks == list(np.argsort(-near, kind="stable")[:5])
    picks, _ = retrieve.marginal_relevance(q, m, 4, 0.0)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    assert picks[0] == 0 and all(s[p, picks[:n]].max() <= min(s[j, picks[:n]].max() for j in range(12) if j not in picks[:n]) + 1e-9 for n, p in enumerate(picks) if n)


def test_diversify_rerank_compress(spark):
    rows = [(f"c{k}", [float(x) for x in np.random.default_rng(k).normal(size=4)]) for k in range(8)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "cat", rows[0][1])], "query_id int, query string, embedding array<double>")
    found = dense.search(vectors, q, 8)
    assert {r["chunk_id"] for r in retrieve.diversify(found, vectors, q, 8).collect()} == {r[0] for r in rows}
    top = retrieve.diversify(found, vectors, q, 3, 1.0).orderBy("rank").collect()
    assert [r["chunk_id"] for r in top] == [r["chunk_id"] for r in found.orderBy("rank").limit(3).collect()]
    assert retrieve.rerank(found, vectors, q, 1).first()["chunk_id"] == "c0"
    texts = spark.createDataFrame([(1, "a", "Dogs. A cat sat. Birds. My cat. Fish. cat cat."), (1, "b", "One. Two."), (1, "c", None)], "query_id int, chunk_id string, text string")
    out = {r["chunk_id"]: r["text"] for r in retrieve.compress(texts, q).collect()}
    assert out == {"a": "A cat sat. My cat. cat cat.", "b": "One. Two.", "c": None}


# Graph


def test_every_retrieved_chunk_is_compressed(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/results.parquet").collect() if r["score"] is not None and not math.isnan(r["score"])]
    known = {r["chunk_id"] for r in spark.read.parquet(f"{DATA}/chunks.parquet").select("chunk_id").collect()}
    out = [(r["query_id"], r["chunk_id"]) for r in catalog.QUERIES["sentence_compress"](spark, str(DATA)).collect()]
    assert sorted(out) == sorted({(r["query_id"], r["chunk_id"]) for r in rows if r["chunk_id"] in known})


def test_graph(spark):
    text = "Beta Corp. operates in France. We compete with Gamma and others. Revenue was $5 million, up 3% in fiscal year 2020. A subsidiary of Delta, revenue again."
    df = spark.createDataFrame([(1, text, "Acme", "MD&A"), (2, None, "Acme", "MD&A"), (3, "We compete with Gamma.", "", None), (4, "", None, None)], "doc_id int, text string, company_name string, section string")
    entities = graph.extract_entities(df)
    assert {(r["entity_type"], r["name"]) for r in entities.collect()} >= {("monetary_amount", "$5 million"), ("percentage", "3%"), ("date", "fiscal year 2020"), ("financial_metric", "revenue"), ("company", "Beta Corp.")}
    assert entities.filter("name = 'revenue'").count() == 1
    relations = graph.extract_relations(df)
    kinds = {(r["src"], r["relation_type"], r["dst"]) for r in relations.collect()}
    assert {("company::Acme", "competes_with", "company::Gamma"), ("company::Delta", "subsidiary_of", "company::Acme"), ("company::Acme", "operates_in", "location::France"), ("company::Acme", "reports", "financial_metric::revenue"), ("company::Acme", "mentioned_in", "filing_section::MD&A")} <= kinds
    nodes, edges = graph.build_graph(entities, relations)
    assert {r["node_id"]: r["degree"] for r in graph.degrees(nodes, edges).collect()}["company::Acme"] == edges.count()
    assert nodes.count() == nodes.select("node_id").distinct().count()
    assert graph.serialise(nodes, edges).count() == nodes.count() + edges.count()
    assert all(json.loads(r["json"]) for r in graph.serialise(nodes, edges).collect())


def test_walk_is_breadth_first(spark):
    links = [("a", "b", "x"), ("a", "c", "y"), ("d", "a", "x"), ("b", "e", "x"), ("c", "e", "x"), ("e", "f", "x"), ("a", "a", "x")]
    edges = spark.createDataFrame([(*e, "", (0, n)) for n, e in enumerate(links)], "src string, dst string, relation_type string, source_text string, seq struct<doc_id:int,seq:int>")
    nodes = spark.createDataFrame([(k, k.upper() if k < "e" else None, None) for k in "abcdef"], "node_id string, name string, entity_type string")
    seeds = spark.createDataFrame([("a",), ("nowhere",), ("f",), ("a",)], "node_id string")
    out = [(r["seed"], r["node_id"], r["name"], r["relation"], r["distance"]) for r in graph.related(seeds, nodes, edges, 2).orderBy("seed", "position").collect()]
    assert out == [("a", "b", "B", "x", 1), ("a", "c", "C", "y", 1), ("a", "d", "D", "x", 1), ("a", "e", "e", "x", 2), ("f", "e", "e", "x", 1), ("f", "b", "B", "x", 2), ("f", "c", "C", "x", 2)]
    assert [r["node_id"] for r in graph.related(seeds.limit(1), nodes, edges, 1, "y").collect()] == ["c"]
    lines = graph.context(graph.related(seeds.limit(1), nodes, edges, 1), 2).first()["context"].split("\n")
    assert lines == ["Knowledge Graph Context for a:", "  - [x] B (type: , hops: 1)", "  - [y] C (type: , hops: 1)"]
    assert graph.summary(nodes, edges, seeds.limit(1)).filter("direction = 'in'").count() == 2


def test_registered_walks_follow_every_relation_two_steps(spark, tmp_path):
    rows = [(1, "Revenue rose.", "Acme", "MD&A", "a.txt"), (2, "Revenue fell. We compete with Gamma.", "Beta", "Risk Factors", "b.txt")]
    spark.createDataFrame(rows, "doc_id bigint, text string, company_name string, section string, source_file string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(50, "Acme")], "filing_id bigint, company_name string").write.parquet(f"{tmp_path}/filings.parquet")
    found = {(r["node_id"], r["distance"]) for r in catalog.QUERIES["kg_related"](spark, str(tmp_path)).collect()}
    assert found == {("financial_metric::revenue", 1), ("filing_section::MD&A", 1), ("company::Beta", 2)}
    assert "company::Beta" in catalog.QUERIES["kg_context"](spark, str(tmp_path)).first()["context"]


def _tied_by_hubs(spark, folder, n):
    """``n`` companies, all of them seeds, that meet in a metric and a section; what a query over them writes below the checkpoint folder, in bytes."""
    spark.range(n).selectExpr("id AS doc_id", "'Revenue rose.' AS text", "concat('Acme ', id) AS company_name", "'MD&A' AS section", "'a.txt' AS source_file").write.parquet(f"{folder}/documents.parquet")
    spark.range(n).selectExpr("id * 50 AS filing_id", "concat('Acme ', id) AS company_name").write.parquet(f"{folder}/filings.parquet")
    shared = Path(scratch(spark, "x").removeprefix("file:")).parent
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())

    def run(name):
        before = size()
        rows = catalog.QUERIES[name](spark, str(folder)).collect()
        return rows, size() - before

    return run


def test_contexts_write_no_walks(spark, tmp_path):
    rows, written = _tied_by_hubs(spark, tmp_path, 300)("kg_context")
    assert len(rows) == 300 and {r["context"].count("\n") for r in rows} == {20} and written < 2_000_000
    first = {r["seed"]: r["context"].split("\n") for r in rows}["company::Acme 7"]
    assert first[1:4] == ["  - [reports] revenue (type: financial_metric, hops: 1)", "  - [mentioned_in] filing_section::MD&A (type: , hops: 1)", "  - [reports] company::Acme 0 (type: , hops: 2)"]


def test_whole_walks_are_not_written_before_the_output(spark, tmp_path):
    rows, written = _tied_by_hubs(spark, tmp_path, 300)("kg_related")
    assert len(rows) == 300 * 301 and written < 2_000_000
    own = sorted((r["position"], r["node_id"], r["distance"]) for r in rows if r["seed"] == "company::Acme 7")
    assert own[:2] == [(1, "financial_metric::revenue", 1), (2, "filing_section::MD&A", 1)]
    assert own[2:] == [(k, f"company::Acme {n}", 2) for k, n in enumerate((n for n in range(300) if n != 7), 3)]


def test_walks_in_tasks_and_by_joins_are_the_same(spark, monkeypatch):
    draw = random.Random(5)
    links = [(f"n{draw.randrange(60)}", draw.choice(["hub", f"n{draw.randrange(60)}"]), draw.choice("xyz"), (n // 3, n % 3)) for n in range(200)]
    edges = spark.createDataFrame([*links, ("n1", "n1", "x", (0, -1)), ("n1", "n2", "y", (0, -2)), ("n1", "n2", "x", (0, -2)), ("n2", "n1", "z", (0, -3))], "src string, dst string, relation_type string, seq struct<doc_id:int,seq:int>").repartition(5)
    seeds = spark.createDataFrame([(f"n{k}",) for k in range(0, 70, 2)] + [("hub",), ("n2",)], "node_id string")
    monkeypatch.setattr(graph, "SEEDS", 3)
    monkeypatch.setattr(graph, "CHUNK", 7)
    asked = ((1, None), (2, None), (3, "x"), (0, None))
    inside = [sorted(graph.walk(seeds, edges, depth, kind).collect()) for depth, kind in asked]
    monkeypatch.setattr(graph, "EDGES", 0)
    assert [sorted(graph.walk(seeds, edges, depth, kind).collect()) for depth, kind in asked] == inside
    assert len(inside[1]) > 1000 and not inside[3]


def test_the_first_of_a_walk_are_those_of_the_whole(spark, monkeypatch):
    edges = spark.range(300).selectExpr("concat('n', id) AS src", "if(id % 3 = 0, 'hub', concat('n', id + 1)) AS dst", "'x' AS relation_type", "named_struct('doc_id', id, 'seq', 0) AS seq")
    seeds = spark.createDataFrame([("n3",), ("n7",), ("hub",), ("nowhere",)], "node_id string")
    whole = sorted(graph.walk(seeds, edges, 3).collect())
    for most in (1, 20, 1000):
        assert sorted(graph.walk(seeds, edges, 3, most=most).collect()) == [r for r in whole if r["position"] <= most]
    monkeypatch.setattr(graph, "EDGES", 0)
    assert sorted(graph.walk(seeds, edges, 3, most=20).collect()) == [r for r in whole if r["position"] <= 20]


# Guardrails, metrics, generation


def test_guardrails(spark):
    source = "Revenue was $100 million in 2020 and the margin widened considerably during winter."
    rows = [
        (1, "Revenue was $100 million in 2020 and the margin widened considerably during the winter as the [Source 1] says so, and it did so for all units.", [source]),
        (2, "Revenue was $500 million. Elephants danced gracefully underneath purple moonlight yesterday. ```x```", [source]),
        (3, "Revenue was $500 million.", []), (4, None, [source]), (5, "", None), (6, "Revenue was $100.5 million overall, according to what the text tells us about the past and the coming seasons. [Source 1]", [source]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "answer_id int, answer string, sources array<string>, severity string")
    found = guardrails.findings(df)
    got = {(r["answer_id"], r["check_name"], r["severity"]) for r in found.collect()}
    assert (2, "hallucination_detection", "high") in got and (2, "factual_consistency", "high") in got and (2, "format_check", "low") in got and (3, "hallucination_detection", "medium") in got
    assert not any(k in (1, 4, 5) for k, *_ in got) and not any(k == 6 and c == "hallucination_detection" for k, c, _ in got)
    report = {r["answer_id"]: r for r in guardrails.report(df, found).collect()}
    assert set(report) == {1, 2, 3, 4, 5, 6} and report[1]["confidence"] == 1.0 and report[1]["passed"] and not report[2]["passed"]
    assert report[2]["warnings"][0].startswith("Confidence below") and all("[HIGH]" in w for w in report[2]["warnings"][1:])


def test_retrieval_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    run = spark.createDataFrame([(1, c, k) for k, c in enumerate("abcdef", 1)] + [(3, "x", 1)], "query_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "f"), (1, "b"), (2, "a")], "query_id int, chunk_id string")
    out = {r["query_id"]: r for r in metrics.retrieval_metrics(q, run, truth, 5).collect()}
    assert (out[1]["precision"], out[1]["recall"], out[1]["reciprocal_rank"]) == (0.2, 0.5, 0.5)
    assert out[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert all(out[k][m] == 0 for k in (2, 3) for m in metrics.RETRIEVAL)
    assert metrics.retrieval_metrics(q, run, truth, 0).filter("precision + recall + ndcg > 0").count() == 0
    mean = metrics.averages(metrics.retrieval_metrics(q, run, truth, 5)).first()
    assert mean["num_questions"] == 3 and mean["avg_precision"] == pytest.approx(0.2 / 3)
    assert metrics.averages(metrics.retrieval_metrics(q.limit(0), run, truth)).first()["avg_ndcg"] == 0


def test_generation_metrics(spark):
    df = spark.createDataFrame(
        [(1, "cash flow grew", "The cash flow grew strongly. Unicorns yodel magnificently tonight.", ["Cash flow grew strongly by 5%."]), (2, "", "", []), (3, None, None, None), (4, "none", "It was 5 and 77.", ["about 5.05 units"])],
        "answer_id int, query string, answer string, sources array<string>",
    )
    get = lambda out: {r[0]: r[1] for r in out.collect()}
    assert get(metrics.faithfulness(df)) == {1: 0.5, 2: 1.0, 3: 1.0, 4: 1.0}
    assert get(metrics.context_relevancy(df)) == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert get(metrics.numerical_accuracy(df)) == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.5}
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, None, [1.0])], "answer_id int, query_vector array<double>, answer_vector array<double>")
    assert get(metrics.answer_relevancy(pairs)) == {1: pytest.approx(2**-0.5), 2: 0.0, 3: 0.0}


def test_generation(spark):
    q = spark.createDataFrame([(1, "cash flow"), (2, "nothing")], "query_id int, query string")
    results = spark.createDataFrame([(1, 2, "Storms came. Cash flow fell.", None, "B", "2020"), (1, 1, "x" * 4000, "MD&A", "A", None)], "query_id int, rank int, text string, section string, company_name string, filing_date string")
    asked = generate.prompts(q, generate.format_sources(results), spark.createDataFrame([(1, "ties")], "query_id int, context string"))
    row = {r["query_id"]: r for r in asked.collect()}
    assert row[1]["sources"].startswith("[Source 1]\nSection: MD&A\nCompany: A\nFiling Date: Unknown\nContent:\n" + "x" * 3000 + "\n---\n[Source 2]") and row[1]["system_prompt"].endswith("ties") and row[2]["sources"] == ""
    out = {r["query_id"]: r for r in generate.generate(asked).collect()}
    assert out[1]["answer"].startswith("Cash flow fell. [Source 2]") and out[2]["answer"] == generate.NO_SOURCES and not out[2]["has_sources"]
    generate.register("fails", lambda s, u: 1 / 0)
    assert {r["query_id"]: r["answer"] for r in generate.generate(asked, "fails").collect()} == {1: "Generation failed: division by zero", 2: generate.NO_SOURCES}
    with pytest.raises(ValueError, match="unknown model"):
        generate.generate(asked, "none")
    assert "".join(w for i, w in generate.stream(generate.generate(asked)) if i == 2) == generate.NO_SOURCES


# Embeddings, stores, sources, engine, streams


def test_embedding_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "cash cash"), (2, None), (3, "cash cash")], "id int, text string")
    out = {r["id"]: r["embedding"] for r in embedding.embed(df, "id", "text").collect()}
    assert out[1] == out[3] and max(out[1]) == 1.0 and set(out[2]) == {0.0}
    path = str(tmp_path / "cache")
    assert embedding.embed_cached(df, "id", "text", path).count() == 3
    assert embedding.misses(df, spark.read.parquet(path), "text").count() == 0 and embedding.misses(df, spark.read.parquet(path), "text", dim=8).count() == 2
    assert embedding.clear_cache(spark, path) == 2
    with pytest.raises(ValueError, match="unknown"):
        embedding.embed(df, "id", "text", "nope")
    assert embedding.mean_pool(np.ones((1, 3, 2)), np.array([[1, 1, 0]])).tolist() == [[1.0, 1.0]]
    assert v.hashed_vectors(df, "id", "text", 8).count() == 3


def test_store(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path), "c")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    assert s.count() == 0 and s.collections() == []
    s.upsert(chunks, vectors)
    s.upsert(chunks, vectors)
    assert s.count() == 2 and s.collections() == ["c"] and s.stats()["count"] == 2
    s.delete(chunks.filter("chunk_id = 'a'"))
    assert [r["chunk_id"] for r in s.rows().collect()] == ["b"]
    with pytest.raises(ValueError, match="no vector"):
        s.upsert(spark.createDataFrame([("z", "q")], "chunk_id string, text string"), vectors)
    s.drop()
    assert s.count() == 0


def test_store_appends_and_merges(spark, tmp_path):
    s = tables.Store(spark, str(tmp_path), "c", merge_at=4)
    made = []

    def derived():
        return s.derived("kind", lambda at: (made.append(s.state()), s.rows().select("chunk_id").write.parquet(f"{at}/ids")))

    for k in range(9):
        ids = [f"i{k % 3}", f"j{k}"]
        chunks = spark.createDataFrame([(i, f"text {k}") for i in ids], "chunk_id string, text string")
        before = s.rows()
        assert s.upsert(chunks, spark.createDataFrame([(i, [float(k)]) for i in ids], "chunk_id string, embedding array<double>")) == 2
        if before is not None:
            before.count()  # a plan made before the write still reads
        if k == 4:
            s.delete(spark.createDataFrame([("j0",), ("i0",)], "chunk_id string"))
            assert {r["chunk_id"] for r in s.rows().collect()} == {"i1", "i2", "j1", "j2", "j3", "j4"}
    assert {r["chunk_id"]: r["text"] for r in s.rows().collect()} == {**{f"i{k}": f"text {k + 6}" for k in range(3)}, **{f"j{k}": f"text {k}" for k in range(1, 9)}}
    assert len(s._parts()) < 4
    assert derived() == derived() and len(made) == 1 and spark.read.parquet(derived() + "/ids").count() == 11
    s.delete(spark.createDataFrame([("j1",)], "chunk_id string"))
    derived()
    assert len(set(made)) == 2 and s.count() == 10


def test_small_helpers(spark, monkeypatch):
    vocabulary = "/opt/tokenizers/byte_bpe_50k.json"
    assert chunking.count_tokens("Net income, 5%") == 5 and chunking.count_tokens("", vocabulary) == 0 and 0 < chunking.count_tokens("unbelievably long", vocabulary) < 7
    df = spark.createDataFrame([(1, "One sentence only.", "Business")], "doc_id int, text string, section string")
    assert chunking.chunk_documents(df, vocabulary=vocabulary).first()["token_count"] == chunking.count_tokens("One sentence only.", vocabulary)
    monkeypatch.setitem(generate.MODELS, "echo", lambda system, user: user.upper())
    assert generate.simple_generate("hello", "echo") == "HELLO" and generate.simple_generate("hello", "absent") == ""
    shown = generate.preview(spark.createDataFrame([("x" * 300,), ("y",), (None,)], "text string")).collect()
    assert [len(r["preview"]) for r in shown] == [203, 1, 0]
    found = spark.createDataFrame([(1, "high"), (1, "low")], "answer_id int, severity string")
    assert guardrails.of_severity(found, "high").count() == 1 and guardrails.of_severity(found, "critical").count() == 0
    with pytest.raises(ValueError, match="severity"):
        guardrails.of_severity(found, "dire")
    bands = spark.createDataFrame([(0.8,), (0.7,), (0.1,)], "c double").select(guardrails.band(F.col("c")).alias("b")).collect()
    assert [r["b"] for r in bands] == ["high", "medium", "low"]
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert EngineConfig(llm_provider="openai").missing_keys() == ["OPENAI_API_KEY"] and EngineConfig().missing_keys() == []
    assert EngineConfig(log_level="error").configure_logging().level == 40


def test_requests_keep_the_rate_of_all_tasks():
    feed = "".join(f'<entry><accession-number>0-1-{k}</accession-number><link rel="x" href="http://h/{k}"/></entry>' for k in range(9))
    reader = filings._Reader({"feed": feed, "cik": "1", "count": "9", "rate": "2", "tasks": "3", "company": "Acme"}, lambda url: url)
    parts = reader.partitions()
    assert sorted(len(p.filings) for p in parts) == [3, 3, 3] and sum(1 / p.wait for p in parts) == pytest.approx(2)
    parts[0].wait = 0
    assert [r[1] for r in reader.read(parts[0])] == ["Acme"] * 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"COMPANY CONFORMED NAME: Acme\nItem 1. Business\nWe sell \xff things.")
    (tmp_path / "b.html").write_text("ignored")
    assert "�" in filings.read_files(spark, str(tmp_path)).first()["text"]
    doc = filings.load_directory(spark, str(tmp_path), company_name="Other").first()
    assert doc["company_name"] == "Other" and doc["section"] == "Business" and doc["text"].startswith("Item 1")
    feed = '<feed><entry><accession-number>0-1-2</accession-number><filing-date>2020-01-02</filing-date><link rel="x" href="http://h/1"/></entry><entry>none</entry></feed>'
    got = spark.createDataFrame([(feed,)], "f string").select(filings.feed_entries(F.col("f")).alias("e"), filings.document_url(F.lit("000123"), F.lit("0-1-2")).alias("u")).first()
    assert [tuple(e) for e in got["e"]] == [("0-1-2", "2020-01-02", "http://h/1")] and got["u"].endswith("/123/012/0-1-2.txt")
    spark.dataSource.register(filings.RemoteFilings)
    assert spark.read.format("remote_filings").option("feed", feed).option("cik", "1").load().count() == 0

    class Recorded(filings.RemoteFilings):
        fetch = staticmethod(lambda url: f"text of {url}")

        @classmethod
        def name(cls):
            return "recorded_filings"

    spark.dataSource.register(Recorded)
    assert spark.read.format("recorded_filings").option("feed", feed).option("cik", "0001").load().first()["text"].endswith("/1/012/0-1-2.txt")
    (tmp_path / "q.json").write_text(json.dumps([{"query": "q1", "relevant_chunk_ids": ["a"]}, {"query": "q2"}]))
    questions = tables.load_questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r["query_id"], r["relevant_chunk_ids"]) for r in questions] == [(1, ["a"]), (2, [])]
    (tmp_path / "bad.json").write_text(json.dumps([{"metadata": {}}]))
    with pytest.raises(Exception, match="no query"):
        tables.load_questions(spark, str(tmp_path / "bad.json")).collect()


def test_latest(spark):
    df = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("a", "new", 2), ("b", None, None), (None, "x", 1)], "chunk_id string, text string, loaded_at int")
    assert {r["chunk_id"]: r["text"] for r in tables.latest(df).collect()} == {"a": "new", "b": None}
    assert tables.latest(df.limit(0)).count() == 0


def test_config(monkeypatch):
    assert EngineConfig().retrieval_top_k == 5
    monkeypatch.setenv("CHUNK_SIZE", "500")
    monkeypatch.setenv("ENABLE_NUMERICAL_VALIDATION", "false")
    c = EngineConfig.from_environment(retrieval_top_k=7)
    assert (c.chunk_size, c.retrieval_top_k, c.enable_numerical_validation) == (500, 7, False)
    for bad in ({"chunk_size": 50}, {"chunk_overlap": 1000}, {"dense_weight": 2.0}, {"log_level": "LOUD"}, {"retrieval_strategy": "x"}):
        with pytest.raises(ValueError, match=r"."):
            EngineConfig(**bad)


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), EngineConfig(retrieval_top_k=2, retrieval_score_threshold=0.0))
    docs = spark.createDataFrame(
        [(1, "Acme Inc. reports revenue of $5 million. Cash flow grew in the winter.", "MD&A", "Acme", "2020-01-01"), (2, "Storms interrupted the fleet near Rome. We compete with Beta.", "Risk Factors", "Acme", "2020-01-01")],
        "doc_id int, text string, section string, company_name string, filing_date string",
    )
    assert engine.ingest(docs) == 2 and engine.ingest(docs) == 2 and engine.store.count() == 2
    q = spark.createDataFrame([(1, "How did cash flow grow?")], "query_id int, query string")
    row = engine.query(q, {"company": "Acme"}).first()
    assert "Cash flow grew" in row["answer"] and row["has_sources"] and 0 <= row["confidence"] <= 1
    none = engine.query(q, {"company": "Nobody"}).first()
    assert none["answer"] == generate.NO_SOURCES and none["confidence"] == 1.0
    ids = [r["chunk_id"] for r in engine.store.rows().filter("text LIKE '%Cash%'").collect()]
    questions = spark.createDataFrame([(1, "How did cash flow grow?", ids)], "query_id int, query string, relevant_chunk_ids array<string>")
    scores = engine.evaluate(questions).first()
    assert scores["reciprocal_rank"] == 1.0 and scores["faithfulness"] == 1.0
    assert engine.stats()["graph_nodes"] > 0
    engine.reset()
    assert engine.store.count() == 0


def test_streams(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    seen = []
    for k in range(2):
        (inbox / f"{k}.txt").write_text(f"Item 1. Business\nWe sell thing {k}.")
        ingest_stream(filing_stream(spark, str(inbox)), lambda df: seen.extend(r["doc_id"] for r in df.collect()), state).awaitTermination()
        assert len(seen) == k + 1 == len(set(seen))
    events = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(str(tmp_path / "ev*"))
    (tmp_path / "ev").mkdir()
    spark.read.parquet(str(DATA / "events.parquet")).limit(50).write.mode("overwrite").parquet(str(tmp_path / "ev"))
    run = event_counts(events).writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 50


# Units


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("We paid $5.5 million and EUR 2 billion, up 3.5% or 20 bps.", {("usd", 5_500_000), ("eur", 2_000_000_000), ("bp", 350), ("bp", 20)}),
        ("US$9M, $ 4.1B, USD 1,000 and forty million dollars; 3 thousand U.S. dollars", {("usd", 9_000_000), ("usd", 4_100_000_000), ("usd", 1000), ("usd", 40_000_000), ("usd", 3000)}),
        ("12.0 thousand gallons, 2 bbl, 10 short tons, 3 t, 7 lbs", {("l", 45425), ("l", 318), ("kg", 9072), ("kg", 3000), ("kg", 3)}),
        ("5 sq km, 2 acres, 1,000 sq. ft. of space, 4 m², 2 ha", {("m2", 5_000_000), ("m2", 8094), ("m2", 93), ("m2", 4), ("m2", 20_000)}),
        ("36 GJ, 2 MWh, 5 mi, 100 ft; 3 m³", {("kwh", 10_000), ("kwh", 2000), ("m", 8047), ("m", 30), ("l", 3000)}),
        ("In 2014 we employ 2,211 people for 12 days; note 5; Q3 2020; item 7A", set()),
        ("a loss of ($1,200) and -5% and (3 kg)", {("usd", -1200), ("bp", -500), ("kg", 3)}),
        (None, set()),
        ("", set()),
    ],
)
def test_text_quantities(spark, text, found):
    df = spark.createDataFrame([("a", text), ("a", text)], "id string, text string")
    assert {(r["base_unit"], r["base_value"]) for r in units.text_quantities(df, "id", "text").collect()} == found


@pytest.mark.parametrize(
    ("properties", "found"),
    [
        ({"raw": "14.788 Barrel", "locale": "de"}, {("l", 2351104)}), ({"value": "196", "currency": "EUR", "scale": "thousands"}, {("eur", 196_000)}), ({"amount": "(56,230)", "units": "(in millions)", "currency": "USD"}, {("usd", -56_230_000_000)}),
        ({"value_usd_mm": "1.5"}, {("usd", 1_500_000)}), ({"pct": "51.4"}, {("bp", 5140)}), ({"value": "0.2544", "unit": "fraction"}, {("bp", 2544)}), ({"value": "1.831e3", "unit": "sqft"}, {("m2", 170)}), ({"value": "7", "uom": "SHORT_TON"}, {("kg", 6350)}),
        ({"value": "-", "uom": "t"}, set()), ({"value": "7"}, set()), ({"value": "", "unit": "USD"}, set()), ({}, set()), (None, set()), ({"raw": "n/a"}, set()), ({"raw": None}, set()), ({"value_km": "2", "raw": "2 km"}, {("m", 2000)}),
    ],
)
def test_property_quantities(spark, properties, found):
    df = spark.createDataFrame([(1, properties)], "id int, p map<string,string>")
    assert {(r["base_unit"], r["base_value"]) for r in units.property_quantities(df, "id", "p").collect()} == found


def test_units_by_identity(spark):
    weights, volumes = {"kg": 1.0, "lb": 0.45359237}, {"l": 1.0, "gal": 3.785411784}
    how = {"mass": (1, weights), "density": (-1, {"kg/l": 1.0}), "volume": (-1, volumes)}
    rows = [(1, 80.0, 0.8, 100.0), (2, 176.37, 0.8, 100.0), (3, 302.8, 0.8, 100.0), (4, None, 0.8, 1.0), (5, 9e9, 0.8, 1.0), (6, -1.0, 1.0, 1.0)]
    out = {r["id"]: r for r in units.units_by_identity(spark.createDataFrame(rows, "id int, mass double, density double, volume double"), how).collect()}
    assert (out[1]["identity_units"]["mass"], out[1]["identity_units"]["volume"]) == ("kg", "l") and out[2]["identity_units"]["mass"] == "lb" and out[3]["identity_units"]["volume"] == "gal"
    assert all(out[k]["identity_unique"] for k in (1, 2, 3)) and all(out[k]["identity_units"] is None for k in (4, 5, 6))
    same = units.units_by_identity(spark.createDataFrame([(2.0, 2.0)], "a double, b double"), {"a": (1, weights), "b": (-1, weights)}).first()
    assert not same["identity_unique"]


def test_restated_quantities(spark):
    rows = [(1, "4.2 km", {"raw": "4.2 km"}), (2, "$3 million", {"value": "3000"}), (3, "12 t", {"value": "12,000", "x": "y"}), (4, "Acme", {"value": "5"}), (5, "5 kg", {}), (6, None, None), (7, "0 kg", {"value": "3"}), (8, "5 kg", {"value": "none"})]
    df = spark.createDataFrame(rows, "id int, name string, properties map<string,string>")
    got = {r["id"]: (r["base_unit"], r["unit"], r["base_value"], r["unique"]) for r in units.restated_quantities(df, "id", "name", "properties").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "m", 2: "usd", 3: "kg"} and {k: v[2] for k, v in got.items()} == {1: 4200, 2: 3_000_000, 3: 12_000}
    assert got[1][3] is False or "km" in got[1][1]
    assert units.restated_quantities(df.limit(0), "id", "name", "properties").count() == 0
