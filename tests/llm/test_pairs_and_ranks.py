"""p1, p2, p4, p7 against brute force and on hostile input."""

import random
import re

import numpy as np
import pytest

from docsight.llm import near_duplicates as nd
from docsight.llm import names, rank_fusion
from docsight.llm.nearest_vectors import Codebook, NearestVectors, kmeans


def _texts(seed=1, groups=25, edits=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(25, 120))]
        for c in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, len(words) // edits)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
            rows.append((f"c{g:03d}{c}", " ".join(words).capitalize() + "."))
    return rows


def _jaccard(a, b, n):
    s = lambda t: {tuple(w[k : k + n]) for w in [re.findall(r"[^\W_]+", t.lower())] for k in range(len(w) - n + 1)}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.5), (5, 0.8)])
def test_links_equal_brute_force(spark, words, threshold):
    rows = _texts(edits=8 if words == 3 else 40)
    rows += [rows[0], ("copy", rows[0][1]), ("copy2", rows[0][1].upper())]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    found = {tuple(r) for r in nd.NearDuplicates(df, words=words, threshold=threshold).pairs().collect()}
    unique = sorted(set(rows))
    truth = {tuple(sorted((a, b))) for i, (a, t) in enumerate(unique) for b, u in unique[:i] if a != b and _jaccard(t, u, words) >= threshold}
    assert found == truth and len(truth) > 10


def test_crowded_blocks_and_small_tiles_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = [(f"c{k:03d}", " ".join(w if rng.random() > 0.03 else f"{w}x{rng.randint(0, 9)}" for w in base)) for k in range(300)] + [(f"d{k}", t) for k, (_, t) in enumerate(_texts(5))]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    whole = sorted(map(tuple, nd.NearDuplicates(df, words=3, threshold=0.5).pairs().collect()))
    monkeypatch.setattr(nd, "CROWD", 4)
    monkeypatch.setattr(nd, "TILE", 7)
    monkeypatch.setattr(nd, "PART", 1_000)
    assert sorted(map(tuple, nd.NearDuplicates(df, words=3, threshold=0.5).pairs().collect())) == whole and len(whole) > 10_000


def test_links_of_hostile_rows(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [("a", None), ("b", ""), ("c", "   "), ("d", "few words only"), (None, "w " * 40), ("e", long), ("f", long), ("f", long + " tail")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "chunk_id string, text string, block string").withColumnRenamed("block", "cls")
    d = nd.NearDuplicates(df)
    assert {tuple(r) for r in d.pairs().collect()} == {("e", "f")}
    groups = {r["id"]: (r["links"], r["group_id"]) for r in d.groups().collect()}
    assert set(groups) == {"e", "f"} and {g for _, g in groups.values()} == {"e"}
    empty = nd.NearDuplicates(df.limit(0))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_a_hot_class_is_one_row_in_the_join(spark):
    text = " ".join(f"k{n}" for n in range(40))
    df = spark.range(500).selectExpr("cast(id as string) as chunk_id", f"'{text}' as text")
    d = nd.NearDuplicates(df)
    assert d.classes().count() == 1 and d.candidates().count() == 0
    assert {r["links"] for r in d.groups().select("links").distinct().collect()} == {499}


def test_median_rank(spark):
    legs = spark.createDataFrame([("up", True), ("down", False), ("third", True), ("third", True)], "leg string, higher_is_better boolean")
    rows = [
        (1, "up", 1, "a", 0.9), (1, "up", 1, "a", 0.9), (1, "up", 2, "b", 0.8), (1, "up", 3, "c", 0.8), (1, "up", 4, "n", float("nan")),
        (1, "down", 9, "a", 5.0), (1, "down", 9, "b", 1.0), (1, "down", None, "c", None), (1, "third", 0, "a", 1e9), (1, "third", 0, "b", -3.0),
        (1, "other", 0, "a", 1.0), (None, "up", 0, "a", 1.0), (2, "up", 0, None, 1.0), (2, "up", 0, "z", 1.0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id bigint, leg string, rank int, chunk_id string, score double, own string")
    out = {(r["query_id"], r["chunk_id"]): r for r in rank_fusion.median_rank(df, legs).collect()}
    assert set(out) == {(1, "a"), (1, "b"), (1, "c"), (2, "z")}
    # a: up 1, down 2, third 1; b: up 2 (tied), down 1, third 2; c: up 2 (tied), down 3 and third 3 as it is missing there
    assert (out[1, "a"]["median_rank"], out[1, "b"]["median_rank"], out[1, "c"]["median_rank"]) == (1.0, 2.0, 3.0)
    assert [out[1, c]["position"] for c in "abc"] == [1, 2, 3]
    heavy = {r["chunk_id"]: r["median_rank"] for r in rank_fusion.median_rank(df, legs, {"down": 10.0}).filter("query_id = 1").collect()}
    assert heavy["b"] == 1.0 and heavy["a"] == 2.0
    assert rank_fusion.median_rank(df.limit(0), legs).count() == 0


def test_median_rank_of_a_crowded_query(spark):
    rng = random.Random(8)
    rows = [(7, leg, f"c{k:04d}", float(rng.randint(0, 300))) for leg in ("up", "down", "wide") for k in range(1500) if rng.random() < 0.9] + [(8, "up", "only", 1.0)]
    legs = spark.createDataFrame([("up", True), ("down", False), ("wide", True)], "leg string, higher_is_better boolean")
    df = spark.createDataFrame(rows, "query_id bigint, leg string, chunk_id string, score double").repartition(5)
    ranks, chunks = [], sorted({c for q, _, c, _ in rows if q == 7})
    for leg, up in (("up", 1), ("down", -1), ("wide", 1)):
        own = {c: -up * s for q, n, c, s in rows if (q, n) == (7, leg)}
        cost = np.sort(list(own.values()))
        ranks.append([int(np.searchsorted(cost, own[c])) + 1 if c in own else len(own) + 1 for c in chunks])
    r = np.array(ranks, float)
    order = np.lexsort((chunks, r.mean(0), np.median(r, 0)))
    out = rank_fusion.median_rank(df, legs).orderBy("query_id", "position").collect()
    assert [(x["position"], x["chunk_id"], x["median_rank"]) for x in out[:-1]] == [(n, chunks[k], float(np.median(r[:, k]))) for n, k in enumerate(order, 1)]
    first = rank_fusion.best(df, legs, 5).orderBy("query_id", "position").collect()
    assert [x["chunk_id"] for x in first] == [*[chunks[k] for k in order[:5]], "only"]


REGISTRY = [
    (1, "company", "Giavein Insurance Inc.", None), (2, "company", "Drofaedei & Piaspiaen Corp.", "Old Koveinwell Ltd."), (3, "company", "Bank of Vastundis Corp.", None), (4, "company", "Zeiszolor Pacific Foods Ventures L.P.", None),
    (5, "company", "Giavemor Insurance Inc.", None), (6, "person", "Lawrence B. Trolbriaum", None), (7, "person", "Katherine Trolbriaum", None), (8, "company", "Giavein Foods Inc.", None), (9, "company", None, None), (10, None, "Nobody", None),
]


@pytest.mark.parametrize(
    ("kind", "name", "ref"),
    [
        ("company", "GIAVEIN INS. INC", 1), ("company", "Giavien Insurance Inc. (NYSE)", 1), ("company", "Insurance, Giavein, Inc.", 1), ("company", "In Q3 Giavein Insurance", 1), ("company", "Giavein Inc.", None), ("company", "Giavein Marine Inc.", None),
        ("company", "piaspiaen, drofaedei +, corp", 2), ("company", "Old Koveinwel Limited", 2), ("company", "Drofaedei & Piaspiaen LLC", None), ("company", "Bank_of Vastund1s Corporation /DE/", 3), ("company", "Z.P.F.V. LP", 4), ("company", "Zeiszolor L.P.", 4),
        ("person", "TROLBRIAUM, LARRY", 6), ("person", "Mr. L. Trolbriaum", 6), ("person", "Lawrence K. Trolbriaum", None), ("person", "Kathy Trolbriaum (Director)", 7), ("person", "Trolbriaum", None), ("company", "Unknown Works Inc.", None),
    ],
)
def test_typed_names(linked, kind, name, ref):
    assert linked.get((kind, name)) == ref


@pytest.fixture(scope="module")
def linked(spark):
    mark = test_typed_names.pytestmark[0]
    typed = [(k, n) for k, n, _ in mark.args[1]] + [("company", None), ("company", "  "), ("place", "Giavein"), (None, "Giavein Insurance Inc."), ("company", "x" * 20_000), ("company", "...")]
    filler = [(100 + k, "company", f"Qz{k}worth {w} Inc.", None) for k in range(40) for w in ["Insurance", "Foods", "Pacific", "Ventures", "Bank of"][k % 5 : k % 5 + 1]]
    registry = spark.createDataFrame(REGISTRY + filler, "ref_id bigint, entity_type string, name string, former_name string")
    out = names.link_names(spark.createDataFrame(typed + typed[:3], "kind string, name string"), registry, common=0.05)
    assert names.link_names(spark.createDataFrame([], "kind string, name string"), registry).count() == 0
    assert names.link_names(spark.createDataFrame(typed, "kind string, name string"), registry.limit(0)).count() == 0
    return {(r["kind"], r["name"]): r["ref_id"] for r in out.collect()}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_are_levenshteins():
    rng = random.Random(2)
    words = ["", "x" * 300, *["".join(rng.choices("abcdé", k=rng.randint(1, 30))) for _ in range(200)]]
    pivots = ["", "a", "b" * 63, *words[5:9]]
    assert names.distances(words, pivots).tolist() == [[min(255, _levenshtein(w, p)) for p in pivots] for w in words]
    assert names.distances([], pivots).shape == (0, len(pivots))


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdef", k=rng.randint(4, 22))) for _ in range(150)]

    def typed(w):
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice(["", rng.choice("abcdef")]) + w[k + rng.randint(0, 1) :]
        return w

    targets = [(s, w) for w in base for s in (["one"] if len(w) % 3 else ["one", "two"])]
    asked = [(s, typed(rng.choice(base)), r) for s in ("one", "two", "none") for r in (0, 1, 2, 4) for _ in range(150)] + [("one", "z" * 5000, 4), ("one", "", 2)]
    got = {(r["space"], r["q"], r["key"], r["distance"]) for r in names.radius_join(spark.createDataFrame(asked, "space string, key string, radius int"), spark.createDataFrame(targets + targets[:9], "space string, key string")).collect()}
    widest = {}
    for s, q, r in asked:
        widest[s, q] = max(r, widest.get((s, q), 0))
    truth = {(s, q, t, _levenshtein(q, t)) for (s, q), r in widest.items() if len(q) < 99 for u, t in targets if u == s and _levenshtein(q, t) <= r}
    assert got == truth and len(truth) > 200


def test_words_are_told_from_the_registry():
    lexicon = names.Lexicon(["insurance", "instruments", "international", "manufacturing", "technologies", "bank"], ["timothy", "margaret"])
    meant = lambda w: lexicon.meant(w)[0]
    assert (meant("ins"), meant("intl"), meant("mfg"), meant("technology"), meant("bk"), meant("zz")) == (["instruments", "insurance"], ["international"], ["manufacturing"], ["technologies"], ["bank"], ["zz"])
    assert "timothy" in lexicon.given_names("timmy") and "margaret" in lexicon.given_names("peggy") and lexicon.given_names("odile") == ["odile"]
    assert names.Lexicon(given=["timothy"], nicknames={}).given_names("tim") == ["tim", "timothy"]


def test_words_around_typed_names_are_learned(spark):
    rng = random.Random(6)
    own = ["".join(rng.choices("bdfgklmnprst", k=9)) + rng.choice(["avo", "ixe", "oru"]) for _ in range(60)]
    registry = spark.createDataFrame([(k, "company", f"{w.capitalize()} Foods Inc.", None) for k, w in enumerate(own)], "ref_id bigint, entity_type string, name string, former_name string")
    typed = [("company", f"Quarrel over {w.capitalize()} Foods, Inc.") for w in own[:30]]
    out = {r["name"]: r["ref_id"] for r in names.link_names(spark.createDataFrame(typed, "kind string, name string"), registry).collect()}
    assert out == {n: k for k, (_, n) in enumerate(typed)}


def _vectors(n=700, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def test_neighbours_reach_the_recall(spark):
    x = _vectors()
    rows = [(f"v{k:04d}", [float(f) for f in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:5]], "chunk_id string, embedding array<float>, cell int")
    nv = NearestVectors(df, dim=16, block=128, rerank=20)
    assert nv.cells > 1
    got = {}
    for r in nv.neighbours().collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = {f"v{k:04d}": {f"v{j:04d}" for j in np.argsort(-s[k])[:10]} for k in range(len(x))}
    assert set(map(len, got.values())) == {10}
    assert sum(len(truth[k] & set(v)) for k, v in got.items()) / (10 * len(x)) >= 0.9


@pytest.mark.parametrize("n", [400, 1600])
def test_cells_grow_with_the_root_and_a_crowded_cell_is_cut(spark, n):
    x = _vectors(n, 8)
    x[: n // 3] = x[0] + 1e-4 * np.random.default_rng(1).normal(size=(n // 3, 8))  # a third of all rows in one spot
    df = spark.createDataFrame([(k, [float(f) for f in v]) for k, v in enumerate(x)], "chunk_id bigint, embedding array<float>")
    nv = NearestVectors(df, dim=8, block=32)
    assert 2 * n**0.5 <= nv.cells <= 8 * n**0.5 and nv.units >= n / 32 and nv.probes < nv.cells
    got = {}
    for r in nv.neighbours().collect():
        got.setdefault(r["id"], []).append((r["position"], r["neighbour"], r["similarity"]))
    assert set(got) == set(range(n)) and all(sorted(p for p, _, _ in g) == list(range(1, 11)) and k not in {i for _, i, _ in g} for k, g in got.items())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    least = np.sort(s, axis=1)[:, -10] - 1e-6
    assert np.mean([sum(v >= least[k] for _, _, v in g) for k, g in got.items()]) >= 9


def test_neighbours_of_hostile_vectors(spark):
    same = [1.0, 2.0]
    rows = [("a", same), ("b", same), ("c", same), ("d", [2.0, 1.0]), ("e", None), ("f", [0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [1.0]), (None, same), ("a", same), ("i", [None, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    out = {}
    for r in NearestVectors(df, dim=2, k=2).neighbours().collect():
        out.setdefault(r["id"], []).append((r["position"], r["neighbour"]))
    assert {k: sorted(v) for k, v in out.items()} == {"a": [(1, "b"), (2, "c")], "b": [(1, "a"), (2, "c")], "c": [(1, "a"), (2, "b")], "d": [(1, "a"), (2, "b")]}
    assert NearestVectors(df.limit(0), dim=2).neighbours().count() == 0


def test_anisotropic_codes_keep_inner_products_better():
    x = _vectors(2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    along = []
    for threshold in (0.2, 0.8):
        book = Codebook(x, width=2, threshold=threshold)
        codes = book.encode(x)
        back = book.words[np.arange(book.groups), codes].reshape(len(x), -1)[:, :16]
        along.append(float(np.mean(((x - back) * x).sum(1) ** 2)))
    assert along[1] < along[0]
    assert kmeans(x, 8).shape == (8, 16)
