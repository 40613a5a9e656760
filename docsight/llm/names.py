"""Typed names of organisations and persons linked to registry entries by a metric-space radius join.

Every name gets canonical keys: case, accents, punctuation, titles, tickers, state codes and legal forms go, reordered parts are put in
order. What abbreviates a word that many registry names share is told from the registry (a beginning, or letters in their
order), given names likewise; words that come with many typed names and that the registry does not know are learned from the typed names
and dropped. Nicknames that no rule tells are a list that callers may replace.

Keys are compared by the Levenshtein distance, a true metric. Registry keys belong to their nearest pivot; pivots grow with
the registry. A typed key goes to every cell that the triangle inequality allows to hold a key within the radius; inside a cell the
distances to all pivots rule out most pairs by the same inequality, and the exact distance decides on the rest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsight.runtime import checkpoint, settle

#: Pivots for the square root of the registry keys, the fewest and the most of them, registry keys that they are chosen from for each, and typed keys of a unit of work.
_DENSITY, FEWEST, MOST, _SAMPLE, _UNIT = 0.15, 8, 255, 24, 50_000

#: Legal forms by their usual spellings.
_FORMS = {
    "inc": "inc incorporated",
    "corp": "corp corporation",
    "co": "co company cie",
    "llc": "llc",
    "ltd": "ltd limited",
    "lp": "lp",
    "llp": "llp",
    "plc": "plc",
    "group": "group grp",
    "holdings": "holdings holding hldgs hldg",
    "sa": "sa",
    "ag": "ag",
    "gmbh": "gmbh",
    "nv": "nv",
}
_FORM = {w: f for f, ws in _FORMS.items() for w in ws.split()}
#: English given names whose usual short forms are not simply their beginning, in alphabetical order.
NICKNAMES = {
    "abigail": "abby gail", "albert": "bert", "alexander": "alec sandy sasha", "alexandra": "sandra sandy", "alfred": "fred", "amanda": "mandy", "andrew": "drew", "anthony": "tony", "augustus": "gus", "barbara": "babs",
    "benjamin": "benny", "bernard": "bernie", "bridget": "biddy", "caroline": "carrie", "catherine": "cathy kate katie kit kitty", "cecilia": "cissy", "charles": "charlie chuck chas", "christina": "chrissy tina", "christopher": "kit", "cynthia": "cindy",
    "daniel": "danny", "david": "davy", "deborah": "debbie debby", "dorothy": "dolly dot dottie", "edgar": "eddie ned", "edmund": "eddie ned ted", "edward": "eddie ned ted teddy", "eleanor": "ellie nell nellie nora", "elizabeth": "bess beth betsy betty eliza libby liz lizzie", "eugene": "gene",
    "florence": "flo florrie", "frances": "fanny frannie", "francis": "frank", "frederick": "freddie", "gerald": "gerry jerry", "gertrude": "trudy", "harold": "hal harry", "helen": "nell", "henry": "hal hank harry", "isabella": "bella",
    "jacob": "jake", "james": "jamie jim jimmy", "jane": "jenny", "jennifer": "jen jenny", "jeremy": "jerry", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate kathy katie kay kitty",
    "laurence": "larry", "lawrence": "larry", "leonard": "lenny", "louis": "lou", "louise": "lou lulu", "margaret": "greta madge maggie maisie marge margie meg peg peggy rita", "martha": "mattie patty", "mary": "maisie molly polly", "matilda": "tilda tilly", "michael": "mick mickey mike",
    "nancy": "nan", "nathaniel": "nat nate", "nicholas": "nick nicky", "oliver": "ollie", "patricia": "patty tricia trish", "patrick": "paddy", "peter": "pete", "philippa": "pippa", "raymond": "ray", "rebecca": "becky",
    "richard": "dick rich rick ricky", "robert": "bob bobby rob robbie", "ronald": "ronnie", "rosemary": "rosie", "rudolph": "rudy", "samantha": "sammy", "samuel": "sammy", "sarah": "sadie sally", "sophia": "sophie", "stephen": "steve",
    "steven": "steve", "susan": "sue susie suzy", "teresa": "terry tess", "theodore": "ted teddy theo", "thomas": "tommy", "timothy": "timmy", "ulrich": "uli", "victoria": "tori vicky", "virginia": "ginny", "walter": "walt wally", "wilhelmina": "mina", "william": "bill billy liam willie", "zachary": "zack zak",
}
#: Titles and what stands behind names of persons; English words that stand before names in running text.
_TITLES = frozenset("mr mrs ms miss dr prof sir hon jr sr ii iii iv md phd esq cpa cfo ceo coo cto chairman chairwoman director officer president secretary treasurer".split())
_BEFORE = "a an the in on at of for from with by to as and or during after before since we they he she it our its their his her"
_LEAD = re.compile(rf"^\s*(?:(?:{'|'.join(_BEFORE.split())})\b(?:\s+(?:q[1-4]|fy\s?\d{{2,4}}|fiscal\s+\d{{4}}|\d{{4}})\b)?[\s,:]+)+", re.I)
_TAIL = re.compile(r"\s*(?:\([^()]*\)|\[[^\[\]]*\]|/[A-Za-z]{2,3}/?|[,;]?\s+(?:and|or)\s+(?:its\s+)?(?:subsidiaries|affiliates)|,?\s+(?:a|an)\s+\w+\s+(?:company|corporation|corp\.?)|\s+[-–—]\s+\w+|[,;:]+)\s*$", re.I)


def _plain(name: str, company: bool = True) -> str:
    """Without accents, leads and tails."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).replace("_", " ").replace("’", "'")
    text = re.sub(r"\s+", " ", text).strip()
    for _ in range(3):
        new = _TAIL.sub("", text if re.match(r"\w[ .]", text) and not company else _LEAD.sub("", text))  # a person's initial is no article
        if new == text or not new:
            break
        text = new
    return text


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text)


def _letters(word: str) -> str:
    """Digits that stand for letters inside words."""
    if word.isdigit() or not any(c.isdigit() for c in word):
        return word
    return word.translate(str.maketrans("015", "ois"))


def _in_order(short: str, word: str) -> bool:
    """Whether a word has the letters of a shorter one in their order, the first one first."""
    rest = iter(word)
    return len(short) >= 2 and short[0] == word[0] and len(short) < len(word) and all(c in rest for c in short)


def _alike(a: str, b: str) -> bool:
    """Forms of one word: all but the last letter of the shorter one in common, four at least."""
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return n >= 4 and n >= min(len(a), len(b)) - 1


class Lexicon:
    """What is known of words: ``generic`` ones of companies, ``given`` names, ``noise`` that typed names of a kind bring along, and nicknames."""

    def __init__(self, generic: Iterable[str] = (), given: Iterable[str] = (), noise: Iterable[tuple[str, str]] = (), nicknames: dict[str, str] | None = None):
        self.generic, self.given = frozenset(generic), frozenset(given)
        self.noise = {kind: frozenset(w for k, w in noise if k == kind) for kind in ("company", "person")}
        self.short: dict[str, list[str]] = {}
        for full, forms in (NICKNAMES if nicknames is None else nicknames).items():
            for f in forms.split():
                self.short.setdefault(f, []).append(full)
        self.known: dict[str, tuple[list[str], bool]] = {}

    def meant(self, word: str) -> tuple[list[str], bool]:
        """The generic words that a word may stand for, itself if there are none, and whether that is sure."""
        if word in self.generic or word in _FORM or len(word) < 2:
            return [word], True
        if word not in self.known:
            found = sorted(g for g in self.generic if g.startswith(word) or _alike(word, g))
            sure = bool(found)
            found = found or sorted(g for g in self.generic if _in_order(word, g))
            self.known[word] = (found or [word]), sure or not found
        return self.known[word]

    def given_names(self, word: str) -> list[str]:
        """A given name as it is, and the full ones that it may be short for."""
        stem = re.sub(r"(.)\1$", r"\1", re.sub(r"(?:ie|y|s)$", "", word)) if len(word) > 3 else word
        by_rule = [g for g in self.given if g != word and (g.startswith(word) or (len(stem) >= 3 and (g.startswith(stem) or _in_order(stem, g))))]
        return [word, *sorted({*self.short.get(word, ()), *by_rule} - {word})]


def _company_words(name: str, lexicon: Lexicon) -> tuple[list[list[str]], str]:
    """The readings of a company name's words without its legal form, and that form."""
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", _plain(name))
    text = re.sub(r"\b([A-Za-z])\.\s?(?=[A-Za-z]\b)", r"\1", text.lower().replace("'", ""))
    words = [w for w in map(_letters, _words(text)) if w not in ("and", "the")]
    kept = [w for w in words if w not in lexicon.noise["company"]] or words
    while len(kept) > 1 and kept[0] in _BEFORE.split() and kept[0] != words[0]:  # what led to a name goes with the word before it
        kept.pop(0)
    words, form = kept, ""
    while len(words) > 1 and words[-1] in _FORM:
        form = form or _FORM[words[-1]]
        words.pop()
    options = []
    for w in words:
        found, sure = lexicon.meant(w)
        options.append(found if sure and len(words) > 1 else list(dict.fromkeys([*found, w])))
    return [list(r) for r in product(*options)], form


def _key(own: list[str], common: list[str]) -> str:
    return "".join(own + sorted(common))


def _split(words: list[str], lexicon: Lexicon) -> tuple[list[str], list[str]]:
    return [w for w in words if w not in lexicon.generic], [w for w in words if w in lexicon.generic]


def radius(space: str, own: str) -> int:
    """Edits allowed: none in initials, one in very short names, two in others, more where two own words may each be misspelled."""
    if space == "initials":
        return 0
    return 1 if len(own) < 6 else 2 if len(own) < 14 else 3 if len(own) < 18 else 4


def _person(name: str, lexicon: Lexicon) -> tuple[str, list[str], str]:
    """(last name, readings of the first given name, initials of the given names): the last name is the last word, or what stands before a comma."""
    text = _plain(name, False).lower().replace("'", "")
    head, comma, tail = text.partition(",")
    one, two = ([w for w in map(_letters, _words(t)) if w not in _TITLES and w not in lexicon.noise["person"]] for t in (head, tail))
    if comma and two and one:
        words = two + one
    else:
        words = one + two
        full = [w for w in words if len(w) > 1]
        is_given = lambda w: w in lexicon.given or len(lexicon.given_names(w)) > 1
        if len(full) == 2 and is_given(full[1]) and not is_given(full[0]):
            words = [full[1], *(w for w in words if len(w) == 1), full[0]]
    if not words:
        return "", [], ""
    long = [w for w in words if len(w) > 1]
    if len(long) == 1 and long[0] == words[0]:  # a last name and initials
        words = [*words[1:], words[0]]
    given = [w for w in words[:-1] if len(w) > 1]
    return words[-1], lexicon.given_names(given[0]) if given else [], "".join(w[0] for w in words[:-1])


def typed_keys(kind: str, name: str, lexicon: Lexicon) -> list[tuple[str, str, str, int]]:
    """(space, key, legal form or initials, radius) of a name as typed, one for each reading; short words in one case may be initials as well."""
    out = []
    if kind == "company":
        readings, form = _company_words(name, lexicon)
        for words in readings:
            own, common = _split(words, lexicon)
            key = _key(own, common)
            out.append(("company", key, form, radius("company", "".join(own) or key)))
            letters = re.sub(r"[^A-Za-z]", "", _plain(name))[: len(key)]
            if not common and 3 <= len(key) <= 6 and (letters.isupper() or letters.islower()):
                out.append(("initials", key, form, 0))
        return out
    last, given, initials = _person(name, lexicon)
    if not given and initials:
        return [("lastname", f"{initials[0]}{last}", initials, radius("lastname", last))]
    # Of a given name's readings the initial changes, that of a middle name does not.
    return [("person", last + g, g[:1] + initials[1:], radius("person", last)) for g in given] or [("person", last, "", radius("person", last))]


def registry_keys(kind: str, name: str, lexicon: Lexicon) -> list[tuple[str, str, int, str]]:
    """(space, key, weight, legal form or initials) of a registry name: all of it; companies also with own words the other way round, without the last or all generic words, as initials; persons also with parts exchanged or the given name's initial alone."""
    if kind == "company":
        readings, form = _company_words(name, lexicon)
        words = readings[0]
        own, common = _split(words, lexicon)
        out = [("company", _key(own, common), 0, form)]
        if len(own) > 1:
            out.append(("company", _key(own[::-1], common), 1, form))
        if own and common and not {"bank", "bancorp"} & set(common):
            out += [("company", _key(own, common[:k]), 1, form) for k in {0, len(common) - 1}]
        if len(words) >= 3:
            out.append(("initials", "".join(w[0] for w in words), 2, form))
        return out
    last, given, initials = _person(name, lexicon)
    first = given[0] if given else ""
    return [("person", last + first, 0, initials), ("person", first + last, 1, initials), ("lastname", f"{initials[:1]}{last}", 1, initials)]


def distances(words: list[str], pivots: list[str]) -> np.ndarray:
    """(words, pivots): Levenshtein distances, 255 at most, of all words at once, bit by bit of the pivot (at most 63 characters)."""
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    sizes = np.array([len(words[k]) for k in order], np.int64)
    ends = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # how many are longer than j
    signs = {c: k for k, c in enumerate(sorted(set("".join(words))))}
    columns = [np.array([signs[words[k][j]] for k in order[:n]], np.int64) for j, n in enumerate(ends)]
    out = np.empty((len(words), len(pivots)), np.uint8)
    one = np.uint64(1)
    for p, pivot in enumerate(pivots):
        m = len(pivot)
        if not m:
            out[order, p] = np.minimum(sizes, 255)
            continue
        where = np.zeros(max(1, len(signs)), np.uint64)
        for k, c in enumerate(pivot):
            if c in signs:
                where[signs[c]] |= one << np.uint64(k)
        last = np.uint64(m - 1)
        up, down = np.full(len(words), (1 << m) - 1, np.uint64), np.zeros(len(words), np.uint64)
        score = np.full(len(words), m, np.int64)
        for column in columns:
            n = len(column)
            eq, vp, vn = where[column], up[:n], down[:n]
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp, hn = vn | ~(d0 | vp), d0 & vp
            score[:n] += ((hp >> last) & one).astype(np.int64) - ((hn >> last) & one).astype(np.int64)
            hp = (hp << one) | one
            up[:n], down[:n] = (hn << one) | ~(d0 | hp), d0 & hp
        out[order, p] = np.minimum(score, 255)
    return out


def choose_pivots(keys: list[str], count: int) -> list[str]:
    """Keys far from each other, each the farthest from those before it; the empty key is the first, whose distances are lengths."""
    keys = sorted({k for k in keys if len(k) < 64})
    pivots = [""]
    away = distances(keys, pivots)[:, 0].astype(int) if keys else np.zeros(0, int)
    while len(pivots) < min(count, len(keys) + 1):
        pivots.append(keys[int(away.argmax())])
        away = np.minimum(away, distances(keys, pivots[-1:])[:, 0])
        away[[k in pivots for k in keys]] = -1
    return pivots


def radius_join(asked: DataFrame, targets: DataFrame) -> DataFrame:
    """(space, q, key, distance): the pairs of distinct typed keys (space, key, radius) and registry keys (space, key) within the radius, the widest one asked with.

    Targets belong to their nearest pivot; cells are kept apart by space. For a key q at most r from a target in the cell of pivot p, d(q, p) is
    at most the cell's greatest distance + r, and at most 2 r more than the distance from q to its own nearest pivot.
    """
    spark = settle(asked.sparkSession)
    targets = checkpoint(targets.select("space", "key").distinct())
    facts = targets.agg(F.count("*").alias("n"), F.max(F.length("key")).alias("most")).first()
    schema = "space string, q string, key string, distance int"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    count = min(MOST, max(FEWEST, round(_DENSITY * facts["n"] ** 0.5)))
    drawn = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, _SAMPLE * count / facts["n"]) * (1 << 30))
    pivots = choose_pivots([r["key"] for r in targets.filter(drawn).collect()], count)  # about _SAMPLE * count rows
    asked = asked.groupBy("space", F.col("key").alias("q")).agg(F.max("radius").alias("radius")).filter(F.length("q") - F.col("radius") <= facts["most"])

    def measure(column: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    d = distances(part.column(column).to_pylist(), pivots)
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(pivots)), len(d), [None, pa.py_buffer(np.ascontiguousarray(d).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(axis=1), pa.int32()), packed], [*part.schema.names, "cell", "d"])

        return run

    placed = checkpoint(targets.mapInArrow(measure(1), "space string, key string, cell int, d binary"))
    own = F.conv(F.hex(F.expr("substring(d, cell + 1, 1)")), 16, 10).cast("int")
    cells = placed.groupBy("space", "cell").agg(F.max(own).alias("reach")).collect()  # at most a row for each space and pivot
    number = {(r["space"], r["cell"]): k for k, r in enumerate(sorted(cells))}
    reach = {s: {r["cell"]: r["reach"] for r in cells if r["space"] == s} for s, _ in number}
    near = asked.mapInArrow(measure(1), "space string, q string, radius int, cell int, d binary")
    splits = max(1, -(-asked.count() // _UNIT))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(int)
            r, space = b.column(2).to_numpy().astype(int), np.array(b.column(0).to_pylist(), object)
            for s, far in reach.items():
                rows = np.flatnonzero(space == s)
                which = np.array(sorted(far))
                ids, most = np.array([number[s, c] for c in which]), np.array([far[c] for c in which])
                mine = d[rows][:, which]
                go = (mine <= most + r[rows, None]) & (mine <= d[rows].min(axis=1)[:, None] + 2 * r[rows, None])
                i, c = np.nonzero(go)
                part = b.take(pa.array(rows[i]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[c] * splits + rows[i] % splits, pa.int32()), pa.array(np.ones(len(i)), pa.int32()), part.column(1), part.column(4), part.column(2)], names)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([number[x] for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)], int)
            i = np.repeat(np.arange(b.num_rows), splits)
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i] * splits + np.tile(np.arange(splits), b.num_rows), pa.int32()), pa.array(np.zeros(len(i)), pa.int32()), part.column(1), part.column(3), pa.array(np.zeros(len(i)), pa.int32())], names)

    names = ["unit", "asks", "key", "d", "radius"]
    kind = "unit int, asks int, key string, d binary, radius int"
    sent = placed.mapInArrow(give, kind).unionByName(near.mapInArrow(route, kind)).repartitionById(len(number) * splits, F.col("unit")).sortWithinPartitions("unit", "asks")
    space_of = {k: s for (s, _), k in number.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a unit that no pivot rules out; its targets come first."""
        unit, held, keys, away = None, [], None, None
        for b in batches:
            units, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(units) | np.diff(asks)) + 1
            for a, z in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows], strict=True):
                part = b.slice(a, z - a)
                if not part.num_rows:
                    continue
                if units[a] != unit:
                    unit, held, keys = units[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if keys is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    away = np.frombuffer(b"".join(t["d"].to_pylist()), np.uint8).reshape(t.num_rows, -1).astype(np.int16)
                    order = np.argsort(away[:, 0], kind="stable")  # by length, the first pivot being empty
                    keys, away = t["key"].combine_chunks().take(pa.array(order)), away[order]
                    keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
                q = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1).astype(np.int16)
                r = part.column(4).to_numpy()
                lo, hi = np.searchsorted(away[:, 0], q[:, 0] - r, "left"), np.searchsorted(away[:, 0], q[:, 0] + r, "right")
                hits = [lo[i] + np.flatnonzero((np.abs(away[lo[i] : hi[i]] - q[i]) <= r[i]).all(axis=1)) for i in range(len(q))]
                i, j = np.repeat(np.arange(len(q)), [len(h) for h in hits]), np.concatenate(hits) if hits else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array([space_of[units[a] // splits]] * len(i), pa.string()), part.column(2).take(pa.array(i)), keys.take(pa.array(j)), part.column(4).take(pa.array(i))], ["space", "q", "key", "radius"])

    pairs = sent.mapInArrow(compare, "space string, q string, key string, radius int").withColumn("distance", F.levenshtein("q", "key", 4))
    return pairs.filter("distance >= 0 AND distance <= radius").select("space", "q", "key", "distance")


def _learn(names: DataFrame, registry: DataFrame, common: float, nicknames: dict[str, str] | None) -> Lexicon:
    """The lexicon of a registry and of the names typed.

    Generic words are those of at least ``common`` of all companies, given names those that begin at least ``common`` / 4 of all persons' names
    (three in either case). Noise are words that no registry name has and that come with many different longest words: with at least
    ``common`` / 8 times as many as there are distinct typed names of the kind (eight at least). So each list has a bounded length.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    firms, persons = registry.filter("kind = 'company'"), registry.filter("kind = 'person'")
    shared = firms.select("ref_id", F.explode(F.array_distinct(words(F.col("name")))).alias("w")).distinct().groupBy("w").count().filter(F.col("count") >= max(3, common * firms.count()))
    first = persons.select("ref_id", F.element_at(words(F.col("name")), 1).alias("w")).distinct().groupBy("w").count().filter(F.col("count") >= max(3, common / 4 * persons.count()))
    generic, given = {r["w"] for r in shared.collect()} - set(_FORM), {r["w"] for r in first.collect() if r["w"] and len(r["w"]) > 2}
    typed = names.select("kind", F.array_distinct(words(F.col("name"))).alias("ws"))
    ranked = F.reverse(F.array_sort(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    beside = typed.withColumn("l", F.transform(F.slice(ranked, 1, 2), lambda x: x["w"])).select("kind", "l", F.explode("ws").alias("w"))
    beside = beside.select("kind", "w", F.when(F.col("w") == F.col("l")[0], F.try_element_at("l", F.lit(2))).otherwise(F.col("l")[0]).alias("other"))
    sizes = {r["kind"]: r["count"] for r in names.groupBy("kind").count().collect()}
    many = beside.groupBy("kind", "w").agg(F.approx_count_distinct("other").alias("n"))
    many = many.filter(reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("n") >= max(8, common / 8 * n)) for k, n in sizes.items()], F.lit(False)))
    known = registry.select(F.explode(words(F.col("name"))).alias("w")).distinct()
    lexicon = Lexicon(generic, given, (), nicknames)
    noise = []
    for r in many.join(known, "w", "left_anti").collect():
        kind, w = r["kind"], r["w"]
        told = lexicon.meant(w) != ([w], True) if kind == "company" else len(lexicon.given_names(w)) > 1
        if w not in _FORM and not told and len(w) > 1:
            noise.append((kind, w))
    return Lexicon(generic, given, noise, nicknames)


def link_names(names: DataFrame, registry: DataFrame, common: float = 0.008, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(kind, name, ref_id, distance): the registry entry of every distinct (kind, name) that means one.

    ``names`` has kind (company or person) and name; ``registry`` has ref_id, entity_type, name and
    former_name. A name may differ from an entry's full or former name by a few edits of its canonical key, may lack
    generic words, be reduced to initials, or a given name to its initial; a legal form or middle initial that contradicts the
    entry's rules it out. The nearest entry wins, fuller names before reduced ones; a name that two entries are
    equally near to means none. Null and empty names and other kinds give no row. ``common`` is described at ``_learn``; ``nicknames`` maps
    full given names to their short forms, apart by spaces, and replaces ``NICKNAMES``.
    """
    listed = registry.select("ref_id", F.col("entity_type").alias("kind"), F.explode(F.array("name", "former_name")).alias("name")).filter("name IS NOT NULL AND kind IN ('company', 'person')").distinct()
    spark = names.sparkSession
    # As many parts as the session shuffles into: the work is in the keys, not in their few bytes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    named = checkpoint(names.select("kind", "name").filter("kind IN ('company', 'person') AND trim(name) != ''").distinct().repartition(parts, "name"))
    lexicon = _learn(named, listed, common, nicknames)

    def keys_of_registry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *k) for i, kind, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in registry_keys(kind, n, lexicon) if k[1]]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], ["ref_id", "space", "key", "weight", "mark"])

    def keys_of_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(kind, n, *k) for kind, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in typed_keys(kind, n, lexicon) if k[1]]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.string()] * 5, pa.int32()], strict=True)], ["kind", "name", "space", "q", "qmark", "radius"])

    reference = checkpoint(listed.select("ref_id", "kind", "name").mapInArrow(keys_of_registry, "ref_id bigint, space string, key string, weight int, mark string"))
    typed = checkpoint(named.mapInArrow(keys_of_names, "kind string, name string, space string, q string, qmark string, radius int"))
    near = radius_join(typed.select("space", F.col("q").alias("key"), "radius"), reference)
    near = near.join(reference, ["space", "key"]).select("space", "q", "distance", "ref_id", "weight", "mark").join(typed, ["space", "q"]).filter(F.col("distance") <= F.col("radius"))
    person = F.col("kind") == "person"
    middle = (F.length("mark") > 1) & (F.length("qmark") > 1)
    agrees = F.when(person, (~middle | (F.substring("mark", 2, 1) == F.substring("qmark", 2, 1))) & ((F.col("space") != "lastname") | (F.substring("mark", 1, 1) == F.substring("qmark", 1, 1)))).otherwise((F.col("qmark") == "") | (F.col("mark") == F.col("qmark")))
    # A name has few entries within its radius.
    rank = F.struct("distance", "weight")
    best = near.filter(agrees).groupBy("kind", "name", "ref_id").agg(F.min(rank).alias("rank"))
    top = best.groupBy("kind", "name").agg(F.min(F.struct("rank", "ref_id")).alias("top"), F.collect_list("rank").alias("ranks"))
    return top.filter(F.size(F.filter("ranks", lambda r: r == F.col("top.rank"))) == 1).select("kind", "name", F.col("top.ref_id").alias("ref_id"), F.col("top.rank.distance").alias("distance"))


def link_records(records: DataFrame, registry: DataFrame, **options) -> DataFrame:
    """(record_kind, record_id, ref_id): the records, with columns record_kind, record_id, kind and name, whose name means an entry. Repeated records count once."""
    links = link_names(records, registry, **options).select("kind", "name", "ref_id")
    return records.select("record_kind", "record_id", "kind", "name").distinct().join(links, ["kind", "name"]).select("record_kind", "record_id", "ref_id").distinct()
