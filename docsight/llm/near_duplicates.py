"""Near-duplicate texts over sets of word shingles: blocks of fingerprint slots, Hamming verification, exact check.

A text's fingerprint has ``slots`` min-hash values of its shingle set, one byte each. The slots are cut into
blocks of ``width`` slots, twice and in different ways. By the pigeonhole principle two fingerprints that differ in fewer
slots than one cut has blocks agree on a whole block, so a join on blocks meets them; the second cut makes
pairs that differ in more slots meet almost always. Candidates are verified by the Hamming distance of
two-bit sketches of the slots, then exactly on the texts.

Texts with the same shingle set form a class and only one representative of it takes part in the join,
so exact copies cost nothing however many there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsight.runtime import checkpoint

_WORD = re.compile(r"[^\W_]+")
_PIECE = 512
_WORDS_KEPT = 500_000
_SEED = 20_240_117
#: Classes of a block beyond which it is spread, and of a tile in which texts are compared; blocks posted to one part.
CROWD, TILE, PART = 1_024, 2_048, 500_000


@lru_cache(maxsize=4)
def _multipliers(slots: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes of the distinct word shingles of texts; one for each Python worker."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of the texts that count, shingle hashes sorted by text, their text's place among these)."""
        from xxhash import xxh3_64_intdigest

        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        known = self.known
        lists = [_WORD.findall(t.lower()) for t in texts]
        use = [k for k, w in enumerate(lists) if len(w) >= max(least, self.words)]
        lists = [lists[k] for k in use]
        for w in set().union(*lists) - known.keys():
            known[w] = xxh3_64_intdigest(w)
        sizes = np.array([len(w) for w in lists], np.int64)
        if not len(sizes):
            return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
        flat = np.fromiter((known[w] for ws in lists for w in ws), np.uint64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        n = len(flat) - self.words + 1
        value = np.zeros(n, np.uint64)
        for k in range(self.words):
            value = _mix(value + flat[k : k + n] + np.uint64(k + 1))
        inside = doc[:n] == doc[self.words - 1 :]
        value, doc = value[inside], doc[:n][inside]
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        return np.array(use), value[new], doc[new]


_shinglers: dict[int, Shingler] = {}


def _shingler(words: int) -> Shingler:
    return _shinglers.setdefault(words, Shingler(words))


def _class(x: np.ndarray) -> int:
    """What ``signatures`` gives as class of one set of shingle hashes."""
    return int(_mix(_mix(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))).view(np.int64)[0])


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, least: int, slots: int) -> DataFrame:
    """(id, cls, s0, s1, ..., slots): class of the shingle set, two bits of each slot in longs, and one byte of each slot."""
    kind = df.schema[id_col].dataType.simpleString()
    longs = slots // 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, a = _shingler(words), _multipliers(slots)
        for batch in batches:
            for at in range(0, batch.num_rows, _PIECE):
                part = batch.slice(at, _PIECE)
                use, x, doc = shingle([t or "" for t in part.column(1).to_pylist()], least)
                if not len(use):
                    continue
                starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                cls = _mix(np.add.reduceat(_mix(x), starts) + np.diff(np.r_[starts, len(x)]).astype(np.uint64)).view(np.int64)
                low = np.empty((len(starts), slots), np.uint8)
                for k in range(slots):
                    low[:, k] = np.minimum.reduceat((x * a[k]) >> np.uint64(24), starts) & np.uint64(255)
                sketch = np.packbits(np.concatenate([low & 1, (low >> 1) & 1], axis=1), axis=1).view(np.int64)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(slots), len(starts), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(use)), pa.array(cls), *(pa.array(sketch[:, k]) for k in range(longs)), packed], ["id", "cls", *(f"s{k}" for k in range(longs)), "slots"])

    sketch = ", ".join(f"s{k} bigint" for k in range(longs))
    return df.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * least - 1)).select(id_col, text_col).mapInArrow(run, f"id {kind}, cls bigint, {sketch}, slots binary")


def _posted(classes: DataFrame, slots: int, width: int) -> DataFrame:
    """(cls, block) of all blocks of classes (cls, slots): consecutive slots, then slots a fixed stride apart; a block's number and its slots make its key."""
    count = slots // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                low = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, slots)
                both = np.concatenate([low.reshape(-1, count, width), low.reshape(-1, width, count).transpose(0, 2, 1)], axis=1).astype(np.int64)
                key = np.zeros(both.shape[:2], np.int64) + np.arange(2 * count)
                for k in range(width):
                    key = key << 8 | both[:, :, k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), 2 * count)), pa.array(key.ravel())], ["cls", "block"])

    return classes.select("cls", "slots").mapInArrow(run, "cls bigint, block bigint")


def _only(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``df`` whose id may be among the ``n`` of ``ids``: a bitmap of some 16 bits an id, 8 MB at most, is broadcast. Where there are more ids it only lets more rows pass."""
    bits = min(26, max(16, (16 * n).bit_length()))
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6).cast("int"), F.expr("shiftleft(1L, cast(xxhash64(id) & 63 as int))")
    bitmap = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = df.withColumns({"word": word, "bit": bit}).join(F.broadcast(bitmap), "word")
    return marked.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


class NearDuplicates:
    """The linked pairs of a collection.

    ``words``: words in a shingle; words are runs of letters and digits, lower-cased. ``threshold``: least
    Jaccard similarity. ``least``: texts of fewer words never count, nor do null texts and null ids. Repeated
    rows of an id count once; an id with several different texts is linked by any of them. Extra columns
    are not read. An empty table gives no pair.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, least: int = 20, slots: int = 96, width: int = 4):
        if slots % width or slots % 32 or width > 6:
            raise ValueError("slots must be a multiple of width, 6 at most, and of 32")
        self.df, self.id_col, self.text_col, self.words, self.threshold, self.least, self.width, self.slots = df, id_col, text_col, words, threshold, least, width, slots
        self.signed = checkpoint(signatures(df, id_col, text_col, words, least, slots))
        self.members = self.signed.select("cls", "id").distinct()
        self.longs = [f"s{k}" for k in range(slots // 32)]

    def classes(self, *columns: str) -> DataFrame:
        """One row for each class: its smallest id and what all its members have in common."""
        return self.signed.groupBy("cls").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in columns)).select("cls", *(columns or ["id"]))

    def candidates(self) -> DataFrame:
        """(a, b) of classes that share a block and whose sketches are near enough, a < b."""
        posted = _posted(self.classes("slots"), self.slots, self.width)
        # In parts of bounded size, whatever the session shuffles into.
        parts = max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.signed.count() * 2 * (self.slots // self.width) // PART))
        posted = posted.repartition(parts, "block")
        a, b = posted.withColumnRenamed("cls", "a"), posted.withColumnRenamed("cls", "b")
        # One class in 64 tells which blocks are crowded; each of those is spread over parts of about CROWD classes.
        drawn = self.signed.filter(F.pmod(F.xxhash64("cls"), F.lit(64)) == 0).groupBy("cls").agg(F.first("slots").alias("slots"))
        few = _posted(drawn, self.slots, self.width).groupBy("block").agg((F.count("*") * 64).alias("n"))
        hot = checkpoint(few.filter(F.col("n") >= CROWD).select("block", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")))
        if hot.isEmpty():
            pairs = a.join(b, "block")
        else:
            pairs = a.join(hot, "block", "left_anti").join(b, "block").select("a", "b")
            split = a.join(hot, "block").withColumn("part", F.pmod(F.xxhash64("a", F.lit(1)), F.col("parts")).cast("int"))
            copied = b.join(hot, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            pairs = pairs.unionByName(split.join(copied, ["block", "part"]).select("a", "b"))
        sketches = self.classes(*self.longs)
        # Both the sketch and the removal of repeats need the pairs by their first class.
        pairs = pairs.filter("a < b").select("a", "b").join(sketches.toDF("a", *(f"a{k}" for k in self.longs)), "a").dropDuplicates(["a", "b"])
        pairs = pairs.join(sketches.toDF("b", *(f"b{k}" for k in self.longs)), "b")
        # A slot agrees with probability J, else each of its two bits with 1/2; 3.5 standard deviations are allowed for.
        j = self.threshold
        far = round(self.slots * (1 - j) + 3.5 * (self.slots * ((1 - j) * j + (1 - j) / 2)) ** 0.5)
        distance = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in self.longs), F.lit(0))
        return pairs.filter(distance <= far).select("a", "b")

    def links(self) -> DataFrame:
        """(a, b, similarity) of the classes whose texts are at least as similar as the threshold.

        A class leads those of its partners that have no smaller partner; a pair is compared where its smaller class is led. As partners mostly share
        their leader, a text travels about once however many partners it has. What one class leads is cut into tiles of bounded size.
        """
        pairs = checkpoint(self.candidates())
        ends = pairs.select(F.col("a").alias("cls"), F.col("a").alias("least")).union(pairs.select(F.col("b"), F.col("a")))
        leaders = checkpoint(ends.groupBy("cls").agg(F.min("least").alias("leader")))
        led = pairs.join(leaders.toDF("a", "leader"), "a")
        taken = led.select("leader", F.explode(F.array("a", "b")).alias("cls")).distinct()
        tiles = taken.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        place = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.col("tiles")).cast("int")
        led = led.join(tiles, "leader").select("leader", place("a").alias("x"), place("b").alias("y"), "a", "b")
        # A pair lies in the tile of its two places; a text goes to the tiles that need it.
        wanted = led.select("leader", "x", "y", F.explode(F.array("a", "b")).alias("cls")).distinct()
        ids = checkpoint(self.classes().join(leaders.select("cls"), "cls"))
        texts = self.df.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text")).filter(F.length("text") >= 2 * self.least - 1)
        # Texts are moved by id, repeats removed there, and then to their tiles; an id may have come with several texts, the class tells which one is meant.
        texts = _only(texts, ids.select("id"), ids.count()).repartition("id").dropDuplicates(["id", "text"])
        none = F.lit(None)
        sent = texts.join(wanted.join(ids, "cls"), "id").select("leader", "x", "y", F.col("cls").alias("a"), none.cast("bigint").alias("b"), "text")
        sent = sent.unionByName(led.select("leader", "x", "y", "a", "b", none.cast("string").alias("text")))
        keys = ["leader", "x", "y"]
        sent = sent.repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first())
        words, least, threshold = self.words, self.least, self.threshold

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by tile, its texts before its pairs; the sets of one tile are kept."""
            shingle, tile, sets = _shingler(words), None, {}
            for batch in batches:
                place = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
                a, b, text = (batch.column(k).to_pylist() for k in range(3, 6))
                full = [k for k, t in enumerate(text) if t is not None]
                made: dict[int, frozenset] = {}
                for n in range(0, len(full), _PIECE):
                    rows = full[n : n + _PIECE]
                    use, x, doc = shingle([text[k] for k in rows], least)
                    for i, found in zip(use, np.split(x, np.flatnonzero(np.diff(doc)) + 1), strict=True) if len(use) else ():
                        if _class(found) == a[rows[i]]:
                            made[rows[i]] = frozenset(found.tolist())
                at = 0
                while at < len(place):
                    end = at
                    while end < len(place) and place[end] == place[at] and (b[end] is None) == (b[at] is None):
                        end += 1
                    if place[at] != tile:
                        tile, sets = place[at], {}
                    if b[at] is None:
                        sets.update((a[k], made[k]) for k in range(at, end) if k in made)
                    else:
                        out = []
                        for k in range(at, end):
                            p, q = sets.get(a[k]), sets.get(b[k])
                            if p is not None and q is not None:
                                common = len(p & q)
                                value = common / (len(p) + len(q) - common)
                                if value >= threshold:
                                    out.append((a[k], b[k], value))
                        cols = list(zip(*out, strict=True)) or [()] * 3
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "similarity"])
                    at = end

        return sent.mapInArrow(exact, "a bigint, b bigint, similarity double")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all linked pairs of ids, those within a class included."""
        a, b = self.members.toDF("a", "id_a"), self.members.toDF("b", "id_b")
        across = self.links().join(a, "a").join(b, "b").select("id_a", "id_b")
        within = a.join(b, F.col("a") == F.col("b")).select("id_a", "id_b").filter("id_a < id_b")
        ordered = across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a != id_b")
        return ordered.union(within).distinct()

    def groups(self, rounds: int = 50) -> DataFrame:
        """(id, class_id, links, group_id): one row for each id that counts.

        ``class_id`` is the smallest id of its exact class, ``links`` the number of other ids it is linked
        to, ``group_id`` the smallest id of its connected group. Group labels spread by repeated minima with
        pointer jumping until nothing changes; only class ids take part in it.
        """
        links = checkpoint(self.links().select("a", "b"))
        edges = links.union(links.select("b", "a")).toDF("a", "b")
        label = checkpoint(self.signed.select(F.col("cls").alias("a"), F.col("cls").alias("g")).distinct())
        for _ in range(rounds):
            near = edges.join(label.toDF("b", "g"), "b").groupBy("a").agg(F.min("g").alias("n"))
            step = label.join(near, "a", "left").select("a", F.least("g", F.coalesce("n", "g")).alias("g"), F.col("g").alias("was"))
            jump = label.toDF("g", "up")
            step = checkpoint(step.join(jump, "g").select("a", F.least("g", "up").alias("g"), "was"))
            label = step.select("a", "g")
            if step.filter("g != was").isEmpty():
                break
        else:
            raise RuntimeError("the groups did not settle")
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
        degree = edges.join(sizes.select(F.col("cls").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("d"))
        classes = sizes.join(label.toDF("cls", "g"), "cls").join(degree.toDF("cls", "d"), "cls", "left")
        names = classes.groupBy("g").agg(F.min("class_id").alias("group_id"))
        classes = classes.join(names, "g").select("cls", "class_id", "group_id", (F.col("size") - 1 + F.coalesce("d", F.lit(0))).alias("links"))
        return self.members.join(classes, "cls").select("id", "class_id", "links", "group_id")
