"""The k most similar vectors of every vector by cosine: anisotropic 4-bit quantisation with exact reranking.

Cells number four times the square root of the vectors at every size. Their centroids are trained in two levels: coarse
ones on the driver from a bounded sample, fine ones by the executors inside each coarse one, then refined together. What a vector's centroid
leaves of it is encoded by a 4-bit product codebook whose loss weighs the residual along the vector more than the one across it (score-aware loss for maximum
inner product). A query scans the codes of the cells nearest to itself by table look-ups and reranks the best with the exact vectors;
how many cells that takes is measured against exact neighbours in the whole table.

Neighbouring cells are packed into shards of bounded rows, larger cells are cut; a vector is sent once to its shard and once, as a
query, to every other shard that holds one of its cells. Equal vectors are one class with one representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsight.runtime import checkpoint, settle

#: Vectors that coarse centroids and codes are trained on, vectors whose exact neighbours are looked up, and the most cells, which bounds
#: what is broadcast (reached at 7e10 vectors); the most rows of a shard, some 180 MB in a task.
SAMPLE, PROBED, CELLS, BLOCK = 20_000, 256, 1 << 20, 1 << 19
#: Cells, and rows of a shard, for each square root of a vector; sampled vectors that train one cell, and the share of them that it begins with.
_DENSITY, _ROWS, _PER_CELL, _FIRST = 4.0, 128, 64, 0.25
#: Rounds in which all cells are refined together.
_ROUNDS = 5
_SEED = 7
_TOP = 60_000  # quantised scores fit 16 bits


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; empty cells restart at the worst served vectors."""
    rng = np.random.default_rng(_SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        own, best = s.argmax(1), s.max(1)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(own, x[:, j], k)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        c[empty] = x[np.argsort(best)[: len(empty)]]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class Codebook:
    """4-bit codes for groups of ``width`` dimensions under the anisotropic loss.

    loss = |r|^2 + (eta - 1) <r, x>^2 / |x|^2 for the residual r that coding leaves of a vector x; eta follows from the threshold T
    on the inner product above which scores matter: (d - 1) T^2 / (1 - T^2). What is coded may be ``x`` itself or what a
    cell's centroid leaves of it; ``along`` is x in both cases.
    """

    def __init__(self, y: np.ndarray, along: np.ndarray | None = None, width: int = 2, threshold: float = 0.2, rounds: int = 8):
        self.dim = y.shape[1]
        self.width = width
        self.groups = -(-self.dim // width)
        self.groups += self.groups % 2
        self.extra = max(0.0, (self.dim - 1) * threshold**2 / (1 - threshold**2) - 1)
        x = self.pad(y if along is None else along)
        y = self.pad(y)
        rng = np.random.default_rng(_SEED)
        self.words = np.stack([y[rng.choice(len(y), 16, replace=len(y) < 16)][:, g] for g in range(self.groups)])
        for _ in range(rounds):
            self._update(y, x, self._encode(y, x))

    def pad(self, x: np.ndarray) -> np.ndarray:
        """(n, groups, width)"""
        out = np.zeros((len(x), self.groups * self.width), np.float32)
        out[:, : self.dim] = x
        return out.reshape(len(x), self.groups, self.width)

    def _left(self, y: np.ndarray, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of each group's residual with x, x of unit length."""
        return ((y - self.words[np.arange(self.groups), codes]) * x).sum(2)

    def encode(self, y: np.ndarray, along: np.ndarray | None = None) -> np.ndarray:
        """(n, groups) of codes 0..15."""
        return self._encode(self.pad(y), self.pad(y if along is None else along))

    def _encode(self, y: np.ndarray, x: np.ndarray, passes: int = 1) -> np.ndarray:
        """Nearest words, then coordinate descent on the anisotropic loss."""
        codes = np.empty(y.shape[:2], np.uint8)
        for g in range(self.groups):
            codes[:, g] = ((y[:, g, None, :] - self.words[g]) ** 2).sum(2).argmin(1)
        left = self._left(y, x, codes)
        total = left.sum(1)
        for _ in range(passes):
            for g in range(self.groups):
                diff = y[:, g, None, :] - self.words[g]
                p = (diff * x[:, g, None, :]).sum(2)
                rest = total - left[:, g]
                best = ((diff**2).sum(2) + self.extra * (rest[:, None] + p) ** 2).argmin(1)
                codes[:, g] = best
                left[:, g] = p[np.arange(len(y)), best]
                total = rest + left[:, g]
        return codes

    def _update(self, y: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        left = self._left(y, x, codes)
        total = left.sum(1)
        eye = np.eye(self.width)
        for g in range(self.groups):
            rest = (total - left[:, g]).astype(float)
            for c in range(16):
                own = codes[:, g] == c
                if own.any():
                    v, w = y[own, g].astype(float), x[own, g].astype(float)
                    right = v.sum(0) + self.extra * ((rest[own] + (v * w).sum(1))[:, None] * w).sum(0)
                    self.words[g, c] = np.linalg.solve(len(v) * eye + self.extra * w.T @ w, right)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        return (codes[:, 0::2] << 4) | codes[:, 1::2]

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        out = np.empty((len(packed), self.groups), np.uint8)
        out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(groups, 16, n): how much each code scores above the lowest of its group, for every query."""
        single = np.einsum("ngw,gcw->gcn", self.pad(queries), self.words, optimize=True)
        return single - single.min(axis=1, keepdims=True)


def chain(x: np.ndarray) -> np.ndarray:
    """An order in which each vector follows the one nearest to it among those left."""
    left = np.ones(len(x), bool)
    order = [0] if len(x) else []
    while len(order) < len(x):
        left[order[-1]] = False
        order.append(int(np.where(left, x @ x[order[-1]], -np.inf).argmax()))
    return np.array(order, int)


class Shards:
    """Where cells lie: consecutive cells share a shard of at most ``block`` rows, a larger cell has several to itself.

    ``asked`` is the share of all queries that each cell gets. A shard with more than ``16 * block`` queries is served by several
    units, so copies of its rows stay few against the queries.
    """

    def __init__(self, counts: np.ndarray, asked: np.ndarray, total: int, block: int):
        starts, blocks, held = [], [], 0
        for cell, n in enumerate(counts):
            if not starts or held + n > block:
                starts.append(cell)
                blocks.append(max(1, -(-int(n) // block)))
                held = 0
            held += int(n)
        self.starts, self.blocks = np.array(starts), np.array(blocks)
        share = np.array([a.any(axis=1).mean() for a in np.split(asked, self.starts[1:], axis=1)]) if len(asked) else np.ones(len(starts))
        self.splits = np.maximum(1, np.ceil(share * total / (16 * block))).astype(int)
        self.base = np.concatenate([[0], np.cumsum(self.blocks * self.splits)])
        self.units = int(self.base[-1])
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.r_[self.starts, len(counts)]))

    def route(self, cls: np.ndarray, own: np.ndarray, hit: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """((row, unit, whether it asks there) of targets, (row, unit) of the queries elsewhere)."""
        h = cls.view(np.uint64)
        home = self.group[own]
        at, turn = (h >> np.uint64(8)) % self.blocks[home].astype(np.uint64), (h >> np.uint64(32)).astype(np.int64)
        row = np.repeat(np.arange(len(own)), self.splits[home])
        copy = np.arange(len(row)) - np.repeat(np.cumsum(self.splits[home]) - self.splits[home], self.splits[home])
        first = self.base[home] + at.astype(np.int64) * self.splits[home]
        targets = row, first[row] + copy, copy == turn[row] % self.splits[home][row]
        i, g = np.nonzero(np.logical_or.reduceat(hit, self.starts, axis=1))
        i, g = np.repeat(i, self.blocks[g]), np.repeat(g, self.blocks[g])
        new = np.r_[True, (i[1:] != i[:-1]) | (g[1:] != g[:-1])] if len(i) else np.zeros(0, bool)
        seen = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        unit = self.base[g] + seen * self.splits[g] + turn[i] % self.splits[g]
        away = (g != home[i]) | (seen != at.astype(np.int64)[i])
        return targets, (i[away], unit[away])


class Shard:
    """The rows of one shard, by cell, ready to be searched."""

    def __init__(self, codebook: Codebook, centroids: np.ndarray, cls: np.ndarray, cell: np.ndarray, ids: pa.ListArray, vectors: np.ndarray, codes: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.codebook, self.cls, self.vectors, self.codes = codebook, cls[order], vectors[order], codebook.unpack(codes[order])
        self.ids = ids.take(pa.array(order))
        first = pc.list_element(self.ids, 0) if len(order) else self.ids
        self.place = np.empty(len(order), np.int64)
        self.place[np.asarray(pc.array_sort_indices(first))] = np.arange(len(order))  # ties go to the smaller id
        cells, self.starts, self.sizes = np.unique(cell[order], return_index=True, return_counts=True)
        self.centroids = centroids[cells]

    def search(self, cls: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, row here, cosine) of the best ``k`` for each query among the cells whose centroid is at least ``least`` near to it, itself left out."""
        base = q @ self.centroids.T - (least[:, None] - 1e-6)
        hit = base >= 0
        taken = hit * self.sizes
        off = np.cumsum(taken, axis=1) - taken
        width = int(taken.sum(1).max()) if len(q) and len(self.sizes) else 0
        if not width:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        score = np.zeros((len(q), width), np.uint16)  # 0 is an empty place
        tables = self.codebook.tables(q)
        scale = _TOP / np.maximum(np.where(hit, base, 0).max(axis=1) + tables.max(axis=1).sum(axis=0), 1e-12)
        tables = (tables * scale).astype(np.uint16)
        base = np.where(hit, base * scale[:, None], 0).astype(np.uint16) + np.uint16(1)
        for f in np.flatnonzero(hit.any(axis=0)):
            rows = np.flatnonzero(hit[:, f])
            table = tables if len(rows) == len(q) else np.take(tables, rows, axis=2)
            code = self.codes[self.starts[f] : self.starts[f] + self.sizes[f]].astype(np.intp)
            total, part = np.repeat(base[None, rows, f], len(code), axis=0), np.empty((len(code), len(rows)), np.uint16)
            for g in range(table.shape[0]):
                np.take(table[g], code[:, g], axis=0, out=part, mode="clip")
                total += part
            score[rows[:, None], off[rows, f][:, None] + np.arange(len(code))] = total.T
        cut = np.partition(score, width - rerank, axis=1)[:, width - rerank] if rerank < width else np.zeros(len(q), np.uint16)
        r, p = np.nonzero(score >= np.maximum(cut, 1)[:, None])
        hr, hf = np.nonzero(hit)
        span = np.searchsorted(hr * np.int64(width + 1) + off[hr, hf], r * np.int64(width + 1) + p, side="right") - 1
        t = self.starts[hf[span]] + p - off[r, hf[span]]
        other = self.cls[t] != cls[r]
        r, t = r[other], t[other]
        exact, near = np.empty(len(r), np.float32), np.zeros(len(r), bool)
        ends = np.searchsorted(r, np.arange(len(q) + 1))
        for i in np.flatnonzero(np.diff(ends)):
            own = slice(ends[i], ends[i + 1])
            e = exact[own] = self.vectors[t[own]] @ q[i]
            near[own] = e >= np.partition(e, len(e) - k)[len(e) - k] if len(e) > k else True
        r, t, exact = r[near], t[near], exact[near]
        order = np.lexsort((self.place[t], -exact, r))
        r, t, exact = r[order], t[order], exact[order]
        new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        best = np.arange(len(r)) - np.repeat(new, np.diff(np.r_[new, len(r)])) < k
        return r[best], t[best], exact[best]


class NearestVectors:
    """Neighbours of every vector of ``df``.

    Null and all-zero vectors, vectors of another length than ``dim`` and vectors with NaN, null or infinite
    values take no part, nor do null ids. Of several vectors of one id the one with the smallest hash counts. Ties go to the
    smaller id; a vector has fewer than ``k`` neighbours only if the cells that it scans have no more. Extra columns are not read.
    ``recall`` is the share of the exact ``k`` nearest, of ``PROBED`` vectors in the whole table, that lie in the cells scanned;
    ``rerank`` candidates of each shard are compared exactly; ``block`` bounds the rows of a shard; by default it is 128 times the square root of the vectors, ``BLOCK`` at most.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", dim: int = 64, k: int = 10, block: int | None = None, rerank: int = 100, recall: float = 0.93, density: float = _DENSITY):
        self.k, self.dim, self.spark = k, dim, settle(df.sparkSession)
        self.id_type = df.schema[id_col].dataType.simpleString()

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                good = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), _binary(_unit(x[good]))], ["id", "v"])

        rows = df.filter(F.col(id_col).isNotNull() & (F.size(vector_col) == dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        vectors = rows.mapInArrow(clean, f"id {self.id_type}, v binary").select("id", F.xxhash64("v").alias("cls"), "v")
        self.members = checkpoint(vectors.groupBy("id").agg(F.min("cls").alias("cls")))
        n = self.members.agg(F.approx_count_distinct("cls", 0.02)).first()[0]
        self.near = None
        if not n:
            return

        rank = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
        # The first k + 1 ids of a class are all that can be among anyone's k nearest.
        first = self.members.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        classes = checkpoint(vectors.select("cls", "v").groupBy("cls").agg(F.first("v").alias("v")).join(first, "cls").select("cls", "ids", "v"))
        centroids, codebook, probed = self._train(classes.select("cls", "v"), n, density)
        self.cells = len(centroids)
        counts, near = self._survey(classes.select("cls", "v"), centroids, probed)
        q = probed[1] @ centroids.T
        places = np.argsort(np.argsort(-q, axis=1, kind="stable"), axis=1)
        found = np.array([places[i, c] for i, c in near], int)
        self.probes = probe = int(np.quantile(found, recall, method="higher")) + 1 if len(found) else 1
        shards = Shards(counts, places < probe, n, block or max(1, min(BLOCK, round(_ROWS * n**0.5))))
        self.units = shards.units
        enough = 4 * (k + 1)

        listed = f"array<{self.id_type}>"

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["unit", "asks", "cls", "least", "v", "cell", "code", "ids"]
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    cls, x = part.column(0).to_numpy(), _matrix(part.column(2), np.float32)
                    s = x @ centroids.T
                    own = s.argmax(axis=1)
                    least = -np.partition(-s, probe - 1, axis=1)[:, probe - 1]
                    for i in np.flatnonzero((s >= least[:, None]) @ counts < enough):  # these scan more cells, until there are rows enough
                        near = np.argsort(-s[i])
                        least[i] = s[i, near[min(np.searchsorted(np.cumsum(counts[near]), enough), len(near) - 1)]]
                    code = _binary(codebook.pack(codebook.encode(x - centroids[own], x)))
                    (row, unit, asks), (away, to) = shards.route(cls, own, s >= least[:, None])
                    take = lambda c, i: c.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(np.where(asks, 1, 0), pa.int32()), take(part.column(0), row), pa.array(least[row]), take(part.column(2), row), pa.array(own[row], pa.int32()), take(code, row), take(part.column(1), row)], names)
                    none = [pa.nulls(len(away), t) for t in (pa.int32(), pa.binary(), part.schema.field(1).type)]
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(away), 2), pa.int32()), take(part.column(0), away), pa.array(least[away]), take(part.column(2), away), *none], names)

        sent = classes.mapInArrow(send, f"unit int, asks int, cls bigint, least float, v binary, cell int, code binary, ids {listed}")
        sent = sent.repartitionById(shards.units, F.col("unit")).sortWithinPartitions("unit", "asks")

        def answers(shard: Shard, cls: np.ndarray, q: np.ndarray, least: np.ndarray, home: pa.Array | None) -> Iterator[pa.RecordBatch]:
            """At home a class is told its own ids as well, with a distance that nothing is below."""
            for at in range(0, len(cls), 2048):
                r, t, exact = shard.search(cls[at : at + 2048], q[at : at + 2048], least[at : at + 2048], k, rerank)
                m = len(cls[at : at + 2048])
                d, ids = -np.minimum(exact, 1.0).astype(np.float32), shard.ids.take(pa.array(t))
                if home is not None:
                    d, ids, r = np.r_[d, np.full(m, -1.0, np.float32)], pa.concat_arrays([ids, home.slice(at, m)]), np.r_[r, np.arange(m)]
                    by = np.argsort(r, kind="stable")
                    d, ids, r = d[by], ids.take(pa.array(by)), r[by]
                each = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(r, each, m))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cls[at : at + 2048]), pa.ListArray.from_arrays(ends, pa.array(np.repeat(d, each))), pa.ListArray.from_arrays(ends, ids.flatten())], ["cls", "d", "ids"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by unit, its targets before the queries from elsewhere; only targets are kept."""
            unit, held, shard = None, [], None

            def build() -> tuple[Shard, Iterator[pa.RecordBatch]]:
                t = pa.Table.from_batches(held).combine_chunks()
                cls, v, least = t["cls"].to_numpy(), _matrix(t["v"], np.float32), t["least"].to_numpy()
                ids = t["ids"].combine_chunks()
                ids = ids if isinstance(ids, pa.ListArray) else pa.concat_arrays(ids.chunks)
                made = Shard(codebook, centroids, cls, t["cell"].to_numpy(), ids, v, _matrix(t["code"], np.uint8))
                own = np.flatnonzero(t["asks"].to_numpy() == 1)
                own = own[np.argsort(t["cell"].to_numpy()[own], kind="stable")]  # neighbours scan the same cells
                return made, answers(made, cls[own], v[own], least[own], ids.take(pa.array(own)))

            for b in batches:
                units, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero(np.diff(units) | (np.diff(asks == 2) != 0)) + 1
                for a, z in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows], strict=True):
                    part = b.slice(a, z - a)
                    if not part.num_rows:
                        continue
                    if units[a] != unit:
                        if held and shard is None:
                            yield from build()[1]
                        unit, held, shard = units[a], [], None
                    if asks[a] < 2:
                        held.append(part)
                        continue
                    if not held:  # a shard without rows has nothing to give
                        continue
                    if shard is None:
                        shard, own = build()
                        yield from own
                    yield from answers(shard, part.column(2).to_numpy(), _matrix(part.column(4), np.float32), part.column(3).to_numpy(), None)
            if held and shard is None:
                yield from build()[1]

        self.near = sent.mapInArrow(search, f"cls bigint, d array<float>, ids {listed}")

    def _train(self, vectors: DataFrame, n: int, density: float) -> tuple[np.ndarray, Codebook, tuple[np.ndarray, np.ndarray]]:
        """Centroids, neighbours next to each other; the codebook; (classes, vectors) of the probed vectors."""
        cells = min(CELLS, max(1, round(density * n**0.5)))
        share = min(1.0, _PER_CELL * cells / n)
        drawn = lambda salt, part: F.pmod(F.xxhash64("cls", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30))
        sample = vectors.filter(drawn(1, share))
        rows = sorted((r["cls"], bytes(r["v"])) for r in sample.filter(drawn(2, SAMPLE / (share * n))).collect())  # about SAMPLE rows
        cls, x = np.array([c for c, _ in rows], np.int64), np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(-1, self.dim)
        if not len(x):
            rows = sample.limit(1).collect()
            cls, x = np.array([r["cls"] for r in rows], np.int64), np.frombuffer(b"".join(bytes(r["v"]) for r in rows), np.float32).reshape(-1, self.dim)
        coarse = kmeans(x, min(len(x), max(1, round(cells**0.5)))) if len(x) else np.ones((1, self.dim), np.float32) / self.dim**0.5
        coarse = coarse[chain(coarse)]
        expected = np.bincount((x @ coarse.T).argmax(axis=1), minlength=len(coarse)) / max(1, len(x)) * _FIRST * share * n
        salts = np.maximum(1, np.ceil(expected / 65_536)).astype(np.int64)  # so that a coarse cell of any size is trained in bounded parts

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = (_matrix(b.column(1), np.float32) @ coarse.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(b.column(0).to_numpy() % salts[own], pa.int32()), b.column(1)], ["cell", "salt", "v"])

        def fine(group: pa.Table) -> pa.Table:
            y = _matrix(group["v"], np.float32)
            y = y[np.lexsort(y.T[::-1])]
            c = kmeans(y, min(len(y), max(1, round(len(y) * cells / (_FIRST * share * n)))))
            return pa.table({"cell": pa.array(np.full(len(c), group["cell"][0].as_py()), pa.int32()), "salt": pa.array(np.full(len(c), group["salt"][0].as_py()), pa.int32()), "v": _binary(c[chain(c)])})

        trained = sample.filter(drawn(3, _FIRST)).mapInArrow(split, "cell int, salt int, v binary").groupBy("cell", "salt").applyInArrow(fine, "cell int, salt int, v binary")
        kept = {}
        for r in trained.collect():  # as many rows as cells
            kept.setdefault((r["cell"], r["salt"]), []).append(bytes(r["v"]))
        centroids = np.frombuffer(b"".join(v for key in sorted(kept) for v in kept[key]), np.float32).reshape(-1, self.dim) if kept else coarse
        for _ in range(_ROUNDS):
            centroids = self._refine(sample, centroids)
        few = x[:4_096]
        return centroids, Codebook(few - centroids[(few @ centroids.T).argmax(axis=1)], few), (cls[:PROBED], x[:PROBED])

    def _refine(self, sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """Each centroid moved to the mean of the sampled vectors nearest to it."""
        kind = "cell int, bin int, v binary"

        def sums(own: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(own, kind="stable")
            own, x = own[order], x[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total = np.add.reduceat(x.astype(np.float64), first, axis=0).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array(own[first], pa.int32()), pa.array(own[first] % 64, pa.int32()), _binary(total)], ["cell", "bin", "v"])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), np.float32)
                if len(x):
                    yield sums((x @ centroids.T).argmax(axis=1), x)

        merge = lambda t: pa.Table.from_batches([sums(t["cell"].to_numpy(), _matrix(t["v"], np.float32))])
        new = centroids.copy()
        for r in sample.mapInArrow(partial, kind).groupBy("bin").applyInArrow(merge, kind).collect():  # as many rows as cells
            new[r["cell"]] = _unit(np.frombuffer(bytes(r["v"]), np.float32)[None])[0]
        return new

    def _survey(self, vectors: DataFrame, centroids: np.ndarray, probed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """How many rows each cell has, and (probed vector, cell) of the exact ``k`` nearest in the whole table of every probed one."""
        own, asked = probed
        k = self.k

        def best(q, cls, cell, sim):
            order = np.lexsort((cls, -sim, q))
            q, cls, cell, sim = q[order], cls[order], cell[order], sim[order]
            new = np.r_[True, (q[1:] != q[:-1]) | (cls[1:] != cls[:-1])] if len(q) else np.zeros(0, bool)
            q, cls, cell, sim = q[new], cls[new], cell[new], sim[new]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
            top = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
            return q[top], cls[top], cell[top], sim[top]

        def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(centroids), np.int64)
            held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, np.float32))
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    cls, x = part.column(0).to_numpy(), _matrix(part.column(1), np.float32)
                    cell = (x @ centroids.T).argmax(axis=1)
                    counts += np.bincount(cell, minlength=len(counts))
                    cls, one = np.unique(cls, return_index=True)
                    cell, s = cell[one], asked @ x[one].T
                    s[own[:, None] == cls[None, :]] = -2
                    keep = min(k, len(cls))
                    top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                    new = np.repeat(np.arange(len(asked)), keep), cls[top].ravel(), cell[top].ravel(), np.take_along_axis(s, top, 1).ravel()
                    real = new[3] > -2
                    held = best(*(np.concatenate([h, v[real]]) for h, v in zip(held, new, strict=True)))
            full = np.flatnonzero(counts)
            q, cls, cell, sim = held
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), -1), pa.int32()), pa.array(full), pa.array(full, pa.int32()), pa.array(np.zeros(len(full), np.float32)), pa.array(counts[full])], ["q", "cls", "cell", "sim", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(cls), pa.array(cell, pa.int32()), pa.array(sim), pa.array(np.zeros(len(q), np.int64))], ["q", "cls", "cell", "sim", "n"])

        found = vectors.select("cls", "v").mapInArrow(survey, "q int, cls bigint, cell int, sim float, n bigint").groupBy("q", "cls", "cell").agg(F.max("sim").alias("sim"), F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("q", F.when(F.col("q") < 0, F.col("cell"))).orderBy(F.col("sim").desc(), "cls"))
        counts, near = np.zeros(len(centroids), np.int64), []
        for r in found.withColumn("r", place).filter(F.col("r") <= k).collect():  # one row for each cell, k for each probed vector
            if r["q"] < 0:
                counts[r["cell"]] = r["n"]
            else:
                near.append((r["q"], r["cell"]))
        return counts, near

    def neighbours(self) -> DataFrame:
        """(id, neighbour, similarity, position) for every vector that takes part."""
        k = self.k
        if self.near is None:
            return self.spark.createDataFrame([], f"id {self.id_type}, neighbour {self.id_type}, similarity double, position int")
        pairs = F.flatten(F.collect_list(F.arrays_zip("d", "ids")))  # k ids from each shard asked, k copies of each at most
        # Of its own class a vector may find itself, so one more is kept.
        merged = self.near.groupBy("cls").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("near"))
        own = self.members.select("cls", "id").join(merged, "cls")
        top = F.slice(F.filter("near", lambda s: s["ids"] != F.col("id")), 1, k)
        return own.select("id", F.posexplode(top).alias("p", "s")).select("id", F.col("s.ids").alias("neighbour"), (-F.col("s.d")).cast("double").alias("similarity"), (F.col("p") + 1).alias("position"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
