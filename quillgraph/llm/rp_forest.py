"""Operator 9: embedding near-duplicates by a forest of random projections.

A tree splits vectors again and again at the median of their projection on a
random direction.  Vectors near the cut go to both sides (spill), so a close
pair is rarely parted, and as many trees are grown as pairs just at the
threshold need to meet in one of them, which is measured.  Vectors are compared
within leaves: by a product of single-precision unit vectors, and near the
threshold by the plain formula in double precision.

A comparison costs less than a copy of a vector in the shuffle, so leaves are
large and spill zones narrow.  A leaf that outgrows what its tree was fitted
for is split again where it is compared, by a forest of its own vectors, and
one that outgrows a task is compared in blocks.

A pair that meets in several leaves counts in the first of them only, which the
members' leaf lists tell; so a leaf gives no pairs but, for each member, how
many links it found, and such links as join its members' groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, dropped, written
from .shingles import mix

#: Vectors of a leaf, about.
LEAF = 16_384
#: Vectors that the trees of one length are fitted on, at most; all vectors are indexed.
SAMPLE = 40_000
#: Vectors of the sample in a leaf, at least: so deep the trees go.
FIT = 16
#: Half the width of the spill zone, in standard deviations of the projected
#: distance of a pair just at the threshold.
SPILL = 0.4
#: Share of pairs just at the threshold that meet in some leaf, at least.
TARGET = 0.99
#: Vectors that one task compares, at most; more are dealt into blocks of half as many.
HELD = 131_072
#: Tables of so many rows at most are broadcast.
SMALL = 200_000
#: Single-precision cosines are this close to the truth.
ERROR = 2e-5
ROWS = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Forest:
    """Trees of hyperplanes; leaf t * 2^depth + k is the k-th of tree t."""

    def __init__(self, sample: np.ndarray, depth: int, least: float, target: float = TARGET, spill: float = SPILL, seed: int = 0):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth, self.margin = depth, spill * math.sqrt(max(0.0, 2 - 2 * least) / dims)
        self.planes: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.recall = 1.0
        if not depth:
            self.planes, self.cuts = [np.zeros((0, dims))], [np.zeros(0)]
            return
        x = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
        y = rng.standard_normal(x.shape)
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
        y = least * x + math.sqrt(max(0.0, 1 - least * least)) * y / np.maximum(1e-300, np.linalg.norm(y, axis=1, keepdims=True))
        met = np.zeros(len(x), bool)
        while len(self.planes) < 2 or met.mean() < target and len(self.planes) < 64:
            self._grow(sample, rng)
            t = len(self.planes) - 1
            a, b = (self._descend(z, t) for z in (x, y))
            common = np.intersect1d(*(row << 32 | node for row, node in (a, b)))
            met[common >> 32] = True
        self.recall = float(met.mean())

    def _grow(self, sample: np.ndarray, rng: np.random.Generator) -> None:
        inner = (1 << self.depth) - 1
        planes, cuts = rng.standard_normal((inner, sample.shape[1])), np.zeros(inner)
        planes /= np.linalg.norm(planes, axis=1, keepdims=True)
        parts = {0: np.arange(len(sample))}
        for node in range(inner):
            own = parts.pop(node)
            x = sample[own] @ planes[node]
            cuts[node] = np.median(x) if len(x) else 0.0
            parts[2 * node + 1], parts[2 * node + 2] = own[x < cuts[node]], own[x >= cuts[node]]
        self.planes.append(planes)
        self.cuts.append(cuts)

    def _descend(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[row], self.planes[t][node]) - self.cuts[t][node]
            left, right = p < self.margin, p >= -self.margin
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node - ((1 << self.depth) - 1)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf), ordered by row and leaf, of unit vectors."""
        found = [self._descend(x, t) for t in range(len(self.planes))]
        row = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([n + (t << self.depth) for t, (_, n) in enumerate(found)])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def depth_for(n: int, sample: int, leaf_size: int) -> int:
    """Levels for leaves of about ``leaf_size``, as far as the sample goes."""
    return max(0, min(math.ceil(math.log2(max(1, n / leaf_size))), int(math.log2(max(1, sample / FIT)))))


# ------------------------------------------------------------ within a leaf


def _lists(row: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """Leaf lists as rows of one array, filled up with -1."""
    counts = np.bincount(row, minlength=n)
    out = np.full((n, int(counts.max(initial=0))), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = leaf
    return out


def _met(lists: np.ndarray, i: np.ndarray, j: np.ndarray, before: int) -> np.ndarray:
    """Whether pairs share a leaf before that one."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        a, b = lists[i[k : k + 100_000]], lists[j[k : k + 100_000]]
        own = (a >= 0) & (a < before)
        for c in range(b.shape[1]):
            out[k : k + 100_000] |= ((a == b[:, c : c + 1]) & own).any(axis=1)
    return out


class Found:
    """Links of the vectors of one cell: counts, and groups by union and find."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, own: np.ndarray | None, leaf: int, lists: np.ndarray, least: float):
        self.v, self.x = vectors, unit(vectors)
        self.single = self.x.astype(np.float32)
        self.weight, self.own, self.leaf, self.lists, self.least = weight, own, leaf, lists, least
        self.counts = np.zeros(len(vectors), np.int64)
        self.parent = np.arange(len(vectors))

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 100_000):
            a, b = (self.v[z[k : k + 100_000]].astype(np.float64) for z in (i, j))
            a, b = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1, keepdims=True))[1]) for z in (a, b))  # by powers of two, so exactly
            dot = lambda y, z: np.einsum("ij,ij->i", y, z)
            out[k : k + 100_000] = dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) >= self.least
        return out

    def compare(self, some: np.ndarray, near: np.ndarray | None = None, part: int = 0) -> None:
        """All pairs of these members; in leaf ``part`` of the cell's own forest, with lists ``near``."""
        y = self.single[some]
        for lo in range(0, len(some), ROWS):
            cos = y[lo : lo + ROWS] @ y[lo:].T
            i, j = np.nonzero(cos >= self.least - ERROR)
            use = j > i
            i, j = i[use], j[use]
            sure = cos[i, j] > self.least + ERROR
            i, j = some[i + lo], some[j + lo]
            if self.own is not None:
                use = self.own[i] != self.own[j]
                i, j, sure = i[use], j[use], sure[use]
            doubt = np.flatnonzero(~sure)
            sure[doubt] = self._exact(i[doubt], j[doubt])
            i, j = i[sure], j[sure]
            new = ~_met(self.lists, i, j, self.leaf)
            if near is not None:
                new &= ~_met(near, i, j, part)
            np.add.at(self.counts, i[new], self.weight[j[new]])
            np.add.at(self.counts, j[new], self.weight[i[new]])
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def all_pairs(self, leaf_size: int) -> None:
        """Compares all; beyond twice a leaf's size, in the leaves of a forest of these vectors."""
        k = len(self.v)
        if k <= 2 * leaf_size:
            self.compare(np.arange(k))
            return
        fit = self.x[:: max(1, k // SAMPLE)][:SAMPLE]
        forest = Forest(fit, depth_for(k, len(fit), leaf_size), self.least, seed=self.leaf & 0xFFFF)
        row, leaf = forest.leaves(self.x)
        if len(row) > 3 * len(forest.planes) * k:  # vectors so close to each other that no cut parts them
            self.compare(np.arange(k))
            return
        near = _lists(row, leaf, k)
        order = np.argsort(leaf, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], leaf[order][1:] != leaf[order][:-1], [True])))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            self.compare(row[order[lo:hi]], near, int(leaf[order[lo]]))

    def groups(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (smallest id of a group, another of its ids)."""
        root = self.parent
        while not np.array_equal(up := root[root], root):
            root = up
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, root, ids)
        low = low[root]
        other = low != ids
        return low[other], ids[other]


# ------------------------------------------------------------------ dealing


@dataclass
class Kind:
    """How components are stored on the way: as they came."""

    dtype: np.dtype

    def matrix(self, column: pa.Array, dims: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.dtype).reshape(-1, dims)


def _hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row."""
    words = (x.view(np.uint32) if x.dtype == np.float32 else x.view(np.uint64)).astype(np.uint64)
    k = np.arange(1, words.shape[1] + 1, dtype=np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        out.append(mix(mix(words + k * np.uint64(salt)).sum(axis=1, dtype=np.uint64)).view(np.int64))
    return out[0], out[1]


def _of_lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the length, the rows, and the vectors that have only
    finite components, not all of them zero."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        flat = column.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # null becomes NaN
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield d, rows[good], np.ascontiguousarray(x[good]) + x.dtype.type(0)  # -0.0 becomes 0.0


def keyed(rows: DataFrame, kind: Kind, vectors: bool) -> DataFrame:
    """Rows (id, h1, h2, d[, v]) of (id, v): two hashes, the length and the bytes; nulls where a vector links with nothing."""
    names = ["id", "h1", "h2", "d", *(["v"] if vectors else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                n = batch.num_rows
                h, d, v, ok = np.zeros((2, n), np.int64), np.zeros(n, np.int32), [None] * n, np.zeros(n, bool)
                for size, some, x in _of_lengths(batch.column(1)):
                    ok[some], d[some] = True, size
                    h[:, some] = _hashes(x)
                    if vectors:
                        for i, y in zip(some.tolist(), x, strict=True):
                            v[i] = y.tobytes()
                ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                out = [batch.column(0), *(pa.array(z, mask=~ok) for z in (h[0], h[1], d))]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(v, pa.binary())] if vectors else [])], names=names)

    return rows.mapInArrow(read, "id long, h1 long, h2 long, d int" + (", v binary" if vectors else ""))


def representatives(rows: DataFrame, classes: DataFrame, kind: Kind) -> DataFrame:
    """Rows (id, m, d, v): of each class one vector, and how many it stands for.

    Only classes of several are joined; they are broadcast if few.
    """
    full = keyed(rows, kind, True).where("h1 is not null")
    several = written(classes.where("m > 1").select("h1", "h2", "d", "rep", "times", "m"), "vector-copies")
    n, twice = several.agg(F.count(F.lit(1)), F.max("times")).first()
    if not n:
        return full.select("id", F.lit(1).cast("long").alias("m"), "d", "v")
    got = full.join(F.broadcast(several) if n <= SMALL else several, ["h1", "h2", "d"], "left").where("rep is null or id = rep")
    if twice > 1:  # a row that is there several times
        again = got.where("times > 1").dropDuplicates(["h1", "h2", "d"])
        got = got.where("times is null or times = 1").unionByName(again)
    return got.select("id", F.coalesce("m", F.lit(1)).cast("long").alias("m"), "d", "v")


def similar_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, leaf_size: int = LEAF, sample_size: int = SAMPLE, seed: int = 0, held: int = HELD) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Links are pairs of vectors of one length whose cosine is ``least`` or more.
    Null vectors, zero vectors and those with null or non-finite components have
    no links, nor has a null identifier.  Equal vectors are one class, of which
    each counts the others.  Rows that share an identifier are vectors of their
    own under one identifier.  Vectors of any length are compared with those of
    that length, each length by a forest of its own, fitted on ``sample_size``
    vectors at most, chosen by a hash.  An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    kind_of = vectors.schema[vector_col].dataType
    single = isinstance(kind_of, T.ArrayType) and isinstance(kind_of.elementType, T.FloatType)
    kind = Kind(np.dtype("<f4" if single else "<f8"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    light = written(keyed(rows, kind, False), "vector-keys")
    each = light.where("h1 is not null").groupBy("h1", "h2", "d", "id").agg(F.count(F.lit(1)).alias("c"))
    classes = each.groupBy("h1", "h2", "d").agg(F.min(F.struct("id", "c")).alias("f"), F.sum("c").alias("m"))
    classes = written(classes.select("h1", "h2", "d", F.col("f.id").alias("rep"), F.col("f.c").alias("times"), "m"), "vector-classes")
    sizes = {r.d: r.n for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    reps = representatives(rows, classes, kind)

    forests: dict[int, Forest] = {}
    for d, n in sizes.items():
        if n > leaf_size:
            share = min(1.0, 1.1 * sample_size / n)
            some = reps.where((F.col("d") == d) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < share * (1 << 30))).select("v").limit(sample_size).toArrow()
            sample = unit(kind.matrix(some.column(0), d))
            forests[d] = Forest(sample, depth_for(n, len(sample), leaf_size), least, seed=seed)
    sent = spark.sparkContext.broadcast(forests)  # a direction for each two leaves: at most sample_size / FIT a tree

    def leaves_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: its rows in the batch, and pairs (place among these, leaf)."""
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            some = np.flatnonzero(dims == d)
            if (forest := sent.value.get(d)) is None:
                row, leaf = np.arange(len(some)), np.zeros(len(some), np.int64)
            else:
                row, leaf = forest.leaves(unit(kind.matrix(batch.column(3).take(pa.array(some)), d)))
            yield some, row, leaf + (d << 32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                for _, _, leaf in leaves_of(whole.slice(at, 4000)):
                    for k, c in zip(*(z.tolist() for z in np.unique(leaf, return_counts=True)), strict=True):
                        total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["leaf", "k"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                for some, row, leaf in leaves_of(batch):
                    of = np.searchsorted(row, np.arange(len(some) + 1))
                    raw = leaf.astype("<i8").tobytes()
                    lists = pa.array([raw[8 * a : 8 * b] for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.binary())
                    take = pa.array(some[row])
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), *(batch.column(c).take(take) for c in (0, 1, 3)), lists.take(pa.array(row))], names=["leaf", "id", "m", "v", "leaves"])

    sized = reps.mapInArrow(count, "leaf long, k long").groupBy("leaf").agg(F.sum("k").alias("k")).where(F.col("k") > held)
    sized = written(sized.select("leaf", F.ceil(F.col("k") / (held // 2)).cast("int").alias("blocks")), "large-leaves")
    n_large = sized.count()
    cells = reps.mapInArrow(place, "leaf long, id long, m long, v binary, leaves binary")
    if n_large:
        cells = cells.join(F.broadcast(sized) if n_large <= SMALL else sized, "leaf", "left")
        own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        cells = cells.withColumn("own", F.when(F.col("blocks") > 1, own).otherwise(-1))
        cells = cells.withColumn("other", F.explode(F.when(F.col("own") >= 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(-1)))))
        # a block meets itself, and each other block in a cell of the two
        lo, hi = F.least("own", "other"), F.greatest("own", "other")
        cells = cells.select(F.xxhash64("leaf", lo, hi).alias("cell"), F.when(lo == hi, -1).otherwise(F.col("own")).alias("own"), "leaf", "id", "m", "v", "leaves")
    else:
        cells = cells.select(F.xxhash64("leaf").alias("cell"), F.lit(-1).alias("own"), "leaf", "id", "m", "v", "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held_)
            held_.clear()
            column = lambda k: t.column(k).combine_chunks()
            leaf = int(t.column("leaf")[0].as_py())
            ids, own = column("id").to_numpy(), column("own").to_numpy()
            v = kind.matrix(t.column("v"), leaf >> 32)
            raw = column("leaves").to_pylist()
            counts = np.array([len(r) // 8 for r in raw])
            lists = _lists(np.repeat(np.arange(len(raw)), counts), np.frombuffer(b"".join(raw), "<i8"), len(raw))
            found = Found(v, column("m").to_numpy(), own if own[0] >= 0 else None, leaf, lists, least)
            found.all_pairs(leaf_size)
            some = np.flatnonzero(found.counts)
            h1, h2 = _hashes(np.ascontiguousarray(v[some]))
            a, b = found.groups(ids)
            none = [pa.nulls(k, pa.int64()) for k in (len(some), len(a))]
            both = lambda x, y: pa.concat_arrays([x, y])
            columns = [both(none[0], pa.array(a)), both(none[0], pa.array(b)), both(pa.array(h1), none[1]), both(pa.array(h2), none[1]), both(pa.array(np.full(len(some), leaf >> 32)), none[1]), both(pa.array(found.counts[some]), none[1])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "h1", "h2", "d", "n"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            at = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for i, j in zip(at[:-1], at[1:], strict=True):
                if i == j:
                    continue
                if held_ and held_[0].column(0)[0].as_py() != cell[i]:
                    yield done()
                held_.append(batch.slice(i, j - i))
        if held_:
            yield done()

    found = written(cells.mapInArrow(compare, "a long, b long, h1 long, h2 long, d long, n long"), "found")
    counts = found.where("n is not null").groupBy("h1", "h2", F.col("d").cast("int").alias("d")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a is not null").select("a", "b")).withColumnRenamed("id", "rep")
    of = classes.select("h1", "h2", "d", "rep", "m").join(counts, ["h1", "h2", "d"], "left").join(joined, "rep", "left")
    of = written(of.select("h1", "h2", "d", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-groups")
    dropped(found)
    out = light.join(of, ["h1", "h2", "d"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
