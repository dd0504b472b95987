"""Operator 3: near-duplicates by circulant MinHash.

A shingle hash is placed on a ring of ``RING`` positions by a first
permutation; a second permutation, shifted by k places, gives the k-th hash
function, so all coordinates of a signature come from two permutations: the
values under the second one at positions x .. x + K - 1 are the K hashes of a
shingle at x.  Coordinates are banded; documents that share a band are
candidates, and only pairs confirmed on their full shingle sets are linked.

A pair of similarity 0.8 shares no band of 4 coordinates out of 32 bands with
probability (1 - 0.8^4)^32 = 5e-8.

No group's pairs are all made.  Equal sets are one class with one
representative.  Within a band each member is first compared with one member,
that which meets most others (a cluster's centre); members already in one
component need no further comparison.  Only members of one band that are still
in different components are then compared.  Those of large bands are first
parted by shingles: sets that are similar enough share one of the rarest
shingles of each (its prefix), so only members that share one meet, and members
of a band that have merely a passage in common do not.  Where even such a
shingle has many members, they meet in blocks, with their full sets, and give
links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, dropped, slices, small_batches, utf8, written
from .shingles import mix, shingle_sets

RING = 1 << 20
BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
#: Of 128 signature bits, pairs that differ in more are not compared: at
#: similarity 0.8 the mean is 12.8 and 40 is eight deviations off.
SKETCH_BITS = 40
#: Up to so many members of a band or shingle are compared as pairs; of larger
#: ones the same pairs are, by way of shingles and blocks.
FEW = 48
BLOCK = 256
#: Counters of shingles, a power of two; 4 MB are sent to each executor.
COUNTERS = 1 << 20
#: Shingles that a task counts before it gives its sums, so that these are few beside them.
COUNTED = 16 * COUNTERS

_TABLES: list[np.ndarray] = []


def _ring() -> np.ndarray:
    """The values of the second permutation at each run of COORDS positions."""
    if not _TABLES:
        p = np.random.default_rng(7).permutation(RING).astype(np.uint32)
        _TABLES.append(np.lib.stride_tricks.sliding_window_view(np.concatenate((p, p[: COORDS - 1])), COORDS))
    return _TABLES[0]


def positions(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: a bijection of 64-bit integers, cut to the ring."""
    return (mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(RING - 1)).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDS smallest values of a non-empty set, one for each shift."""
    ring, x = _ring(), positions(shingles)
    low = ring[x[:2048]].min(axis=0)
    for i in range(2048, len(x), 2048):
        np.minimum(low, ring[x[i : i + 2048]].min(axis=0), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return h.view(np.int64)


_SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, h1, h2, s1, s2, bands) of (id, text): set size, a 128-bit
    digest of the set, 128 signature bits and the band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(*utf8(part.column(1)), size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig = np.array([signature(sets[i]) for i in full], np.uint32).reshape(-1, COORDS)
                out = {k: np.zeros(len(n), np.int64) for k in ("h1", "h2", "s1", "s2")}
                for i in full:
                    s = sets[i]
                    out["h1"][i] = mix(s).sum(dtype=np.uint64).view(np.int64)
                    out["h2"][i] = mix(s + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).view(np.int64)
                odd = (sig & np.uint32(1)).astype(np.uint64)
                out["s1"][full] = (odd[:, :64] * bits).sum(axis=1, dtype=np.uint64).view(np.int64)
                out["s2"][full] = (odd[:, 64:] * bits).sum(axis=1, dtype=np.uint64).view(np.int64)
                sizes = np.zeros(len(n) + 1, np.int32)
                sizes[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
                bands = pa.ListArray.from_arrays(pa.array(sizes), pa.array(band_keys(sig).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *map(pa.array, out.values()), bands], schema=_SIGNED)

    return docs.select("id", "text").mapInArrow(sign, "id long, n long, h1 long, h2 long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, shingles) of (id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(*utf8(part.column(1)), size)
                at = np.zeros(len(sets) + 1, np.int32)
                at[1:] = np.cumsum([len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], schema=_SETS)

    return docs.select("id", "text").mapInArrow(read, "id long, n long, shingles array<long>")


def _close(a: str, b: str, percent: int) -> Column:
    """What pairs of that similarity always (sizes) or nearly always (bits) satisfy."""
    ca, cb = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    sizes = F.least(ca("n"), cb("n")) * 100 >= F.greatest(ca("n"), cb("n")) * percent
    bits = F.bit_count(ca("s1").bitwiseXOR(cb("s1"))) + F.bit_count(ca("s2").bitwiseXOR(cb("s2")))
    return sizes & (bits <= SKETCH_BITS)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds on the full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    out = pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")
    return written(out, "confirmed")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists in one array, and n + 1 offsets."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]


def by_prefix(left: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) among members of large bands, and members of large
    groups in the columns of ``left``, which are to be compared in blocks.

    With shingles in any one order, two sets of n and more shingles that are
    similar enough share one of the first n - ceil(percent * n / 100) + 1 of each.
    The order is by how many members have a shingle, as ``COUNTERS`` counters
    tell that shingles share by hash (the only thing that is sent to all tasks);
    so a prefix holds the rarest ones, and what is shuffled are a fifth of the
    members' shingles at most, not their pairs.
    """
    members = left.select("id", "component", "n", "s1", "s2").distinct()
    rows = written(sets.join(members.select("id").distinct(), "id").select("id", "n", "shingles"), "large-sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    rows = rows.select("id", "shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat, _ = _flat(batch.column(1))
            total += np.bincount((mix(flat) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])

    # however thinly the sets lie over files: a shingle of many members is a row a task, not a row a file
    sums = rows.coalesce(max(1, -(-total // COUNTED))).mapInArrow(count, "counter long, n long")
    with small_batches(left.sparkSession):
        got = sums.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int32)
    counts[got["counter"].to_numpy()] = np.minimum(got["n"].to_numpy(), np.iinfo(np.int32).max)
    sent = left.sparkSession.sparkContext.broadcast(counts)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _flat(batch.column(1))
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            df = sent.value[(mix(flat) & np.uint64(COUNTERS - 1)).astype(np.int64)]
            order = np.lexsort((flat, df, row))
            place = np.arange(len(flat)) - at[:-1][row]  # rows stay together
            keep = order[place < (n - (n * percent + 99) // 100 + 1)[row]]
            keep = keep[df[keep] > 1]  # a counter of one is a shingle that nobody shares
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), batch.column(0).take(pa.array(row[keep]))], names=["t", "id"])

    first = written(rows.mapInArrow(take, "t long, id long").distinct().join(members, "id"), "prefixes")
    sizes = written(first.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("m > 1 and lo <> hi").select("t", "m"), "prefix-sizes")
    first = written(first.join(sizes, "t"), "shared-prefixes")
    x, y = first.where(F.col("m") <= FEW).alias("x"), first.where(F.col("m") <= FEW).alias("y")
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _close("x", "y", percent))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), first.where(F.col("m") > FEW).withColumnRenamed("t", "band")


def in_blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of large groups (``band``) that are in different components.

    Within a group the members of its largest component need no comparison with
    each other.  They and the others are dealt into blocks by hash; each block
    of others meets each block of either in a cell, with their full sets, and a
    cell counts all its intersections as a product of incidence matrices.  No
    pair is a row but the links, of which a cell gives only those that join
    components.
    """
    per = left.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("band").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("m"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.select("band", F.col("top.component").alias("main"), blocks(F.col("top.k")).alias("n_main"), blocks(F.col("m") - F.col("top.k")).alias("n_rest"))
    per = written(per.where("n_rest > 0"), "block-counts")
    rows = left.select("band", "id", "component", "s1", "s2").join(per, "band").withColumn("in_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, side, alone: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"), alone.alias("alone"))
    own, no = F.col("own"), F.lit(False)
    of_main = F.transform(upto("n_rest"), lambda j: cell(0, own, j, F.lit(-1), no))
    of_rest = F.concat(F.transform(upto("n_main"), lambda i: cell(0, i, own, F.lit(-2), no)), F.transform(upto("n_rest"), lambda k: cell(1, F.least(own, k), F.greatest(own, k), own, own == k)))
    cells = rows.select("band", "id", "component", "s1", "s2", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_rest)).alias("c"))
    cells = cells.select("id", "component", "s1", "s2", F.col("c.side").alias("own"), F.xxhash64("band", "c.kind", "c.i", "c.j").alias("cell"), "c.alone")
    full = cells.join(sets, "id").select("cell", "alone", "own", "id", "component", "s1", "s2", "shingles")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(n, "cell").sortWithinPartitions("cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda k: table.column(k).combine_chunks()
            sets = [x.values.to_numpy() for x in column("shingles")]
            sketch = np.stack((column("s1").to_numpy(), column("s2").to_numpy()), axis=1).view(np.uint64)
            pairs = joining_links(column("id").to_numpy(), column("component").to_numpy(), None if column("alone")[0].as_py() else column("own").to_numpy(), sets, sketch, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            at = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for i, j in zip(at[:-1], at[1:], strict=True):
                if i == j:
                    continue
                if held and held[0].column(0)[0].as_py() != cell[i]:
                    yield done()
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    return written(full.mapInArrow(compare, "a long, b long"), "block-links")


def joining_links(ids: np.ndarray, component: np.ndarray, own: np.ndarray | None, sets: list[np.ndarray], sketch: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of all pairs (between blocks ``own``, if given) that are similar enough,
    such as join the components into as few as can be."""
    n, k = np.array([len(s) for s in sets], np.int64), len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(k), n)
    _, col, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((k, k))
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((k, width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        both += m @ m.T
    similar = (both * 100 >= (n[:, None] + n[None, :] - both) * percent) & (component[:, None] != component[None, :])
    similar &= np.bitwise_count(sketch[:, None] ^ sketch[None, :]).sum(axis=2) <= SKETCH_BITS  # as with pairs
    if own is not None:
        similar &= own[:, None] != own[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, j in np.argwhere(np.triu(similar, 1)).tolist():
        a, b = root(int(component[i])), root(int(component[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: id_col, n_shingles, component_id, kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of
    their sets of ``size``-word shingles; a shorter text is one shingle.
    ``component_id`` is the smallest identifier reachable by links and ``kept``
    whether that is the document itself.  Null or wordless texts have an empty
    set and are linked with nothing.  Rows that share an identifier count as
    one document with all their texts.  A null identifier has a null component
    and is kept.  Texts may be of any length; a set travels as 8 bytes a shingle.
    An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signed(rows, size), "signed")
    classed = sig.where("n > 0 and id is not null")
    classes = classed.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    reps = classed.join(classes.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"], "left_semi").dropDuplicates(["h1", "h2"])
    member = written(reps.select(F.explode("bands").alias("band"), "id", F.col("n").cast("int").alias("n"), "s1", "s2"), "bands")
    # what a band is joined with is a written table, so that a band with many members can be split
    sizes = written(member.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "band-sizes")
    member2 = written(member.join(sizes, "band"), "shared-bands")
    dropped(member)
    member = member2
    # full sets of all that share a band, once; their number has no bound, so no broadcast
    sets = written(full_sets(rows.join(member.select("id").distinct().hint("merge"), "id", "left_semi"), size), "sets")
    # the centre: the member that meets most others over all bands
    degree = member.groupBy("id").agg(F.sum("m").alias("degree"))
    ranked = member.join(degree, "id")
    centre = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("id")).alias("low"), "id", "n", "s1", "s2")).alias("c")).select("band", "c.id", "c.n", "c.s1", "c.s2")
    centre = written(centre, "centres")
    x, c = member.alias("x"), centre.alias("c")
    star = x.join(c, (F.col("x.band") == F.col("c.band")) & (F.col("x.id") != F.col("c.id")) & _close("x", "c", percent))
    star = written(star.select(F.least("x.id", "c.id").alias("a"), F.greatest("x.id", "c.id").alias("b")).distinct(), "star")
    several = classed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("c0"), F.max(F.struct("h1", "h2")).alias("c1")).where("c0 <> c1").select("id")
    one = classed.join(several, "id", "left_semi").join(classes, ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = confirmed(star, sets, percent).unionByName(written(one, "one-document"))
    joined = components(links)
    # what is still apart within a band
    state = member.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    state = written(state, "state")
    apart = state.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("m").alias("k")).where("lo <> hi and k > 2").select("band")
    apart = written(apart, "bands-apart")
    left = written(state.join(apart, "band"), "apart")
    dropped(state)
    x, y = left.where(F.col("m") <= FEW).alias("x"), left.where(F.col("m") <= FEW).alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & _close("x", "y", percent))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = left.where(F.col("m") > FEW)
    if not large.isEmpty():
        more, crowds = by_prefix(large, sets, percent)
        pairs = pairs.unionByName(more)
        if not crowds.isEmpty():
            links = links.unionByName(in_blocks(crowds, sets, percent))
    rest = written(pairs.distinct().join(star, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(confirmed(rest, sets, percent))
    joined = components(links)
    for table in (sets, member, sizes, centre, apart, star, left, rest):
        dropped(table)
    of_class = classes.join(joined, F.col("rep") == F.col("id"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    # an identifier with several texts: its classes count as one through its own id
    out = sig.select("id", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.least("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)
