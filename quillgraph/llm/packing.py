"""Operator 10: packing into optimal length buckets.

Every document is padded to the length of its bucket.  Bucket boundaries come
from dynamic programming over the histogram of all lengths, so the padding is
the least that so many buckets allow.  Inside a bucket documents are dealt, in
a seeded order, into batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import n_words, written

N_BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows of a bucket that are numbered in one task, about, as long as the buckets
#: have at most 16^PART_DIGITS parts each; then the parts grow.
ROWS_A_TASK = 4_096
PART_DIGITS = 3


def boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper ends of at most ``n_buckets`` buckets with the least padding.

    ``lengths`` ascend.  With f[k, j] the least padded size of the first j
    lengths in k buckets, f[k, j] = min over i of f[k-1, i] + lengths[j-1] *
    counts[i:j].sum().  The best i never falls as j grows, so each row is
    filled by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    upto = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    took, costs = [], []
    for _ in range(min(n_buckets, n)):
        new = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
        new[0] = 0
        arg = np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            c = best[i] + int(lengths[j - 1]) * (upto[j] - upto[i])
            k = int(np.argmin(c))
            new[j], arg[j] = c[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        took.append(arg)
        costs.append(int(new[n]))
        best = new
    k = int(np.argmin(costs))
    ends, j = [], n
    while j > 0 and k >= 0:
        ends.append(int(lengths[j - 1]))
        j = int(took[k][j])
        k -= 1
    return ends[::-1]


def histogram(lengths: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All distinct lengths (column ``length``), ascending, with their counts.

    They fit the driver whatever the input: n distinct lengths take n^2 / 2 words
    of text at least.  Only if ``most`` is given are neighbours joined, each
    group with the longest length in it, to that many.
    """
    got = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()
    at, n = got["length"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(at)
    at, n = at[order], n[order]
    if most is not None and len(at) > most:
        first = np.arange(0, len(at), -(-len(at) // most))
        at, n = at[np.append(first[1:], len(at)) - 1], np.add.reduceat(n, first)
    return at, n


def seeded(seed: int, id_col: str, length: str = "length") -> Column:
    """A 60-bit number from the md5 of seed, identifier and length, which any engine can compute."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(length).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def packed(docs: DataFrame, length: Column, id_col: str = "doc_id", n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 0) -> DataFrame:
    """Adds length, bucket, bucket_length, batch and slot to each row.

    A document of bucket b is padded to ``bucket_length``; a batch holds as many
    as fit the token budget, one at least, so that a document longer than the
    budget is a batch of its own and nothing is cut.  ``batch`` counts from 0 in
    each bucket, ``slot`` within the batch.  Rows are numbered in the order of a
    seeded hash, null identifiers last: each bucket is split by the hash into
    parts (null identifiers by their place in ``docs``) that are numbered in
    tasks of their own; the numbers are written, and from what was written come
    the sizes of the parts before, of which there are at most n_buckets times
    twice 16^3.  Null and empty texts have length 0; repeated rows are packed
    like any other, each with a seat of its own; columns of the names added give
    way to them; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("length", "bucket", "bucket_length", "batch", "slot")]
    rows = docs.select(*[f"`{c}`" for c in keep], length.cast("long").alias("length"))
    lengths, counts = histogram(rows.select("length"))
    ends = boundaries(lengths, counts, n_buckets)
    if not ends:
        return rows.limit(0).withColumns({"bucket": F.lit(0), "bucket_length": F.lit(0).cast("long"), "batch": F.lit(0).cast("long"), "slot": F.lit(0)})
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[i], i).otherwise(bucket)
    most = max(int(counts[(lengths > lo) & (lengths <= hi)].sum()) for lo, hi in zip([-1, *ends], ends))
    digits = min(PART_DIGITS, next(k for k in range(16) if most <= ROWS_A_TASK << 4 * k))
    rows = rows.withColumns({"bucket": bucket, "hash_": seeded(seed, id_col)})
    # the upper digits of the hash, so that parts follow one another in its order; then those without an identifier
    none = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 4 * digits)) + (1 << 4 * digits)
    rows = rows.withColumn("part_", F.when(F.col(id_col).isNull(), none).otherwise(F.shiftright("hash_", 60 - 4 * digits)).cast("int"))
    own = Window.partitionBy("bucket", "part_").orderBy("hash_", id_col)
    seats = written(rows.withColumn("own_", F.row_number().over(own) - 1).drop("hash_"), "pack-seats")
    sizes = seats.groupBy("bucket", "part_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    got = seats.join(F.broadcast(offsets), ["bucket", "part_"])  # at most n_buckets * 2 * 16^PART_DIGITS rows
    end = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(end, F.lit(1))))
    place = F.col("own_") + F.col("offset_")
    return got.select(*[f"`{c}`" for c in keep], "length", "bucket", end.alias("bucket_length"), F.floor(place / room).alias("batch"), (place % room).cast("int").alias("slot"))


def pack_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, length (words of the whole text, however long), bucket, bucket_length, batch, slot."""
    rows = written(docs.select(F.col(id_col), n_words(F.col(text_col).cast("string")).alias("words")), "pack-lengths")
    return packed(rows, F.col("words"), id_col).drop("words")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: f[k, j], the least padded size of the first j lengths in k buckets, by
#: recursion over k; then the ends from the last length back, and the seats.
SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS length FROM documents),
hist AS (SELECT length, row_number() OVER (ORDER BY length) AS j, sum(count(*)) OVER (ORDER BY length) AS upto FROM docs GROUP BY length),
points AS (SELECT 0 AS j, 0::BIGINT AS length, 0::HUGEINT AS upto UNION ALL SELECT j, length, upto FROM hist),
f(k, j, size, i) AS (
  SELECT 1, j, length * upto, 0::BIGINT FROM hist
  UNION ALL
  SELECT k + 1, q.j, min(size + q.length * (q.upto - p.upto)), arg_min(p.j, struct_pack(a := size + q.length * (q.upto - p.upto), b := p.j))
  FROM f JOIN points p ON p.j = f.j JOIN hist q ON q.j > p.j WHERE k < 16 GROUP BY k, q.j),
best AS (SELECT k, j, i FROM f WHERE j = (SELECT max(j) FROM hist) ORDER BY size, k LIMIT 1),
back(k, j, i) AS (SELECT k, j, i FROM best UNION ALL SELECT f.k, f.j, f.i FROM back JOIN f ON f.k = back.k - 1 AND f.j = back.i WHERE back.i > 0),
ends AS (SELECT h.length AS bucket_length, row_number() OVER (ORDER BY h.length) - 1 AS bucket, coalesce(lag(h.length) OVER (ORDER BY h.length), -1) AS low FROM back JOIN hist h USING (j)),
seats AS (
  SELECT doc_id, length, bucket, bucket_length, greatest(1, 65536 // greatest(bucket_length, 1)) AS room,
         row_number() OVER (PARTITION BY bucket ORDER BY doc_id IS NULL, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || length), 1, 15))::BIGINT, doc_id) - 1 AS place
  FROM docs JOIN ends ON length <= bucket_length AND length > low)
SELECT doc_id, length, bucket::INTEGER AS bucket, bucket_length, place // room AS batch, (place % room)::INTEGER AS slot FROM seats"""
