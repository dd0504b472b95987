"""Operator 5: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to), so the network is small whatever the number of documents.  Each pattern
offers its words once at cost 0, a second time at cost 1, a third at cost 2:
repetition has convex cost, so flow repeats text only where quotas ask for it.
Patterns feed the quotas of their sources.  Costs stand on the arcs out of the
flow's origin alone, so the cheapest augmenting paths are those of the lowest
repetition: a largest flow with the first use of all words, then with the
second, then with the third, is a least-cost flow of the largest size.  Within
a pattern the flow is met by whole documents: all of them as often as it goes
evenly, and once more those that come first in a seeded order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import seeded
from .shared import n_words, written

MAX_REPEATS = 3
BUCKETS = 4096
#: Tables of so many patterns at most are broadcast; larger ones are joined by shuffle.
SMALL = 20_000


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the
    excess is shared anew by weight until none is above."""
    out = [0.0] * len(sizes)
    # those that fill up first, by the share of weight at which they do
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: most * sizes[i] / weights[i])
    rest, weight = float(total), float(sum(weights[i] for i in order))
    for k, i in enumerate(order):
        if most * sizes[i] >= rest * weights[i] / weight:
            for j in order[k:]:
                out[j] = rest * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        rest -= out[i]
        weight -= weights[i]
    return out


class _Network:
    """Largest flow by blocking flows on level graphs; capacities can be raised and the flow continued."""

    def __init__(self, n: int):
        self.heads: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def arc(self, a: int, b: int, c: int) -> int:
        for x, y, k in ((a, b, c), (b, a, 0)):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(k)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        heads, to, cap = self.heads, self.to, self.cap
        while True:
            level = [-1] * len(heads)
            level[source], queue = 0, deque([source])
            while queue:
                u = queue.popleft()
                for e in heads[u]:
                    if cap[e] > 0 and level[to[e]] < 0:
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if level[sink] < 0:
                return
            at, path, u = [0] * len(heads), [], source
            while True:
                if u == sink:
                    push = min(cap[e] for e in path)
                    for k, e in enumerate(path):
                        cap[e] -= push
                        cap[e ^ 1] += push
                    k = next(k for k, e in enumerate(path) if not cap[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                while at[u] < len(heads[u]) and not (cap[heads[u][at[u]]] > 0 and level[to[heads[u][at[u]]]] == level[u] + 1):
                    at[u] += 1
                if at[u] < len(heads[u]):
                    path.append(heads[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def min_cost_flow(supply: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    ``supply[p]`` words of pattern p can be sent up to ``repeats`` times, the
    k-th time at cost k a word; source s takes at most ``quota[s]``.  The flow
    is as large as can be and of least cost.
    """
    n_p, n_s = len(supply), len(quota)
    net, sink = _Network(2 + n_p + n_s), 1 + n_p + n_s
    offers = [net.arc(0, 1 + p, 0) for p in range(n_p)]
    feed = {(p, s): net.arc(1 + p, 1 + n_p + s, int(supply[p]) * repeats) for p in range(n_p) for s in members[p]}
    for s in range(n_s):
        net.arc(1 + n_p + s, sink, int(quota[s]))
    for _ in range(repeats):
        for p, e in enumerate(offers):
            net.cap[e] += int(supply[p])
        net.run(0, sink)
    out: list[dict[int, int]] = [{} for _ in range(n_p)]
    for (p, s), e in feed.items():
        if net.cap[e ^ 1]:
            out[p][s] = net.cap[e ^ 1]
    return out


def mixed(docs: DataFrame, size: Column, sources: Column, seed: int = 0, weights: Sequence[float] = (1, 2, 3), order: Column | None = None) -> tuple[DataFrame, dict]:
    """The rows with ``size``, ``pattern`` (their sources, sorted) and ``repeats``,
    and for each source, as (is null, name), its size and target.

    ``sources`` is an array of names (null within it is a source of its own,
    after all others).  Sources in order of code point weigh ``weights``,
    repeating, and share all sizes; a target stops at three times its source's
    size.  ``repeats`` (0 to 3) says how often the mix takes a document.

    Rows are ordered by a seeded hash of all their columns, or by ``order``, a
    64-bit number that rows of one size share at most.  The place at which
    a pattern's words run out is found from sums over 4,096 hash buckets and then
    over the hashes within one of them, so no pattern is sorted in one task.  Of
    equal rows (repeated, or with null identifiers) some may be taken and others
    not: they are numbered by where they stand in ``docs``, which should be files
    or a table of which a second reading gives the same rows in the same places.

    What comes to the driver is a row a pattern, about 200 bytes; a flow over
    20,000 patterns of up to three sources takes some seconds.
    """
    spark = docs.sparkSession
    kind = "array<struct<none: boolean, name: string>>"
    pattern = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name"))))).cast(kind)
    names = [c for c in docs.columns if c not in ("size", "pattern", "repeats")]
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]) if order is None else order
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    own_columns = F.struct(*[F.col(f"`{c}`") for c in names])  # whatever their names, they meet none used here
    rows = docs.select(own_columns.alias("row_"), size.alias("size"), pattern.alias("pattern"), h.alias("h_"))
    light = written(rows.select("pattern", F.col("h_").alias("h"), "size", F.spark_partition_id().alias("part")), "mix-sizes")
    sums = written(light.groupBy("pattern", bucket(F.col("h")).alias("bucket")).agg(F.sum("size").alias("words")), "mix-sums")
    patterns = sums.groupBy("pattern").agg(F.sum("words").alias("words")).collect()
    key = lambda p: tuple((x.none, x.name) for x in p)
    patterns.sort(key=lambda r: key(r.pattern))
    found = sorted({x for r in patterns for x in key(r.pattern)}, key=lambda x: (x[0], x[1].encode()))
    place = {x: i for i, x in enumerate(found)}
    members = [[place[x] for x in key(r.pattern)] for r in patterns]
    sizes = [0] * len(found)
    for r, m in zip(patterns, members, strict=True):
        for s in m:
            sizes[s] += r.words
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], sum(r.words for r in patterns), MAX_REPEATS)
    flow = min_cost_flow([r.words for r in patterns], members, [round(t) for t in targets])
    sent = [sum(f.values()) for f in flow]
    need = [(r.pattern, x // r.words, x % r.words) if r.words else (r.pattern, 0, 0) for r, x in zip(patterns, sent, strict=True)]
    need = spark.createDataFrame(need, f"pattern {kind}, times long, extra long")
    few = F.broadcast if len(patterns) <= SMALL else lambda x: x
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(few(need), "pattern")
    cut = marks.where("before < extra and before + words >= extra").select("pattern", "bucket", (F.col("extra") - F.col("before")).alias("left"))
    cut = written(cut, "mix-cuts")
    near = light.withColumn("bucket", bucket(F.col("h"))).join(few(cut), ["pattern", "bucket"]).groupBy("pattern", "left", "h").agg(F.sum("size").alias("words"), F.max("size").alias("each"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("h"))
    near = near.withColumn("upto", upto).where(F.col("upto") - F.col("words") <= F.col("left"))
    whole, edge = F.when(F.col("upto") <= F.col("left"), F.struct("h", "upto")), F.when(F.col("upto") > F.col("left"), F.struct("h", ((F.col("left") - F.col("upto") + F.col("words")) / F.col("each")).cast("long").alias("k"), "each"))
    last = near.groupBy("pattern").agg(F.max(whole).alias("last"), F.max(edge).alias("edge"))
    plan = need.join(cut, "pattern", "left").join(last, "pattern", "left")
    done = F.when(F.col("extra") > 0, F.coalesce("bucket", F.lit(BUCKETS))).otherwise(-1)
    lacks = F.coalesce(F.col("left") - F.coalesce("last.upto", F.lit(0)) - F.coalesce(F.col("edge.k") * F.col("edge.each"), F.lit(0)), F.lit(0))
    plan = plan.select("pattern", "times", done.alias("cut"), F.coalesce("last.h", F.lit(-(1 << 63))).alias("last"), F.col("edge.h").alias("edge"), F.coalesce("edge.k", F.lit(0)).alias("k"), lacks.alias("lacks"))
    plan = written(plan, "mix-plan")
    # of the documents after the cut, the one whose size is nearest to what is still lacking
    own = bucket(F.col("h"))
    taken = (own < F.col("cut")) | ((own == F.col("cut")) & (F.col("h") <= F.col("last")))
    after = light.join(few(plan), "pattern").where(~taken & (F.abs(F.col("size") - F.col("lacks")) < F.col("lacks")))
    fill = after.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lacks")).alias("off"), "h")).alias("f")).select("pattern", F.col("f.h").alias("fill"))
    fill = written(fill, "mix-fill")
    # hashes of which only some rows are taken: at most two a pattern
    some = plan.where("edge is not null and k > 0").select("pattern", F.col("edge").alias("h"), "k").unionByName(fill.select("pattern", F.col("fill").alias("h"), F.lit(1).cast("long").alias("k")))
    some = written(some.groupBy("pattern", "h").agg(F.sum("k").alias("some")), "mix-some")
    ties = light.join(few(some.select("pattern", "h")), ["pattern", "h"]).groupBy("pattern", "h", "part").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("pattern", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = written(ties.withColumn("first", first).join(few(some), ["pattern", "h"]).where("first < some").select("pattern", F.col("h").alias("h_"), "part", (F.col("some") - F.col("first")).alias("some"), (F.col("some") - F.col("first") >= F.col("n")).alias("all_")), "mix-ties")

    got = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    got = got.join(few(plan.select("pattern", "times", "cut", "last")), "pattern").join(F.broadcast(ties) if few is F.broadcast else ties, ["pattern", "h_", "part"], "left")
    own = bucket(F.col("h_"))
    once = (own < F.col("cut")) | ((own == F.col("cut")) & (F.col("h_") <= F.col("last"))) | F.coalesce("all_", F.lit(False))
    plain = got.withColumn("once", once.cast("int"))
    if not ties.where("not all_").isEmpty():  # equal rows in one place, of which only some are taken
        n = F.row_number().over(Window.partitionBy("pattern", "h_", "part").orderBy("at"))
        tied = got.where("not all_").withColumn("once", (n <= F.col("some")).cast("int"))
        plain = plain.where("all_ is null or all_").unionByName(tied)
    got = plain
    out = got.select("row_.*", "size", "pattern", (F.col("times") + F.col("once")).cast("int").alias("repeats"))
    return out, {x: (s, t) for x, s, t in zip(found, sizes, targets, strict=True)}


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, source, repeats.

    The size is the number of words of the whole text, however long (null text:
    0).  Documents without words are taken with size 0.  An empty table gives no
    rows; null identifiers and repeated rows are mixed like any other row, each
    by itself; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col).cast("string")).alias("words"))
    rows = written(rows, "mix-words")
    got, sources = mixed(rows, F.col("words"), F.array("source"), order=seeded(seed, "doc_id", "words"))
    table = docs.sparkSession.createDataFrame([(None if none else name, s, float(t)) for (none, name), (s, t) in sources.items()], "source_ string, source_size long, target double")
    got = got.join(F.broadcast(table) if len(sources) <= SMALL else table, F.col("source").eqNullSafe(F.col("source_")))
    return got.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("repeats")


#: Sources fill up in the order of three times their size by weight; of each
#: source whole documents are taken in the order of the hash, and one more of
#: the size nearest to what then lacks.
SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (SELECT *, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h FROM docs),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized),
ranked AS (SELECT *, row_number() OVER (ORDER BY source_size = 0, 3 * source_size / w::DOUBLE, source NULLS LAST) AS k FROM weighed),
fill(k, rest, weight) AS (
  SELECT 0, sum(source_size)::DOUBLE, (sum(w) FILTER (WHERE source_size > 0))::DOUBLE FROM ranked
  UNION ALL
  SELECT f.k + 1, f.rest - 3 * r.source_size, f.weight - r.w FROM fill f JOIN ranked r ON r.k = f.k + 1
  WHERE r.source_size > 0 AND NOT 3 * r.source_size >= f.rest * r.w / f.weight),
full_ AS (SELECT k, rest, weight FROM fill ORDER BY k DESC LIMIT 1),
aims AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN r.k <= f.k THEN (3 * source_size)::DOUBLE ELSE f.rest * w / f.weight END AS target
  FROM ranked r, full_ f),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(round_even(target, 0)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS times,
         CASE WHEN source_size > 0 THEN least(round_even(target, 0)::BIGINT, 3 * source_size) % source_size ELSE 0 END AS extra
  FROM aims),
run AS (
  SELECT d.*, source_size, target, times, extra, sum(size) OVER (PARTITION BY d.source ORDER BY h % 4096, h) AS upto
  FROM keyed d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source),
cut AS (SELECT source, max(upto) FILTER (WHERE upto <= extra) AS got FROM run GROUP BY source),
lacking AS (
  SELECT r.*, CASE WHEN extra > 0 THEN extra - coalesce(got, 0) ELSE 0 END AS lacks FROM run r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY upto <= extra OR abs(size - lacks) >= lacks, abs(size - lacks), h) = 1 AND upto > extra AND abs(size - lacks) < lacks AS last_one
  FROM lacking)
SELECT doc_id, size, source_size, target, (size * (times + CASE WHEN upto <= extra OR last_one THEN 1 ELSE 0 END))::BIGINT AS taken, source FROM filled"""
