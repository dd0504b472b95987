"""Graph measures over undirected simple graphs.

Input edges are (src, dst) with any duplicates, directions and weights;
:func:`simple` makes of them one row an edge, src < dst.  Sums over neighbours
are one shuffle on the node.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import whole
from .rounds import checkpointed, dropped


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops: src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b: each edge in both directions, from one pass."""
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("w")).select("w.*")


def degrees(edges: DataFrame) -> DataFrame:
    """node, d."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, value: degree over the number of other nodes."""
    d = degrees(edges)
    n = d.agg((F.count(F.lit(1)) - 1).alias("others"))
    return d.crossJoin(F.broadcast(n)).select("node", F.when(F.col("others") > 0, F.col("d") / F.col("others")).otherwise(0.0).alias("value"))  # one row


def laplacian(edges: DataFrame) -> DataFrame:
    """node, value: d^2 + d + twice the neighbours' degrees."""
    d = degrees(edges)
    near = both_ways(edges).join(d, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("d").alias("s"))
    return d.join(near, F.col("node") == F.col("a")).select("node", (F.col("d") * F.col("d") + F.col("d") + 2 * F.col("s")).alias("value"))


def local_reaching(edges: DataFrame) -> DataFrame:
    """node, value: the nodes within two hops, itself included."""
    w = both_ways(edges)
    two = w.alias("x").join(w.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    return w.unionByName(two).distinct().groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("value"))


def triangles(edges: DataFrame) -> DataFrame:
    """x, y, z with x before y before z: each triangle once.

    Edges point from the lower to the higher (degree, id), so that wedges start
    at the end of least degree: at most m^1.5 of them, whatever the hubs.
    """
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    a, b = e.alias("a"), e.alias("b")
    wedge = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") < F.col("b.y"))).select(F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.y").alias("z"))
    return wedge.join(edges.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"]).select("x", "y", "z")


def triangle_counts(edges: DataFrame) -> DataFrame:
    """node, t: triangles of each node that is in one."""
    return triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, value: 2 triangles / (d (d - 1)); 0 below degree 2."""
    both = degrees(edges).join(triangle_counts(edges), "node", "left")
    return both.select("node", F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("value"))


def structure(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, transitivity, triangles, avg_clustering, assortativity."""
    per = degrees(edges).join(triangle_counts(edges), "node", "left").select("d", F.coalesce("t", F.lit(0)).alias("t"))
    own = F.when(F.col("d") > 1, 2.0 * F.col("t") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    wedges = F.sum(F.col("d") * (F.col("d") - 1) / 2)
    nodes = per.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("d") / 2, F.lit(0)).cast("long").alias("edges"), F.coalesce(F.sum("t") / 3, F.lit(0)).cast("long").alias("triangles"), F.coalesce(F.when(wedges > 0, F.sum("t") / wedges), F.lit(0.0)).alias("transitivity"), F.coalesce(F.avg(own), F.lit(0.0)).alias("avg_clustering"))
    d = degrees(edges)
    w = both_ways(edges).join(d.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    x, y = F.col("da").cast("double"), F.col("db").cast("double")
    spread = F.avg(x * x) - F.avg(x) * F.avg(x)
    mixing = w.agg(F.coalesce(F.when(spread > 1e-12, (F.avg(x * y) - F.avg(x) * F.avg(y)) / F.when(spread > 1e-12, spread)), F.lit(0.0)).alias("assortativity"))
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return nodes.crossJoin(F.broadcast(mixing)).withColumn("density", density)  # one row


def _converge(start: DataFrame, step, rounds: int, tolerance: float, stride: int = 5) -> tuple[DataFrame, bool]:
    """Applies ``step`` to (node, value) until the sum of changes in one round is
    below the tolerance, or as often as told if that is 0.  ``stride`` rounds are
    one job, whose last two states are written."""
    now, done = checkpointed(start), 0
    while done < rounds:
        n = min(stride, rounds - done)
        before = new = now.select("node", "value")
        for _ in range(n):
            before, new = new, step(new)
        done += n
        if tolerance <= 0:
            new = checkpointed(new)
        else:
            new = checkpointed(new.join(before.select("node", F.col("value").alias("was")), "node"))
            off = new.agg(F.sum(F.abs(F.col("value") - F.col("was")))).first()[0]
            if off is None or off < tolerance:
                return new.select("node", "value"), True
        dropped(now)
        now = new
    return now.select("node", "value"), tolerance <= 0


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """node, value: PageRank of the undirected graph; sums to 1."""
    d = checkpointed(degrees(edges))
    n = d.count()
    if not n:
        return d.select("node", F.lit(0.0).alias("value"))
    w = checkpointed(both_ways(edges).join(d, F.col("a") == F.col("node")).select("a", "b", "d"))

    def step(now: DataFrame) -> DataFrame:
        got = w.join(now, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("value") / F.col("d")).alias("s"))
        return got.select(F.col("b").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("s")).alias("value"))

    return _converge(d.select("node", F.lit(1.0 / n).alias("value")), step, rounds, tolerance)[0]


def eigenvector(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-8) -> DataFrame:
    """node, value: the leading eigenvector, of length 1 and positive.  Each round
    adds the vector itself, so that it converges on two-coloured graphs too."""
    if tolerance <= 0 and edges.count() <= whole.MOST_EDGES:
        return whole.eigenvector_sums(edges, rounds)
    d = checkpointed(degrees(edges))
    # a node's own row carries its value on, so a round is one join and one sum
    w = checkpointed(both_ways(edges).unionByName(d.select(F.col("node").alias("a"), F.col("node").alias("b"))))

    def unit(new: DataFrame) -> DataFrame:
        norm = new.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        return new.crossJoin(F.broadcast(norm)).select("node", (F.col("value") / F.col("norm")).alias("value"))  # one row

    def step(now: DataFrame) -> DataFrame:
        return w.join(now, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.sum("value").alias("value"))

    now, done, stride = checkpointed(d.select("node", F.lit(max(1, d.count()) ** -0.5).alias("value"))), 0, 5
    while done < rounds:
        n = min(stride, rounds - done)
        before = new = now.select("node", "value")
        for _ in range(n):
            before, new = new, step(new)
        done += n
        # lengths are only taken once a job: they cancel out
        both = checkpointed(new.join(before.select("node", F.col("value").alias("was")), "node"))
        out = checkpointed(unit(both.select("node", "value")))
        if tolerance > 0:
            was = unit(both.select("node", F.col("was").alias("value"))).withColumnRenamed("value", "was")
            off = out.join(was, "node").agg(F.sum(F.abs(F.col("value") - F.col("was")))).first()[0]
        dropped(now, both)
        now = out
        if tolerance > 0 and (off is None or off < tolerance):
            break
    return now


def katz(edges: DataFrame, alpha: float = 1e-4, beta: float = 1.0, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, value of x = alpha A x + beta; an error if it does not converge."""
    w = checkpointed(both_ways(edges))

    def step(now: DataFrame) -> DataFrame:
        got = w.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("value").alias("s"))
        return got.select(F.col("a").alias("node"), (alpha * F.col("s") + beta).alias("value"))

    out, ended = _converge(degrees(edges).select("node", F.lit(0.0).alias("value")), step, rounds, tolerance)
    if not ended:
        raise ValueError(f"no convergence within {rounds} rounds; alpha must be below 1 over the leading eigenvalue")
    return out


def wcc(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that is reachable.

    Large-star and small-star steps in turn, each a min-aggregation and a join.
    """
    e = checkpointed(simple(edges).select(F.col("dst").alias("u"), F.col("src").alias("v")))
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(e)
    while seen[0]:
        way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
        both = e.select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("w")).select("w.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(way("v", "m"), way("u", "m"))).alias("w")).select("w.*").where("u <> v").distinct()
        was, e = e, checkpointed(small)
        now = mark(e)
        dropped(was)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def modularity(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, value: the sum over stored edge rows (src, dst, weight) within a
    community of weight - d_s d_t / 2m, over 2m, where 2m is the sum of degrees."""
    d = rows.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("d"))
    total = d.agg(F.sum("d").alias("m2"))
    of = labels.join(d, "node")
    e = rows.join(of.select(F.col("node").alias("src"), F.col("label").alias("ls"), F.col("d").alias("ds")), "src").join(of.select(F.col("node").alias("dst"), F.col("label").alias("lt"), F.col("d").alias("dt")), "dst")
    return e.where("ls = lt").crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("weight") - F.col("ds") * F.col("dt") / F.col("m2")) / F.max("m2"), F.lit(0.0)).alias("value"))  # one row


def link_scores(edges: DataFrame, method: str = "jaccard") -> DataFrame:
    """lo, hi, score of pairs that are not linked; only positive scores.

    All but preferential attachment come from wedges: two edges that share a
    node.  That one needs pairs without a common neighbour too and is ranked
    from degrees by :func:`preferential_top`.
    """
    w, d = both_ways(edges), degrees(edges)
    x, y = w.alias("x"), w.join(d.select(F.col("node").alias("a"), F.col("d").alias("dm")), "a").alias("y")
    wedge = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.b").alias("lo"), F.col("y.b").alias("hi"), "y.dm")
    per: Column = {"common": F.lit(1.0), "jaccard": F.lit(1.0), "adamic_adar": 1 / F.log("dm"), "resource_allocation": 1 / F.col("dm")}[method]
    got = wedge.groupBy("lo", "hi").agg(F.sum(per).alias("score"))
    got = got.join(edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi")), ["lo", "hi"], "left_anti")
    if method == "jaccard":
        got = got.join(d.select(F.col("node").alias("lo"), F.col("d").alias("dl")), "lo").join(d.select(F.col("node").alias("hi"), F.col("d").alias("dh")), "hi")
        got = got.select("lo", "hi", (F.col("score") / (F.col("dl") + F.col("dh") - F.col("score"))).alias("score"))
    return got.select("lo", "hi", "score")


def preferential_top(edges: DataFrame, n: int) -> DataFrame:
    """The n unlinked pairs with the largest products of degrees; ties by lo, hi.

    Pairs are sought class by class: of the pairs of distinct degrees, in falling
    order of their product, only as many are needed as hold n unlinked pairs, and
    how many a pair of degrees holds is known from counts.  Of the nodes of one
    degree only the first by name can be in the answer: at most n and those that
    the linked pairs of the classes use up.
    """
    spark = edges.sparkSession
    d = checkpointed(degrees(edges))
    sizes = {r.d: r.n for r in d.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a distinct degree: at most sqrt(2 edges)
    of = edges.join(d.select(F.col("node").alias("src"), F.col("d").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("y")), "dst")
    linked = {(r.x, r.y): r.n for r in of.groupBy(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes, seen, values = [], 0, sorted(sizes, reverse=True)
    heap = [(-x * x, i, i) for i, x in enumerate(values)]
    heapq.heapify(heap)
    last = None
    while heap:
        product, i, j = heapq.heappop(heap)
        if seen >= n and product != last:
            break
        x, y = values[i], values[j]
        free = (sizes[x] * (sizes[x] - 1) // 2 if i == j else sizes[x] * sizes[y]) - linked.get((x, y), 0)
        if free:
            classes.append((x, y))
            seen, last = seen + free, product
        if j + 1 < len(values):
            heapq.heappush(heap, (-x * values[j + 1], i, j + 1))
    if not classes:
        return d.select(F.col("node").alias("lo"), F.col("node").alias("hi"), F.lit(0.0).alias("score")).limit(0)
    # of a class of equal nodes the first n by name, and one more for each linked pair of its classes
    most = {v: min(sizes[v], n + 1 + sum(linked.get(c, 0) for c in classes if v in c)) for v in {v for c in classes for v in c}}
    few = d.join(F.broadcast(spark.createDataFrame(list(most.items()), "d long, most long")), "d")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("node"))).where("r <= most").select("node", "d")
    wanted = spark.createDataFrame(classes, "x long, y long")
    pairs = few.select(F.col("node").alias("p"), F.col("d").alias("x")).join(wanted, "x").join(few.select(F.col("node").alias("q"), F.col("d").alias("y")), "y").where("p <> q and (x <> y or p < q)")
    pairs = pairs.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("x") * F.col("y")).cast("double").alias("score"))
    return pairs.join(edges.select(F.col("src").alias("lo"), F.col("dst").alias("hi")), ["lo", "hi"], "left_anti").orderBy(F.desc("score"), "lo", "hi").limit(n)


def candidates(scores: DataFrame) -> DataFrame:
    """node, candidates: each pair under both of its ends, best first, as JSON."""
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.struct((-F.round("score", 6)).alias("neg"), F.col(y).alias("other")).alias("c"))
    both = scores.select(F.explode(F.array(way("lo", "hi"), way("hi", "lo"))).alias("w")).select("w.*")
    lists = both.groupBy("node").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    return lists.select("node", F.transform("cs", lambda c: c["other"]).alias("others"))


def suggestions(scores: DataFrame, companies: DataFrame, linked: DataFrame, least: float, n: int) -> DataFrame:
    """The best unlinked pairs of companies; the pool is 8 n pairs, as each filter may drop some."""
    pool = scores.orderBy(F.desc("score"), "lo", "hi").limit(8 * n).where(F.col("score") >= least)
    for end in ("lo", "hi"):
        pool = pool.join(companies.select(F.col("node").alias(end)), end, "left_semi")
    any_way = linked.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return pool.join(any_way, ["lo", "hi"], "left_anti").orderBy(F.desc("score"), "lo", "hi").limit(n)


def dispatch(metric: str, edges: DataFrame) -> DataFrame:
    """node, value of a node measure by name."""
    from . import paths

    known = {"degree": degree_centrality, "pagerank": pagerank, "eigenvector": eigenvector, "katz": katz, "laplacian": laplacian, "local_reaching": local_reaching, "clustering": clustering, "closeness": paths.closeness, "harmonic": paths.harmonic, "betweenness": paths.betweenness}
    if metric not in known:
        raise ValueError(f"no such measure: {metric}")
    return known[metric](edges)
