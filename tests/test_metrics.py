"""Graph measures against closed forms and small brute-force versions."""

from __future__ import annotations

import math
import random
from collections import deque

import pytest

from quillgraph.operators import community, metrics, paths
from quillgraph.queries import metrics as queries


def graph(spark, edges):
    return metrics.simple(spark.createDataFrame(edges, "src long, dst long"))


def values(df):
    return {r.node: r.value for r in df.collect()}


K4 = [(a, b) for a in range(4) for b in range(4) if a != b]
STAR = [(0, i) for i in range(1, 5)]
PATH = [(i, i + 1) for i in range(4)]
C4 = [(0, 1), (1, 2), (2, 3), (3, 0)]


def close(got, want):
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in want), (got, want)


def test_clique(spark):
    g = graph(spark, K4)
    close(values(metrics.eigenvector(g)), dict.fromkeys(range(4), 0.5))
    close(values(metrics.degree_centrality(g)), dict.fromkeys(range(4), 1.0))
    close(values(metrics.pagerank(g)), dict.fromkeys(range(4), 0.25))
    close(values(metrics.clustering(g)), dict.fromkeys(range(4), 1.0))
    dist = paths.distances(g)
    close(values(paths.closeness(g, dist)), dict.fromkeys(range(4), 1.0))
    close(values(paths.betweenness(g, dist)), dict.fromkeys(range(4), 0.0))


def test_star_and_path(spark):
    star, path = graph(spark, STAR), graph(spark, PATH)
    close(values(paths.harmonic(star)), {0: 4, 1: 2.5, 2: 2.5, 3: 2.5, 4: 2.5})
    close(values(paths.harmonic(path)), {0: 25 / 12, 1: 17 / 6, 2: 3, 3: 17 / 6, 4: 25 / 12})
    close(values(metrics.laplacian(star)), {0: 28, 1: 10, 2: 10, 3: 10, 4: 10})
    close(values(metrics.laplacian(path)), {0: 6, 1: 12, 2: 14, 3: 12, 4: 6})
    close(values(metrics.local_reaching(path)), {0: 3, 1: 4, 2: 5, 3: 4, 4: 3})
    leaf = 1.1 / 0.96
    close(values(metrics.katz(star, alpha=0.1, tolerance=1e-9)), {0: 1 + 0.4 * leaf, **dict.fromkeys(range(1, 5), leaf)})
    assert community.voterank(star) == [0] and community.voterank(path) == [1, 3] and community.voterank(path, 1) == [1]
    with pytest.raises(ValueError):
        metrics.katz(graph(spark, [(0, i) for i in range(1, 201)]), alpha=0.1)


def test_structure(spark):
    row = metrics.structure(graph(spark, [(0, 1), (1, 2), (2, 0)])).first()
    assert (row.density, row.transitivity, row.triangles, row.avg_clustering, row.assortativity) == (1, 1, 1, 1, 0)
    row = metrics.structure(graph(spark, [(0, 1), (1, 2), (2, 3)])).first()
    assert (row.density, row.triangles, row.transitivity) == (0.5, 0, 0)
    e = paths.eccentricity(graph(spark, [(0, 1), (1, 2), (2, 3)])).first()
    assert (e.diameter, e.radius) == (3, 2) and math.isclose(e.avg_path, 10 / 6)
    e = paths.eccentricity(graph(spark, [(0, 1), (2, 3)])).first()
    assert (e.diameter, e.radius, e.avg_path) == (None, None, None)


def test_link_scores(spark):
    g = graph(spark, C4)
    score = lambda m: {(r.lo, r.hi): r.score for r in metrics.link_scores(g, m).collect()}
    close(score("common"), {(0, 2): 2, (1, 3): 2})
    close(score("jaccard"), {(0, 2): 1, (1, 3): 1})
    close(score("adamic_adar"), {(0, 2): 2 / math.log(2), (1, 3): 2 / math.log(2)})
    close(score("resource_allocation"), {(0, 2): 1, (1, 3): 1})
    hub = graph(spark, [*STAR, (3, 4)])
    assert [(r.lo, r.hi, r.score) for r in metrics.preferential_top(hub, 2).collect()] == [(1, 3, 2.0), (1, 4, 2.0)]


def test_communities(spark):
    one = {r.label for r in community.louvain(graph(spark, K4)).collect()}
    assert one == {0}
    two = {r.node: r.label for r in community.louvain(graph(spark, [*K4, (10, 11)])).collect()}
    assert two == {0: 0, 1: 0, 2: 0, 3: 0, 10: 1, 11: 1}


def test_rows_doubled_and_turned_change_nothing(spark):
    a, b = graph(spark, STAR), graph(spark, [*STAR, *[(y, x) for x, y in STAR], (1, 1)])
    for measure in (metrics.degree_centrality, metrics.clustering, metrics.laplacian):
        assert values(measure(a)) == values(measure(b))


def test_empty(spark):
    g = graph(spark, [])
    for name in ("degree", "laplacian", "clustering", "pagerank", "katz", "local_reaching"):
        assert metrics.dispatch(name, g).count() == 0
    assert metrics.wcc(g).count() == 0 and community.voterank(g) == []
    with pytest.raises(ValueError):
        metrics.dispatch("none", g)


def test_random_graph(spark):
    r = random.Random(7)
    edges = [(a, b) for a in range(24) for b in range(a) if r.random() < 0.12]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(s):
        d, q = {s: 0}, deque([s])
        while q:
            x = q.popleft()
            for y in near[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        return d

    g = graph(spark, edges)
    dist = {}
    for row in paths.distances(g).collect():
        dist.setdefault(row.src, {})[row.dst] = row.d
    assert dist == {s: reach(s) for s in near}
    assert {x.node: x.component for x in metrics.wcc(g).collect()} == {s: min(reach(s)) for s in near}
    walk = metrics.both_ways(g)
    source = min(near)
    for target in sorted(near)[:6]:
        got = paths.shortest_path(walk, source, target, 10)
        want = reach(source).get(target)
        assert (got is None) == (want is None) and (got is None or (len(got) - 1 == want and got[0] == (source, 0) and all(b in near[a] for (a, _), (b, _) in zip(got, got[1:]))))
    assert paths.shortest_path(walk, source, -1, 3) is None
    with pytest.raises(ValueError):
        paths.shortest_path(walk, source, source + 1, -1)


def test_hierarchy_cycles_query_walks_ten_steps(spark, monkeypatch):
    r = random.Random(3)
    edges = {(a, b) for a in range(40) for b in range(40) if a != b and r.random() < 0.02}
    edges |= {(100 + i, 100 + (i + 1) % 10) for i in range(10)} | {(200 + i, 200 + (i + 1) % 11) for i in range(11)} | {(300, 300), (300, 301), (301, 302)}

    def round_trip(s):
        at = {s}
        for k in range(1, 11):
            at = {b for a, b in edges if a in at}
            if s in at:
                return k
        return None

    want = {n: round_trip(n) for n in {x for e in edges for x in e}}
    monkeypatch.setattr(queries, "Model", lambda *_: None)
    monkeypatch.setattr(queries, "_directed", lambda _: spark.createDataFrame(sorted(edges), "source long, target long"))
    got = [x.node for x in queries.QUERIES["hierarchy_cycles"](spark, "").collect()]
    assert len(got) == len(set(got)) and set(got) == {n for n, k in want.items() if k} and max(k or 0 for k in want.values()) == 10


@pytest.mark.parametrize("name", ["bfs_distances_from", "shortest_path_parents"])
def test_search_queries_run_until_nothing_is_new(spark, monkeypatch, name):
    rows = [(queries.SOURCE, "n00"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(8)], ("n03", "side"), ("side", "n05"), ("n08", queries.SOURCE), ("far", "off")]
    monkeypatch.setattr(queries, "Model", lambda *_: None)
    monkeypatch.setattr(queries, "_names", lambda _: spark.createDataFrame(rows, "a string, b string"))
    want = {queries.SOURCE: (0, None), "n00": (1, queries.SOURCE), **{f"n{i:02}": (i + 1, f"n{i - 1:02}") for i in range(1, 9)}, "side": (5, "n03")}
    got = {r.node: (r.depth, r.parent if "parent" in r else want[r.node][1]) for r in queries.QUERIES[name](spark, "").collect()}
    assert got == want
