"""Queries of graph measures over the part graph, paths, and link prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import metrics as M
from ..operators import paths as H
from ..plans.model import MODEL_SQL, Model

_r = lambda df, *cols: df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def _g(f):
    return lambda spark, root: f(Model(spark, root).part_graph)


def _m(f):
    return lambda spark, root: f(Model(spark, root))


def _measure(name, **options):
    return _g(lambda e: _r(getattr(M, name)(e, **options), "value"))


def _names(m: Model):
    return m.walk.where("edge_type in ('supplier_to', 'acquired', 'subsidiary_of')").select("a", "b")


def _directed(m: Model):
    """Acquired, subsidiary and customer edges as stored, and supplier edges between suppliers turned about."""
    return m.edges.where("edge_type in ('acquired', 'subsidiary_of', 'customer_of')").select("source", "target").unionByName(m.edges.where("edge_type = 'competes_with'").select(F.col("target").alias("source"), F.col("source").alias("target")))


def _labels(e):
    return M.degrees(e).select("node", (F.col("node") % 10).alias("label"))


def _suggest(m: Model):
    e = m.part_graph
    companies = M.degrees(e).select("node")
    return _r(M.suggestions(M.link_scores(e, "adamic_adar"), companies, e, 0.1, 20), "score")


SOURCE = "Supplier#000000001"
QUERIES = {
    "degree": _measure("degree_centrality"),
    "laplacian": _g(M.laplacian),
    "local_reaching": _g(M.local_reaching),
    "clustering": _measure("clustering"),
    "triangles": _g(M.triangle_counts),
    "structure": _g(lambda e: _r(M.structure(e), "density", "transitivity", "avg_clustering", "assortativity")),
    "pagerank_20it": _measure("pagerank", rounds=20, tolerance=0),
    "eigenvector_50it": _measure("eigenvector", rounds=50, tolerance=0),
    "katz": _measure("katz"),
    "wcc": _g(M.wcc),
    "closeness": _g(lambda e: _r(H.closeness(e), "value")),
    "harmonic": _g(lambda e: _r(H.harmonic(e), "value")),
    "diameter_radius_apl": _g(lambda e: _r(H.eccentricity(e), "avg_path")),
    "betweenness": _g(lambda e: _r(H.betweenness(e), "value")),
    "louvain": _g(C.louvain),
    "voterank": _g(C.voterank_table),
    "modularity_given_labels": _g(lambda e: _r(M.modularity(e.withColumn("weight", F.lit(1.0)), _labels(e)), "value")),
    "lp_jaccard": _g(lambda e: _r(M.link_scores(e, "jaccard"), "score")),
    "lp_adamic_adar": _g(lambda e: _r(M.link_scores(e, "adamic_adar"), "score")),
    "lp_common": _g(lambda e: _r(M.link_scores(e, "common"), "score")),
    "lp_resource_alloc": _g(lambda e: _r(M.link_scores(e, "resource_allocation"), "score")),
    "lp_pref_attach": _g(lambda e: M.preferential_top(e, 50)),
    "lp_node_candidates": _g(lambda e: M.candidates(M.link_scores(e, "adamic_adar")).select("node", F.array_join("others", ",").alias("others"))),
    "suggestions": _m(_suggest),
    "bfs_distances_from": _m(lambda m: H.bfs(_names(m), [SOURCE]).select("node", "depth")),
    "shortest_path_parents": _m(lambda m: H.bfs(_names(m), [SOURCE])),
    "cycles_len4": _m(lambda m: H.cycles(_directed(m), 4, 100)),
    "hierarchy_cycles": _m(lambda m: H.hierarchy_cycles(_directed(m))),
}

_N = "nd AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM part_edge UNION ALL SELECT dst FROM part_edge) GROUP BY node), w AS (SELECT src AS a, dst AS b FROM part_edge UNION ALL SELECT dst, src FROM part_edge)"
_T = "tri AS (SELECT x.src AS x, x.dst AS y, y.dst AS z FROM part_edge x JOIN part_edge y ON x.dst = y.src JOIN part_edge q ON q.src = x.src AND q.dst = y.dst), tc AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY node)"
_CC = "cc AS (SELECT node, d, coalesce(t, 0) AS t, CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END AS value FROM nd LEFT JOIN tc USING (node))"
_DIST = "reach(src, dst, d) USING KEY (src, dst) AS (SELECT node, node, 0 FROM nd UNION SELECT r.src, w.b, min(r.d) + 1 FROM reach r JOIN w ON r.dst = w.a LEFT JOIN recurring.reach k ON k.src = r.src AND k.dst = w.b WHERE k.d IS NULL GROUP BY r.src, w.b), dist AS (SELECT src, dst, d FROM reach)"
_WEDGE = "wedge AS (SELECT x.b AS lo, y.b AS hi, d.d AS dm FROM w x JOIN w y ON x.a = y.a AND x.b < y.b JOIN nd d ON d.node = x.a), free AS (SELECT * FROM wedge WHERE NOT EXISTS (SELECT 1 FROM part_edge e WHERE e.src = lo AND e.dst = hi))"


def _with(*ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {MODEL_SQL.strip()}, {', '.join(ctes)} {body}"


_AA = "SELECT lo, hi, sum(1 / ln(dm)) AS score FROM free GROUP BY lo, hi"
_WALK = "steps AS (SELECT DISTINCT a, b FROM walk WHERE edge_type IN ('supplier_to', 'acquired', 'subsidiary_of'))"
_BFS = f"bfs(node, depth, parent) USING KEY (node) AS (SELECT '{SOURCE}', 0, NULL::VARCHAR UNION SELECT s.b, min(r.depth) + 1, min(s.a) FROM bfs r JOIN steps s ON s.a = r.node LEFT JOIN recurring.bfs k ON k.node = s.b WHERE k.node IS NULL GROUP BY s.b)"
#: Pairs of nodes by the number of steps from one to the other, up to ten.
_STEPS = ", ".join(f"h{k} AS (SELECT DISTINCT x.s, y.t FROM {f'h{k - 1}' if k > 2 else 'dedge'} x JOIN dedge y ON x.t = y.s)" for k in range(2, 11))
_DIRECTED = "dedge AS (SELECT source AS s, target AS t FROM edge WHERE edge_type IN ('acquired', 'subsidiary_of', 'customer_of') UNION SELECT target, source FROM edge WHERE edge_type = 'competes_with')"
_PATHS = "reach(src, dst, d, sig) USING KEY (src, dst) AS (SELECT node, node, 0, 1.0::DOUBLE FROM nd UNION SELECT r.src, w.b, min(r.d) + 1, sum(r.sig) FROM reach r JOIN w ON r.dst = w.a LEFT JOIN recurring.reach k ON k.src = r.src AND k.dst = w.b WHERE k.d IS NULL GROUP BY r.src, w.b), dist AS (SELECT src, dst, d, sig FROM reach), top AS (SELECT max(d) AS d FROM dist)"
_BACK = "acc(src, dst, d, sig, delta) AS (SELECT dist.src, dist.dst, dist.d, dist.sig, 0.0::DOUBLE FROM dist JOIN top ON dist.d = top.d UNION ALL SELECT p.src, p.dst, p.d, p.sig, coalesce(sum(p.sig / c.sig * (1 + c.delta)), 0) FROM (SELECT DISTINCT d - 1 AS lower FROM acc) l JOIN dist p ON p.d = l.lower LEFT JOIN w ON w.a = p.dst LEFT JOIN acc c ON c.src = p.src AND c.dst = w.b WHERE p.d >= 1 GROUP BY p.src, p.dst, p.d, p.sig)"
_VOTES = """vr(step, node, v, place) AS (
  SELECT 0, node, 1.0::DOUBLE, NULL::INTEGER FROM nd
  UNION ALL
  SELECT s.step + 1, s.node, CASE WHEN s.node = t.node THEN 0.0 WHEN EXISTS (SELECT 1 FROM w WHERE w.a = t.node AND w.b = s.node) THEN greatest(0.0, s.v - 1.0 / (SELECT avg(d) FROM nd)) ELSE s.v END, CASE WHEN s.node = t.node THEN s.step ELSE s.place END
  FROM vr s, (SELECT x.node FROM vr x JOIN (SELECT w.a AS node, round(sum(y.v), 9) AS votes FROM vr y JOIN w ON w.b = y.node GROUP BY w.a) z ON z.node = x.node WHERE x.place IS NULL AND z.votes > 0 ORDER BY z.votes DESC, x.node LIMIT 1) t)"""
ORACLES = {
    "betweenness": _with(_N, _PATHS, _BACK, body="SELECT node, round(coalesce(sum(delta), 0) / 2, 6) AS value FROM nd LEFT JOIN acc ON dst = node AND acc.d > 0 GROUP BY node"),
    "voterank": _with(_N, _VOTES, body="SELECT place, node FROM vr WHERE step = (SELECT max(step) FROM vr) AND place IS NOT NULL"),
    "degree": _with(_N, body="SELECT node, round(d / ((SELECT count(*) FROM nd) - 1), 6) AS value FROM nd"),
    "laplacian": _with(_N, body="SELECT a AS node, max(x.d) * max(x.d) + max(x.d) + 2 * sum(y.d) AS value FROM w JOIN nd x ON x.node = a JOIN nd y ON y.node = b GROUP BY a"),
    "local_reaching": _with(_N, body="SELECT a AS node, count(*) AS value FROM (SELECT a, b FROM w UNION SELECT x.a, y.b FROM w x JOIN w y ON x.b = y.a) GROUP BY a"),
    "clustering": _with(_N, _T, _CC, body="SELECT node, round(value, 6) AS value FROM cc"),
    "triangles": _with(_T, body="SELECT * FROM tc"),
    "structure": _with(_N, _T, _CC, body="""SELECT count(*) AS nodes, (SELECT count(*) FROM part_edge) AS edges, CAST(sum(t) / 3 AS BIGINT) AS triangles, round(sum(t) / sum(d * (d - 1) / 2), 6) AS transitivity, round(avg(value), 6) AS avg_clustering,
      (SELECT round(corr(x.d, y.d), 6) FROM w JOIN nd x ON x.node = a JOIN nd y ON y.node = b) AS assortativity, round(sum(d) / (count(*) * (count(*) - 1.0)), 6) AS density FROM cc"""),
    "pagerank_20it": _with(_N, "pr AS (SELECT node, 0 AS it, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS v FROM nd UNION ALL SELECT w.b, any_value(it) + 1, 0.15 / (SELECT count(*) FROM nd) + 0.85 * sum(v / nd.d) FROM pr JOIN w ON pr.node = w.a JOIN nd ON nd.node = w.a WHERE it < 20 GROUP BY w.b)", body="SELECT node, round(v, 6) AS value FROM pr WHERE it = 20"),
    "eigenvector_50it": _with(_N, "wi AS (SELECT a, b FROM w UNION ALL SELECT node, node FROM nd), ev AS (SELECT node, 0 AS it, 1.0::DOUBLE AS v FROM nd UNION ALL SELECT wi.a, any_value(it) + 1, sum(v) FROM ev JOIN wi ON ev.node = wi.b WHERE it < 50 GROUP BY wi.a)", body="SELECT node, round(v / (SELECT sqrt(sum(v * v)) FROM ev WHERE it = 50), 6) AS value FROM ev WHERE it = 50"),
    "katz": _with(_N, "kz AS (SELECT node, 0 AS it, 0.0::DOUBLE AS v FROM nd UNION ALL SELECT w.a, any_value(it) + 1, 0.0001 * sum(v) + 1.0 FROM kz JOIN w ON kz.node = w.b WHERE it < 10 GROUP BY w.a)", body="SELECT node, round(v, 6) AS value FROM kz WHERE it = 10"),
    "wcc": _with(_N, "wi AS (SELECT a, b FROM w UNION ALL SELECT node, node FROM nd), lp AS (SELECT node, 0 AS it, node AS component FROM nd UNION ALL SELECT wi.a, any_value(it) + 1, min(component) FROM lp JOIN wi ON lp.node = wi.b WHERE it < 16 GROUP BY wi.a)", body="SELECT node, component FROM lp WHERE it = 16"),
    "closeness": _with(_N, _DIST, body="SELECT src AS node, round((count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM nd) - 1), 6) AS value FROM dist GROUP BY src"),
    "harmonic": _with(_N, _DIST, body="SELECT src AS node, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END), 6) AS value FROM dist GROUP BY src"),
    "diameter_radius_apl": _with(_N, _DIST, "ecc AS (SELECT src, max(d) AS e, sum(d) AS s, count(*) AS r FROM dist GROUP BY src), n AS (SELECT count(*) AS n FROM nd)", body="SELECT CASE WHEN min(r) = max(n) THEN max(e) END AS diameter, CASE WHEN min(r) = max(n) THEN min(e) END AS radius, CASE WHEN min(r) = max(n) THEN round(sum(s) / (max(n) * (max(n) - 1)), 6) END AS avg_path FROM ecc, n"),
    "modularity_given_labels": _with(_N, body="SELECT round(sum(1.0 - x.d * y.d / (SELECT sum(d) FROM nd)) / (SELECT sum(d) FROM nd), 6) AS value FROM part_edge JOIN nd x ON x.node = src JOIN nd y ON y.node = dst WHERE src % 10 = dst % 10"),
    "lp_jaccard": _with(_N, _WEDGE, body="SELECT lo, hi, round(count(*) / (max(x.d) + max(y.d) - count(*)), 6) AS score FROM free JOIN nd x ON x.node = lo JOIN nd y ON y.node = hi GROUP BY lo, hi"),
    "lp_adamic_adar": _with(_N, _WEDGE, body=f"SELECT lo, hi, round(score, 6) AS score FROM ({_AA})"),
    "lp_common": _with(_N, _WEDGE, body="SELECT lo, hi, CAST(count(*) AS DOUBLE) AS score FROM free GROUP BY lo, hi"),
    "lp_resource_alloc": _with(_N, _WEDGE, body="SELECT lo, hi, round(sum(1.0 / dm), 6) AS score FROM free GROUP BY lo, hi"),
    "lp_pref_attach": _with(_N, body="SELECT x.node AS lo, y.node AS hi, CAST(x.d * y.d AS DOUBLE) AS score FROM nd x JOIN nd y ON x.node < y.node WHERE NOT EXISTS (SELECT 1 FROM part_edge e WHERE e.src = x.node AND e.dst = y.node) ORDER BY score DESC, lo, hi LIMIT 50"),
    "lp_node_candidates": _with(_N, _WEDGE, body=f"SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY score DESC, other) AS others FROM (SELECT lo AS node, hi AS other, round(score, 6) AS score FROM ({_AA}) UNION ALL SELECT hi, lo, round(score, 6) FROM ({_AA})) GROUP BY node"),
    "suggestions": _with(_N, _WEDGE, body=f"SELECT lo, hi, round(score, 6) AS score FROM ({_AA}) WHERE score >= 0.1 ORDER BY round(score, 12) DESC, lo, hi LIMIT 20"),
    "bfs_distances_from": _with(_WALK, _BFS, body="SELECT node, depth FROM bfs"),
    "shortest_path_parents": _with(_WALK, _BFS, body="SELECT node, depth, parent FROM bfs"),
    "cycles_len4": _with(_DIRECTED, "p2 AS (SELECT x.s AS a, x.t AS b, y.t AS c FROM dedge x JOIN dedge y ON x.t = y.s), p3 AS (SELECT a, b, c, t AS d FROM p2 JOIN dedge ON c = s WHERE a <> c), p4 AS (SELECT a, b, c, d, t AS e FROM p3 JOIN dedge ON d = s WHERE a <> d AND b <> d AND c <> d)", body="SELECT * FROM (SELECT a AS start, 2 AS length, a || '>' || b || '>' || c AS path FROM p2 WHERE a = c UNION ALL SELECT a, 3, a || '>' || b || '>' || c || '>' || d FROM p3 WHERE a = d AND b <> c UNION ALL SELECT a, 4, a || '>' || b || '>' || c || '>' || d || '>' || e FROM p4 WHERE a = e AND b <> c) ORDER BY length, path LIMIT 100"),
    "hierarchy_cycles": _with(_DIRECTED, _STEPS, body="SELECT DISTINCT s AS node FROM (SELECT s, t FROM dedge UNION ALL " + " UNION ALL ".join(f"SELECT s, t FROM h{k}" for k in range(2, 11)) + ") WHERE s = t"),
}
