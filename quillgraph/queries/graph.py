"""Queries of graph patterns, time, listings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators import temporal as T
from ..plans.model import Model, sql

AS_OF = "1995-07-01"
_VALID = f"(valid_from IS NULL OR valid_from <= DATE '{AS_OF}') AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')"


def _q(f):
    return lambda spark, root: f(Model(spark, root))


def _seeds(m: Model):
    return m.companies.where(F.col("name").isin("Supplier#000000001", "Supplier#000000002")).select("name")


def _asked(m: Model):
    rows = [("Supplier#000000001",), ("SUPPLIER#000000002",), ("s3",), ("nobody",), ("nation_4",)]
    return m.spark.createDataFrame(rows, "query string")


QUERIES = {
    "v_node": _q(lambda m: m.entities),
    "e_belongs": _q(lambda m: m.edges.where("edge_type = 'belongs_to'").select("source", "target")),
    "e_supplier": _q(lambda m: m.edges.where("edge_type = 'supplier_to'").select("source", "target", "weight", "valid_from")),
    "e_acquired_year": _q(lambda m: P.acquisitions(m.edges)),
    "walk_undirected": _q(lambda m: m.walk.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("ends"))),
    "sector_of": _q(lambda m: P.sector_of(m.edges)),
    "sector_members_cap": _q(lambda m: P.sector_members(m.edges, m.entities, "large_cap")),
    "theme_members": _q(lambda m: P.theme_members(m.edges)),
    "hierarchy_rollup": _q(lambda m: P.hierarchy(m.edges)),
    "neighbors_all": _q(lambda m: P.neighbours(m.edges)),
    "peers_all": _q(lambda m: P.peers(m.walk)),
    "group_siblings": _q(lambda m: P.peers(m.walk, "same_group", AS_OF)),
    "jv_partners": _q(lambda m: P.jv_partners(m.walk, AS_OF)),
    "acquisitions_as_of": _q(lambda m: P.acquisitions(m.edges, AS_OF)),
    "parents": _q(lambda m: P.parents(m.edges)),
    "suppliers_customers": _q(lambda m: P.suppliers_and_customers(m.edges)),
    "ego_bundle": _q(lambda m: P.ego_bundle(m.edges, m.companies)),
    "ego_bundle_as_of": _q(lambda m: P.ego_bundle(m.edges, m.companies, AS_OF)),
    "sector_cap_histogram": _q(lambda m: P.cap_histogram(m.edges, m.entities)),
    "co_mention_top": _q(lambda m: P.co_mention_top(m.edges)),
    "cross_sector_bridges": _q(lambda m: P.cross_sector_bridges(m.edges)),
    "cloud_nodes": _q(lambda m: P.cloud_nodes(m.edges, m.entities)),
    "two_hop_expansion": _q(lambda m: P.expansion(m.walk.where("edge_type <> 'has_company' and edge_type <> 'part_of'"), _seeds(m))),
    "facts_topk": _q(lambda m: P.top_facts(m.edges, _seeds(m), 40)),
    "sector_rollup": _q(lambda m: P.sector_rollup(m.companies, m.entities)),
    "edges_by_year": _q(lambda m: T.edges_by_year(m.edges)),
    "event_timeline": _q(lambda m: T.timeline(m.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), "event_type", F.to_date("ts").alias("event_date")), ["purchase", "signup"])),
    "validity_coverage": _q(lambda m: T.validity_coverage(m.edges)),
    "entities_filtered_page": _q(lambda m: P.entity_page(m.entities, P.entity_tags(m.entities), "company", sector="NATION_3", cap="mid_cap", like="0", offset=2, limit=20)),
    "entity_tags_agg": _q(lambda m: P.tags_by_entity(P.entity_tags(m.entities))),
    "resolve_nocase": _q(lambda m: P.resolve(m.entities, _asked(m))),
    "metric_topn_total": _q(lambda m: P.metric_top(P.cloud_nodes(m.edges, m.entities).select("name", F.col("degree").alias("value")), 25)),
    "arbitrary_sql": lambda spark, root: _arbitrary(Model(spark, root)),
}


def _arbitrary(m: Model):
    """Any SQL over the registered views."""
    m.entities.createOrReplaceTempView("qg_entity")
    m.edges.createOrReplaceTempView("qg_edge")
    return m.spark.sql("SELECT kind, edge_type, count(*) AS n, round(sum(weight), 6) AS weight FROM qg_edge JOIN qg_entity ON source = name GROUP BY kind, edge_type")


def _arms(where: str) -> str:
    return f"""
arms AS (
  SELECT source AS company, 'sector' AS arm, target AS item FROM edge WHERE edge_type = 'part_of' AND {where}
  UNION ALL SELECT source, 'theme', target FROM edge WHERE edge_type = 'exposed_to' AND {where}
  UNION ALL SELECT a, 'peer', b FROM walk WHERE edge_type = 'competes_with' AND {where}
  UNION ALL SELECT a, 'sibling', b FROM walk WHERE edge_type = 'same_group' AND {where}
  UNION ALL SELECT a, 'jv', b || ':' || json_extract_string(properties, '$.venture') FROM walk WHERE edge_type = 'jv_with' AND {where}
  UNION ALL SELECT source, 'acquired', target || ':' || json_extract_string(properties, '$.year') FROM edge WHERE edge_type = 'acquired' AND {where}
  UNION ALL SELECT source, 'parent', target FROM edge WHERE edge_type = 'subsidiary_of' AND {where}
  UNION ALL SELECT target, 'supplier', source FROM edge WHERE edge_type = 'supplier_to' AND {where}
  UNION ALL SELECT source, 'customer', target FROM edge WHERE edge_type = 'supplier_to' AND {where}
  UNION ALL SELECT source, 'supplier', target FROM edge WHERE edge_type = 'customer_of' AND {where}
  UNION ALL SELECT target, 'customer', source FROM edge WHERE edge_type = 'customer_of' AND {where}
  UNION ALL SELECT a, 'co_mention', b FROM walk WHERE edge_type = 'co_mentioned_in' AND {where})
SELECT company, arm, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS others
FROM arms WHERE company IN (SELECT name FROM entity WHERE kind = 'company') GROUP BY company, arm"""


_SEEDS = "('Supplier#000000001', 'Supplier#000000002')"
_PRIORITY = "CASE edge_type " + " ".join(f"WHEN '{t}' THEN {i}" for t, i in P.PRIORITY.items()) + " END"
_DEGREE = "SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edge UNION ALL SELECT target FROM edge) GROUP BY name"
_TAGS = "SELECT name AS entity_name, unnest(['sector/' || lower(sector), 'market_cap/' || market_cap]) AS tag FROM entity WHERE kind = 'company'"
_PAIRS = "SELECT target AS company, 'supplier' AS role, source AS other FROM edge WHERE edge_type = 'supplier_to' UNION SELECT source, 'customer', target FROM edge WHERE edge_type = 'supplier_to' UNION SELECT source, 'supplier', target FROM edge WHERE edge_type = 'customer_of' UNION SELECT target, 'customer', source FROM edge WHERE edge_type = 'customer_of'"

ORACLES = {
    "v_node": sql("SELECT * FROM entity"),
    "e_belongs": sql("SELECT source, target FROM edge WHERE edge_type = 'belongs_to'"),
    "e_supplier": sql("SELECT source, target, weight, valid_from FROM edge WHERE edge_type = 'supplier_to'"),
    "e_acquired_year": sql("SELECT source AS company, target, json_extract_string(properties, '$.year') AS year FROM edge WHERE edge_type = 'acquired'"),
    "walk_undirected": sql("SELECT edge_type, count(*) AS n, count(DISTINCT a) AS ends FROM walk GROUP BY edge_type"),
    "sector_of": sql("SELECT source AS company, min(target) AS sector FROM edge WHERE edge_type = 'part_of' GROUP BY source"),
    "sector_members_cap": sql("SELECT e.source AS sector, e.target AS company, n.market_cap FROM edge e JOIN entity n ON n.name = e.target WHERE edge_type = 'has_company' AND n.market_cap = 'large_cap'"),
    "theme_members": sql("SELECT DISTINCT target AS theme, source AS company FROM edge WHERE edge_type = 'exposed_to'"),
    "hierarchy_rollup": sql("SELECT target AS super_sector, string_agg(source, ',' ORDER BY source) AS sectors, count(*) AS n FROM edge WHERE edge_type = 'belongs_to' GROUP BY target"),
    "neighbors_all": sql("SELECT source AS entity, 'out' AS direction, target AS other, edge_type AS label FROM edge UNION SELECT target, 'in', source, edge_type FROM edge"),
    "peers_all": sql("SELECT DISTINCT a AS company, b AS peer FROM walk WHERE edge_type = 'competes_with'"),
    "group_siblings": sql(f"SELECT DISTINCT a AS company, b AS peer FROM walk WHERE edge_type = 'same_group' AND {_VALID}"),
    "jv_partners": sql(f"SELECT a AS company, b AS partner, coalesce(json_extract_string(properties, '$.venture'), '') AS venture FROM walk WHERE edge_type = 'jv_with' AND {_VALID}"),
    "acquisitions_as_of": sql(f"SELECT source AS company, target, json_extract_string(properties, '$.year') AS year FROM edge WHERE edge_type = 'acquired' AND {_VALID}"),
    "parents": sql("SELECT source AS company, min(target) AS parent FROM edge WHERE edge_type = 'subsidiary_of' GROUP BY source"),
    "suppliers_customers": sql(_PAIRS),
    "ego_bundle": sql("SELECT * FROM (WITH " + _arms("true").strip() + ")"),
    "ego_bundle_as_of": sql("SELECT * FROM (WITH " + _arms(_VALID).strip() + ")"),
    "sector_cap_histogram": sql("SELECT e.source AS sector, coalesce(n.market_cap, 'unknown') AS market_cap, count(*) AS n FROM edge e JOIN entity n ON n.name = e.target WHERE edge_type = 'has_company' GROUP BY 1, 2"),
    "co_mention_top": sql("SELECT source AS entity, count(*) AS n FROM edge WHERE edge_type = 'co_mentioned_in' GROUP BY source ORDER BY n DESC, entity LIMIT 15"),
    "cross_sector_bridges": sql("SELECT edge_type, x.sector AS sector_a, y.sector AS sector_b, count(*) AS n FROM edge JOIN entity x ON x.name = source JOIN entity y ON y.name = target WHERE edge_type IN ('jv_with', 'acquired') AND x.sector <> y.sector GROUP BY 1, 2, 3"),
    "cloud_nodes": sql(f"SELECT d.name, coalesce(e.kind, 'unknown') AS kind, d.degree FROM ({_DEGREE}) d LEFT JOIN entity e ON e.name = d.name"),
    "two_hop_expansion": sql(f"""SELECT name, min(hop) AS hop FROM (
      SELECT unnest(['Supplier#000000001', 'Supplier#000000002']) AS name, 0 AS hop
      UNION ALL SELECT b, 1 FROM walk WHERE a IN {_SEEDS} AND edge_type NOT IN ('co_mentioned_in', 'has_company', 'part_of')
      UNION ALL SELECT y.b, 2 FROM (SELECT DISTINCT a, b FROM walk WHERE edge_type NOT IN ('co_mentioned_in', 'has_company', 'part_of')) x JOIN (SELECT DISTINCT a, b FROM walk WHERE edge_type NOT IN ('co_mentioned_in', 'has_company', 'part_of')) y ON x.b = y.a WHERE x.a IN {_SEEDS}) GROUP BY name"""),
    "facts_topk": sql(f"SELECT source, edge_type, target, {_PRIORITY} AS priority, weight FROM edge WHERE source IN {_SEEDS} OR target IN {_SEEDS} ORDER BY priority, weight DESC, source, target, edge_type LIMIT 40"),
    "sector_rollup": sql("SELECT sector, count(*) AS n FROM entity WHERE kind = 'company' AND sector IS NOT NULL GROUP BY sector"),
    "edges_by_year": sql("SELECT CAST(year(valid_from) AS VARCHAR) AS year, edge_type, count(*) AS n FROM edge WHERE valid_from IS NOT NULL GROUP BY 1, 2"),
    "event_timeline": "SELECT event_id AS id, user_id AS entity, event_type, CAST(ts AS DATE) AS event_date, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) NULLS LAST, event_id) AS place FROM events WHERE event_type IN ('purchase', 'signup')",
    "validity_coverage": sql("SELECT edge_type, count(*) AS total, count(valid_from) AS with_from, count(*) - count(valid_from) AS missing, count(valid_to) AS with_to FROM edge GROUP BY edge_type"),
    "entities_filtered_page": sql("SELECT name, kind, sector, market_cap, (SELECT count(*) FROM entity WHERE kind = 'company' AND sector = 'NATION_3' AND market_cap = 'mid_cap') AS total FROM entity WHERE kind = 'company' AND sector = 'NATION_3' AND market_cap = 'mid_cap' ORDER BY name LIMIT 20 OFFSET 2"),
    "entity_tags_agg": sql(f"SELECT entity_name, string_agg(tag, ',' ORDER BY tag) AS tags, substr(min(tag) FILTER (tag LIKE 'market_cap/%'), 12) AS market_cap FROM ({_TAGS}) GROUP BY entity_name"),
    "resolve_nocase": sql("""SELECT q AS query, CASE WHEN e.name IS NOT NULL THEN e.name WHEN l.name IS NOT NULL THEN l.name ELSE t.name END AS name, CASE WHEN e.name IS NOT NULL THEN 1 WHEN l.name IS NOT NULL THEN 2 WHEN t.name IS NOT NULL THEN 3 END AS step
      FROM (SELECT unnest(['Supplier#000000001', 'SUPPLIER#000000002', 's3', 'nobody', 'nation_4']) AS q) LEFT JOIN entity e ON e.name = q LEFT JOIN entity l ON lower(l.name) = lower(q) LEFT JOIN entity t ON lower(t.ticker) = lower(q)"""),
    "metric_topn_total": sql(f"SELECT name, degree AS value, (SELECT count(*) FROM ({_DEGREE})) AS total FROM ({_DEGREE}) ORDER BY degree DESC, name LIMIT 25"),
    "arbitrary_sql": sql("SELECT kind, edge_type, count(*) AS n, round(sum(weight), 6) AS weight FROM edge JOIN entity ON source = name GROUP BY kind, edge_type"),
}
