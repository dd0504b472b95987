"""Queries of notes, newsletters, events, citations and stored measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import community as C
from ..operators import editions as D
from ..operators import events as Y
from ..operators import integrity as I
from ..operators import market as G
from ..operators import mentions as N
from ..operators import metrics as M
from ..operators import patterns as P
from ..operators import resolve as E
from ..operators import search as S
from ..operators import validators as K
from ..operators import vector as V
from ..plans.model import Model, sql
from ..plans.notes import NOTES_SQL, SERIES, firms, newsletters, notes
from ..sources.heads import parsed
from .metrics import _N as NEAR
from .metrics import _VOTES as VOTES
from .metrics import _with as with_graph

SECTORS = [f"NATION_{i}" for i in range(25) if i != 7]
KNOWN = {"geography": ("india", "global")}
TODAY, YEAR = "2025-06-01", 2025
TYPES = ["co_mentioned_in"]


def _m(f):
    return lambda spark, root: f(Model(spark, root))


def _read(m: Model):
    n = notes(m)
    return parsed(n).join(n.select("path", "k", "entity"), "path")


def _entities(m: Model):
    return m.table("supplier").where("s_suppkey % 10 <> 7").select(F.regexp_replace("s_name", "#", "_").alias("normalized_name"))


def _files(m: Model):
    return m.spark.range(4).select(F.concat(F.lit("Editions/ed_"), "id", F.lit(".md")).alias("path"))


def _bodies(m: Model):
    return _read(m).select("entity", F.col("path").alias("edition"), "body")


def _cites(m: Model):
    n = _read(m)
    edges, _ = D.citations(n, m.spark.range(5).select(F.concat(F.lit("ed_"), "id").alias("id")))
    said = n.where("k % 3 > 0").select("entity", F.concat(F.lit("ed_"), F.col("k") % 5).alias("edition"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") % 3)).alias("i"))
    return D.cited_in(edges, said).select("source", "target", "edge_type", "n_quotes")


def _cite_counts(m: Model):
    return D.citations(_read(m), m.spark.range(5).select(F.concat(F.lit("ed_"), "id").alias("id")))[1]


def _told(m: Model):
    return N.edges_told(newsletters(m), firms(m), this_year=YEAR)


def _applied(m: Model):
    edges = _told(m)[0].select("source", "target", "edge_type")
    table = firms(m).where("place % 4 = 0").select(F.col("name").alias("source"), F.concat(F.lit("Orbis K"), F.col("place") + 1, F.lit(" Works")).alias("target"), F.lit("acquired").alias("edge_type"))
    no = firms(m).where("place % 5 = 0").select(F.col("name").alias("source"), F.concat(F.lit("Orbis K"), F.col("place") + 3, F.lit(" Works")).alias("target"), F.lit("supplier_to").alias("edge_type"))
    known = firms(m).where("place % 11 <> 0")
    return N.applied(table, edges, known, no)


def _groups(m: Model):
    parts = N.sections(newsletters(m)).select("id", F.col("name").alias("company"), "body")
    return N.groups_told(parts)


def _scores(m: Model):
    return M.link_scores(m.part_graph, "common")


def _links(m: Model):
    table = A.stored_links(_scores(m), "common", TYPES)
    return A.links(table).select("entity", "method", F.array_join("edge_types", ",").alias("edge_types"), "best_score", F.size("candidates").alias("n"), F.element_at("candidates", 1)["name"].alias("first"))


def _groups_of(m: Model):
    labels = M.wcc(m.part_graph)
    return A.groups(A.stored_components(labels), "wcc", "componentId").select(F.col("label").cast("long").alias("label"), "size", F.element_at("members", 1).alias("first"))


def _seed_reader(m: Model):
    return A.seeds(A.stored_seeds(C.voterank_table(m.part_graph, 5))).select("place", F.col("name").cast("long").alias("node"))


def _fresh(m: Model):
    pairs = _scores(m).where("score >= 2")
    earlier = pairs.where("(lo + hi) % 2 = 0").select(F.col("hi").cast("string").alias("source"), F.col("lo").cast("string").alias("target_mention"), F.when(F.col("lo") % 3 == 0, "other").otherwise("link_prediction").alias("origin"))
    return A.fresh_suggestions(pairs, earlier)


def _vectors(m: Model):
    return m.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _faulty(m: Model):
    """The edges with some faults, each of a kind of its own."""
    rows = [("Supplier#000000001", "Supplier#000000001", "acquired", "{}"), ("Supplier#000000002", "Supplier#000000003", "odd", "{}"), ("Supplier#000000002", "nobody", "jv_with", "{}"), ("NATION_1", "Supplier#000000004", "part_of", "{}"), ("Supplier#000000005", "Supplier#000000006", "zz_with", "{bad"), ("NATION_2", "NATION_3", "belongs_to", "{}"), ("NATION_3", "NATION_2", "belongs_to", "{}")]
    more = m.spark.createDataFrame(rows, "source string, target string, edge_type string, properties string")
    return m.edges.select("source", "target", "edge_type", "valid_from", "properties").unionByName(more.select("source", "target", "edge_type", F.lit(None).cast("date").alias("valid_from"), "properties"))


def _faulty_entities(m: Model):
    more = [("Acme Works", "company", "S1"), ("Acme Works Limited", "company", None), ("Lost Region", "super_sector", None), ("Lost Part", "sub_sector", None)]
    return m.entities.select("name", "kind", "ticker").unionByName(m.spark.createDataFrame(more, "name string, kind string, ticker string"))


def _tags(m: Model):
    return P.entity_tags(m.entities).unionByName(m.spark.createDataFrame([("nobody", "sector/x"), ("Supplier#000000001", "market_cap/other")], "entity_name string, tag string"))


def _docs(m: Model):
    return m.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_type"), F.col("lang").alias("title"), "text")


def _quotes(m: Model):
    """Each supplier's figures as a quote service gives them."""
    s = m.table("supplier").select(F.col("s_name").alias("entity"), F.col("s_acctbal").alias("v"), F.when(F.col("s_suppkey") % 4 == 0, "USD").otherwise("INR").alias("currency"))
    each = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    rows = F.array(each("totalRevenue", F.col("v") * 1e7), each("grossMargins", F.col("v") / 10000), each("beta", F.round("v") / 1000), each("odd", F.col("v")), each("trailingPE", F.lit("n/a")))
    return s.select("entity", "currency", F.explode(rows).alias("r")).select("entity", "currency", "r.*")


def _prose(m: Model):
    """Each order as a sentence with an amount, or a count that is none."""
    k, p = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    text = F.when(k % 5 == 0, F.concat(F.lit("Net revenue came in at Rs."), p, F.lit(" crore for Q2 FY26."))).when(k % 5 == 1, F.concat(F.lit("They opened "), k % 90 + 1, F.lit("% more stores than before.")))
    text = text.when(k % 5 == 2, F.concat(F.lit("EBITDA margin rose by "), k % 300 + 20, F.lit(" bps in Mar 2026."))).when(k % 5 == 3, F.concat(F.lit("Net debt fell to "), k % 9 + 1, F.lit(".5x of equity there."))).otherwise(F.concat(F.lit("It is "), k % 9 + 2, F.lit("x more fun than it was before.")))
    return m.table("orders").select(k.alias("id"), text.alias("text"))


def _taxonomy(m: Model):
    n = m.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("child"), F.concat(F.lit("Region"), "n_regionkey").alias("parent"))
    up = n.where("k % 7 <> 3").select("child", F.when(F.col("k") == 1, F.lit("NATION_2")).otherwise(F.col("parent")).alias("parent"), F.lit("sector").alias("kind"))
    more = m.spark.createDataFrame([("NATION_4", "Other", "sector"), ("Nowhere", "Other", "sector"), ("Sub A", "NATION_5", "sub_sector"), ("Sub A", "NATION_6", "sub_sector"), ("NATION_8", "Nobody", "sub_sector")], "child string, parent string, kind string")
    return up.unionByName(more)


def _recall(m: Model):
    rows = m.table("benchmark").select(F.col("item_id").cast("long").alias("i"))
    asked = rows.select(F.col("i").alias("question"), F.concat(F.lit("c"), F.col("i") % 3).alias("category"), (F.col("i") * 2).alias("expect"))
    found = rows.select(F.col("i").alias("question"), F.explode(F.array(F.lit("bm25"), F.lit("hybrid"))).alias("mode")).select("question", "mode", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place"))
    found = found.withColumn("found", F.when(F.col("mode") == "bm25", F.col("question") + F.col("place")).otherwise(F.col("question") * 2 - F.col("place") % 4))
    return G.recall_at(asked, found)


def _filed(m: Model):
    """Suppliers with paths, some of them wrong, and the files that there are."""
    s = m.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("company").alias("kind"), F.regexp_replace("s_name", "#", "_").alias("stem"))
    path = F.when(F.col("k") % 5 == 0, F.lit("")).when(F.col("k") % 9 == 1, F.concat(F.lit("vault/Sectors/"), "stem", F.lit(".md"))).when(F.col("k") % 11 == 2, F.concat(F.lit("vault/Companies/bad name "), "k", F.lit(".md"))).otherwise(F.concat(F.lit("vault/Companies/"), "stem", F.lit(".md")))
    e = s.select("k", "name", "kind", path.alias("file_path"), F.when(F.col("k") % 6 == 0, F.lit("Other")).otherwise(F.col("stem")).alias("normalized_name"))
    files = e.where("file_path <> '' and k % 7 <> 3").select(F.col("file_path").alias("path")).unionByName(m.spark.createDataFrame([("vault/Companies/alone.md",)], "path string"))
    return e, files


def _facts(m: Model):
    e = m.table("events").select(F.col("user_id").cast("string").alias("entity"), F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("properties"))
    names = m.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("name"))
    return I.quotes(e, names).unionByName(I.figures(e, names))


def _note_tags(m: Model):
    n = _read(m).where("k % 3 <> 0").select("path", "tags")
    table = notes(m).select(F.col("path").alias("note_path"), F.explode(F.array(F.lit("entity_type/company"), F.lit("geography/mars"))).alias("tag"))
    return I.note_tags(table, n)


def _meta(m: Model):
    return I.build_meta(m.spark.createDataFrame([("generation", "12"), ("schema_version", "3"), ("model", "x")], "key string, value string"), {"schema_version": "3", "model": "y", "gone": "1"})


QUERIES = {
    "file_path_checks": _m(lambda m: I.file_paths(*_filed(m)).unionByName(I.names_and_files(*_filed(m)))),
    "fact_checks": _m(_facts),
    "note_tag_checks": _m(_note_tags),
    "build_meta_checks": _m(_meta),
    "market_measures": _m(lambda m: G.market_measures(_quotes(m)).withColumn("value_num", F.round("value_num", 6))),
    "prose_measures": _m(lambda m: G.measures(_prose(m)).select("id", "label", "raw", "value", "unit", "period")),
    "built_hierarchy": _m(lambda m: G.built_hierarchy(_taxonomy(m))[1]),
    "hierarchy_entities": _m(lambda m: G.built_hierarchy(_taxonomy(m))[0]),
    "taxonomy_faults": _m(lambda m: G.taxonomy_faults(_taxonomy(m), m.table("nation").select(F.col("n_name").alias("name")))),
    "industry_competitors": _m(lambda m: G.industry_competitors(m.table("supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 9 > 0, F.concat(F.lit("i"), F.col("s_nationkey"))).alias("industry")))),
    "retrieval_recall": _m(_recall),
    "note_checks": _m(lambda m: K.all_notes(_read(m), _entities(m), SECTORS, KNOWN)),
    "provenance_checks": _m(lambda m: K.provenance_checks(_read(m), _files(m))),
    "provenance_census": _m(lambda m: K.provenance_census(_read(m), TODAY)),
    "stale_after": _m(lambda m: K.stale_after(_read(m), "2024-01-01")),
    "merged_sources": _m(lambda m: K.merged_sources(_read(m), notes(m).where("k % 2 = 0").select("path", F.explode(F.array(F.lit("ed_0"), F.lit("ed_9"))).alias("id"), F.lit("/r").alias("resource"), F.lit("t").alias("title"), F.lit("2024-01-01").alias("last_modified"))).select("path", F.array_join(F.transform("sources", lambda s: s["id"]), ",").alias("ids"))),
    "schema_checks": _m(lambda m: K.schema_checks(_read(m), {"company": {"required": ["title", "market_cap"], "properties": {"market_cap": {"enum": ["mid_cap", None]}, "permalink": {"pattern": "^/companies/"}}}}).select("path", "check", "detail")),
    "guidance_events": _m(lambda m: Y.guidance(_bodies(m), YEAR).select("entity", "event_type", "event_date", "period", "date_precision", "magnitude")),
    "management_events": _m(lambda m: Y.management(_bodies(m), YEAR).select("entity", "event_type", "event_date", "period", "date_precision", "magnitude", F.get_json_object("properties", "$.person").alias("person"))),
    "promoted_events": _m(lambda m: Y.promoted(m.edges).select("entity", "event_type", "event_date", "period", "date_precision", "counterparty")),
    "edition_co_mentions": _m(lambda m: D.co_mentions(_bodies(m).select("entity", "body"), SERIES)),
    "cited_in": _m(_cites),
    "citation_counts": _m(_cite_counts),
    "synced_tags": _m(lambda m: D.synced_tags(m.spark.createDataFrame([("kept", "sector/x"), ("Orbis K1 Works", "sector/old")], "entity_name string, tag string"), _read(m))),
    "synced_sectors": _m(lambda m: D.synced_sectors(firms(m).select("name", F.lit(None).cast("string").alias("sector")), _read(m), {f"nation_{i}": f"Nation{i}" for i in range(25)})),
    "sector_roster": _m(lambda m: D.roster(m.entities).select("sector", F.length("companies").alias("n"))),
    "resolved_editions": _m(lambda m: D.resolved_editions(m.table("supplier").select(F.concat(F.lit("Tales of Harbour "), F.col("s_suppkey") % 30, F.when(F.col("s_suppkey") % 3 == 0, F.lit(", Edition #4")).otherwise("")).alias("ref")), D.edition_index(m.spark.range(20).select(F.concat(F.lit("Editions/E_"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("Series: Tales of Harbour "), "id").alias("title"))), "Series")),
    "company_headings": _m(lambda m: N.company_headings(newsletters(m))),
    "relation_sections": _m(lambda m: N.sections(newsletters(m)).select("id", "name", "line", F.size(F.split("body", "\n")).alias("lines"))),
    "relations_told": _m(lambda m: _told(m)[0].select("source", "target", "edge_type", "valid_from", "symmetric", "edition")),
    "relations_unresolved": _m(lambda m: _told(m)[1].select("edge_type", "source", "target_mention", "edition")),
    "relations_applied": _m(lambda m: _applied(m)[0]),
    "relations_counts": _m(lambda m: _applied(m)[1]),
    "same_group_told": _m(_groups),
    "classified_names": _m(lambda m: E.classified(N.company_headings(newsletters(m)).select("name", "line").unionByName(m.spark.range(5).select(F.concat(F.lit("Quite New Firm "), "id").alias("name"), F.lit(9).alias("line"))), firms(m).where("place % 2 = 0")).where("kind <> 'uncertain'").select("name", "kind")),
    "guessed_sector": _m(lambda m: E.guessed_sector(m.table("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), [("Rings", ("ring",)), ("Tools", ("widget", "gear")), ("Small", ("small",))], ["Rings", "Tools", "Small", "Diversified"])),
    "link_prediction_reader": _m(_links),
    "component_reader": _m(_groups_of),
    "seed_reader": _m(_seed_reader),
    "fresh_suggestions": _m(_fresh),
    "graph_hygiene": _m(lambda m: I.hygiene(_faulty(m), _faulty_entities(m), _tags(m))),
    "integrity_faults": _m(lambda m: I.all_checks(_faulty(m), _faulty_entities(m), _tags(m))),
    "largest_sectors": _m(lambda m: I.largest_sectors(m.edges)),
    "sector_bundles": _m(lambda m: P.bundles(m.edges, m.entities)),
    "cloud_types": _m(lambda m: P.cloud(_faulty(m), m.entities)[2]),
    "path_or_name": _m(lambda m: P.path_or_name(_base_paths(m), m.spark.createDataFrame([("Supplier#000000001",), ("vault/2.md",), ("none",)], "query string"))),
    "search_page": _m(lambda m: S.search_page(_docs(m), "the and", 10, 5)),
    "edition_companies": _m(lambda m: V.edition_companies(_vectors(m), m.spark.range(50).select("id", F.concat(F.lit("Tale "), "id").alias("title"), F.concat(F.lit("Editions/e"), "id", F.lit(".md")).alias("path")), _vectors(m).where("id >= 50").select("id", F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("company")), "e7", 10)),
    "notes_like_entity": _m(lambda m: V.like_entity(_vectors(m), m.spark.createDataFrame([("Acme", 11)], "entity string, id long"), "Acme", 10, ["1", "2", "3"])),
    "entity_match": _m(lambda m: V.entity_match(_vectors(m).where("id % 50 = 0").select(F.col("id").alias("query"), "v"), _vectors(m).where("id % 50 <> 0"), 0.1)),
}


def _base_paths(m: Model):
    return m.table("supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("vault/"), "s_suppkey", F.lit(".md")).alias("file_path"))


def _n(body: str) -> str:
    return f"WITH {NOTES_SQL} {body}"


_FULL = "k % 19 <> 0"
_CHECKS = f"""
SELECT path, 'filename_format' AS "check", 'error' AS severity, CASE k % 29 WHEN 3 THEN 'trailing_underscore' ELSE 'double_underscore' END AS detail FROM note WHERE k % 29 IN (3, 5)
UNION ALL SELECT path, 'yaml_missing', 'error', 'title' FROM note WHERE k % 10 = 1
UNION ALL SELECT path, 'yaml_type', 'error', 'firm' FROM note WHERE k % 10 = 2
UNION ALL SELECT path, 'tags_repeated', 'error', '' FROM note WHERE k % 5 = 0
UNION ALL SELECT path, 'tag_format', 'warning', 'sector/' || nation FROM note WHERE k % 6 = 0
UNION ALL SELECT path, 'name_sync', 'error', CASE k % 12 WHEN 1 THEN 'missing' WHEN 0 THEN 'Other' ELSE stem END FROM note WHERE k % 12 IN (0, 1) OR k % 29 IN (3, 5)
UNION ALL SELECT path, 'tag_value', 'warning', 'geography/mars' FROM note WHERE k % 4 = 0
UNION ALL SELECT path, 'permalink', 'error', '/firms/x' FROM note WHERE k % 10 <> 2 AND k % 9 = 0
UNION ALL SELECT path, 'field_order', 'warning', 'type,ticker' FROM note WHERE k % 10 = 1
UNION ALL SELECT path, 'missing_field', 'warning', 'market_cap' FROM note WHERE k % 10 <> 2 AND k % 11 = 0
UNION ALL SELECT path, 'market_cap_value', 'error', 'giant_cap' FROM note WHERE k % 10 <> 2 AND k % 11 = 1
UNION ALL SELECT path, 'listed_missing', 'warning', '' FROM note WHERE k % 10 <> 2 AND k % 7 = 0
UNION ALL SELECT path, 'sector_scalar', 'warning', nation FROM note WHERE k % 10 <> 2 AND nation = 'NATION_7'
UNION ALL SELECT path, 'content_minimal', 'error', '0' FROM note WHERE k % 19 = 0
UNION ALL SELECT path, 'duplicates', 'error', 'Strategy' FROM note WHERE {_FULL} AND k % 7 = 1
UNION ALL SELECT path, 'case_variant_heading', 'warning', 'strategy' FROM note WHERE {_FULL} AND k % 7 = 2
UNION ALL SELECT path, 'near_duplicate_heading', 'warning', 'Strategy | Strategyy' FROM note WHERE {_FULL} AND k % 7 = 3
UNION ALL SELECT path, 'redundant_yaml', 'warning', 'title' FROM note WHERE {_FULL} AND k % 23 = 0
UNION ALL SELECT path, CASE WHEN k % 6 = 0 THEN 'sector_tag_case' ELSE 'sector_tag_unknown' END, CASE WHEN k % 6 = 0 THEN 'error' ELSE 'warning' END, 'sector/' || CASE WHEN k % 6 = 0 THEN nation ELSE lower(nation) END FROM note WHERE k % 6 = 0 OR nation = 'NATION_7'
UNION ALL SELECT path, 'permalink_folder', 'error', '/companies/elsewhere/' || stem FROM note WHERE k % 9 = 1
UNION ALL SELECT path, 'date_order', 'error', '2024-01-01' FROM note WHERE k % 8 = 0
UNION ALL SELECT path, 'orphan_note', 'error', file FROM note WHERE k % 10 = 7 OR k % 29 IN (3, 5)"""
_FIRMS = "firm AS (SELECT 'Orbis K' || s_suppkey || ' Works' AS name, s_suppkey AS k FROM supplier)"
_SAID = f"""WITH {_FIRMS},
said AS (
  SELECT k, name, i, kind, 'Orbis K' || (k + i) || ' Works' AS other FROM firm, (VALUES (1, 'acquired'), (2, 'jv_with'), (3, 'supplier_to'), (4, 'subsidiary_of')) t(i, kind)),
edges AS (
  SELECT CASE WHEN kind = 'jv_with' THEN least(name, other) ELSE name END AS source, CASE WHEN kind = 'jv_with' THEN greatest(name, other) ELSE other END AS target, kind AS edge_type,
         CASE WHEN kind = 'acquired' THEN DATE '2021-03-01' END AS valid_from, kind = 'jv_with' AS "symmetric", 'ed_' || k AS edition, k, i
  FROM said WHERE other IN (SELECT name FROM firm))"""
_KEPT = "kept AS (SELECT * FROM edges WHERE NOT (edge_type = 'supplier_to' AND k % 5 = 0)), good AS (SELECT * FROM kept WHERE source IN (SELECT name FROM firm WHERE k % 11 <> 0) AND target IN (SELECT name FROM firm WHERE k % 11 <> 0)), old AS (SELECT name AS source, 'Orbis K' || (k + 1) || ' Works' AS target, 'acquired' AS edge_type FROM firm WHERE k % 4 = 0)"
_COMMON = "w AS (SELECT src AS a, dst AS b FROM part_edge UNION ALL SELECT dst, src FROM part_edge), sc AS (SELECT x.b AS lo, y.b AS hi, count(*)::DOUBLE AS score FROM w x JOIN w y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM part_edge e WHERE e.src = x.b AND e.dst = y.b) GROUP BY 1, 2)"
_FAULTY = """faulty AS (SELECT source, target, edge_type, valid_from, properties FROM edge UNION ALL SELECT a, b, t, NULL, p FROM (VALUES ('Supplier#000000001', 'Supplier#000000001', 'acquired', '{}'), ('Supplier#000000002', 'Supplier#000000003', 'odd', '{}'), ('Supplier#000000002', 'nobody', 'jv_with', '{}'), ('NATION_1', 'Supplier#000000004', 'part_of', '{}'), ('Supplier#000000005', 'Supplier#000000006', 'zz_with', '{bad'), ('NATION_2', 'NATION_3', 'belongs_to', '{}'), ('NATION_3', 'NATION_2', 'belongs_to', '{}')) x(a, b, t, p)),
people AS (SELECT name, kind, ticker FROM entity UNION ALL SELECT * FROM (VALUES ('Acme Works', 'company', 'S1'), ('Acme Works Limited', 'company', NULL), ('Lost Region', 'super_sector', NULL), ('Lost Part', 'sub_sector', NULL)) y(a, b, c))"""
_KINDS = """(edge_type = 'part_of' AND (s.kind <> 'company' OR t.kind <> 'sector')) OR (edge_type = 'has_company' AND (s.kind <> 'sector' OR t.kind <> 'company')) OR (edge_type = 'belongs_to' AND (s.kind NOT IN ('sector', 'sub_sector') OR t.kind NOT IN ('super_sector', 'sector'))) OR (edge_type = 'exposed_to' AND (s.kind NOT IN ('company', 'sector') OR t.kind <> 'theme')) OR (edge_type IN ('competes_with', 'jv_with', 'same_group', 'supplier_to', 'customer_of', 'acquired', 'subsidiary_of', 'co_mentioned_in') AND (s.kind <> 'company' OR t.kind <> 'company'))"""
_SIM = "list_cosine_similarity(x.v, q.v)"
_V = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings"
_TOK = r"tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda t: t <> '')) AS term FROM documents), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda t: t <> '')) AS l FROM documents), st AS (SELECT count(*) AS n, avg(l) AS a FROM len)"
_BM = "bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) AS score FROM post JOIN (SELECT term, count(*) AS df FROM post WHERE term IN ('the', 'and') GROUP BY term) USING (term) JOIN len USING (id), st GROUP BY id HAVING count(*) = 2)"

_TAX = """tax AS (SELECT n_name AS child, CASE WHEN n_nationkey = 1 THEN 'NATION_2' ELSE 'Region' || n_regionkey END AS parent, 'sector' AS kind FROM nation WHERE n_nationkey % 7 <> 3
  UNION ALL SELECT * FROM (VALUES ('NATION_4', 'Other', 'sector'), ('Nowhere', 'Other', 'sector'), ('Sub A', 'NATION_5', 'sub_sector'), ('Sub A', 'NATION_6', 'sub_sector'), ('NATION_8', 'Nobody', 'sub_sector')) x(a, b, c))"""
_FILED = """e AS (SELECT s_suppkey AS k, replace(s_name, '#', '_') AS stem, CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 9 = 1 THEN 1 WHEN s_suppkey % 11 = 2 THEN 2 ELSE 3 END AS w FROM supplier)"""
ORACLES = {
    "classified_names": f"WITH {_FIRMS} SELECT name, 'existing' AS kind FROM firm WHERE k % 2 = 0 UNION ALL SELECT 'Quite New Firm ' || i, 'new' FROM range(5) t(i)",
    "seed_reader": with_graph(NEAR, VOTES, body="SELECT place, node FROM vr WHERE step = (SELECT max(step) FROM vr) AND place < 5"),
    "file_path_checks": f"""WITH {_FILED} SELECT 'file_path_empty' AS "check", 'error' AS severity, count(*) AS count FROM e WHERE w = 0 UNION ALL SELECT 'file_path_missing', 'error', count(*) FROM e WHERE w > 0 AND k % 7 = 3 UNION ALL SELECT 'file_path_folder', 'error', count(*) FROM e WHERE w = 1
      UNION ALL SELECT 'file_path_name', 'error', count(*) FROM e WHERE w = 2 UNION ALL SELECT 'normalization_stem', 'warning', count(*) FROM e WHERE w > 0 AND (k % 6 = 0 OR w = 2) UNION ALL SELECT 'normalization_orphan_files', 'warning', 1""",
    "fact_checks": " UNION ALL ".join(f"SELECT '{t}_orphans' AS \"check\", 'error' AS severity, count(*) AS count FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT '{t}_json', 'error', count(*) FROM events WHERE event_id % 10 = 0 OR NOT json_valid(props)" for t in ("quotes", "company_metrics")),
    "note_tag_checks": _n("SELECT 'note_tags_missing_note' AS \"check\", 'error' AS severity, 2 * count(*) AS count FROM note WHERE k % 3 = 0 UNION ALL SELECT 'note_tags_dropped', 'error', count(*) FROM note WHERE k % 3 <> 0 AND k % 4 <> 0"),
    "build_meta_checks": "SELECT 'db_meta_generation' AS \"check\", 'error' AS severity, 0::BIGINT AS count UNION ALL SELECT 'db_meta_schema_version', 'error', 0 UNION ALL SELECT 'db_meta_model', 'error', 1 UNION ALL SELECT 'db_meta_gone', 'error', 1",
    "market_measures": """SELECT s_name AS entity, label AS metric_label, round(CASE label WHEN 'total_revenue' THEN s_acctbal * 1e7 * CASE WHEN s_suppkey % 4 = 0 THEN 83.0 ELSE 1.0 END / 1e7 WHEN 'gross_margin' THEN s_acctbal / 10000 * CASE WHEN s_acctbal / 10000 < 1 THEN 100 ELSE 1 END ELSE round(s_acctbal) / 1000 END, 6) AS value_num, unit, period
      FROM supplier, (VALUES ('total_revenue', 'crore_inr', 'TTM'), ('gross_margin', 'percent', 'TTM'), ('beta', 'dimensionless', 'latest')) t(label, unit, period)""",
    "prose_measures": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'revenue' WHEN 2 THEN 'ebitda_margin' ELSE 'debt' END AS label, CASE o_orderkey % 5 WHEN 0 THEN 'Rs.' || round(o_totalprice)::BIGINT || ' crore' WHEN 2 THEN (o_orderkey % 300 + 20) || ' bps' ELSE (o_orderkey % 9 + 1) || '.5x' END AS raw,
      CASE o_orderkey % 5 WHEN 0 THEN round(o_totalprice) WHEN 2 THEN (o_orderkey % 300 + 20)::DOUBLE ELSE (o_orderkey % 9 + 1) + 0.5::DOUBLE END AS value, CASE o_orderkey % 5 WHEN 0 THEN 'crore' WHEN 2 THEN 'bps' ELSE 'x' END AS unit, CASE o_orderkey % 5 WHEN 0 THEN 'Q2 FY26' WHEN 2 THEN 'Mar 2026' END AS period FROM orders WHERE o_orderkey % 5 IN (0, 2, 3)""",
    "built_hierarchy": f"WITH {_TAX} SELECT DISTINCT child AS source, parent AS target, 'belongs_to' AS edge_type FROM tax",
    "hierarchy_entities": f"WITH {_TAX} SELECT DISTINCT parent AS name, 'super_sector' AS kind FROM tax WHERE kind = 'sector' UNION ALL SELECT DISTINCT child, kind FROM tax WHERE kind = 'sub_sector'",
    "taxonomy_faults": f"WITH {_TAX} SELECT 'unknown_sector' AS fault, 'Nowhere' AS name UNION ALL SELECT 'unmapped_sector', n_name FROM nation WHERE n_name NOT IN (SELECT child FROM tax WHERE kind = 'sector') UNION ALL SELECT 'mapped_twice', 'NATION_4' UNION ALL SELECT 'unknown_parent', 'Nobody' UNION ALL SELECT 'super_sector_collides', 'NATION_2' UNION ALL SELECT 'sub_sector_collides', 'NATION_8' UNION ALL SELECT 'sub_sector_repeats', 'Sub A'",
    "industry_competitors": "SELECT least(x.s_name, y.s_name) AS source, greatest(x.s_name, y.s_name) AS target, 'competes_with' AS edge_type FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey WHERE x.s_suppkey % 9 > 0 AND y.s_suppkey % 9 > 0",
    "retrieval_recall": "WITH i AS (SELECT item_id AS q FROM benchmark) SELECT 'c' || (q % 3) AS category, mode, count(*) AS n, round(avg(CASE WHEN mode = 'bm25' THEN (q < 5)::INT ELSE 1 END), 6) AS recall FROM i, (VALUES ('bm25'), ('hybrid')) t(mode) GROUP BY 1, 2",
    "note_checks": _n(_CHECKS),
    "provenance_checks": _n("SELECT path, 'source_gone' AS \"check\", 'warning' AS severity, CASE WHEN k % 6 = 0 THEN '/Reports/r.pdf' ELSE '/Editions/ed_4.md' END AS detail FROM note WHERE k % 6 = 0 OR k % 5 = 4"),
    "provenance_census": _n("SELECT 'company' AS \"group\", CASE k % 3 WHEN 1 THEN 'human-reviewed' WHEN 2 THEN 'machine-confirmed' ELSE 'unverified' END AS tier, count(*) AS notes, count(*) FILTER (k % 2 = 0) AS stale FROM note GROUP BY 1, 2"),
    "stale_after": _n("SELECT path, CAST(CAST(DATE '2024-03-01' + CAST(k % 5 AS INTEGER) + 180 AS DATE) AS VARCHAR) AS stale_after FROM note"),
    "merged_sources": _n("SELECT path, own || CASE WHEN k % 2 = 0 THEN CASE WHEN own = 'ed_0' THEN '' ELSE ',ed_0' END || ',ed_9' ELSE '' END AS ids FROM (SELECT *, CASE WHEN k % 17 = 0 THEN 'unknown' ELSE 'ed_' || (k % 5) END AS own FROM note)"),
    "schema_checks": _n("SELECT path, 'schema_required' AS \"check\", 'title' AS detail FROM note WHERE k % 10 = 1 UNION ALL SELECT path, 'schema_required', 'market_cap' FROM note WHERE k % 10 <> 2 AND k % 11 = 0 UNION ALL SELECT path, 'schema_enum', 'market_cap' FROM note WHERE k % 10 <> 2 AND k % 11 = 1 UNION ALL SELECT path, 'schema_pattern', 'permalink' FROM note WHERE k % 10 <> 2 AND k % 9 = 0"),
    "guidance_events": _n(f"SELECT entity, 'guidance' AS event_type, NULL::DATE AS event_date, 'FY27' AS period, 'none' AS date_precision, (10 + k % 5) || '-' || (12 + k % 5) || '%' AS magnitude FROM note WHERE {_FULL}"),
    "management_events": _n(f"SELECT entity, 'management_change' AS event_type, DATE '2024-04-01' AS event_date, 'April 2024' AS period, 'month' AS date_precision, 'CEO' AS magnitude, 'Mina Rao' AS person FROM note WHERE {_FULL}"),
    "promoted_events": sql("SELECT source AS entity, CASE edge_type WHEN 'acquired' THEN 'acquisition' ELSE 'jv' END AS event_type, valid_from AS event_date, json_extract_string(properties, '$.year') AS period, CASE WHEN CAST(valid_from AS VARCHAR) LIKE '%-01-01' THEN 'year' ELSE 'month' END AS date_precision, target AS counterparty FROM edge WHERE edge_type IN ('acquired', 'jv_with')"),
    "edition_co_mentions": _n(f"SELECT least(x.entity, y.entity) AS source, greatest(x.entity, y.entity) AS target, 'Tales ' || (x.k % 4) || CASE WHEN x.k % 4 < 3 THEN ' (Edition #' || (10 + x.k % 4) || ', Q1FY27)' ELSE '' END AS edition, CASE WHEN x.k % 4 < 3 THEN (10 + x.k % 4)::INTEGER END AS edition_number FROM note x JOIN note y ON x.k % 4 = y.k % 4 AND x.k < y.k WHERE x.k % 19 <> 0 AND y.k % 19 <> 0"),
    "cited_in": _n("SELECT entity AS source, 'ed_' || (k % 5) AS target, 'cited_in' AS edge_type, k % 3 AS n_quotes FROM note WHERE k % 6 <> 0 AND k % 17 <> 0"),
    "citation_counts": _n("SELECT count(*) FILTER (k % 6 = 0) AS skipped_reports, count(*) FILTER (k % 6 <> 0 AND k % 17 = 0) AS unknown_id FROM note"),
    "synced_tags": _n("SELECT entity AS entity_name, unnest(list_distinct(['entity_type/company', 'sector/' || CASE WHEN k % 6 = 0 THEN nation ELSE lower(nation) END, 'market_cap/mid_cap', CASE WHEN k % 4 = 0 THEN 'geography/mars' ELSE 'market_cap/mid_cap' END])) AS tag FROM note UNION ALL SELECT 'kept', 'sector/x'"),
    "synced_sectors": _n("SELECT entity AS name, CASE WHEN k % 6 = 0 THEN nation ELSE 'Nation' || replace(nation, 'NATION_', '') END AS sector FROM note"),
    "sector_roster": sql("SELECT sector, sum(length(name) + 4)::BIGINT + count(*) - 1 AS n FROM entity WHERE kind = 'company' AND sector IS NOT NULL GROUP BY sector"),
    "resolved_editions": "WITH r AS (SELECT DISTINCT s_suppkey % 30 AS j, 'Tales of Harbour ' || (s_suppkey % 30) || CASE WHEN s_suppkey % 3 = 0 THEN ', Edition #4' ELSE '' END AS ref FROM supplier) SELECT ref, 'Editions/E_' || lpad((CASE WHEN j < 10 OR j < 20 AND j % 3 > 0 THEN j ELSE j // 10 END)::VARCHAR, 2, '0') || '.md' AS path FROM r",
    "company_headings": f"WITH {_FIRMS} SELECT 'ed_' || k AS id, 1 AS line, name FROM firm",
    "relation_sections": f"WITH {_FIRMS} SELECT 'ed_' || k AS id, name, 1 AS line, 7 AS lines FROM firm",
    "relations_told": f"{_SAID} SELECT source, target, edge_type, valid_from, \"symmetric\", edition FROM edges",
    "relations_unresolved": f"{_SAID} SELECT kind AS edge_type, name AS source, other AS target_mention, 'ed_' || k AS edition FROM said WHERE other NOT IN (SELECT name FROM firm) UNION ALL SELECT 'competes_with', name, 'Unknown Rival', 'ed_' || k FROM firm",
    "relations_applied": f"{_SAID}, {_KEPT} SELECT source, target, edge_type FROM old UNION SELECT source, target, edge_type FROM good",
    "relations_counts": f"{_SAID}, {_KEPT} SELECT (SELECT count(*) FROM (SELECT source, target, edge_type FROM good EXCEPT SELECT source, target, edge_type FROM old)) AS inserted, (SELECT count(*) FROM kept) - (SELECT count(*) FROM good) AS skipped_fk, (SELECT count(*) FROM edges) - (SELECT count(*) FROM kept) AS skipped_suppressed",
    "same_group_told": f"WITH {_FIRMS} SELECT least(x.name, y.name) AS source, greatest(x.name, y.name) AS target, 'Circle ' || (x.k % 7) AS \"group\" FROM firm x JOIN firm y ON x.k % 7 = y.k % 7 AND x.k < y.k",
    "guessed_sector": "SELECT p_partkey AS id, CASE WHEN t LIKE '%ring%' THEN 'Rings' WHEN t LIKE '%widget%' OR t LIKE '%gear%' THEN 'Tools' WHEN t LIKE '%small%' THEN 'Small' ELSE 'Diversified' END AS sector FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)",
    "link_prediction_reader": sql(f"SELECT entity, 'common' AS method, 'co_mentioned_in' AS edge_types, max(score) AS best_score, count(*)::INTEGER AS n, arg_min(other, {{'s': -score, 'o': other}}) AS first FROM (SELECT lo::VARCHAR AS entity, hi::VARCHAR AS other, score FROM sc UNION ALL SELECT hi::VARCHAR, lo::VARCHAR, score FROM sc) GROUP BY entity").replace(" SELECT entity, 'common'", f", {_COMMON} SELECT entity, 'common'", 1),
    "component_reader": sql("SELECT component AS label, count(*) AS size, min(node::VARCHAR) AS first FROM lp WHERE it = 16 GROUP BY component").replace(" SELECT component AS label", ", w AS (SELECT src AS a, dst AS b FROM part_edge UNION ALL SELECT dst, src FROM part_edge UNION ALL SELECT src, src FROM part_edge UNION ALL SELECT dst, dst FROM part_edge), lp AS (SELECT DISTINCT a AS node, 0 AS it, a AS component FROM w UNION ALL SELECT w.a, any_value(it) + 1, min(component) FROM lp JOIN w ON lp.node = w.b WHERE it < 16 GROUP BY w.a) SELECT component AS label", 1),
    "fresh_suggestions": sql("SELECT lo, hi, score FROM sc WHERE score >= 2 AND NOT ((lo + hi) % 2 = 0 AND lo % 3 <> 0)").replace(" SELECT lo, hi, score FROM sc", f", {_COMMON} SELECT lo, hi, score FROM sc", 1),
    "graph_hygiene": sql(f"""SELECT (SELECT count(*) FROM people WHERE kind = 'company' AND name NOT IN (SELECT source FROM faulty WHERE edge_type = 'part_of')) AS orphan_companies, (SELECT count(*) FROM people WHERE kind = 'company' AND ticker IS NULL) AS no_ticker,
      (SELECT count(*) FROM faulty WHERE source = target) AS self_loops, (SELECT count(*) FROM faulty WHERE source NOT IN (SELECT name FROM people) OR target NOT IN (SELECT name FROM people)) AS orphan_edges, 1::BIGINT AS conflicting_market_cap""").replace(" SELECT (SELECT count(*) FROM people", f", {_FAULTY} SELECT (SELECT count(*) FROM people", 1),
    "integrity_faults": sql(f"""SELECT 'relations_unknown_type' AS "check", 'error' AS severity, count(*) AS count FROM faulty WHERE edge_type IN ('odd', 'zz_with')
      UNION ALL SELECT 'relations_self_loop', 'error', count(*) FROM faulty WHERE source = target
      UNION ALL SELECT 'relations_orphan_end', 'error', count(*) FROM faulty WHERE source NOT IN (SELECT name FROM people) OR target NOT IN (SELECT name FROM people)
      UNION ALL SELECT 'relations_wrong_kind', 'error', count(*) FROM faulty e LEFT JOIN people s ON s.name = e.source LEFT JOIN people t ON t.name = e.target WHERE {_KINDS}
      UNION ALL SELECT 'relations_no_has_company', 'error', count(*) FROM faulty e WHERE edge_type = 'part_of' AND NOT EXISTS (SELECT 1 FROM faulty i WHERE i.edge_type = 'has_company' AND i.source = e.target AND i.target = e.source)
      UNION ALL SELECT 'relations_no_part_of', 'error', count(*) FROM faulty e WHERE edge_type = 'has_company' AND NOT EXISTS (SELECT 1 FROM faulty i WHERE i.edge_type = 'part_of' AND i.source = e.target AND i.target = e.source)
      UNION ALL SELECT 'relations_both_directions', 'error', count(*) FROM faulty e WHERE source < target AND EXISTS (SELECT 1 FROM faulty i WHERE i.edge_type = e.edge_type AND i.source = e.target AND i.target = e.source)
      UNION ALL SELECT 'relations_json', 'error', count(*) FROM faulty WHERE NOT json_valid(properties)
      UNION ALL SELECT 'entity_tags', 'error', 1
      UNION ALL SELECT 'market_cap_conflicts', 'error', 1
      UNION ALL SELECT 'orphan_companies', 'error', count(*) FROM people WHERE kind = 'company' AND name NOT IN (SELECT source FROM faulty WHERE edge_type = 'part_of')
      UNION ALL SELECT 'hierarchy_orphans', 'error', count(*) FROM people WHERE kind = 'sector' AND name NOT IN (SELECT source FROM faulty WHERE edge_type = 'belongs_to')
      UNION ALL SELECT 'hierarchy_several_parents', 'error', count(*) FROM (SELECT source FROM faulty WHERE edge_type = 'belongs_to' GROUP BY source HAVING count(DISTINCT target) > 1)
      UNION ALL SELECT 'hierarchy_sub_sector_orphans', 'error', 1
      UNION ALL SELECT 'hierarchy_super_sector_orphans', 'error', count(*) FROM people WHERE kind = 'super_sector' AND name NOT IN (SELECT target FROM faulty WHERE edge_type = 'belongs_to')
      UNION ALL SELECT 'hierarchy_cycles', 'error', 2
      UNION ALL SELECT 'duplicate_tickers', 'error', count(*) FROM (SELECT ticker FROM people WHERE ticker IS NOT NULL GROUP BY ticker HAVING count(*) > 1)
      UNION ALL SELECT 'fuzzy_duplicates', 'warning', 1
      UNION ALL SELECT 'validity_window', 'warning', count(*) FROM faulty WHERE edge_type IN ('acquired', 'subsidiary_of') AND valid_from IS NULL""").replace(" SELECT 'relations_unknown_type'", f", {_FAULTY} SELECT 'relations_unknown_type'", 1),
    "largest_sectors": sql("SELECT * FROM (SELECT 'top' AS side, source AS sector, count(*) AS n FROM edge WHERE edge_type = 'has_company' GROUP BY source ORDER BY n DESC, sector LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom', source AS sector, count(*) AS n FROM edge WHERE edge_type = 'has_company' GROUP BY source ORDER BY n, sector LIMIT 5)"),
    "sector_bundles": sql("""SELECT entity, kind, part, item, n FROM (
      SELECT DISTINCT source AS entity, 'member' AS part, target AS item, 1::BIGINT AS n FROM edge WHERE edge_type = 'has_company'
      UNION ALL SELECT DISTINCT target, 'member', source, 1 FROM edge WHERE edge_type = 'exposed_to'
      UNION ALL SELECT DISTINCT target, 'child', source, 1 FROM edge WHERE edge_type = 'belongs_to'
      UNION ALL SELECT DISTINCT source, 'parent', target, 1 FROM edge WHERE edge_type = 'belongs_to'
      UNION ALL SELECT entity, 'market_cap', coalesce(market_cap, 'unknown'), count(*) FROM (SELECT DISTINCT source AS entity, target AS item FROM edge WHERE edge_type = 'has_company' UNION SELECT DISTINCT target, source FROM edge WHERE edge_type = 'exposed_to') LEFT JOIN entity n ON n.name = item GROUP BY 1, 3
      ) JOIN entity e ON e.name = entity WHERE kind IN ('sector', 'theme', 'super_sector', 'sub_sector')"""),
    "cloud_types": sql("SELECT edge_type, count(*) AS n, CASE WHEN edge_type IN ('competes_with', 'jv_with', 'same_group', 'co_mentioned_in') THEN 'symmetric' WHEN edge_type IN ('part_of', 'has_company', 'belongs_to', 'exposed_to') THEN 'membership' WHEN edge_type IN ('odd', 'zz_with') THEN 'unknown' ELSE 'directed' END AS semantics FROM faulty GROUP BY edge_type").replace(" SELECT edge_type, count(*)", f", {_FAULTY} SELECT edge_type, count(*)", 1),
    "path_or_name": "SELECT 'Supplier#000000001' AS query, 'Supplier#000000001' AS name UNION ALL SELECT 'vault/2.md', (SELECT s_name FROM supplier WHERE s_suppkey = 2) UNION ALL SELECT 'none', NULL",
    "search_page": f"WITH {_TOK}, {_BM} SELECT id, source AS doc_type, lang AS title, round(score, 6) AS score, (SELECT count(*) FROM bm) AS total FROM bm JOIN documents ON doc_id = id ORDER BY round(score, 6) DESC, id LIMIT 10 OFFSET 5",
    "edition_companies": f"SELECT 'C' || lpad(x.id::VARCHAR, 6, '0') AS company, round({_SIM}, 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id = 7 AND x.id >= 50 AND {_SIM} > 0 ORDER BY sim DESC, company LIMIT 10",
    "notes_like_entity": f"SELECT x.id, round({_SIM}, 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id = 11 AND x.id <> 11 AND x.label IN (1, 2, 3) AND {_SIM} > 0 ORDER BY sim DESC, x.id LIMIT 10",
    "entity_match": f"SELECT query, arg_max(id, {{'s': sim, 'i': -id}}) AS id, max(sim) AS sim FROM (SELECT q.id AS query, x.id, round(list_inner_product(x.v, q.v), 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id % 50 = 0 AND x.id % 50 <> 0) WHERE sim >= 0.1 GROUP BY query",
}
