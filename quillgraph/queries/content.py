"""Queries of vectors, search, resolution, extraction, writes, checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import integrity as I
from ..operators import patterns as P
from ..operators import reports as R
from ..operators import resolve as E
from ..operators import search as S
from ..operators import store as W
from ..operators import vector as V
from ..plans.model import Model, sql

WORDS = ["the", "and"]
ALIASES = {"grains": ["license", "rights"], "tin": ["tion", "ment"], "stars": ["***"]}
GUIDANCE = [r"[0-9]", r"(?i)the|de|der"]


def _m(f):
    return lambda spark, root: f(Model(spark, root))


def _rows(m: Model):
    return m.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _docs(m: Model):
    return m.table("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("title"), F.col("source").alias("path"))


def _sims(m: Model):
    q = _rows(m).where("id = 0").select(F.col("v").alias("q"))
    return V.similarities(_rows(m), q).select("id", F.round("sim", 6).alias("sim"))


def _near(m: Model, least: float):
    return V.near_pairs(_rows(m), least, "label").select("a", "b", F.round("sim", 6).alias("sim"))


def _bm25(m: Model):
    return S.bm25(_docs(m), WORDS)


def _hybrid(m: Model):
    # a document's vector is the one of its number; documents beyond have none
    return S.fused(_bm25(m).select("id", F.round("score", 6).alias("score")), _sims(m), 20, 5).select("id", F.round("score", 9).alias("score"))


def _delta(m: Model):
    new = _docs(m).select("id", F.sha2("text", 256).alias("hash"))
    old = new.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 11 == 0, F.lit("old")).otherwise(F.col("hash"))).unionByName(new.select((-F.col("id") - 1).alias("id"), "hash").where("id % 13 = 0"))
    return V.index_delta(old, new)


def _parts(m: Model):
    return m.table("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place")).groupBy("name").agg(F.min("place").alias("place"))


def _asked(m: Model):
    return m.table("part").select(F.concat("p_name", F.lit(" "), "p_type").alias("query")).distinct()


def _names(m: Model):
    some = m.table("part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")).distinct()
    return some.unionByName(m.table("part").select(F.col("p_name").alias("name")).distinct()).distinct().withColumn("ticker", F.lit(None).cast("string"))


def _insert(m: Model):
    old = m.edges.where("edge_type = 'acquired'").select("source", "target", "edge_type", "weight")
    new = m.edges.where("edge_type in ('acquired', 'jv_with')").select("source", "target", "edge_type", (F.col("weight") + 1).alias("weight"))
    return W.insert_or_ignore(old, new.unionByName(new))


def _replace(m: Model):
    old = m.edges.where("edge_type in ('acquired', 'jv_with')").select("source", "target", F.concat(F.lit("derive:"), "edge_type", F.lit(":x")).alias("source_ref"), F.lit("old").alias("made"))
    new = m.edges.where("edge_type = 'acquired' and valid_from >= date '1995-06-01'").select("source", "target", F.lit("derive:acquired:x").alias("source_ref"), F.lit("new").alias("made"))
    more = m.edges.where("edge_type = 'same_group'").select("source", "target", F.lit("derive:acquired:x").alias("source_ref"), F.lit("new").alias("made"))
    return W.replace_prefix(old, new.unionByName(more), "derive:acquired:", ["source", "target", "source_ref"])


def _upsert(m: Model):
    old = m.companies.where("market_cap <> 'micro_cap'").select(F.col("name").alias("entity_name"), F.lit("cap").alias("metric"), F.lit("0").alias("value"), F.lit(1).alias("computed_at"))
    new = m.companies.where("market_cap in ('micro_cap', 'large_cap')").select(F.col("name").alias("entity_name"), F.lit("cap").alias("metric"), F.col("market_cap").alias("value"), F.lit(2).alias("computed_at"))
    return W.upsert(old, new, ["metric", "entity_name"], ["computed_at"])


def _rename(m: Model):
    names = m.table("nation").select(F.col("n_name").alias("old"), F.concat(F.lit("renamed "), "n_name").alias("new")).where("old like '%1%'")
    return W.rename_cascade(m.edges.select("source", "target", "edge_type"), ["source", "target"], names)


def _move(m: Model):
    e = m.edges.where("edge_type in ('part_of', 'has_company')").select("source", "target", "edge_type")
    return W.move_sector(e, "Supplier#000000003", "NATION_9")


def _first_seen(m: Model):
    return m.edges.where("valid_from is not null").groupBy(F.col("source").alias("name")).agg(F.min("valid_from").alias("first"))


def _cache(m: Model):
    kinds = ("part_of", "has_company", "belongs_to", "exposed_to", "jv_with")
    want = {k: m.edges.where(F.col("edge_type") == k) for k in kinds}
    got = {k: v.join(m.entities.select(F.col("name").alias("source")), "source", "left_semi") for k, v in want.items()}
    return I.table_counts(want, got)


def _co_mentions(m: Model):
    return X.pairs_within(m.urgent_lines, "l_orderkey", "l_suppkey")


def _events(m: Model):
    e = m.table("events").select(F.col("user_id").cast("string").alias("entity"), "event_type", F.col("props").alias("properties"))
    names = m.table("customer").select(F.col("c_custkey").cast("string").alias("name"))
    return I.events(e, names)


def _orders(m: Model):
    return m.table("orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy").cast("int").alias("y"), "o_orderpriority", F.round("o_totalprice").cast("long").alias("p"))


def _said(m: Model):
    """Each order as what somebody said, some too short, some without a speaker."""
    quote = F.when(F.col("id") % 5 == 0, F.lit('"Too short."')).otherwise(F.concat(F.lit('"We shipped order '), "id", F.lit(" on time and the\nclient was pleased with it in "), "y", F.lit('."')))
    speaker = F.when(F.col("id") % 3 > 0, F.concat(F.lit("\n\n— Mina Rao "), F.col("id") % 7, F.when(F.col("id") % 2 == 0, F.lit(", Head of Sales")).otherwise(""))).otherwise("")
    return _orders(m).select("id", F.concat(F.lit("# Notes\n"), quote, speaker, F.lit("\n\n\n\n\nMore text.")).alias("text"))


def _told(m: Model):
    """Each order as a relation of one of seven types."""
    k = F.col("id") % 7
    name = F.concat(F.lit("Orbis K"), F.col("id") % 50, F.lit(" Works"))
    text = F.when(k == 0, F.concat(F.lit("The company acquired "), name, F.lit(" in "), F.col("y") + 24, F.lit(".")))
    for i, (before, after) in enumerate([("It is a subsidiary of ", "."), ("It has a joint venture with ", " and a bank."), ("It is a supplier to ", " since long."), ("It was acquired by ", "."), ("It competes with ", "."), ("It sources from ", ".")], 1):
        text = F.when(k == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(text)
    return _orders(m).select("id", text.alias("text"))


def _measured(m: Model):
    """Each order as a figure with a unit and a word for what it is."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Revenue grew to Rs "), F.format_number("p", 0), F.lit(" crore in the year."))).when(F.col("id") % 3 == 1, F.concat(F.lit("The margin was "), F.col("id") % 40, F.lit("%."))).otherwise(F.concat(F.lit("We plan "), F.col("id") % 90 + 5, F.lit("-"), F.col("id") % 90 + 9, F.lit(" MW of capacity.")))
    return _orders(m).select("id", text.alias("text"))


QUERIES = {
    "knn_cosine": _m(lambda m: V.nearest(_rows(m), 3, 10)),
    "knn_ip": _m(lambda m: V.nearest(_rows(m), 3, 10, "ip")),
    "knn_cross_sector": _m(lambda m: V.nearest(_rows(m), 3, 10, other_label=True)),
    "knn_doc_type": _m(lambda m: V.nearest(_rows(m), 3, 10, label="2")),
    "knn_all_vs_query": _m(_sims),
    "near_duplicates": _m(lambda m: _near(m, 0.4)),
    "pseudo_embedding": _m(lambda m: V.embedded(m.table("documents").select(F.col("doc_id").alias("id"), "text"), V.embedder(384)).select("id", "text_hash", "model", F.size("v").alias("dims"), F.transform(F.slice("v", 1, 16), lambda x: F.round(x, 6)).alias("v"))),
    "inverted_index_stats": _m(lambda m: S.index_stats(S.postings(_docs(m)))),
    "bm25": _m(lambda m: _bm25(m).select("id", F.round("score", 6).alias("score"))),
    "rrf_hybrid": _m(_hybrid),
    "doc_scan_score": _m(lambda m: S.scan_scores(_docs(m), ["the", "en"], 25)),
    "incremental_delta": _m(_delta),
    "token_overlap_match": _m(lambda m: E.overlap_match(_asked(m), _parts(m)).select("query", "name", F.round("score", 6).alias("score"))),
    "fuzzy_duplicate_names": _m(lambda m: E.fuzzy_duplicates(_names(m))),
    "normalize_name": _m(lambda m: m.table("part").select(F.concat("p_name", F.lit("  "), F.lower("p_type"), F.lit("-"), "p_brand").alias("name")).distinct().select("name", E.normalised_name(F.col("name")).alias("normalised"))),
    "co_mention_pairs": _m(_co_mentions),
    "group_pairs": _m(lambda m: X.pairs_within(m.entities.where("kind = 'company' and ticker is not null"), "sector", "name")),
    "theme_exposure": _m(lambda m: X.theme_exposure(_docs(m), ALIASES)),
    "guidance_filter_dedup": _m(lambda m: X.picked(_docs(m), GUIDANCE, F.regexp_extract("sentence", r"([0-9]+)", 1))),
    "percent_figures": _m(lambda m: _docs(m).select("id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+\.[0-9]+)"), F.lit(1))).alias("figure")).groupBy("id", "figure").agg(F.count(F.lit(1)).alias("n"))),
    "clean_pages": _m(lambda m: m.table("pages").select("page_id", F.length(X.clean_page(F.col("html"))).alias("n"), F.md5(X.clean_page(F.col("html")).cast("binary")).alias("digest"))),
    "quotes": _m(lambda m: X.quotes(_said(m))),
    "relations": _m(lambda m: X.relations(_told(m)).select("id", "edge_type", "mention", "year", "role")),
    "metrics_full": _m(lambda m: X.figures(_measured(m))),
    "insert_or_ignore": _m(_insert),
    "stable_prefix_replace": _m(_replace),
    "upsert_metric": _m(_upsert),
    "rename_cascade": _m(_rename),
    "move_sector": _m(_move),
    "integrity_all": _m(lambda m: I.all_checks(m.edges, m.entities, P.entity_tags(m.entities))),
    "integrity_events": _m(_events),
    "integrity_cache": _m(_cache),
    "sector_sizes": _m(lambda m: I.sector_sizes(m.edges)),
    "edge_growth": _m(lambda m: R.edge_growth(m.edges)),
    "sector_growth": _m(lambda m: R.sector_growth(m.entities, _first_seen(m))),
    "top_entities": _m(lambda m: R.top_entities(m.edges)),
    "coverage": _m(lambda m: R.coverage(m.edges, m.entities)),
    "snapshot_summary": _m(lambda m: R.summary({"entity": m.entities, "edge": m.edges})),
}
_V = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings"
_SIM = "list_cosine_similarity(x.v, q.v)"
_KNN = f"SELECT x.id, round({{0}}, 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id = 3 AND x.id <> 3 AND {{1}} ORDER BY sim DESC, x.id LIMIT 10"
_TOK = r"tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda t: t <> '')) AS term FROM documents), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda t: t <> '')) AS l FROM documents), st AS (SELECT count(*) AS n, avg(l) AS a FROM len)"
_BM = "bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) AS score FROM post JOIN (SELECT term, count(*) AS df FROM post WHERE term IN ('the', 'and') GROUP BY term) USING (term) JOIN len USING (id), st GROUP BY id HAVING count(*) = 2)"
_OCC = "(length(t) - length(replace(t, '{0}', ''))) // length('{0}')"
_SCORE = " + ".join(f"3 * ({_OCC.format(f' {w} ')}) + 2 * ({_OCC.format(f' {w}')}) + 5 * (contains(lower(lang), '{w}'))::INT + 4 * (contains(lower(source), '{w}'))::INT" for w in ("the", "en"))
_CHECKS = """
SELECT 'relations_unknown_type' AS "check", 'error' AS severity, 0::BIGINT AS count
UNION ALL SELECT 'relations_self_loop', 'error', count(*) FROM edge WHERE source = target
UNION ALL SELECT 'relations_orphan_end', 'error', count(*) FROM edge WHERE source NOT IN (SELECT name FROM entity) OR target NOT IN (SELECT name FROM entity)
UNION ALL SELECT 'relations_wrong_kind', 'error', count(*) FROM edge e JOIN entity s ON s.name = e.source JOIN entity t ON t.name = e.target WHERE (edge_type = 'part_of' AND (s.kind <> 'company' OR t.kind <> 'sector')) OR (edge_type = 'has_company' AND (s.kind <> 'sector' OR t.kind <> 'company')) OR (edge_type = 'exposed_to' AND t.kind <> 'theme')
UNION ALL SELECT 'relations_no_has_company', 'error', count(*) FROM edge e WHERE edge_type = 'part_of' AND NOT EXISTS (SELECT 1 FROM edge i WHERE i.edge_type = 'has_company' AND i.source = e.target AND i.target = e.source)
UNION ALL SELECT 'relations_no_part_of', 'error', count(*) FROM edge e WHERE edge_type = 'has_company' AND NOT EXISTS (SELECT 1 FROM edge i WHERE i.edge_type = 'part_of' AND i.source = e.target AND i.target = e.source)
UNION ALL SELECT 'relations_both_directions', 'error', count(*) FROM edge e WHERE source < target AND EXISTS (SELECT 1 FROM edge i WHERE i.edge_type = e.edge_type AND i.source = e.target AND i.target = e.source)
UNION ALL SELECT 'relations_json', 'error', count(*) FROM edge WHERE NOT json_valid(properties)
UNION ALL SELECT 'hierarchy_sub_sector_orphans', 'error', count(*) FROM entity WHERE kind = 'sub_sector'
UNION ALL SELECT 'hierarchy_super_sector_orphans', 'error', count(*) FROM entity WHERE kind = 'super_sector' AND name NOT IN (SELECT target FROM edge WHERE edge_type = 'belongs_to')
UNION ALL SELECT 'hierarchy_cycles', 'error', count(DISTINCT x.source) FROM edge x JOIN edge y ON x.edge_type = 'belongs_to' AND y.edge_type = 'belongs_to' AND x.target = y.source AND y.target = x.source
UNION ALL SELECT 'fuzzy_duplicates', 'warning', count(*) FROM (SELECT name, string_split(lower(name), ' ') AS w FROM entity WHERE kind = 'company') x, (SELECT name, string_split(lower(name), ' ') AS w FROM entity WHERE kind = 'company') y WHERE x.name < y.name AND (list_has_all(x.w, y.w) OR list_has_all(y.w, x.w))
UNION ALL SELECT 'entity_tags', 'error', 0
UNION ALL SELECT 'market_cap_conflicts', 'error', count(*) FROM (SELECT name FROM entity WHERE kind = 'company' GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'orphan_companies', 'error', count(*) FROM entity WHERE kind = 'company' AND name NOT IN (SELECT source FROM edge WHERE edge_type = 'part_of')
UNION ALL SELECT 'hierarchy_orphans', 'error', count(*) FROM entity WHERE kind = 'sector' AND name NOT IN (SELECT source FROM edge WHERE edge_type = 'belongs_to')
UNION ALL SELECT 'hierarchy_several_parents', 'error', count(*) FROM (SELECT source FROM edge WHERE edge_type = 'belongs_to' GROUP BY source HAVING count(DISTINCT target) > 1)
UNION ALL SELECT 'duplicate_tickers', 'error', count(*) FROM (SELECT ticker FROM entity WHERE ticker IS NOT NULL GROUP BY ticker HAVING count(*) > 1)
UNION ALL SELECT 'validity_window', 'warning', count(*) FROM edge WHERE edge_type IN ('acquired', 'subsidiary_of') AND valid_from IS NULL"""
#: Each block of 32 bytes is the hash of all bytes before; the first of seed and text.
_EMBED = """WITH RECURSIVE grown(text, n, raw) AS (
  SELECT DISTINCT coalesce(text, ''), 1, unhex(sha256('42:' || coalesce(text, ''))) FROM documents
  UNION ALL SELECT text, n + 1, raw || unhex(sha256(raw)) FROM grown WHERE octet_length(raw) < 4 * 384),
whole AS (SELECT text, hex(raw) AS h FROM grown WHERE octet_length(raw) >= 4 * 384),
numbers AS (SELECT text, list_transform(range(384), lambda i: ('0x' || substr(h, i * 8 + 7, 2) || substr(h, i * 8 + 5, 2) || substr(h, i * 8 + 3, 2) || substr(h, i * 8 + 1, 2))::BIGINT) AS u FROM whole),
squashed AS (SELECT text, list_transform(u, lambda x: tanh((x - CASE WHEN x >= 2147483648 THEN 4294967296 ELSE 0 END) / 2147483648.0::DOUBLE)) AS v FROM numbers),
units AS (SELECT text, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM squashed)
SELECT doc_id AS id, sha256(coalesce(d.text, '')) AS text_hash, 'pseudo' AS model, 384 AS dims, list_transform(v[1:16], lambda x: round(x / n, 6)) AS v FROM documents d JOIN units u ON u.text = coalesce(d.text, '')"""
ORACLES = {
    "knn_cosine": _KNN.format(_SIM, f"{_SIM} > 0"),
    "knn_ip": _KNN.format("-list_inner_product(x.v, q.v)", "list_inner_product(x.v, q.v) > 0"),
    "knn_cross_sector": _KNN.format(_SIM, f"{_SIM} > 0 AND x.label <> q.label"),
    "knn_doc_type": _KNN.format(_SIM, f"{_SIM} > 0 AND x.label = 2"),
    "knn_all_vs_query": f"SELECT x.id, round({_SIM}, 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id = 0 AND {_SIM} > 0",
    "near_duplicates": f"SELECT x.id AS a, q.id AS b, round({_SIM}, 6) AS sim FROM ({_V}) x JOIN ({_V}) q ON x.label = q.label AND x.id < q.id WHERE {_SIM} >= 0.4",
    "inverted_index_stats": f"WITH {_TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "bm25": f"WITH {_TOK}, {_BM} SELECT id, round(score, 6) AS score FROM bm",
    "rrf_hybrid": f"WITH {_TOK}, {_BM}, bt AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM bm), vs AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS v FROM (SELECT x.id, round({_SIM}, 6) AS sim FROM ({_V}) x, ({_V}) q WHERE q.id = 0 AND {_SIM} > 0)) SELECT id, round(1.0::DOUBLE / (60 + r) + 1.0::DOUBLE / (60 + coalesce(v, (SELECT count(*) FROM vs) + 1)), 9) AS score FROM bt LEFT JOIN vs USING (id) WHERE r <= 25 ORDER BY score DESC, id LIMIT 20 OFFSET 5",
    "doc_scan_score": f"SELECT * FROM (SELECT doc_id AS id, lang AS title, {_SCORE} AS score FROM (SELECT *, ' ' || lower(text) || ' ' AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, title, id LIMIT 25",
    "incremental_delta": "WITH n AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), o AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'old' ELSE hash END AS hash FROM n WHERE id % 7 <> 0 UNION ALL SELECT -id - 1, hash FROM n WHERE (-id - 1) % 13 = 0) SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash",
    "token_overlap_match": """WITH q AS (SELECT DISTINCT p_name || ' ' || p_type AS query FROM part), n AS (SELECT p_name AS name, min(p_partkey) AS place FROM part GROUP BY 1)
      SELECT query, arg_min(name, place) AS name, 1.0::DOUBLE AS score FROM q JOIN n ON contains(lower(query), lower(name)) OR contains(lower(name), lower(query)) GROUP BY query""",
    "fuzzy_duplicate_names": """WITH n AS (SELECT DISTINCT name, list_distinct(string_split(lower(name), ' ')) AS w FROM (SELECT p_name || ' ' || lower(p_type) AS name FROM part UNION SELECT p_name FROM part))
      SELECT DISTINCT least(s.name, l.name) AS a, greatest(s.name, l.name) AS b FROM n s, n l WHERE s.name <> l.name AND list_has_all(l.w, s.w)""",
    "normalize_name": r"SELECT name, array_to_string(list_transform(list_filter(string_split(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '_') AS normalised FROM (SELECT DISTINCT p_name || '  ' || lower(p_type) || '-' || p_brand AS name FROM part)",
    "co_mention_pairs": sql("SELECT DISTINCT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM urgent x JOIN urgent y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey"),
    "group_pairs": sql("SELECT x.sector, x.name AS a, y.name AS b FROM entity x JOIN entity y ON x.sector = y.sector AND x.name < y.name WHERE x.kind = 'company' AND y.kind = 'company' AND x.ticker IS NOT NULL AND y.ticker IS NOT NULL"),
    "theme_exposure": "SELECT doc_id AS id, theme, string_agg(alias, ',' ORDER BY alias) AS found FROM documents JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS theme, '{a}' AS alias" for t, v in ALIASES.items() for a in v) + ") ON contains(lower(coalesce(text, '')), alias) GROUP BY 1, 2",
    "guidance_filter_dedup": r"""WITH s AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) AS sentence FROM documents)
      SELECT id, "key", sentence FROM (SELECT id, regexp_extract(sentence, '([0-9]+)', 1) AS "key", sentence, row_number() OVER (PARTITION BY id, regexp_extract(sentence, '([0-9]+)', 1) ORDER BY length(sentence) DESC, encode(sentence)) AS k FROM s WHERE regexp_matches(sentence, '[0-9]') AND regexp_matches(sentence, '(?i)the|de|der')) WHERE k = 1""",
    "percent_figures": r"SELECT id, figure, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '([0-9]+\.[0-9]+)', 1)) AS figure FROM documents) GROUP BY 1, 2",
    "clean_pages": r"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)",
    "pseudo_embedding": _EMBED,
    "quotes": "SELECT o_orderkey AS id, 'We shipped order ' || o_orderkey || ' on time and the client was pleased with it in ' || year(o_orderdate) || '.' AS quote, CASE WHEN o_orderkey % 3 > 0 THEN 'Mina Rao ' || (o_orderkey % 7) END AS speaker, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'Head of Sales' END AS title FROM orders WHERE o_orderkey % 5 <> 0",
    "relations": "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'acquired' WHEN 1 THEN 'subsidiary_of' WHEN 2 THEN 'jv_with' WHEN 3 THEN 'supplier_to' WHEN 4 THEN 'acquired' WHEN 5 THEN 'competes_with' ELSE 'supplier_to' END AS edge_type, 'Orbis K' || (o_orderkey % 50) || ' Works' AS mention, CASE WHEN o_orderkey % 7 = 0 THEN (year(o_orderdate) + 24)::INTEGER END AS year, CASE o_orderkey % 7 WHEN 2 THEN 'symmetric' WHEN 5 THEN 'symmetric' WHEN 4 THEN 'reverse' WHEN 6 THEN 'reverse' ELSE 'forward' END AS role FROM orders",
    "metrics_full": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'margin' ELSE 'capacity' END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'Rs ' || format('{:,}', round(o_totalprice)::BIGINT) || ' crore' WHEN 1 THEN (o_orderkey % 40) || '%' ELSE (o_orderkey % 90 + 5) || '-' || (o_orderkey % 90 + 9) || ' MW' END AS raw, CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice) WHEN 1 THEN (o_orderkey % 40)::DOUBLE ELSE (o_orderkey % 90 + 5)::DOUBLE END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'crore' WHEN 1 THEN '%' ELSE 'MW' END AS unit FROM orders",
    "insert_or_ignore": sql("SELECT source, target, edge_type, weight + (edge_type = 'jv_with')::INT AS weight FROM edge WHERE edge_type IN ('acquired', 'jv_with')"),
    "stable_prefix_replace": sql("SELECT source, target, 'derive:jv_with:x' AS source_ref, 'old' AS made FROM edge WHERE edge_type = 'jv_with' UNION ALL SELECT source, target, 'derive:acquired:x', 'old' FROM edge WHERE edge_type = 'acquired' AND valid_from >= DATE '1995-06-01' UNION ALL SELECT source, target, 'derive:acquired:x', 'new' FROM edge WHERE edge_type = 'same_group'"),
    "upsert_metric": sql("SELECT name AS entity_name, 'cap' AS metric, CASE WHEN market_cap IN ('micro_cap', 'large_cap') THEN market_cap ELSE '0' END AS value, CASE WHEN market_cap = 'micro_cap' THEN 2 ELSE 1 END AS computed_at FROM entity WHERE kind = 'company'"),
    "rename_cascade": sql("SELECT CASE WHEN source LIKE 'NATION_%1%' THEN 'renamed ' || source ELSE source END AS source, CASE WHEN target LIKE 'NATION_%1%' THEN 'renamed ' || target ELSE target END AS target, edge_type FROM edge"),
    "move_sector": sql("SELECT CASE WHEN edge_type = 'has_company' AND target = 'Supplier#000000003' THEN 'NATION_9' ELSE source END AS source, CASE WHEN edge_type = 'part_of' AND source = 'Supplier#000000003' THEN 'NATION_9' ELSE target END AS target, edge_type FROM edge WHERE edge_type IN ('part_of', 'has_company')"),
    "integrity_all": sql(_CHECKS),
    "integrity_events": """SELECT 'events_orphans' AS "check", 'error' AS severity, count(*) AS count FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'events_json', 'error', count(*) FROM events WHERE NOT json_valid(props) UNION ALL SELECT 'events_types', 'error', count(*) FROM events WHERE event_type NOT IN ('acquisition', 'jv', 'guidance', 'management_change')""",
    "integrity_cache": " UNION ALL ".join(f"SELECT 'cache_{k}' AS \"check\", 'error' AS severity, 0::BIGINT AS count" for k in ("part_of", "has_company", "belongs_to", "exposed_to", "jv_with")),
    "sector_sizes": sql("SELECT min(n) AS least, list_sort(list(n))[len(list(n)) // 2 + 1] AS median, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT source, count(*) AS n FROM edge WHERE edge_type = 'has_company' GROUP BY source)"),
    "edge_growth": sql("SELECT coalesce(CAST(year(valid_from) AS VARCHAR), 'undated') AS year, edge_type, count(*) AS n FROM edge GROUP BY 1, 2"),
    "sector_growth": sql("SELECT sector, count(*) AS companies, max(y) AS latest, count(*) FILTER (y = (SELECT max(year(valid_from)) FROM edge)) AS new FROM entity LEFT JOIN (SELECT source, year(min(valid_from)) AS y FROM edge WHERE valid_from IS NOT NULL GROUP BY source) ON source = name WHERE kind = 'company' AND sector IS NOT NULL GROUP BY sector"),
    "top_entities": sql("SELECT name, count(*) AS degree, count(*) FILTER (edge_type = 'co_mentioned_in') AS co_mentions, min(year(valid_from)) AS first_year FROM (SELECT source AS name, edge_type, valid_from FROM edge UNION ALL SELECT target, edge_type, valid_from FROM edge) WHERE edge_type NOT IN ('part_of', 'has_company', 'belongs_to', 'exposed_to') GROUP BY name ORDER BY degree DESC, name LIMIT 15"),
    "coverage": sql("SELECT target AS theme, sector, count(DISTINCT source) AS companies, sum(weight) AS mentions FROM edge JOIN entity ON name = source WHERE edge_type = 'exposed_to' GROUP BY GROUPING SETS ((target, sector), (target))"),
    "snapshot_summary": sql("SELECT 'entity' AS name, count(*) AS n FROM entity UNION ALL SELECT 'edge', count(*) FROM edge"),
}
