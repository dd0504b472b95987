"""Time, patterns, text, stores and checks on small inputs; queries against SQL."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.operators import extract, integrity, patterns, reports, resolve, search, store, temporal, vector

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROOT = "/root/testdata/sf0.001"


def test_as_of_shapes():
    n = temporal.normalise_as_of
    assert (n("2020"), n("2020-03"), n("2020-03-04"), n(" "), n(None)) == ("2020-01-01", "2020-03-01", "2020-03-04", None, None)
    for bad in ("20", "2020-1", "2020-01-01-01", "x"):
        with pytest.raises(ValueError):
            n(bad)


EDGES = "source string, target string, edge_type string, weight double, valid_from date, valid_to date, properties string"


def edges(spark, rows):
    df = spark.createDataFrame([(*r[:3], 1.0, *(r[3:5] if len(r) > 4 else (None, None)), r[5] if len(r) > 5 else None) for r in rows], EDGES.replace("date", "string"))
    return df.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})


def test_validity_ends_count(spark):
    e = edges(spark, [("a", "b", "acquired", "2020-01-01", "2020-12-31"), ("a", "c", "acquired", None, None)])
    hits = lambda d: {r.target for r in e.where(temporal.valid_at(d)).collect()}
    assert hits("2020") == hits("2020-12-31") == {"b", "c"} and hits("2019-12-31") == hits("2021") == {"c"} and hits(None) == {"b", "c"}


def test_suppliers_and_customers(spark):
    e = edges(spark, [("a", "b", "supplier_to"), ("b", "a", "customer_of"), ("c", "a", "supplier_to")])
    got = {tuple(r) for r in patterns.suppliers_and_customers(e).collect()}
    assert got == {("b", "supplier", "a"), ("a", "customer", "b"), ("a", "supplier", "c"), ("c", "customer", "a")}


def test_bridges_drop_unknown_sectors(spark):
    e = edges(spark, [("a", "S", "part_of"), ("b", "T", "part_of"), ("a", "b", "jv_with"), ("a", "x", "jv_with"), ("a", "a2", "acquired"), ("a2", "S", "part_of")])
    assert [tuple(r) for r in patterns.cross_sector_bridges(e).collect()] == [("jv_with", "S", "T", 1)]


def test_context_pack(spark):
    e = edges(spark, [("a", "b", "jv_with"), ("a", "S", "part_of"), ("c", "d", "acquired"), ("a", "z", "co_mentioned_in")])
    facts = patterns.top_facts(e, spark.createDataFrame([("a",)], "name string"), 2)
    text, size = patterns.context_pack(facts, "a")
    assert text.splitlines()[2:] == ["- a jv_with b", "- a part_of S"] and size == -(-len(text) // 4)


def test_store_is_idempotent(spark):
    t = spark.createDataFrame([("a", "b", "jv_with", 1.0)], "source string, target string, edge_type string, weight double")
    new = spark.createDataFrame([("a", "b", "jv_with", 2.0), ("a", "c", "jv_with", 1.0), ("a", "c", "jv_with", 3.0), ("d", "d", "jv_with", 1.0)], t.schema)
    once = store.insert_or_ignore(t, new)
    assert sorted(tuple(r) for r in once.collect()) == [("a", "b", "jv_with", 1.0), ("a", "c", "jv_with", 1.0)]
    assert sorted(store.insert_or_ignore(once, new).collect()) == sorted(once.collect())
    assert store.dry_run(t, new) == 3


def test_replace_prefix_keeps_equal_rows(spark):
    t = spark.createDataFrame([(1, "x", "p:1"), (2, "x", "p:1"), (3, "y", "p:1"), (4, "z", "q:1"), (5, "n", None)], "id long, v string, source_ref string")
    new = spark.createDataFrame([(10, "x", "p:1"), (11, "w", "p:1")], t.schema)
    got = sorted(tuple(r) for r in store.replace_prefix(t, new, "p:", ["v", "source_ref"]).collect())
    assert got == [(1, "x", "p:1"), (4, "z", "q:1"), (5, "n", None), (11, "w", "p:1")]


def test_snapshot(spark, tmp_path):
    e = edges(spark, [("a", "b", "jv_with"), ("a", "S", "part_of")])
    reports.write_snapshot({"edge": e}, str(tmp_path))
    assert [tuple(r) for r in reports.verify_snapshot({"edge": e}, str(tmp_path)).collect()] == [("edge", 2, 2)]
    back = reports.restore_snapshot(spark, str(tmp_path), {"edge": e.schema})["edge"]
    assert sorted(back.select("source", "target").collect()) == sorted(e.select("source", "target").collect())


def test_checks_find_faults(spark):
    e = edges(spark, [("a", "S", "part_of"), ("a", "a", "jv_with"), ("x", "a", "odd"), ("a", "b", "jv_with"), ("b", "a", "jv_with")])
    names = spark.createDataFrame([("a", "company", None, None, "T"), ("b", "company", None, None, "T"), ("S", "theme", None, None, None)], "name string, kind string, sector string, market_cap string, ticker string")
    tags = spark.createDataFrame([("a", "market_cap/large"), ("a", "market_cap/small"), ("gone", "t/x")], "entity_name string, tag string")
    got = {r.check: r["count"] for r in integrity.all_checks(e, names, tags).collect()}
    assert got["relations_self_loop"] == 1 and got["relations_unknown_type"] == 1 and got["relations_orphan_end"] == 1 and got["relations_wrong_kind"] == 1
    assert got["relations_no_has_company"] == 1 and got["relations_both_directions"] == 1 and got["market_cap_conflicts"] == 1 and got["entity_tags"] == 1
    assert got["orphan_companies"] == 1 and got["duplicate_tickers"] == 1
    facts = spark.createDataFrame([("a", "jv", "{"), ("z", "odd", None)], "entity string, event_type string, properties string")
    got = {r.check: r["count"] for r in integrity.events(facts, names).collect()}
    assert got == {"events_orphans": 1, "events_json": 1, "events_types": 1}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [0.0, 1.0], "b"), (4, [-1.0, 0.0], None), (5, [1.0], "b"), (6, [0.0, 0.0], "b")], "id long, v array<double>, label string")
    assert [r.id for r in vector.nearest(rows, 1, 5).collect()] == [2] and vector.nearest(rows, 1, -1).count() == 0
    assert [r.id for r in vector.nearest(rows, 2, 5, other_label=True).collect()] == [3]
    assert [(r.a, r.b) for r in vector.near_pairs(rows.where("id <> 5"), 0.99).collect()] == [(1, 2)]
    v = vector.pseudo_vector("x", 20)
    assert len(v) == 20 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == vector.pseudo_vector("x", 20) != vector.pseudo_vector("y", 20)
    with pytest.raises(ValueError):
        vector.pseudo_vector("x", 0)
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, text string")
    first = vector.embedded(docs, vector.embedder(4))
    again = vector.embedded(docs, vector.embedder(4), first.select("text_hash", "model", "v").distinct())
    assert sorted((r.id, r.v) for r in first.collect()) == sorted((r.id, r.v) for r in again.collect())


def test_search(spark):
    docs = spark.createDataFrame([(1, "cat dog dog"), (2, "cat"), (3, None), (4, "Dog, CAT!")], "id long, text string")
    assert {r.id for r in search.bm25(docs, ["cat", "dog"]).collect()} == {1, 4}
    with pytest.raises(ValueError):
        search.bm25(docs, [])
    assert docs.where("id = 4").select(search.snippet(F.col("text"), "cat")).first()[0] == "Dog, <mark>CAT</mark>!"


def test_names(spark):
    q = spark.createDataFrame([("Acme Steel Ltd",), ("acme steel",), ("Steel Works Group",), ("Akme Steal",), ("nothing",)], "query string")
    n = spark.createDataFrame([("Acme Steel", 1), ("Big Steel Works", 2)], "name string, place int")
    got = {r.query: (r.name, r.stage) for r in resolve.staged_match(q, n).collect()}
    assert got["acme steel"] == ("Acme Steel", 1) and got["Acme Steel Ltd"] == ("Acme Steel", 2) and got["Steel Works Group"] == ("Big Steel Works", 3) and got["Akme Steal"] == ("Acme Steel", 4) and got["nothing"] == (None, None)
    assert resolve.folded("Édition #4 — Été") == "edition 4 ete"
    once = q.select(resolve.normalised_name(F.col("query")).alias("n"))
    assert once.collect() == once.select(resolve.normalised_name(F.col("n")).alias("n")).collect()


def test_extraction(spark):
    assert extract.quotes_of('x\n"We will grow this business a lot, every year.\nAnd more."\n- Jane Doe, CEO\n') == [("We will grow this business a lot, every year. And more.", "Jane Doe", "CEO")]
    assert extract.figures_of("Revenue grew 12.5% to ₹1,200 crore; capex of 3-4 bn")[0] == ("revenue", "12.5%", 12.5, "%")
    got = extract.relations_of("In 2021 it acquired Beta Works. A joint venture with Gamma Co. Providing 40% of Delta Motors.")
    assert [(k, m) for k, m, *_ in got] == [("acquired", "Beta Works"), ("jv_with", "Gamma Co"), ("supplier_to", "Delta Motors")] and got[0][3] == 2021
    assert extract.front_matter("---\ntitle: 'A b'\ntags:\n  - x/y\n  - z\n---\nbody") == ({"title": "A b", "tags": ["x/y", "z"]}, "body")
    docs = spark.createDataFrame([(1, "# A\ntext\n## B c"), (2, None)], "id long, text string")
    assert [(r.line, r.level, r.title) for r in extract.headings(docs).collect()] == [(1, 1, "A"), (3, 2, "B c")]
    assert extract.quotes(docs).count() == extract.figures(docs).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It was acquired by Beta Works in 2021.", [("acquired", "Beta Works", "reverse")]),
        ("It acquired Ashok Leyland and acquired Customers.", [("acquired", "Ashok Leyland", "forward")]),
        ("Demerged from Alpha Ltd. Later merged with Beta Ltd.", [("acquired", "Alpha Ltd", "reverse"), ("acquired", "Beta Ltd", "reverse")]),
        ("In partnership with Gamma Co, a tie-up with Delta Co; strategic alliance with Eta Co.", [("jv_with", x, "symmetric") for x in ("Gamma Co", "Delta Co", "Eta Co")]),
        ("The parent company of Theta Foods. Its listed subsidiary is Iota Labs.", [("subsidiary_of", "Theta Foods", "reverse"), ("subsidiary_of", "Iota Labs", "reverse")]),
        ("A key supplier of brake parts to Kappa Motors, supplier for Bank of Baroda, supplier to OEMs.", [("supplier_to", "Kappa Motors", "forward"), ("supplier_to", "Bank of Baroda", "forward")]),
        ("It supplied wheel rims to Lambda Cars. Won Mu Rail contract. Vendor to Nu Steel.", [("supplier_to", x, "forward") for x in ("Lambda Cars", "Mu Rail", "Nu Steel")]),
        ("It sources from Xi Mines.", [("supplier_to", "Xi Mines", "reverse")]),
        ("Major customers are Pi Oil, Rho Gas and Tau Air. Key customers (IOCL 1.5 MMSCMD, BPCL 0.8 MMSCMD) grew.", [("customer_of", x, "forward") for x in ("IOCL", "BPCL", "Pi Oil", "Rho Gas", "Tau Air")]),
        ("It has peers like Tata Motors, Ashok Leyland, and Eicher Motors which grew. It competes with Chinese imports.", [("competes_with", x, "symmetric") for x in ("Tata Motors", "Ashok Leyland", "Eicher Motors")]),
        ("It was grouped with peers such as Pace Digitek.", []),
    ],
)
def test_relation_patterns(text, want):
    assert [(k, m, role) for k, m, _, _, role in extract.relations_of(text)] == want


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")
@pytest.mark.parametrize("name", ["ego_bundle_as_of", "neighbors_all", "facts_topk", "entities_filtered_page", "resolve_nocase", "clustering", "lp_jaccard", "knn_ip", "rrf_hybrid", "fuzzy_duplicate_names", "stable_prefix_replace", "integrity_all", "coverage", "cycles_len4"])
def test_queries_equal_sql(spark, name):
    from tools_compare import compare

    assert compare(spark, ROOT, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
