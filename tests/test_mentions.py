"""Notes, names, events, relations, readers and builds on small inputs."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analytics, community, editions, events, mentions, metrics, paths, resolve, search, store, validators, vector
from quillgraph.plans import staged
from quillgraph.plans.model import SOURCES, Model
from quillgraph.sources import heads

NOTE = """---
title: Acme
type: company
ticker: null
tags:
- sector/Tools
- sector/tools
generated:
  by: tool
  at: 2024-01-02T00:00:00Z
verified:
- by: human:ann
sources:
- id: e1
  resource: /E/e1.md
  last_modified: '2024-02-03'
- id: e2
---
# Acme

Two lines that say something.
And more of it here.
"""


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_heads():
    h = heads.head_of(NOTE)
    assert h["names"] == ["title", "type", "ticker", "tags", "generated", "verified", "sources"] and h["fault"] is None
    assert h["fields"] == {"title": "Acme", "type": "company", "ticker": None} and h["tags"] == ["sector/Tools", "sector/tools"]
    assert h["sources"] == [{"id": "e1", "resource": "/E/e1.md", "title": None, "last_modified": "2024-02-03"}, {"id": "e2", "resource": None, "title": None, "last_modified": None}]
    assert h["generated"] == {"by": "tool", "at": "2024-01-02T00:00:00Z"} and h["verified"] == ["human:ann"] and h["body"].startswith("# Acme")
    assert [heads.head_of(x)["fault"] for x in (None, "", "no block", "---\n---\nx", "---\n  - a\n---\n")] == ["no_block"] * 3 + ["empty_block", "invalid"]
    assert heads.head_of("---\ntags: one\n---\n")["tags_fault"]


def test_validators(spark):
    rows = [("v/Tools/Acme.md", "company", NOTE), ("v/Tools/B__c.md", "company", "no block at all"), ("v/Tools/d.md", "sector", "---\ntitle: \"D\"\ntype: sector\ncreated: 2024-01-01\nodd: 1\nnormalized_name: d\n---\n\n"), ("v/Tools/e.md", None, None)]
    notes = heads.parsed(frame(spark, rows, "path string, doc_type string, text string"))
    got = {(r.path.rsplit("/", 1)[-1], r.check, r.detail) for r in validators.all_notes(notes, frame(spark, [("Acme",), ("d",)], "normalized_name string"), ["Tools"]).collect()}
    assert {("Acme.md", "tag_format", "sector/Tools"), ("Acme.md", "name_sync", "missing"), ("Acme.md", "listed_missing", ""), ("Acme.md", "missing_field", "market_cap"), ("Acme.md", "sector_tag_case", "sector/Tools")} <= got
    assert {("B__c.md", "filename_format", "double_underscore"), ("B__c.md", "yaml_structure", "no_block"), ("B__c.md", "orphan_note", "B__c"), ("e.md", "yaml_structure", "no_block")} <= got
    assert {("d.md", "title_quoted", '"D"'), ("d.md", "date_unquoted", "created"), ("d.md", "unexpected_fields", "odd"), ("d.md", "content_minimal", "nothing")} <= got
    assert not any(p == "d.md" and c == "name_sync" for p, c, _ in got)
    days = {r.path: r.stale_after for r in validators.stale_after(notes, "2024-01-01").collect()}
    assert days["v/Tools/Acme.md"] == "2024-08-01" and days["v/Tools/d.md"] == "2024-06-29"
    assert validators.all_notes(notes.limit(0), frame(spark, [], "normalized_name string")).count() == 0


def test_alike_headings():
    assert validators.alike(["Strategic Initiatives", "Strategic Initiatives Plan", "Two Wheelers", "Four Wheelers", "On Growth", "Growth", "x"]) == []
    assert validators.alike(["Order Book Growth", "Order Books Growth", "ORDER BOOK GROWTH"]) == [("Order Book Growth", "Order Books Growth"), ("Order Books Growth", "ORDER BOOK GROWTH")]


def test_days(spark):
    texts = [("bought in Dec 2025 and 2019", "2025-12-01"), ("in Q4 FY26 results", "2026-01-01"), ("Q1FY27", "2026-04-01"), ("in 2017, 2031, 2022 and 2020", "2020-01-01"), ("Source: Yahoo 2021 data\nno year", None), ("last year", None), ("Sept. 2024", "2024-09-01")]
    got = frame(spark, texts, "t string, want string").select("want", events.day_of(F.col("t"), 2026).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_events(spark):
    body = "Target of 10-12% growth in FY27.\nWe target 10-12% growth in FY27 and say so at more length.\nFY25 revenue was 5%.\nRavi Rao appointed CEO in May 2024. Appointed Actuary and Director stays.\n\n"
    notes = frame(spark, [("A", "e", body), ("B", "e", None)], "entity string, edition string, body string")
    g = events.guidance(notes, 2026).collect()
    assert [(r.period, r.magnitude, r.source_quote[:9]) for r in g] == [("FY27", "10-12%", "We target")]
    m = events.management(notes, 2026).collect()
    assert [(r.magnitude, r.event_date, r.date_precision) for r in m] == [("CEO", datetime.date(2024, 5, 1), "month")]


def test_sections_and_headings(spark):
    text = "intro\n# Banks\n## Acme Limited | Mid Cap | Tools\nline\n## Jane Roe, Managing Director\nsaid\n## [Concall]\nmore\n## Beta Small Cap Pharma\nend"
    assert mentions.sections_of(text) == [("Acme", 3, "line\n## Jane Roe, Managing Director\nsaid\n## [Concall]\nmore"), ("Beta", 9, "end")]
    assert mentions.sections_of(None) == mentions.sections_of("## no cap") == []
    got = mentions.company_headings(frame(spark, [("d", text), ("n", None)], "id string, text string")).collect()
    assert sorted((r.line, r.name) for r in got) == [(3, "Acme"), (9, "Beta")]


def test_resolved_mentions(spark):
    names = [(n, i) for i, n in enumerate(["Tata Consultancy Services", "BlackRock", "Power Grid Corporation of India", "AB Volvo", "Vedanta", "Bharat Steel Works", "Steel Bank"])]
    asked = {"TCS": "Tata Consultancy Services", "the Volvo Group": "AB Volvo", "vedanta ltd": "Vedanta", "VEDANTA.": "Vedanta", "blackrock inc": "BlackRock", "Power Grid": "Power Grid Corporation of India", "Power Grid India": "Power Grid Corporation of India", "Bharat Steel": "Bharat Steel Works", "Steel": None, "Bank Steel": None, "Unknown": None}
    got = resolve.resolved_mentions(frame(spark, [(x,) for x in asked], "mention string"), frame(spark, names, "name string, place long"), {"tcs": "Tata Consultancy Services", "volvo": "AB Volvo", "gone": "Not There"})
    found = {r.mention: r.name for r in got.collect()}
    assert {k: found.get(k) for k in asked} == asked


def test_overlap_and_stages(spark):
    names = frame(spark, [("UTI Asset Management", 0), ("Power Grid Corporation of India", 1), ("Infosys", 2), ("Jio Financial Services", 3)], "name string, place long")
    q = frame(spark, [("Aditya Asset Management",), ("Power Grid Corporation",), ("Infosys Limited",), ("infosys",), ("JFS",), ("Infosis",), (" ",)], "query string")
    got = {r.query: (r.name, r.stage) for r in resolve.staged_match(q, names, {"JFS": "Jio Financial Services", "UTI": "UTI Asset Management"}).collect()}
    assert got["Aditya Asset Management"][0] is None and got["Power Grid Corporation"] == ("Power Grid Corporation of India", 3)
    assert got["Infosys Limited"] == ("Infosys", 2) and got["infosys"] == ("Infosys", 1) and got["JFS"] == ("Jio Financial Services", 2) and got["Infosis"] == ("Infosys", 4) and got[" "][0] is None
    kinds = resolve.classified(frame(spark, [("INFOSYS", 3), ("Infosys", 1), ("Power Grid Corporation", 2), ("Zeta", 4)], "name string, line int"), names)
    assert {(r.name, r.line, r.kind) for r in kinds.collect()} == {("Infosys", 1, "existing"), ("Power Grid Corporation", 2, "uncertain"), ("Zeta", 4, "new")}


def test_relations_applied_twice(spark, tmp_path):
    docs = frame(spark, [("ed", "## Acme Limited | Mid Cap | x\nAcme acquired Beta in 2021. It acquired Acme too. A joint venture with Aaron Works. It acquired Nobody Known."), ("none", None)], "id string, text string")
    names = frame(spark, [("Acme", 0), ("Beta", 1), ("Aaron Works", 2)], "name string, place long")
    edges, open_ = mentions.edges_told(docs, names)
    got = {(r.source, r.target, r.edge_type, str(r.valid_from), r.symmetric) for r in edges.collect()}
    assert got == {("Acme", "Beta", "acquired", "2021-01-01", False), ("Aaron Works", "Acme", "jv_with", "None", True)}
    assert [(r.source, r.target_mention) for r in open_.collect()] == [("Acme", "Nobody Known")]
    table = edges.select("source", "target", "edge_type").limit(0)
    once, n = mentions.applied(table, edges, names)
    again, m = mentions.applied(once, edges, names)
    assert tuple(n.first()) == (2, 0, 0) and tuple(m.first()) == (0, 0, 0) and again.count() == 2
    lines = f"{tmp_path}/open"
    key = ["source", "target_mention"]
    assert mentions.append_lines(open_, lines, key).count() == 1 and mentions.append_lines(open_, lines, key).count() == 0 and spark.read.json(lines).count() == 1


def test_editions(spark):
    body = "## The Ledger — Acme, Beta & More.\nx\n*Source: The Ledger — Acme, Beta & More (Edition #17, Q2FY25)*\n## The Ledger - Edition #9 (May 2, 2025)\n"
    notes = frame(spark, [("B", body), ("A", "## The Ledger — Acme, Beta & More\n"), ("C", None)], "entity string, body string")
    got = {(r.edition, r.entity) for r in editions.editions_of(notes, "The Ledger").collect()}
    assert got == {("Acme, Beta & More (Edition #17, Q2FY25)", "A"), ("Acme, Beta & More (Edition #17, Q2FY25)", "B"), ("Edition #9 (May 2, 2025)", "B")}
    pairs = editions.co_mentions(notes, "The Ledger").collect()
    assert [(r.source, r.target, r.edition_number) for r in pairs] == [("A", "B", 17)]
    assert editions.resolved_editions(frame(spark, [("Éclair tales, Edition #3",), ("nothing like it",)], "ref string"), editions.edition_index(frame(spark, [("E/x.md", "Series: Eclair Tales")], "path string, title string")), "Series").collect()[0].path == "E/x.md"


def test_stems():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope formative form formalize formal electrical electr goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt probate probat rate rate cease ceas controll control roll roll".split()
    assert [search.stem(w) for w in pairs[::2]] == pairs[1::2]


def test_search_pages_and_snippets(spark):
    docs = frame(spark, [(i, "a" if i % 2 else "b", f"t{i}", "running shoes and " * (i + 1) + "x" * i) for i in range(6)] + [(9, "a", "t", None)], "id long, doc_type string, title string, text string")
    page = search.search_page(docs, "shoes, AND", 2, 1, "a").collect()
    assert len(page) == 2 and all(r.total == 3 and r.doc_type == "a" for r in page)
    with pytest.raises(ValueError):
        search.search_page(docs, " -- ")
    assert search.snippet_of("one two three four five", ["FOUR"], 3) == "… two three <mark>four</mark> …"
    assert {r.term for r in search.stemmed_postings(docs).collect()} >= {"run", "shoe"}
    assert search.with_snippets(search.search_page(docs, "shoes", 1), docs, ["shoes"]).first().snippet.count("<mark>") >= 1


def test_vectors_of_texts_and_stores(spark):
    v = vector.pseudo_vector("abc", 384)
    assert vector.pseudo_vector("abc", 8) != vector.pseudo_vector("abc", 8, 1) and abs(sum(x * x for x in v) - 1) < 1e-12
    import hashlib
    import math
    import struct

    raw = hashlib.sha256(b"42:abc").digest()
    raw += hashlib.sha256(raw).digest()
    raw += hashlib.sha256(raw).digest()
    want = [math.tanh(x / 2**31) for x in struct.unpack("<24i", raw)]
    assert all(abs(a / v[0] - b / want[0]) < 1e-9 for a, b in zip(v, want))
    rows = frame(spark, [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [1.0, 0.1], 2)], "id long, v array<double>, label int")
    assert [r.id for r in vector.like_text(rows, "x", lambda s: s.map(lambda _: [1.0, 0.0]), 5, least=0.5).collect()] == [1, 3]
    table = frame(spark, [("a", [1.0], "m"), ("b", [2.0], "m")], "name string, v array<double>, model string")
    new = frame(spark, [("b", [3.0]), ("c", [4.0])], "name string, v array<double>")
    living = frame(spark, [("b",), ("c",)], "name string")
    assert {(r.name, r.v[0]) for r in vector.populated(table, new, "m", living).collect()} == {("b", 3.0), ("c", 4.0)}
    with pytest.raises(ValueError):
        vector.populated(table, new, "other", living)


def test_near_pairs_in_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(90)] + [(100, [0.0] * 4, 1), (101, None, 1), (102, [1.0], 1)]
    df = frame(spark, rows, "id long, v array<double>, label int")
    got = {(x.a, x.b) for x in vector.near_pairs(df, 0.8, "label", block=10).collect()}
    cos = lambda a, b: sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5
    assert got == {(a, b) for a, u, g in rows[:90] for b, v, h in rows[:90] if a < b and g == h and cos(u, v) >= 0.8}


def test_move_sector_leaves_other_rows(spark):
    e = frame(spark, [("c", "S", "part_of"), ("S", "c", "has_company"), ("x", "y", "jv_with"), ("x", "y", "jv_with")], "source string, target string, edge_type string")
    out, people = store.move_sector(e, "c", "T", frame(spark, [("c", "S"), ("d", "S")], "name string, sector string"))
    want = sorted([("c", "T", "part_of"), ("T", "c", "has_company"), ("x", "y", "jv_with"), ("x", "y", "jv_with")])
    assert sorted(map(tuple, out.collect())) == want and sorted(map(tuple, people.collect())) == [("c", "T"), ("d", "S")]
    assert sorted(map(tuple, store.move_sector(out, "c", "T").collect())) == want
    new = store.move_sector(e, "d", "T")
    assert ("d", "T", "part_of") in set(map(tuple, new.collect())) and new.count() == 6


def random_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})


def modularity(edges, label):
    m, d = len(edges), {}
    for a, b in edges:
        d[a], d[b] = d.get(a, 0) + 1, d.get(b, 0) + 1
    total = {}
    for v, k in d.items():
        total[label[v]] = total.get(label[v], 0) + k
    return sum(label[a] == label[b] for a, b in edges) / m - sum((t / 2 / m) ** 2 for t in total.values())


def test_louvain_by_joins_and_in_memory(spark):
    blocks = [(10 * k + a, 10 * k + b) for k in range(4) for a in range(8) for b in range(a)] + [(0, 10), (11, 20), (21, 30), (31, 1)]
    g = metrics.simple(frame(spark, blocks, "src long, dst long"))
    for small in (0, 100_000):
        got = {r.node: r.label for r in community.louvain(g, small=small).collect()}
        assert len({got[10 * k + a] for k in range(4) for a in range(8)}) == 4 and all(len({got[10 * k + a] for a in range(8)}) == 1 for k in range(4))
    edges = random_edges(4, 60, 110)
    for small in (0, 100_000):
        got = {r.node: r.label for r in community.louvain(frame(spark, edges, "src long, dst long"), small=small).collect()}
        assert modularity(edges, got) > 0.4


def test_voterank_by_brute_force(spark):
    for seed in (1, 2):
        edges = random_edges(seed, 40, 70)
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        power, less, want = dict.fromkeys(near, 1.0), len(near) / sum(map(len, near.values())), []
        while True:
            votes = {v: round(sum(power[u] for u in near[v]), 9) for v in near if v not in want}
            best = max(votes, key=lambda v: (votes[v], -v), default=None)
            if best is None or votes[best] <= 0:
                break
            want.append(best)
            power[best] = 0.0
            for u in near[best]:
                power[u] = max(0.0, power[u] - less)
        df = frame(spark, edges, "src long, dst long")
        assert community.voterank(df) == want and community.voterank(df, 3) == want[:3]
        if seed == 1:
            assert community.voterank(df, small=0) == want


def test_preferential_top_by_brute_force(spark):
    for edges in (random_edges(3, 25, 60), [(0, i) for i in range(1, 30)]):
        d = {}
        for a, b in edges:
            d[a], d[b] = d.get(a, 0) + 1, d.get(b, 0) + 1
        want = sorted(((-d[a] * d[b], a, b) for a in d for b in d if a < b and (a, b) not in edges))[:12]
        got = metrics.preferential_top(frame(spark, edges, "src long, dst long"), 12).collect()
        assert [(-r.score, r.lo, r.hi) for r in got] == want


def test_simple_paths(spark):
    walk = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (1, 4)]
    df = frame(spark, walk + [(b, a) for a, b in walk], "a long, b long")
    got = [(tuple(r.path), r.depth) for r in paths.simple_paths(df, 0, 4, 4).collect()]
    assert got == [((0, 1, 4), 2), ((0, 3, 4), 2), ((0, 1, 2, 3, 4), 4), ((0, 3, 2, 1, 4), 4)]
    assert paths.simple_paths(df, 0, 4, 1).count() == 0


def test_readers(spark):
    table = frame(spark, [("A", "pagerank", '{"value": 0.5}'), ("B", "pagerank", '{"value": "x"}'), ("C", "link_prediction", "bad"), ("A", "link_prediction", '{"method": "j", "edge_types": ["t"], "candidates": [{"name": "B", "score": 0.25}, {"name": "C", "score": 1}]}'), ("A", "voterank", '{"seeds": ["A"]}'), ("B", "voterank", '{"seeds": ["B", "A"]}'), ("C", "voterank", "[]")], "entity_name string, metric string, value string")
    assert [(r.entity, r.best_score, len(r.candidates)) for r in analytics.links(table).collect()] == [("A", 1.0, 2)]
    assert [r.name for r in sorted(analytics.seeds(table).collect())] == ["B", "A"]
    assert [tuple(r) for r in analytics.of_entity(table, "pagerank", "a").collect()] == [("A", 0.5)] and analytics.of_entity(table, "pagerank", "B").count() == 0
    times = lambda n, c: frame(spark, [(datetime.datetime(2024, 1, n),)], f"{c} timestamp")
    assert analytics.stale(times(2, "last_updated"), times(1, "computed_at")).first().stale and not analytics.stale(times(1, "last_updated"), times(2, "computed_at")).first().stale


def test_builds_are_reused(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    model = Model(spark, root)
    n = model.edges.count()
    of = staged.fingerprint(spark, root, SOURCES)
    folder = f"{staged.shared_folder(spark)}/quillgraph-build-{of}"
    assert staged.is_warm(spark, folder, of) and not staged.is_warm(spark, folder, "other")
    files = model.edges.inputFiles()
    assert Model(spark, root).edges.inputFiles() == files and all("edge_type=" in f for f in files)
    made = []
    tables = staged.staged(spark, root, SOURCES, {"t": lambda: made.append(1) or spark.range(3).toDF("x")}, name="try")
    again = staged.staged(spark, root, SOURCES, {"t": lambda: made.append(1) or spark.range(4).toDF("x")}, name="try")
    fresh = staged.staged(spark, root, SOURCES, {"t": lambda: made.append(1) or spark.range(5).toDF("x")}, name="try", rebuild=True)
    assert tables["t"].schema == again["t"].schema and len(made) == 2 and fresh["t"].count() == 5
    assert staged.dropped_builds(spark, "try") == 1 and Model(spark, root).edges.count() == n


def test_rebuilt_tables(spark):
    from pyspark.sql import types as T

    table = frame(spark, [("a", "1", "x"), ("a", "1", "x"), ("b", None, "y")], "name string, n string, gone string")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType(), False), T.StructField("new", T.DateType())])
    got = store.rebuilt(table, schema, ["name"])
    assert got.columns == ["n", "name", "new"] and sorted(map(str, got.collect())) == ["Row(n=1, name='a', new=None)", "Row(n=None, name='b', new=None)"]
    with pytest.raises(ValueError):
        store.rebuilt(frame(spark, [("a", "x", "")], "name string, n string, gone string"), schema, ["name"])


def test_restored_snapshot_checks_references(spark, tmp_path):
    from quillgraph.operators import reports

    tables = {"entity": frame(spark, [("a",), ("b",)], "name string"), "tag": frame(spark, [("a", "t"), ("c", "t")], "owner string, tag string")}
    reports.write_snapshot(tables, f"{tmp_path}/s")
    schemas = {n: t.schema for n, t in tables.items()}
    assert '"table": "entity"' in reports.exported_schema(tables, ["entity"])
    with pytest.raises(ValueError, match="tag.owner"):
        reports.restore_snapshot(spark, f"{tmp_path}/s", schemas, [("tag", "owner", "entity", "name")], f"{tmp_path}/live")
    for _ in range(2):  # the second takes the place of the first
        got = reports.restore_snapshot(spark, f"{tmp_path}/s", schemas, [], f"{tmp_path}/live")
    assert got["tag"].count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["live", "s"]
