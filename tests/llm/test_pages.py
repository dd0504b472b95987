"""Operators on pages and embeddings."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re

import numpy as np
import pytest

from quillgraph.llm import main_text, rp_forest, shared, url_graph, warc

PAGES = "page_id long, url string, html string, k string, host string, payload int, rule int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "h", 1, 2) for r in rows], PAGES)


# ------------------------------------------------------------------- op 4


def test_rules(spark):
    rows = [
        (1, "http://www.Example.com/en/758?x=1", ""), (2, "https://a.com/en/1", ""), (3, "https://example.com/en/", ""), (4, "//com/en/", ""),
        (5, None, None), (6, "http://xcom/en/1", ""), (7, "http://b.net/de#f/de/", ""), (8, "http://m.example.net/de/81", "<a href='//a.com/x'>"),
        (9, "http://c.org?/es/", ""), (10, "http://c.org/es/1", ""), (10, "http://c.org/es/1", ""), (11, "http://h/" + "p" * 200_000, ""),
    ]
    got = {r.page_id: r for r in url_graph.judged(pages(spark, rows)).collect()}
    assert (got[1].rule, got[1].verdict, got[1].host, got[1].path) == ("example.com/en/7", "allow", "www.example.com", "/en/758")
    assert (got[2].rule, got[2].verdict) == ("com/en/", "block") and got[3].rule == "com/en/"
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("", "", None, "allow") == (got[5].host, got[5].path, got[5].rule, got[5].verdict)
    assert got[6].rule is None and got[7].rule is None and got[7].path == "/de"
    assert got[8].rule == "example.net/de/8" and got[9].rule is None and got[10].verdict == "block" and len(got[11].path) == 200_001
    assert url_graph.judged(pages(spark, rows)).count() == len(rows)
    assert url_graph.judged(pages(spark, [])).count() == 0


def test_words_of_the_contracts_rules(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = {rule: word for word, rule in (x.split(" ") for x in contract.split(", "))}
    rows = [(i, f"http://{rule}1", "") for i, rule in enumerate(want)] + [(10 + i, f"http://www.{rule}", "") for i, rule in enumerate(want)]
    got = url_graph.judged(pages(spark, rows)).collect()
    assert len(got) == 10 and {(x.rule, x.verdict) for x in got} == set(want.items())



def rank_by_brute_force(edges, seeds):
    hosts = sorted({x for e in edges for x in e} | set(seeds))
    place = {h: i for i, h in enumerate(hosts)}
    m, out = np.zeros((len(hosts), len(hosts))), {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    for (a, b), n in edges.items():
        m[place[b], place[a]] = 0.85 * n / out[a]
    x = np.linalg.solve(np.eye(len(hosts)) - m, [0.15 * seeds.get(h, 0) for h in hosts])
    return dict(zip(hosts, x.tolist(), strict=True))


def test_rank_by_brute_force(spark):
    r = random.Random(1)
    edges = {(a, b): float(r.randint(1, 3)) for a in "abcdef" for b in "abcdef" if a != b and r.random() < 0.4}
    for edges in (edges, {("a", "b"): 1.0, ("b", "a"): 1.0}):
        seeds = {"a": 0.5, "b": 0.25}
        df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n double")
        got = {x.host: x.score for x in url_graph.personalised(df, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
        want = rank_by_brute_force(edges, seeds)
        assert all(abs(got.get(h, 0) - x) < 1e-11 for h, x in want.items())


LINKS = "page_id long, url string, html string, k string"


def linked_pages(n_hosts, per_host, seed):
    """Pages of hosts that link to each other at random, some of them ruled."""
    r, rows = random.Random(seed), []
    names = [f"h{i}.example.com" if i % 9 == 0 else f"h{i}.com" if i % 5 == 0 else f"h{i}.info" for i in range(n_hosts)]
    for i, name in enumerate(names):
        for k in range(per_host):
            path = r.choice(["/en/7", "/en/1", "/x"])
            to = [names[min(n_hosts - 1, int(r.expovariate(3 / n_hosts)))] for _ in range(r.randint(0, 3))]
            links = "".join(f"<a class='x' data-href='//no.where/' href={r.choice(['', chr(34)])}{r.choice(['http://', '//', 'HTTPS://'])}{t.upper()}/p?q>x</a>" for t in to)
            rows.append((i * per_host + k, f"http://{name}{path}", f"<p>{links}<a href='/local'>y</a>", "k"))
    return rows


def test_verdicts_on_linked_hosts_by_brute_force(spark):
    rows = linked_pages(300, 4, 5)
    host = lambda u: u.split("/")[2]
    edges, good, bad, ruled = {}, {}, {}, {}
    for i, url, html, _ in rows:
        h, path = host(url), "/" + url.split("/", 3)[3]
        ruled[i] = None
        if h.endswith(".com") and path.startswith("/en/"):
            ruled[i] = "allow" if h.endswith(".example.com") and path.startswith("/en/7") else "block"
            seeds = good if ruled[i] == "allow" else bad
            seeds[h] = seeds.get(h, 0) + 1 / len(rows)
        for t in re.findall(r" href=\"?(?:http:|https:|)//([^/]*)/p", html, re.I):
            if t.lower() != h:
                edges[h, t.lower()] = edges.get((h, t.lower()), 0) + 1.0
    trust, distrust = rank_by_brute_force(edges, good), rank_by_brute_force({(b, a): n for (a, b), n in edges.items()}, bad)
    got = url_graph.judged(spark.createDataFrame(rows, LINKS)).collect()
    assert len(got) == len(rows)
    for x in got:
        t, d = trust.get(x.host, 0), distrust.get(x.host, 0)
        assert abs(x.trust - t) < 1e-10 and abs(x.distrust - d) < 1e-10
        assert x.verdict == (ruled[x.page_id] or ("block" if d > t * (1 + 1e-6) else "allow"))
    verdicts = [x.verdict for x in got if x.rule is None]
    assert 20 < verdicts.count("block") < len(verdicts) - 20


def test_url_graph_sql_on_linked_hosts(spark, tmp_path):
    import duckdb

    spark.createDataFrame(linked_pages(60, 3, 6), LINKS).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = url_graph.op4_url_graph(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({url_graph.SQL})").fetchall()
    plain = lambda rows: sorted((*r[:5], f"{r[5]:.8f}", f"{r[6]:.8f}") for r in ((r[0], r[1], r[2], r[3] or "", *r[4:]) for r in map(tuple, rows)))
    assert plain(got.collect()) == plain(want)


def test_distrust_reaches_who_links_to_blocked(spark):
    link = "<a class=x href='http://bad.com/en/1'>"
    rows = [(i, "http://bad.com/en/%d" % i, "") for i in range(8)] + [(20, "http://friend.info/", link), (21, "http://other.info/", "<a href='/local'>"), (22, "http://other.info/2", None)]
    got = {r.page_id: r.verdict for r in url_graph.judged(pages(spark, rows)).collect()}
    assert (got[20], got[21], got[22]) == ("block", "allow", "allow")
    # more trust than distrust: an allowed host links to it as well, or it is on the list
    rows += [(30 + i, "http://example.com/en/7", "<a href=//friend.info/>") for i in range(20)]
    assert {r.page_id: r.verdict for r in url_graph.judged(pages(spark, rows)).collect()}[20] == "allow"
    trusted = ["friend.info"]
    assert {r.page_id: r.verdict for r in url_graph.judged(pages(spark, rows[:11] + [rows[8]] * 40), trusted=trusted).collect()}[20] == "allow"


# ------------------------------------------------------------------- op 6


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (10, "http://c/\r\nX: y", ""), (11, "u", "x" * 1_000_000), (3, "http://b/", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "only")]
    got = warc.archived(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(
        (str(i), len((h or "").encode()), b32(h), kind, str(to)) for (i, _, h), (kind, to) in zip(rows, [("revisit", 3), ("response", None), ("response", None), ("revisit", 9), ("response", None), ("response", None), ("response", None), ("response", None)], strict=True)
    )
    few = {r.page_id: r.record_type for r in warc.archived(pages(spark, rows), 100).collect()}
    assert set(few.values()) == {"response"}
    assert warc.archived(pages(spark, [])).count() == 0


def test_warc_names_and_files(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (3, "u", "a"), (4, "u", "b"), (4, "u", "b"), (None, "u", "c"), (None, "u", "c"), (5, "u", "d"), (5, "u", "d")] + [(10 + i, f"u{i}", "x" * 500 + str(i)) for i in range(40)]
    df = warc.with_originals(pages(spark, rows).selectExpr("page_id", "url", "encode(html, 'utf-8') as payload"))
    tables = warc.write_archives(df.coalesce(1), f"{tmp_path}/w", 4000).collect()
    assert len(tables) > 2 and sum(t.records for t in tables) == len(rows)
    names, refers = [], []
    for t in tables:
        with open(t.uri, "rb") as f:
            for r in warc.Reader(f):
                names.append(r.headers["WARC-Record-ID"])
                if r.kind == "revisit":
                    refers.append((r.headers["X-Refers-To-Page-ID"], r.headers.get("WARC-Refers-To")))
    assert len(set(names)) == len(names) == len(rows) + len(tables)
    assert all(to is None or to in names for _, to in refers) and {p for p, to in refers if to} == {"1"}
    got = warc.read_archives(spark.createDataFrame(tables)).collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in got if r.page_id is None or r.page_id < 10) == sorted(map(str, [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "revisit", 1), (4, "revisit", 1), (None, "response", None), (None, "response", None), (5, "response", None), (5, "response", None)]))


def test_warc_reader_checks(spark, tmp_path):
    one = warc.record_bytes("response", "http://a/", "<urn:uuid:1>", b"hello")
    two = warc.record_bytes("revisit", "http://b/", "<urn:uuid:2>", b"hello")
    got = list(warc.Reader(io.BytesIO(warc.info_bytes("x") + one + two)))
    assert [r.kind for r in got] == ["warcinfo", "response", "revisit"] and got[1].payload == b"hello" and got[2].payload == b"" and got[2].http["Content-Length"] == "5"
    import zlib

    raw = zlib.decompress(one, 31)
    again = lambda b: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + z.flush()
    for bad in (one[:-9], again(raw.replace(b"hello", b"hallo")), again(re.sub(rb"(Content-Type: application/http[^\r]*\r\nContent-Length: )\d+", rb"\g<1>80", raw)), again(b"junk\r\n\r\n")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.Reader(io.BytesIO(bad)))
    rows = warc.with_originals(pages(spark, [(1, "u", "t")]).selectExpr("page_id", "url", "encode(html, 'utf-8') as payload"))
    tables = warc.write_archives(rows, f"{tmp_path}/w")
    assert bytes(warc.read_archives(tables, payloads=True).first().payload) == b"t"


# ------------------------------------------------------------------- op 7


@pytest.fixture(scope="module")
def model():
    return main_text.trained(pages=400, rounds=30)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li><li><a href=3>More</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Caf&eacute; &amp; co</h1><p>First  paragraph,\n with <b>bold</b> words and enough of them to read.<p>Second one &lt;here&gt; has words as well, some more.</p>
<div class="comments"><p>Nice story, I liked it a lot.</p></div></article><footer>&copy; a company</footer></body>"""


def test_main_text(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (4, "u", "<p"), (5, "u", PAGE.replace("First", "word " * 60_000))]
    got = {r.page_id: r for r in main_text.extracted(pages(spark, rows), model).collect()}
    assert got[1].text == "Café & co\n\nFirst paragraph, with bold words and enough of them to read.\n\nSecond one <here> has words as well, some more."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == ""
    assert got[5].n_chars > 250_000
    assert main_text.extracted(pages(spark, []), model).count() == 0


#: Pages written by hand in the manner of common systems, not by the generator; the article's blocks have [[ ]] around them.
BY_HAND = [
    """<!doctype html><html lang="en"><head><title>Blog</title><link rel=stylesheet href=a.css></head><body class="home blog"><div id="page"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p>
    <nav id="site-navigation"><div class="menu-main-container"><ul id="menu-main"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></div></nav></header>
    <div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post-1 post type-post hentry"><h1 class="entry-title">[[A walk along the canal]]</h1>
    <div class="entry-content"><p>[[Last week I went out early and followed the canal from the lock to the mill, which took about two hours.]]</p><p>[[The path was wet, but the herons did not mind.]]</p><blockquote><p>[[Take the old path, said the keeper, and mind the dog.]]</p></blockquote>
    <ul><li>[[Bring boots with good soles.]]</li><li>[[Leave before eight in the morning.]]</li></ul></div></article><div id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><p>I love that place, thank you for sharing this walk with us.</p></li></ol></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget widget_search"><form class="search-form"><label>Search for: <input></label></form></section><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Bread</a></li></ul></section></aside></div>
    <footer id="colophon" class="site-footer"><div class="site-info">Proudly made by hand.</div></footer></div></body></html>""",
    """<html><head><title>News</title></head><body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div><div class="topbar"><a href="/">Politics</a> <a href="/">Sport</a> <a href="/">Culture</a></div>
    <div class="layout"><div class="story-body"><h1>[[Council votes to rebuild the pier]]</h1><p>[[The town council voted on Tuesday night to rebuild the pier, which a storm had damaged in the winter.]]</p>
    <div class="advert">Advertisement: buy two lamps and pay for one of them today.</div><p>[[Work is to begin in May and will cost four million, the mayor said after the meeting.]]</p>
    <figure><img src=p.jpg><figcaption>[[The pier after the storm in January.]]</figcaption></figure><p>[[Shops on the front welcomed the news.]]</p></div>
    <div class="related-stories"><h3>More on this</h3><ul><li><a href="/2">Storm closes three roads</a></li><li><a href="/3">How the pier was built</a></li></ul></div></div><div class="footer">Copyright the paper. All rights reserved.</div></body></html>""",
    """<body><div class="navbar"><a href="index">index</a> | <a href="next">next</a></div><div class="document"><div class="section" id="usage"><h2>[[Usage]]</h2><p>[[Call the function with a path; it returns the number of lines it has read.]]</p><pre>[[count("a.txt")]]</pre>
    <table><tr><td>[[path]]</td><td>[[where the file is]]</td></tr><tr><td>[[limit]]</td><td>[[lines to read, all if left out]]</td></tr></table></div></div><div class="sidebar"><h3>Contents</h3><ul><li><a href="#usage">Usage</a></li></ul></div></body>""",
]


def test_pages_written_by_hand():
    model, tp, fp, fn = main_text.default_model(), 0, 0, 0
    for page in BY_HAND:
        want = re.findall(r"\[\[(.*?)\]\]", page)
        got = main_text.main_texts([page.replace("[[", "").replace("]]", "")], model)[0].split("\n\n")
        tp, fp, fn = tp + len(set(want) & set(got)), fp + len(set(got) - set(want)), fn + len(set(want) - set(got))
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.9


def test_stray_quotes_and_untagged_text():
    model = main_text.default_model()
    words = "first words of a paragraph that goes on for a while"
    for page, want in [
        (f"<article><p title=it's>{words}.</p><p>it's the second</p></article>", f"{words}.\n\nit's the second"),
        (f"<article><p title=\"a>b\" data-x='c\"d>e'>{words}</p></article>", words),
        (f'<article><p title="never closed>{words}</p></article>', words),
        (f'<article><p"">{words}</p></article>', words),
        (f"{words}\n and &amp; more", f"{words} and & more"),
        (f"{words} <b>bold</b> <!-- no --><script>x</script>end", f"{words} bold end"),
        (f"<p>{words}.</p><p>{words} once more.</p>", f"{words}.\n\n{words} once more."),
    ]:
        assert main_text.main_texts([page], model) == [want]


def test_held_out_blocks(model):
    make, tp, fp, fn = main_text._Generator(123), 0, 0, 0
    for _ in range(60):
        page = make.page()
        root = main_text.parse(page)
        nodes = main_text.elements(root)
        label = [False] * len(nodes)
        for i, x in enumerate(nodes):
            label[i] = "data-c" in x.attrs or (i > 0 and x.tag not in main_text.BLOCKS and label[x.parent.place])
        want = set(main_text.blocks_of(root, label))
        got = set(main_text.main_texts([page.replace(" data-c", "")], model)[0].split("\n\n")) - {""}
        tp, fp, fn = tp + len(want & got), fp + len(got - want), fn + len(want - got)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_decoding_is_consistent():
    root = main_text.parse("<div><div><p>a</p><p>b</p><p>c</p></div></div>")
    nodes = main_text.elements(root)
    score = np.array([0, 3, 3, 3, -1, 3.0])
    assert main_text.decoded(nodes, score)[1:] == [True] * 5  # one doubtful element follows its surroundings
    score[4] = -6
    assert main_text.decoded(nodes, score)[1:] == [True, True, True, False, True]


def test_left_open_elements_keep_the_article(spark):
    model = main_text.trained()
    rest = "".join(f"<p>The committee of the harbour town met on day {i} and talked at length about the old bridge, the ferry and its crew.</p>" for i in range(6))
    want = main_text.main_texts([f"<html><head><title>t</title></head><body><article>{rest}</article></body></html>"], model)[0]
    assert want.count("harbour") == 6
    article = f"<article>{rest}</article>"
    pages = [
        f"<html><head><title>t</title><body>{article}</body></html>",
        f"<html><head><title>t</title><meta charset=utf-8>{article}</html>",
        f"<html><head><noscript><style>p{{}}</style></noscript><title>t</title><body>{article}",
        *[f"<html><head><title>t</title></head><body><{t}>{article}</body></html>" for t in ("noscript", "button", "select", "object", "svg", "canvas", "iframe", "video")],
        f"<html><head><title>t</title></head><body><button>{article}<button>OK</button></body></html>",
        f"<html><head><title>t</title></head><body><noscript><div>Enable scripts.</div></noscript>{article}</body></html>",
    ]
    assert main_text.main_texts(pages, model) == [want] * len(pages)
    assert "harbour m=2 town" in main_text.main_texts([f"<article>{rest}<p>The harbour <math><mi>m</mi><mo>=</mo><mn>2</mn></math> town has a long word of prose, and more of it follows.</p></article>"], model)[0]
    assert "".join(main_text.parse("<head><title>t</title>words").children[-1:]) == "words"


# ------------------------------------------------------------------- op 9


def linked(x, ids, least=0.9):
    """Numbers of links and components by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= least
    np.fill_diagonal(links, False)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in np.argwhere(np.triu(links)):
        p, q = root(ids[a]), root(ids[b])
        parent[max(p, q)] = min(p, q)
    return links.sum(axis=1), {i: root(i) for i in ids}


def test_similar_groups(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 16))
    x[50:90] = x[50] + 0.05 * r.standard_normal((40, 16))
    x[100:120] = x[0]  # equal vectors
    short = r.standard_normal((30, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, v.tolist()) for i, v in enumerate(short)]
    rows += [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None] * 8), (904, [math.inf] * 16), (905, [1.0] * 5), (906, []), (None, x[0].tolist()), (907, (x[50] * 1e300).tolist())]
    df = spark.createDataFrame([(*row, 1, 2, b"x") for row in rows], "vec_id long, embedding array<double>, id int, m int, v binary")
    got = {y.vec_id: y for y in rp_forest.similar_groups(df, leaf_size=40).collect()}
    assert len(got) == len(rows)
    ids = [*range(400), 907]
    links, of = linked(np.concatenate([x, x[50:51]]), ids)
    found = sum(got[i].n_links for i in ids)
    assert found <= links.sum() and found >= 0.99 * links.sum()
    assert all(got[i].n_links <= links[k] for k, i in enumerate(ids))
    assert sum(got[i].component_id == of[i] for i in ids) >= 0.99 * len(ids)
    links, of = linked(short, list(range(500, 530)))  # vectors of a rarer length have links of their own
    assert links.sum() > 0 and all((got[i].n_links, got[i].component_id) == (links[i - 500], of[i]) for i in of)
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0
    assert rp_forest.similar_groups(df.limit(0)).count() == 0


def test_recall_of_deep_forest(spark):
    """20,000 vectors in 64 dimensions, groups of copies that reach down to the threshold, leaves of 500."""
    r = np.random.default_rng(3)
    x = r.standard_normal((20_000, 64)).astype(np.float32)
    for k, noise in enumerate(np.repeat([0.1, 0.2, 0.3, 0.33], 100)):
        at = 20 * k
        x[at : at + 8] = x[at] + noise * r.standard_normal((8, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    links, of = linked(x.astype(np.float64), list(range(len(x))))
    got = {y.vec_id: y for y in rp_forest.similar_groups(df, leaf_size=500).collect()}
    assert all(got[i].n_links <= links[i] for i in of)
    assert links.sum() > 10_000 and sum(y.n_links for y in got.values()) >= 0.97 * links.sum()
    assert sum(got[i].component_id == of[i] for i in of) >= 0.999 * len(of)
    assert all(got[i].component_id >= of[i] for i in of)
    # leaves that outgrew the sample are split where they are compared, or dealt into blocks, with the same links
    for more in ({"sample_size": 64}, {"sample_size": 64, "held": 4000}):
        again = rp_forest.similar_groups(df, leaf_size=500, **more).collect()
        assert all(y.n_links <= links[y.vec_id] for y in again) and sum(y.n_links for y in again) >= 0.97 * links.sum()


def test_repeated_identifiers_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.01])]
    got = rp_forest.similar_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((y.vec_id, y.n_links, y.component_id) for y in got) == [(1, 1, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 1), (4, 3, 1)]


def test_blocks_of_a_large_leaf(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal(8) + 0.02 * r.standard_normal((300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for leaf_size, held in ((1000, 128), (20, 128), (20, 1000)):
        got = rp_forest.similar_groups(df, leaf_size=leaf_size, held=held).collect()
        assert all(y.n_links == 299 and y.component_id == 0 for y in got)


def test_threshold_in_double_precision(spark):
    """A cosine of exactly 0.9 links, one just below it does not."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [9.0, math.sqrt(19.0), 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [-0.9, 0.0, -math.sqrt(0.19) - 1e-9])]
    cos = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)) / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))
    got = {y.vec_id: y.n_links for y in rp_forest.similar_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=cos(rows[0][1], rows[1][1])).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.id: x.component for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    assert got == {i: root(i) for e in edges for i in e if e[0] != e[1]}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
