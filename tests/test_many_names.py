"""Names that share words and sounds with very many others, and large groups."""

from __future__ import annotations

import random
import re

from quillgraph.operators import extract, paths, resolve


def test_overlap_by_sets_of_words_equals_pairs(spark, monkeypatch):
    r = random.Random(1)
    words = "alpha beta gamma delta bank power eps zeta eta theta of ltd".split()
    made = lambda: " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 3, 4, 9])))
    n = spark.createDataFrame([(made(), i) for i in range(60)], "name string, place long")
    q = spark.createDataFrame([(made(),) for _ in range(80)], "query string")
    got = []
    for short in (0, 3, 6):
        monkeypatch.setattr(resolve, "SHORT", short)
        got.append({x.query: (x.name, round(x.score, 9)) for x in resolve.overlap_match(q, n).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) > 40


def test_names_that_sound_alike_meet_only_where_nothing_else_answers(spark, monkeypatch):
    asked = []
    old = resolve.edit_match
    monkeypatch.setattr(resolve, "edit_match", lambda q, n: asked.append(sorted(x["query"] for x in q.collect())) or old(q, n))
    q = spark.createDataFrame([("Orbis K1 Works",), ("Orbus",), ("Nobody",)], "query string")
    n = spark.createDataFrame([("Orbis K2 Works", 0), ("Orbis", 1)], "name string, place long")
    got = {x["query"]: (x.name, x.stage) for x in resolve.staged_match(q, n).collect()}
    assert got == {"Orbis K1 Works": ("Orbis", 3), "Orbus": ("Orbis", 4), "Nobody": (None, None)} and asked == [["Nobody", "Orbus"]]


def directed(spark):
    r = random.Random(1)
    e = sorted({(r.randrange(40), r.randrange(40)) for _ in range(60)})
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
    return spark.createDataFrame([(str(a), str(b)) for a, b in e], "source string, target string"), near


def test_hierarchy_cycles_by_walks(spark):
    df, near = directed(spark)
    for depth in (1, 2, 3, 10):
        want = set()
        for a in near:
            at = {a}
            for _ in range(depth):
                at = {y for x in at for y in near.get(x, ())}
                if a in at:
                    want.add(str(a))
        assert {x.node for x in paths.hierarchy_cycles(df, depth).collect()} == want


def test_short_cycles_end_the_search(spark, monkeypatch):
    df, near = directed(spark)
    want = []

    def go(path, hops):
        for y in near.get(path[-1], ()):
            if y == path[0] and len(path) > 1:
                want.append((str(y), len(path), ">".join(map(str, [*path, y]))))
            elif y not in path and len(path) < hops:
                go([*path, y], hops)

    for a in near:
        go([a], 4)
    want.sort(key=lambda x: (x[1], x[2]))
    tables = []
    old = paths.checkpointed
    monkeypatch.setattr(paths, "checkpointed", lambda x: tables.append(1) or old(x))
    n = sum(x[1] == want[0][1] for x in want)
    for limit in (n, 100):
        tables.clear()
        assert [tuple(x) for x in paths.cycles(df, 4, limit).collect()] == want[:limit]
        assert len(tables) <= 4 and (limit > n or len(tables) == want[0][1])


def test_pairs_within_blocks(spark):
    r = random.Random(2)
    rows = [(f"g{r.randrange(5)}", f"m{r.randrange(60):03}") for _ in range(150)]
    df = spark.createDataFrame([*rows, ("g9", None), (None, "m1")], "grp string, mem string")
    want = sorted({(g, a, b) for g, a in rows for h, b in rows if g == h and a < b})
    once = {}
    for g, a, b in want:
        once.setdefault((a, b), g)
    for block in (2048, 7):
        assert sorted(tuple(x) for x in extract.pairs_within(df, "grp", "mem", block=block).collect()) == want
        got = sorted(tuple(x) for x in extract.pairs_within(df, "grp", "mem", once=True, block=block).collect())
        assert got == sorted((g, a, b) for (a, b), g in once.items())
