"""Rows are told apart in as many tasks as their number asks for."""

from __future__ import annotations

from quillgraph.operators import patterns, reports, rounds


def test_spread_by_rows(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert rounds.spread(df, "k", rows=50).rdd.getNumPartitions() == 20
    assert rounds.spread(df, "k", rows=50).distinct().count() == 1000
    assert rounds.spread(df, "k", rows=1000) is df


def test_neighbours_and_coverage_of_spread_rows(spark, monkeypatch):
    old = rounds.spread
    for module in (patterns, reports):
        monkeypatch.setattr(module, "spread", lambda df, *c: old(df, *c, rows=2))
    rows = [("a", "b", "t"), ("a", "b", "t"), ("a", "a", "t"), ("b", "a", "u"), (None, "a", "t")]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string").selectExpr("*", "cast(null as date) valid_from", "cast(null as date) valid_to")
    got = sorted((str(x.entity), x.direction, str(x.other), x.label) for x in patterns.neighbours(e).collect())
    want = {(str(s), "out", str(t), k) for s, t, k in rows} | {(str(t), "in", str(s), k) for s, t, k in rows}
    assert got == sorted(want)
    e = spark.createDataFrame([(s, t, "exposed_to", 1.0) for s, t in ("ax", "ay", "bx", "bx", "cx")], "source string, target string, edge_type string, weight double")
    n = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2")], "name string, sector string")
    got = {(x.theme, x.sector): (x.companies, x.mentions) for x in reports.coverage(e, n).collect()}
    assert got == {("x", "s1"): (2, 3.0), ("x", "s2"): (1, 1.0), ("x", None): (3, 4.0), ("y", "s1"): (1, 1.0), ("y", None): (1, 1.0)}


def test_embedder_gets_few_texts_at_once(spark):
    from quillgraph.operators import vector

    def embed(texts):
        if len(texts) > 500:
            raise ValueError("too many texts")
        return texts.map(lambda t: [float(len(t))])

    docs = spark.range(1800).coalesce(1).selectExpr("id", "concat('t', id) AS text")
    got = {x.id: x.v for x in vector.embedded(docs, embed).collect()}
    assert len(got) == 1800 and got[7] == [2.0] and got[1799] == [5.0]
