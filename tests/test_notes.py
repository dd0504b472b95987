"""Notes from files and stored measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import analytics
from quillgraph.sources.notes import scan_notes


def test_notes(spark, tmp_path):
    files = {"Companies/A b.md": "---\ntitle: A\ntags:\n  - sector/x\n---\n# H\nText ![[i.png]] <div>in</div>  here\n", "Other/c.md": "# First\nbody", "images/d.md": "x", "Other/image_map.md": "x", "e.txt": "x"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in scan_notes(spark, str(tmp_path), {"Companies/": "company"}).collect()}
    assert got.keys() == {"Companies/A b.md", "Other/c.md"}
    a, c = got["Companies/A b.md"], got["Other/c.md"]
    assert (a.doc_type, a.title, a.tags, a.body) == ("company", "A", ["sector/x"], "# H Text in here")
    assert (c.doc_type, c.title, c.tags) == ("note", "First", [])


def test_stored_measures(spark):
    v = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "node long, value double")
    table = analytics.stored(v, "degree")
    again = analytics.persisted(table.withColumn("computed_at", F.lit("2020-01-01").cast("timestamp")), analytics.stored(v.where("node < 3").withColumn("value", F.lit(1.0)), "degree"))
    assert again.count() == 3 and again.select("computed_at").distinct().count() == 1
    assert [(r.entity_name, r.value, r.total) for r in analytics.top(again, "degree", 2).collect()] == [("1", 1.0, 3), ("2", 1.0, 3)]
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, label long")
    stored = analytics.stored_communities(labels, spark.createDataFrame([(0.25,)], "value double"))
    assert sorted((r.label, r.size, r.members) for r in analytics.groups(stored).collect()) == [("0", 2, ["1", "2"]), ("1", 1, ["3"])]
