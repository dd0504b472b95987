"""The pipeline on small tables, odd rows included."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = "the and of with tion ing that from ered onth".split()
    text = lambda: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(50))
    texts = [text() for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t), "x", 1) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s1", 1, "x", 1), (101, texts[1] + " more", None, "s0", 1, "x", 1)]  # an exact and a near copy
    rows += [(102, None, "en", "s1", None, "x", 1), (103, "12345", "en", None, 5, "x", 1), (5, texts[5], "en", "s1", 1, "x", 1), (None, text(), "en", "s2", 1, "x", 1), (104, "жук шёл", None, "s3", 7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, repeats int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        ids = {x.doc_id for x in got}
        if name == "language ID":
            assert ids == {*range(40), 100, 101, None} and len(got) == 44
        elif name == "MinHash near-dedup":
            assert ids == {*range(40), None} and len(got) == 41
        if name != "packing":
            assert out.columns == docs.columns and {x.size for x in got} == {"x"}
        if name.startswith("mixing"):
            mixed_well([r.asDict() for r in docs.collect()], [r.asDict() for r in got])
        before, docs = docs, spark.createDataFrame(got, out.schema)
    packed_well([r.asDict() for r in before.collect()], [r.asDict() for r in got])
    assert {(x.bucket, x.batch, x.slot) for x in got} and len({(x.bucket, x.batch, x.slot) for x in got}) == len(got)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed_well(before, after):
    """Words by source near targets found by bisection; no row more than three times."""
    names = sorted({x["source"] for x in before} - {None}) + [None] * any(x["source"] is None for x in before)
    sizes = [sum(n_words(x["text"]) for x in before if x["source"] == n) for n in names]
    total, weights, lo, hi = sum(sizes), [1 + i % 3 for i in range(len(names))], 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, w * mid) for s, w in zip(sizes, weights, strict=True)) < total else (lo, mid)
    for n, s, w in zip(names, sizes, weights, strict=True):
        own = [x for x in before if x["source"] == n]
        taken = sum(n_words(x["text"]) for x in after if x["source"] == n)
        assert abs(taken - min(3 * s, w * hi)) <= max(n_words(x["text"]) for x in own)
    count = lambda rows: Counter(tuple(sorted((k, str(v)) for k, v in x.items())) for x in rows)
    a, b = count(before), count(after)
    assert all(k in a and n <= 3 * a[k] for k, n in b.items())


def packed_well(before, after):
    """The same rows with their texts, in seats of batches within the budget, at the least padding of sixteen buckets."""
    texts = lambda rows: Counter((x["doc_id"], x["text"]) for x in rows)
    assert texts(before) == texts(after)
    for x in after:
        assert x["length"] == n_words(x["text"]) <= x["bucket_length"] and x["slot"] < max(1, 65536 // max(1, x["bucket_length"]))
    lengths = sorted({x["length"] for x in after})
    counts = Counter(x["length"] for x in after)
    best = {0: 0}
    for _ in range(16):
        new = dict(best)
        for j in range(1, len(lengths) + 1):
            new[j] = min([best.get(j, 1 << 60)] + [best[i] + lengths[j - 1] * sum(counts[k] for k in lengths[i:j]) for i in range(j) if i in best])
        best = new
    assert sum(x["bucket_length"] for x in after) == best[len(lengths)]


def test_repeated_identifiers_agree(spark):
    rows = [(1, f"text {i} of one", "en", "s", 1) for i in range(50)] + [(2, None, "en", "s", 1), (2, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a, b = (corpus_pipeline.without_near_duplicates(spark, docs.repartition(k), "").collect() for k in (1, 7))
    assert sorted(map(str, a)) == sorted(map(str, b)) and {(x.doc_id, x.text) for x in a} == {(1, "text 0 of one"), (2, None)}


def test_stages_on_odd_texts(spark):
    """Many lengths, hot sources, repeated rows and a very long text, against brute force."""
    r = random.Random(5)
    rows = [(i, "w " * int(r.paretovariate(0.8) * 3), "en", r.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(300)]
    rows += [(1000, "w " * 70_000, "en", "b", 1), (None, "no name", "en", "a", 1), (None, "no name", "en", "a", 1), (7, "w w", "en", "a", 1), (8, None, "en", "c", 1), (9, " ", None, "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.to_target_weights(spark, docs, "").collect()
    mixed_well([x.asDict() for x in docs.collect()], [x.asDict() for x in mixed])
    packed_well([x.asDict() for x in docs.collect()], [x.asDict() for x in corpus_pipeline.into_batches(spark, docs, "").collect()])


def test_run(spark, tmp_path):
    rows = [(i, f"the and of {i} with words of number {i * 7} from that", "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
