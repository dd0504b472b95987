"""A corpus from raw documents to training batches, in four stages.

Each stage is a function of (spark, docs, sf_dir); its rows are written as
Parquet and read back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import langid, minhash, mixing, packing
from quillgraph.llm.shared import dropped, n_words, written
from quillgraph.session import importable

#: Below this share of agreement a text is in none of the learned languages;
#: documents of these languages reach 0.37 and more, mixed ones included.
LEAST_SCORE = 0.2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in no learned language.

    Null, empty and letterless texts go; a text of any length is judged whole; a
    null ``lang`` or ``doc_id`` is judged like any other but not learned from.
    Repeated rows are judged alike; without any label all rows go; an empty table
    stays empty; further columns, whatever their names, pass through.
    """
    seen = docs.where(~langid.held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    names = tuple("_" * max(map(len, docs.columns)) + x for x in ("lang", "score"))  # names that no column has
    got = langid.predicted(docs, langid.fit(seen), names=names)
    return got.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8
    or more) the document with the smallest identifier, once: of several rows of
    one identifier the least in the order of all columns.  Rows without an
    identifier stay, and so do null, empty and wordless texts, which resemble
    nothing.  Texts of any length are compared whole; an empty table stays empty;
    further columns, whatever their names, pass through.
    """
    kept = minhash.near_duplicates(docs, size=5, percent=80).where("kept")
    rows = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = written(several, "repeated")
    once = rows.join(several, "doc_id", "left_anti").select(docs.columns)
    least = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("least"))
    return once.unionByName(least.select("least.*")).unionByName(docs.where("doc_id is null"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: rows repeat, or go.

    Null and empty texts have no words and cost nothing: they come as often as
    whole uses of their source do, or once more.  A null source is a source of
    its own; null identifiers and repeated rows are each taken by themselves;
    texts of any length stay whole; an empty table stays empty; further columns,
    whatever their names, pass through.
    """
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("words"), "source")
    got, _ = mixing.mixed(rows, F.col("words"), F.array("source"))
    got = got.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return got.select("row.*")


def into_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents, with their texts, into length buckets and batches of
    a token budget: adds length, bucket, bucket_length, batch and slot.

    Null and empty texts have length 0; a text longer than the budget is a batch
    of its own; null identifiers and repeated rows have seats of their own; an
    empty table stays empty; a column of a name that is added gives way to it.
    """
    return packing.packed(docs, n_words(F.col("text")))


STAGES = [
    ("language ID", by_language),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", to_target_weights),
    ("packing", into_batches),
]

#: Language profiles, MinHash components and the dealing of batches are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table is deleted once the next one is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    importable(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if held is not None:
            dropped(held)
        held = docs
    return docs
