"""Notes and newsletters over order data: a note a supplier, with faults in some.

What is wrong with which note follows from its number, so that SQL can say what
checks and extraction must find without reading any text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model

SERIES = "The Ledger"
STEM = "Supplier_"


def firm(k: Column) -> Column:
    """The name that prose gives to a supplier."""
    return F.concat(F.lit("Orbis K"), k.cast("string"), F.lit(" Works"))


def _base(m: Model) -> DataFrame:
    nation = m.table("nation").select("n_nationkey", "n_name")
    s = m.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    # suppliers are few bytes and one file: their texts are made and read in as many tasks as there are cores
    s = s.repartition(max(1, m.spark.sparkContext.defaultParallelism), "s_suppkey")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.regexp_replace("s_name", "#", "_").alias("stem"))


def notes(m: Model) -> DataFrame:
    """k, path, doc_type, text, entity, edition."""
    k, t = F.col("k"), F.lit
    is_ = lambda n, *r: (k % n).isin(*r)
    cat = lambda *x: F.concat(*[t(c) if isinstance(c, str) else c for c in x])
    name, nation, stem = F.col("name"), F.col("nation"), F.col("stem")
    file = F.when(is_(29, 3), cat(stem, "_")).when(is_(29, 5), cat("Supplier__x", k.cast("string"))).otherwise(stem)
    head = [
        t("---"),
        F.when(~is_(10, 1), cat("title: ", name)),
        F.when(is_(10, 2), t("type: firm")).otherwise(t("type: company")),
        F.when(is_(7, 0), t("ticker: null")).otherwise(cat("ticker: S", k.cast("string"))),
        cat("sector: ", nation),
        F.when(is_(11, 1), t("market_cap: giant_cap")).when(~is_(11, 0), t("market_cap: mid_cap")),
        F.when(is_(12, 0), t("normalized_name: Other")).when(~is_(12, 1), cat("normalized_name: ", stem)),
        F.when(is_(9, 0), t("permalink: /firms/x")).when(is_(9, 1), cat("permalink: /companies/elsewhere/", stem)).otherwise(cat("permalink: /companies/", F.lower(nation), "/", stem)),
        t("created: '2024-05-01'"),
        F.when(is_(8, 0), t("last_modified: '2024-01-01'")).otherwise(t("last_modified: '2024-06-01'")),
        t("tags:\n- entity_type/company"),
        F.when(is_(6, 0), cat("- sector/", nation)).otherwise(cat("- sector/", F.lower(nation))),
        F.when(is_(5, 0), t("- entity_type/company")),
        t("- market_cap/mid_cap"),
        F.when(is_(4, 0), t("- geography/mars")),
        F.when(~is_(3, 0), t("generated:\n  by: tool\n  at: 2024-06-01T00:00:00Z")),
        F.when(is_(3, 1), t("verified:\n- by: human:ann")),
        F.when(is_(2, 0), t("stale_after: 2024-12-01")).otherwise(t("stale_after: 2999-01-01")),
        cat("sources:\n- id: ", F.when(is_(17, 0), t("unknown")).otherwise(cat("ed_", (k % 5).cast("string"))), "\n  resource: ", F.when(is_(6, 0), t("/Reports/r.pdf")).otherwise(cat("/Editions/ed_", (k % 5).cast("string"), ".md")), "\n  title: Tales\n  last_modified: 2024-03-0", (k % 5 + 1).cast("string")),
        t("---"),
        cat("# ", name),
    ]
    body = [
        cat("## ", SERIES, " — Tales ", (k % 4).cast("string")),
        cat("FY27 guidance reiterated at ", (k % 5 + 10).cast("string"), "-", (k % 5 + 12).cast("string"), "% growth."),
        t("Mina Rao takes over as CEO in April 2024."),
        t("### Strategy\nMore lines follow here."),
        F.when(is_(7, 1), t("### Strategy")).when(is_(7, 2), t("### STRATEGY")).when(is_(7, 3), t("### Strategyy")),
        F.when(is_(23, 0), t("---\ntitle: again\n---")),
        F.when(~is_(4, 3), cat("*Source: ", SERIES, " — Tales ", (k % 4).cast("string"), " (Edition #", (k % 4 + 10).cast("string"), ", Q1FY27)*")),
    ]
    text = F.array_join(F.array_compact(F.concat(F.array(*head), F.when(is_(19, 0), F.array().cast("array<string>")).otherwise(F.array(*body)))), "\n")
    path = cat("vault/Companies/", nation, "/", file, ".md")
    return _base(m).select("k", path.alias("path"), t("company").alias("doc_type"), text.alias("text"), firm(k).alias("entity"), path.alias("edition"))


#: The same notes without their texts, for the other engine; goes after the model's views.
NOTES_SQL = """note AS (
  SELECT s_suppkey AS k, s_name AS name, n_name AS nation, replace(s_name, '#', '_') AS stem, 'Orbis K' || s_suppkey || ' Works' AS entity,
         CASE WHEN s_suppkey % 29 = 3 THEN replace(s_name, '#', '_') || '_' WHEN s_suppkey % 29 = 5 THEN 'Supplier__x' || s_suppkey ELSE replace(s_name, '#', '_') END AS file,
         'vault/Companies/' || n_name || '/' || CASE WHEN s_suppkey % 29 = 3 THEN replace(s_name, '#', '_') || '_' WHEN s_suppkey % 29 = 5 THEN 'Supplier__x' || s_suppkey ELSE replace(s_name, '#', '_') END || '.md' AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def newsletters(m: Model) -> DataFrame:
    """k, id, text: one section a document, that tells relations to the next suppliers by number."""
    k = F.col("k")
    to = lambda i: firm(k + i)
    lines = [
        F.concat(F.lit("## "), firm(k), F.lit(" Limited | Mid Cap | Industry")),
        F.concat(F.lit("The company acquired "), to(1), F.lit(" in March 2021.")),
        F.concat(F.lit("It has a joint venture with "), to(2), F.lit(".")),
        F.concat(F.lit("It is a supplier to "), to(3), F.lit(".")),
        F.lit("## Jane Doe, CEO"),
        F.concat(F.lit("We are a subsidiary of "), to(4), F.lit(".")),
        F.lit("It competes with Unknown Rival."),
        F.concat(F.lit("It is part of the Circle "), (k % 7).cast("string"), F.lit(" Group.")),
    ]
    return _base(m).select("k", F.concat(F.lit("ed_"), k.cast("string")).alias("id"), F.array_join(F.array(*lines), "\n").alias("text"))


def firms(m: Model) -> DataFrame:
    """name, place of all suppliers by the names that prose gives them."""
    return _base(m).select(firm(F.col("k")).alias("name"), F.col("k").alias("place"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
