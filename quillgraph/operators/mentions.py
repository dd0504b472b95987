"""From newsletters and notes to edges: sections, resolved names, and their writing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import day_of
from .extract import pairs_within, relations_of
from .resolve import resolved_mentions
from .rounds import checkpointed
from .store import EDGE_KEY, insert_or_ignore

# Marks of company headings, endings that names are cut from, and titles of speakers.
CAP = r"(?i)\b(?:large|larg|mid|small|micro|nano|mega)\s*cap\b"
_CAP = re.compile(CAP)
_HEADING = re.compile(r"^\s{0,3}#{1,3}\s+(.+?)\s*$")
_ENDING = re.compile(r"\s+(Limited|Ltd\.?|Private|Pvt\.?)$", re.I)
_SPEAKER = re.compile(r"\b(managing director|chief executive|ceo|cfo|coo|cto|cio|md|director|chairman|president|head of|founder|co-founder)\b", re.I)
GROUP = r"\bpart\s+of\s+(?:the\s+)?([A-Z][A-Za-z0-9&.\-\s]{2,50}?)\s+Group\b"
GROUP_ENDINGS = r"(?i)\s+(?:Corp(?:oration)?|Group|Holdings|Industries)$"
SYMMETRIC = ("jv_with", "competes_with", "same_group", "co_mentioned_in")


def heading_name(line: str, chrome: frozenset[str] = frozenset()) -> tuple[str, bool] | None:
    """The name in a heading, and whether it starts a company's section: one with a
    pipe or a word of market capitalisation does; speakers and page furniture are none."""
    m = _HEADING.match(line)
    if m is None:
        return None
    text = m[1]
    name = text.split("|")[0].split("·")[0]
    if (cut := _CAP.search(name)) is not None:
        name = name[: cut.start()]
    name = _ENDING.sub("", name.strip().rstrip("-·").strip()).strip().strip("[]")
    if len(name) < 3 or not re.match(r"[A-Z0-9]", name) or name.lower() in chrome or "," in name and _SPEAKER.search(name):
        return None
    return name, bool(re.search(r"\s\|\s", text) or _CAP.search(text))


def sections_of(text: str | None, chrome: frozenset[str] = frozenset()) -> list[tuple[str, int, str]]:
    """(name, line of the heading, body) of company sections; a body goes on to the
    next company heading, sub-headings and speakers included."""
    out: list[tuple[str, int, list[str]]] = []
    for i, line in enumerate((text or "").split("\n"), 1):
        got = heading_name(line, chrome)
        if got is not None and got[1]:
            out.append((got[0], i, []))
        elif out:
            out[-1][2].append(line)
    return [(name, i, "\n".join(body)) for name, i, body in out]


def sections(docs: DataFrame, chrome: frozenset[str] = frozenset()) -> DataFrame:
    """id, name, line, body of (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["id"], b["text"], strict=True) for x in sections_of(t, chrome)]
            yield pd.DataFrame(rows, columns=["id", "name", "line", "body"])

    return docs.select("id", "text").mapInPandas(run, "id string, name string, line int, body string")


def company_headings(docs: DataFrame, sector_words: tuple[str, ...] = ()) -> DataFrame:
    """id, line, name of (id, text): headings of up to three # with a pipe or a word of
    market capitalisation, cut at it, without a legal ending; three characters or more."""
    lines = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "l"))
    raw = F.trim(F.regexp_extract("l", r"^#{1,3}\s+(.+?)\s*$", 1))
    got = lines.withColumn("raw", raw).where((F.col("raw") != "") & (F.col("raw").contains("|") | F.col("raw").rlike(CAP)))
    name = F.trim(F.regexp_replace(F.element_at(F.split("raw", r"\|"), 1), CAP + r".*$", ""))
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"(?i)(\s+(limited|ltd\.?|private|pvt\.?))+$", ""))
    words = F.lower(name).isin(*sector_words) if sector_words else F.lit(False)
    return got.select("id", (F.col("i") + 1).alias("line"), name.alias("name")).where((F.length("name") >= 3) & ~words)


def told(parts: DataFrame) -> DataFrame:
    """id, company, edge_type, mention, quote, role of (id, company, body): what the
    sections of known companies tell, names as they are written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, c, kind, mention, quote, role) for i, c, t in zip(b["id"], b["company"], b["body"], strict=True) for kind, mention, quote, _, role in relations_of(t)]
            yield pd.DataFrame(rows, columns=["id", "company", "edge_type", "mention", "quote", "role"])

    return parts.select("id", "company", "body").mapInPandas(run, "id string, company string, edge_type string, mention string, quote string, role string")


def edges_told(docs: DataFrame, names: DataFrame, aliases: dict[str, str] | None = None, this_year: int = 2026, ref: str = "derive:relations") -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, edge_type, valid_from, symmetric, quote, edition, source_ref)
    that newsletters (id, text) tell, and what stayed unresolved (edge_type, source,
    target_mention, quote, edition).

    Sections whose company is not among ``names`` (name, place) tell nothing.  A
    name that is the company itself gives no edge; ends of symmetric types are
    ordered; of one edge in a document the one with the least quote is kept; only
    acquisitions take a date from their quote.
    """
    parts = checkpointed(sections(docs))
    of = resolved_mentions(parts.select(F.col("name").alias("mention")).distinct(), names, aliases)
    parts = parts.join(of.select(F.col("name").alias("company"), F.col("mention").alias("name")), "name").select("id", "company", "body")
    said = checkpointed(told(parts))
    got = checkpointed(resolved_mentions(said.select("mention").distinct(), names, aliases).withColumnRenamed("name", "other"))
    both = said.join(got, "mention", "left")
    open_ = both.where("other is null").select("edge_type", F.col("company").alias("source"), F.col("mention").alias("target_mention"), "quote", F.col("id").alias("edition"))
    e = both.where("other <> company")
    a, b = F.when(F.col("role") == "reverse", F.col("other")).otherwise(F.col("company")), F.when(F.col("role") == "reverse", F.col("company")).otherwise(F.col("other"))
    same = F.col("edge_type").isin(*SYMMETRIC)
    e = e.withColumns({"source": F.when(same, F.least(a, b)).otherwise(a), "target": F.when(same, F.greatest(a, b)).otherwise(b)})
    e = e.groupBy("id", "source", "target", "edge_type").agg(F.min("quote").alias("quote"))
    day = F.when(F.col("edge_type") == "acquired", day_of(F.col("quote"), this_year).cast("date"))
    edges = e.select("source", "target", "edge_type", day.alias("valid_from"), F.col("edge_type").isin(*SYMMETRIC).alias("symmetric"), "quote", F.col("id").alias("edition"), F.lit(ref).alias("source_ref"))
    return edges, open_


def groups_told(parts: DataFrame) -> DataFrame:
    """source, target, group: companies of (id, company, body) that are part of one group."""
    names = F.regexp_extract_all("body", F.lit(GROUP), F.lit(1))
    of = parts.select("company", F.explode(names).alias("g")).select("company", F.trim(F.regexp_replace(F.trim("g"), GROUP_ENDINGS, "")).alias("group")).where(F.length("group") >= 3)
    return pairs_within(of, "group", "company").select(F.col("a").alias("source"), F.col("b").alias("target"), "group")


def applied(table: DataFrame, edges: DataFrame, entities: DataFrame, suppressed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with the edges, and one row of counts: inserted, skipped_fk, skipped_suppressed.

    Suppressed edges (source, target, edge_type) and those with an end that is no
    entity (name) are left out; of the others those whose key the table lacks come in.
    """
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    kept = edges if suppressed is None else edges.join(suppressed.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")
    names = entities.select("name").distinct()
    good = kept.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    out = insert_or_ignore(table, good.select(table.columns))
    counts = n(out, "after").crossJoin(n(table, "before")).crossJoin(n(edges, "all_")).crossJoin(n(kept, "kept")).crossJoin(n(good, "good"))  # one row each
    return out, counts.select((F.col("after") - F.col("before")).alias("inserted"), (F.col("kept") - F.col("good")).alias("skipped_fk"), (F.col("all_") - F.col("kept")).alias("skipped_suppressed"))


def append_lines(rows: DataFrame, to: str, key: list[str]) -> DataFrame:
    """Appends rows as JSON lines, but for those whose key the lines there have; the rows that were new."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(to)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.schema(rows.schema).json(to).select(*key).distinct(), key, "left_anti").select(rows.columns)
    fresh = checkpointed(rows.dropDuplicates(key))
    fresh.write.mode("append").json(to)
    return fresh

