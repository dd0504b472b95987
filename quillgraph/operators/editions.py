"""Editions of newsletters: what they are called, who is in them, what cites them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import pairs_within
from .resolve import fold
from .rounds import checkpointed

NUMBER = r"(?i)Edition\s*#(\d+)"
#: A key inside another counts from so many characters on.
LEAST_KEY = 8


def edition_heads(notes: DataFrame, series: str) -> DataFrame:
    """entity, title of second-level headings ``series — title`` in (entity, body)."""
    lines = notes.select("entity", F.explode(F.split("body", r"\r?\n")).alias("l"))
    title = F.rtrim(F.regexp_extract("l", rf"^##\s+\Q{series}\E\s*[—–-]{{1,3}}\s*(.+?)\s*$", 1))
    return lines.select("entity", F.regexp_replace(title, r"\.+$", "").alias("title")).where("title <> ''")


def edition_feet(notes: DataFrame, series: str) -> DataFrame:
    """title, suffix: the number in brackets that source lines give to a title, the first by entity."""
    lines = notes.select("entity", F.posexplode(F.split("body", r"\r?\n")).alias("i", "l"))
    pattern = rf"^\*Source:\s*\Q{series}\E\s*[—–-]{{1,3}}\s*(.+?)\s*(\([^()]*Edition\s*#\d+[^()]*\))?\s*\*\s*$"
    got = lines.select("entity", "i", F.trim(F.regexp_extract("l", pattern, 1)).alias("title"), F.regexp_extract("l", pattern, 2).alias("suffix")).where("title <> ''")
    return got.groupBy("title").agg(F.min(F.struct("entity", "i", "suffix")).alias("f")).select("title", F.col("f.suffix").alias("suffix"))


def editions_of(notes: DataFrame, series: str) -> DataFrame:
    """Distinct (edition, entity): a title without its number takes it from a source line of any note."""
    heads = edition_heads(notes, series).join(edition_feet(notes, series), "title", "left")
    name = F.when(F.col("title").rlike(NUMBER) | (F.coalesce("suffix", F.lit("")) == ""), F.col("title")).otherwise(F.concat_ws(" ", "title", "suffix"))
    return heads.select(name.alias("edition"), "entity").distinct()


def co_mentions(notes: DataFrame, series: str) -> DataFrame:
    """source, target, edition, edition_number: all pairs within an edition; the first
    edition of a pair is the edge's, by name."""
    notes = checkpointed(notes.select("entity", "body"))  # read twice
    # the number is read once an edition's entity, not once a pair
    of = editions_of(notes, series).select(F.struct("edition", F.regexp_extract("edition", NUMBER, 1).alias("number")).alias("edition"), "entity")
    pairs = pairs_within(of, "edition", "entity", once=True)
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("edition.edition").alias("edition"), F.col("edition.number").try_cast("int").alias("edition_number"))


def key_of(c: Column) -> Column:
    """A name without accents, case and punctuation."""
    return F.pandas_udf(lambda s: fold(s), "string")(c)


def edition_index(notes: DataFrame) -> DataFrame:
    """key, path: each edition note (path, title) by its stem, its title and what
    follows the title's last colon; of two notes with one key the first by path."""
    stem = F.regexp_replace(F.split_part("path", F.lit("/"), F.lit(-1)), r"\.md$", "")
    tail = F.when(F.col("title").contains(":"), F.split_part("title", F.lit(":"), F.lit(-1)))
    keys = notes.select("path", F.explode(F.array_compact(F.array(stem, F.col("title"), tail))).alias("k")).withColumn("key", key_of(F.col("k")))
    return keys.where("key <> ''").groupBy("key").agg(F.min("path").alias("path"))


def variants(cand: Column, series: str) -> Column:
    """The forms in which a reference is looked up, in order."""
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    parts = F.split(cand, r"[,;(]?\b[Ee]dition\s*#?\d+")
    place = F.element_at(F.split(cand, rf",\s*(?:{months})\b"), 1)
    own = F.nullif(F.regexp_extract(cand, rf"(?i)^(?:{series})\s*[—:-]*(.*)$", 1), F.lit(""))
    return F.array_compact(F.concat(F.array(cand), parts, F.array(place, own)))


def resolved_editions(refs: DataFrame, index: DataFrame, series: str) -> DataFrame:
    """ref, path of distinct references (ref): of each variant in turn the note with that
    key, else the first by path of which a key holds it or is held by it (8 characters or more)."""
    tried = refs.select("ref").distinct().select("ref", F.posexplode(variants(F.trim("ref"), series)).alias("place", "v")).withColumn("key", key_of(F.col("v"))).where("key <> ''")
    exact = tried.join(index, "key").select("ref", F.struct("place", F.lit(0).alias("way"), "path").alias("hit"))
    # keys that hold one another share a word of the shorter one, so candidates come from words
    long = tried.where(F.length("key") >= LEAST_KEY)
    words = lambda df: df.withColumn("w", F.explode(F.array_distinct(F.split("key", " "))))
    x, y = words(long).alias("x"), words(index).alias("y")
    inside = F.contains(F.col("y.key"), F.col("x.key")) | F.contains(F.col("x.key"), F.col("y.key"))
    near = x.join(y, (F.col("x.w") == F.col("y.w")) & inside).select(F.col("x.ref").alias("ref"), F.struct(F.col("x.place").alias("place"), F.lit(1).alias("way"), F.col("y.path").alias("path")).alias("hit"))
    best = exact.unionByName(near).groupBy("ref").agg(F.min("hit").alias("hit"))
    return best.select("ref", F.col("hit.path").alias("path"))


def citations(notes: DataFrame, editions: DataFrame, reports: str = "/Reports/") -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, resource) from the sources of notes (entity, sources) to
    editions (id); and one row of counters: entries passed over as reports, and with an unknown id."""
    each = notes.select("entity", F.explode("sources").alias("s")).select("entity", "s.id", F.coalesce("s.resource", F.lit("")).alias("resource")).where("id <> ''")
    own = ~F.col("resource").startswith(reports)
    known = each.join(editions.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    counts = known.agg(F.count(F.when(~own, 1)).alias("skipped_reports"), F.count(F.when(own & F.col("known").isNull(), 1)).alias("unknown_id"))
    edges = known.where(own & F.col("known")).select(F.col("entity").alias("source"), F.col("id").alias("target"), "resource")
    return edges.groupBy("source", "target").agg(F.min("resource").alias("resource")), counts


def cited_in(edges: DataFrame, quotes: DataFrame) -> DataFrame:
    """Citation edges with ``n_quotes``: quotes (entity, edition) of the company in that edition."""
    n = quotes.groupBy(F.col("entity").alias("source"), F.col("edition").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    props = F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("n_quotes"), F.nullif("resource", F.lit("")).alias("resource")))
    return edges.join(n, ["source", "target"], "left").select("source", "target", F.lit("cited_in").alias("edge_type"), F.coalesce("n", F.lit(0)).alias("n_quotes"), props.alias("properties"), F.lit("derive:cited_in").alias("source_ref"))


# The tag spaces that entities and edition notes keep.
ENTITY_SPACES = ("entity_type", "sector", "market_cap", "subsector", "holding_company", "geography", "business_model", "risk_investment", "investment_theme")
NOTE_SPACES = ("series", "publisher", "company")


def kept_tags(notes: DataFrame, spaces: tuple[str, ...], key: str = "entity") -> DataFrame:
    """Distinct (key, place, tag) of the tags whose space is kept."""
    tags = notes.select(key, F.posexplode("tags").alias("place", "t")).withColumn("tag", F.trim("t"))
    own = F.split_part("tag", F.lit("/"), F.lit(1)).isin(*spaces) & F.col("tag").contains("/")
    return tags.where(own).groupBy(key, "tag").agg(F.min("place").alias("place"))


def synced_tags(table: DataFrame, notes: DataFrame) -> DataFrame:
    """entity_name, tag: owners that have a note have its tags, all others keep theirs."""
    mine = kept_tags(notes, ENTITY_SPACES).select(F.col("entity").alias("entity_name"), "tag")
    rest = table.join(notes.select(F.col("entity").alias("entity_name")).distinct(), "entity_name", "left_anti")
    return rest.select("entity_name", "tag").unionByName(mine)


def synced_sectors(entities: DataFrame, notes: DataFrame, canonical: dict[str, str]) -> DataFrame:
    """Entities with ``sector`` from the first sector tag of their note, in its canonical spelling."""
    tags = kept_tags(notes, ("sector",))
    first = tags.groupBy(F.col("entity").alias("name")).agg(F.min(F.struct("place", "tag")).alias("f")).select("name", F.regexp_replace("f.tag", "^sector/", "").alias("slug"))
    names = entities.sparkSession.createDataFrame(list(canonical.items()) or [("", "")], "slug string, own string")
    of = first.join(F.broadcast(names), "slug", "left").select("name", F.coalesce("own", "slug").alias("new_"))  # a row a sector
    return entities.join(of, "name", "left").withColumn("sector", F.coalesce("new_", "sector")).drop("new_").select(entities.columns)


def roster(entities: DataFrame) -> DataFrame:
    """sector, companies: links to a sector's companies, in order."""
    link = F.concat(F.lit("[["), "name", F.lit("]]"))
    return entities.where("kind = 'company' and sector is not null").groupBy("sector").agg(F.array_join(F.sort_array(F.collect_list(link)), "\n").alias("companies"))
