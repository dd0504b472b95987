"""Checks of notes: rows (path, check, severity, detail).

Notes come as :func:`quillgraph.sources.heads.parsed` gives them; all checks but
the likeness of headings are column expressions, so one scan finds all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of notes, fields that stricter types may hold, capital classes, and
# the words that stand for what is still to be written.
TYPES = ("company", "sector", "super_sector", "sub_sector", "theme")
PROVENANCE = ("generated", "verified", "sources", "status", "stale_after")
FIELDS = {
    "sector": ("title", "type", "super_sector", "tags", "created", "last_modified", "normalized_name", "permalink"),
    "super_sector": ("title", "type", "normalized_name", "file_path", "permalink", "tags", "created", "last_modified"),
}
LINKS = {"sector": "/sectors/", "super_sector": "/super_sectors/", "company": "/companies/"}
CAPS = ("large_cap", "mid_cap", "small_cap", "micro_cap")
PLACEHOLDERS = (
    r"More information about this company will be added here",
    r"Information about.*will be added here",
    r"\*Add.*here\.*",
    r"Detail business segments",
    r"Describe competitive positioning",
    r"Include notable quotes if available",
    r"Provide key financial metrics",
)
BODY_KEYS = ("created", "last_modified", "normalized_name", "market_cap", "permalink", "ticker", "title", "type", "sector", "super_sector")
ALIKE_ENDINGS = (" apparel", " technology", " pay later", " wheelers", " wear", " scooters", " bikes")
SHORT = 1500


def stem(path: Column) -> Column:
    return F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(-1)), r"\.md$", "")


def folder(path: Column) -> Column:
    """The directory a note lies in."""
    return F.split_part(path, F.lit("/"), F.lit(-2))


def _has(name: str) -> Column:
    return F.array_contains("names", name)


def _flag(when: Column, check: str, severity: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))


def _rows(notes: DataFrame, flags: list[Column]) -> DataFrame:
    return notes.select("path", F.explode(F.array_compact(F.array(*flags))).alias("x")).select("path", "x.*")


def filename_checks(notes: DataFrame) -> DataFrame:
    """At most 100 characters, letters, digits and single underscores, none at the end: the first fault."""
    s = stem(F.col("path"))
    why = F.when(F.length(s) > 100, "long").when(~s.rlike(r"^[A-Za-z0-9][A-Za-z0-9_]*$"), "characters").when(s.contains("__"), "double_underscore").when(s.endswith("_"), "trailing_underscore")
    return _rows(notes, [_flag(why.isNotNull(), "filename_format", "error", why)])


def structure_checks(notes: DataFrame, known: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Front matter: there and readable, required fields, type, tags as a list of
    distinct ones in the form ``space/value``; name as the file's.  ``known`` maps
    controlled tag spaces to their values."""
    good = F.col("fault").isNull()
    value = lambda k: F.col("fields").getItem(k)
    missing = F.array_compact(F.array(*[F.when(~_has(k), F.lit(k)) for k in ("title", "type")]))
    odd = F.filter("tags", lambda t: ~t.rlike(r"^[a-z_]+/[a-z0-9_]+$"))
    s = stem(F.col("path"))
    name = value("normalized_name")
    flags = [
        _flag(F.col("fault").isNotNull(), "yaml_structure", "error", F.col("fault")),
        _flag(good & (F.size(missing) > 0), "yaml_missing", "error", F.array_join(missing, ",")),
        _flag(good & _has("type") & ~F.coalesce(value("type").isin(*TYPES), F.lit(False)), "yaml_type", "error", F.coalesce(value("type"), F.lit(""))),
        _flag(good & F.col("tags_fault"), "tags_not_a_list", "error", F.lit("")),
        _flag(good & (F.size("tags") != F.size(F.array_distinct("tags"))), "tags_repeated", "error", F.lit("")),
        _flag(good & (F.size(odd) > 0), "tag_format", "warning", F.try_element_at(odd, F.lit(1))),
        _flag(good & (name.isNull() | (name == "")), "name_sync", "error", F.lit("missing")),
        _flag(good & (name != "") & (name != s), "name_sync", "error", name),
    ]
    out = _rows(notes, flags)
    if known:
        words = F.explode("tags").alias("tag")
        tags = notes.where(good).select("path", words)
        space, val = F.split_part("tag", F.lit("/"), F.lit(1)), F.regexp_replace("tag", "^[^/]*/", "")
        bad = F.lit(False)
        for k, values in known.items():
            bad |= (space == k) & F.col("tag").contains("/") & ~val.isin(*values)
        out = out.unionByName(tags.where(bad).select("path", F.lit("tag_value").alias("check"), F.lit("warning").alias("severity"), F.col("tag").alias("detail")))
    return out


def type_checks(notes: DataFrame, sectors: Sequence[str] = ()) -> DataFrame:
    """What the note's type asks for: permalink, quoted dates, unquoted title, allowed
    fields, order, market capitalisation, mark of unlisted companies, sector's spelling."""
    good = F.col("fault").isNull()
    value = lambda k: F.col("fields").getItem(k)
    kind, flags = value("type"), []
    for t, start in LINKS.items():
        flags.append(_flag(good & (kind == t) & ~value("permalink").startswith(start), "permalink", "error", value("permalink")))
    strict = kind.isin(*FIELDS)
    for k in ("created", "last_modified"):
        flags.append(_flag(good & strict & _has(k) & ~F.col("head").rlike(rf"{k}:\s*'[^']*'"), "date_unquoted", "error", F.lit(k)))
    title = F.trim(F.regexp_extract("head", r"title:\s*([^'\n]+)", 1))
    quoted = _has("title") & title.startswith('"') & title.endswith('"')
    flags.append(_flag(good & strict & quoted, "title_quoted", "error", title))
    flags.append(_flag(good & (kind == "company") & quoted, "title_quoted", "warning", title))
    for t, allowed in FIELDS.items():
        more = F.array_except("names", F.array(*[F.lit(x) for x in (*allowed, *PROVENANCE)]))
        flags.append(_flag(good & (kind == t) & (F.size(more) > 0), "unexpected_fields", "error", F.array_join(F.array_sort(more), ",")))
    first = F.array_join(F.slice("names", 1, 2), ",")
    flags.append(_flag(good & kind.isin(*LINKS) & (first != "title,type") & ((kind != "company") | (F.size("names") >= 2)), "field_order", "warning", first))
    company = good & (kind == "company")
    flags += [
        _flag(company & ~_has("market_cap"), "missing_field", "warning", F.lit("market_cap")),
        _flag(company & value("market_cap").isNotNull() & ~value("market_cap").isin(*CAPS), "market_cap_value", "error", value("market_cap")),
        _flag(company & value("ticker").isNull() & ~_has("listed"), "listed_missing", "warning", F.lit("")),
    ]
    if sectors:
        own = F.trim(value("sector"))
        lower = F.lower(own).isin(*[s.lower() for s in sectors])
        flags.append(_flag(company & (own != "") & ~own.isin(*sectors), "sector_scalar", "warning", F.when(lower, F.concat(F.lit("case:"), own)).otherwise(own)))
    return _rows(notes, flags)


def content_checks(notes: DataFrame) -> DataFrame:
    """Short notes need two lines that say something, and a heading."""
    short = (F.col("size") <= SHORT) & ~F.coalesce(F.col("fault") == "no_block", F.lit(False))
    lines = F.filter(F.transform(F.split("body", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    filler = lambda x: x.rlike("(?i)" + "|".join(PLACEHOLDERS)) | (x == "N/A") | (F.lower(x) == "overview")
    n = F.size(F.filter(lines, lambda x: ~filler(x)))
    empty = F.trim("body") == ""
    flags = [
        _flag(short & empty, "content_minimal", "error", F.lit("nothing")),
        _flag(short & ~empty & (n < 2), "content_minimal", "error", n),
        _flag(short & ~empty & ~F.col("body").rlike(r"(?m)^#"), "content_missing_structure", "error", F.lit("")),
    ]
    return _rows(notes, flags)


def headings_of(notes: DataFrame) -> DataFrame:
    """path, line (from 1, in the body), heading: third-level ones."""
    lines = notes.select("path", F.posexplode(F.split("body", "\n")).alias("i", "l"))
    h = F.trim(F.regexp_extract("l", r"^###\s+(.+?)\s*$", 1))
    return lines.select("path", (F.col("i") + 1).alias("line"), h.alias("heading")).where("heading <> ''")


def _normal(h: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", h.lower()).strip()


def alike(headings: list[str], least: float = 0.9) -> list[tuple[str, str]]:
    """Pairs of different headings that are nearly the same, without known variants."""
    normal, out = [(h, _normal(h)) for h in headings], []
    for i, (h, a) in enumerate(normal):
        for g, b in normal[i + 1 :]:
            if not a or not b or h.lower() == g.lower() or 2 * min(len(a), len(b)) < 0.8 * (len(a) + len(b)):
                continue
            if any(a.endswith(x) and b.endswith(x) for x in ALIKE_ENDINGS) or any(x.startswith("on ") and y.startswith(x[3:]) for x, y in ((a, b), (b, a))):
                continue
            m = SequenceMatcher(None, a, b)
            if m.quick_ratio() >= least and m.ratio() >= least:
                out.append((h, g))
    return out


def heading_checks(notes: DataFrame) -> DataFrame:
    """Headings that repeat, differ in case or are nearly the same; front matter within the body."""
    heads = headings_of(notes)
    row = lambda df, check, severity, detail: df.select("path", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))
    exact = row(heads.groupBy("path", "heading").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicates", "error", F.col("heading"))
    cases = heads.groupBy("path", F.lower("heading").alias("low")).agg(F.countDistinct("heading").alias("n")).where("n > 1")
    cases = row(cases, "case_variant_heading", "warning", F.col("low"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, "near_duplicate_heading", "warning", f"{x} | {y}") for p, hs in zip(b["path"], b["hs"], strict=True) for x, y in alike([h["heading"] for h in hs])]
            yield pd.DataFrame(rows, columns=["path", "check", "severity", "detail"])

    lists = heads.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "heading"))).alias("hs")).where(F.size("hs") > 1)  # a note's own
    alike_rows = lists.mapInPandas(near, "path string, check string, severity string, detail string")
    again = F.regexp_extract("body", rf"(?m)^---\s*\n(?:(?!---\s*$).*\n)*?\s*({'|'.join(BODY_KEYS)}):(?:(?!---\s*$).*\n)*?---\s*$", 1)
    stray = notes.withColumn("key", again).where("key <> ''")
    return exact.unionByName(cases).unionByName(alike_rows).unionByName(row(stray, "redundant_yaml", "warning", F.col("key")))


def static_checks(notes: DataFrame, sectors: Sequence[str] = ()) -> DataFrame:
    """Sector tags in lower case and known, permalinks as the folder, dates in order."""
    value = lambda k: F.col("fields").getItem(k)
    tags = notes.select("path", F.explode("tags").alias("tag")).where(F.col("tag").startswith("sector/"))
    val = F.regexp_replace("tag", "^sector/", "")
    wrong = val != F.lower(val)
    known = F.lower(val).isin(*[s.lower() for s in sectors]) if sectors else F.lit(True)
    checks = tags.select("path", F.when(wrong, F.lit("sector_tag_case")).when(~known, F.lit("sector_tag_unknown")).alias("check"), F.when(wrong, F.lit("error")).otherwise("warning").alias("severity"), F.col("tag").alias("detail")).where("check is not null")
    link = F.regexp_extract(value("permalink"), r"^/*companies/([^/]*)", 1)
    flags = [
        _flag((link != "") & (link != F.lower(folder(F.col("path")))), "permalink_folder", "error", value("permalink")),
        _flag((value("created") != "") & (value("last_modified") < value("created")), "date_order", "error", value("last_modified")),
    ]
    return checks.unionByName(_rows(notes, flags))


def orphan_notes(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """Notes whose stem no entity (normalized_name) has."""
    s = notes.select("path", stem(F.col("path")).alias("normalized_name"))
    gone = s.join(entities.where("normalized_name is not null").select("normalized_name").distinct(), "normalized_name", "left_anti")
    return gone.select("path", F.lit("orphan_note").alias("check"), F.lit("error").alias("severity"), F.col("normalized_name").alias("detail"))


def schema_checks(notes: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Fields against a JSON schema a type: ``required``, and of ``properties`` the
    ``enum`` and ``pattern`` of strings; dates count as strings."""
    value = lambda k: F.col("fields").getItem(k)
    flags = []
    for kind, schema in schemas.items():
        mine = F.col("fault").isNull() & (value("type") == kind)
        for k in schema.get("required", ()):
            flags.append(_flag(mine & ~_has(k), "schema_required", "error", F.lit(k)))
        for k, rule in schema.get("properties", {}).items():
            if "enum" in rule:
                flags.append(_flag(mine & value(k).isNotNull() & ~value(k).isin(*[x for x in rule["enum"] if x is not None]), "schema_enum", "error", F.lit(k)))
            if "pattern" in rule:
                flags.append(_flag(mine & value(k).isNotNull() & ~value(k).rlike(rule["pattern"]), "schema_pattern", "error", F.lit(k)))
    return _rows(notes, flags)


def trust(notes: DataFrame) -> Column:
    """How far a note is confirmed: by a human, by a machine, or not."""
    human = F.exists("verified", lambda v: v.startswith("human:"))
    return F.when(human, "human-reviewed").when(F.col("generated").isNotNull() | (F.size("verified") > 0), "machine-confirmed").otherwise("unverified")


def provenance_census(notes: DataFrame, today: str) -> DataFrame:
    """group, tier, notes, stale: notes by folder group and trust, and how many are past their ``stale_after``."""
    after = F.col("fields").getItem("stale_after")
    stale = after.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.lit(today) >= after)
    rows = notes.where("fault is null").select(F.col("doc_type").alias("group"), trust(notes).alias("tier"), F.coalesce(stale, F.lit(False)).alias("past"))
    return rows.groupBy("group", "tier").agg(F.count(F.lit(1)).alias("notes"), F.count(F.when(F.col("past"), 1)).alias("stale"))


def provenance_checks(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Notes without a type; provenance that is not well formed; sources whose
    resource (a path from the vault's root) is not among ``files`` (path)."""
    value = lambda k: F.col("fields").getItem(k)
    made = F.col("generated").isNotNull()
    flags = [
        _flag(F.col("fault").isNotNull(), "provenance_block", "error", F.col("fault")),
        _flag(F.col("fault").isNull() & (F.coalesce(F.trim(value("type")), F.lit("")) == ""), "provenance_type", "error", F.lit("")),
        _flag(made & (F.coalesce(F.col("generated.by"), F.lit("")) == ""), "generated_by", "warning", F.lit("")),
        _flag(made & ~F.coalesce(F.col("generated.at"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}[Tt]"), "generated_at", "warning", F.col("generated.at")),
    ]
    each = notes.select("path", F.explode("sources").alias("s")).select("path", "s.resource")
    ill = each.where(~F.coalesce(F.col("resource").startswith("/"), F.lit(False)))
    gone = each.where(F.col("resource").startswith("/")).join(files.select(F.concat(F.lit("/"), F.col("path")).alias("resource")).distinct(), "resource", "left_anti")
    row = lambda df, check: df.select("path", F.lit(check).alias("check"), F.lit("warning").alias("severity"), F.col("resource").alias("detail"))
    return _rows(notes, flags).unionByName(row(ill, "source_path")).unionByName(row(gone, "source_gone"))


def stale_after(notes: DataFrame, written: str, days: int = 180) -> DataFrame:
    """path, stale_after: so many days after the newest source, or after the day of writing."""
    dates = F.filter(F.transform("sources", lambda s: s["last_modified"]), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    base = F.coalesce(F.array_max(dates), F.lit(written))
    return notes.select("path", F.date_add(base.cast("date"), days).cast("string").alias("stale_after"))


def merged_sources(notes: DataFrame, new: DataFrame) -> DataFrame:
    """path, sources: those of a note as they are, then new ones (path, id, resource,
    title, last_modified) of which it lacks the id."""
    order = F.sort_array(F.collect_list(F.struct("id", "resource", "title", "last_modified")))
    more = new.groupBy("path").agg(order.alias("more"))  # a note's own
    have = F.transform("sources", lambda s: s["id"])
    both = notes.select("path", "sources").join(more, "path", "left")
    kept = F.filter(F.coalesce("more", F.array().cast("array<struct<id: string, resource: string, title: string, last_modified: string>>")), lambda s: ~F.array_contains(have, s["id"]))
    return both.select("path", F.concat("sources", kept).alias("sources"))


def all_notes(notes: DataFrame, entities: DataFrame, sectors: Sequence[str] = (), known: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Every check of notes."""
    parts = [filename_checks(notes), structure_checks(notes, known), type_checks(notes, sectors), content_checks(notes), heading_checks(notes), static_checks(notes, sectors), orphan_notes(notes, entities)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
