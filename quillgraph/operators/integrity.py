"""Checks of a graph's tables; each gives rows (check, severity, count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EDGE_TYPES, EVENT_TYPES


def _row(name: str, severity: str, count: DataFrame) -> DataFrame:
    return count.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col("count").cast("long").alias("count"))


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def bad_json(c: str) -> Column:
    return F.col(c).isNotNull() & F.try_parse_json(F.col(c)).isNull()


def relations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Counters of faulty edges: unknown type, self-loop, orphan end, wrong kinds, missing inverse, both directions."""
    names = entities.select("name", "kind")
    ends = edges.join(names.select(F.col("name").alias("source"), F.col("kind").alias("sk")), "source", "left").join(names.select(F.col("name").alias("target"), F.col("kind").alias("tk")), "target", "left")
    wrong = F.lit(False)
    for t in EDGE_TYPES.values():
        for kinds, col in ((t.source_kinds, "sk"), (t.target_kinds, "tk")):
            if kinds:
                wrong |= (F.col("edge_type") == t.name) & F.col(col).isNotNull() & ~F.col(col).isin(*kinds)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    flags = {
        "unknown_type": ~F.col("edge_type").isin(*EDGE_TYPES),
        "self_loop": F.col("source") == F.col("target"),
        "orphan_end": F.col("sk").isNull() | F.col("tk").isNull(),
        "wrong_kind": F.coalesce(wrong, F.lit(False)),
    }
    one = ends.agg(*[count(c).alias(k) for k, c in flags.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f"relations_{k}").alias("check"), F.lit("error").alias("severity"), F.col(k).alias("count")) for k in flags])).alias("x")).select("x.*")
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type")
    missing = lambda a, b: edges.where(F.col("edge_type") == a).join(turned.where(F.col("edge_type") == b).drop("edge_type"), ["source", "target"], "left_anti")
    twice = edges.where("source < target").join(turned, ["source", "target", "edge_type"], "left_semi")
    parts = [rows, _row("relations_no_has_company", "error", _n(missing("part_of", "has_company"))), _row("relations_no_part_of", "error", _n(missing("has_company", "part_of"))), _row("relations_both_directions", "error", _n(twice))]
    return reduce(DataFrame.unionByName, parts)


def orphan_companies(edges: DataFrame, entities: DataFrame) -> DataFrame:
    held = edges.where("edge_type = 'part_of'").select(F.col("source").alias("name"))
    return _row("orphan_companies", "error", _n(entities.where("kind = 'company'").join(held, "name", "left_anti")))


def hierarchy(edges: DataFrame, entities: DataFrame) -> DataFrame:
    up = edges.where("edge_type = 'belongs_to'")
    orphans = entities.where("kind = 'sector'").join(up.select(F.col("source").alias("name")), "name", "left_anti")
    several = up.groupBy("source").agg(F.countDistinct("target").alias("n")).where("n > 1")
    return _row("hierarchy_orphans", "error", _n(orphans)).unionByName(_row("hierarchy_several_parents", "error", _n(several)))


def tag_checks(tags: DataFrame, entities: DataFrame) -> DataFrame:
    owners = tags.join(entities.select(F.col("name").alias("entity_name")), "entity_name", "left_anti")
    caps = tags.where(F.col("tag").startswith("market_cap/")).groupBy("entity_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _row("entity_tags", "error", _n(owners)).unionByName(_row("market_cap_conflicts", "error", _n(caps)))


def duplicate_tickers(entities: DataFrame) -> DataFrame:
    several = entities.where("kind = 'company' and ticker is not null and ticker <> ''").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _row("duplicate_tickers", "error", _n(several))


def rows_of_entities(name: str, table: DataFrame, entities: DataFrame, json: str = "properties", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Orphans, invalid JSON and (for events) unknown types of a fact table."""
    parts = [_row(f"{name}_orphans", "error", _n(table.join(entities.select(F.col("name").alias("entity")), "entity", "left_anti"))), _row(f"{name}_json", "error", _n(table.where(bad_json(json))))]
    if kinds is not None:
        parts.append(_row(f"{name}_types", "error", _n(table.where(~F.col("event_type").isin(*kinds)))))
    return reduce(DataFrame.unionByName, parts)


def events(table: DataFrame, entities: DataFrame) -> DataFrame:
    return rows_of_entities("events", table, entities, kinds=EVENT_TYPES)


def normalised(entities: DataFrame) -> DataFrame:
    """Missing, repeated and ill-formed normalised names (editions may look as they like)."""
    e = entities.where("kind <> 'edition'")
    several = e.where("normalized_name is not null").groupBy("normalized_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [_row("normalization_missing", "error", _n(e.where("normalized_name is null or normalized_name = ''"))), _row("normalization_duplicate", "error", _n(several)), _row("normalization_format", "error", _n(e.where(~F.col("normalized_name").rlike(r"^[A-Z0-9][A-Za-z0-9]*(_[A-Z0-9][A-Za-z0-9]*)*$"))))])


def validity(edges: DataFrame) -> DataFrame:
    """Ownership edges without a start."""
    return _row("validity_window", "warning", _n(edges.where("edge_type in ('acquired', 'subsidiary_of') and valid_from is null")))


def table_counts(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """A row a derived table: how far its count is from its source's."""
    rows = []
    for name, df in expected.items():
        got = _n(actual[name]).withColumnRenamed("count", "b") if name in actual else _n(df.limit(0)).withColumnRenamed("count", "b")
        both = _n(df).crossJoin(F.broadcast(got)).select(F.abs(F.col("count") - F.col("b")).alias("count"))  # one row each
        rows.append(_row(f"cache_{name}", "error", both))
    return reduce(DataFrame.unionByName, rows)


def sector_sizes(edges: DataFrame) -> DataFrame:
    """One row: least, upper-middle, largest and mean sector size."""
    sizes = edges.where("edge_type = 'has_company'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.sort_array(F.collect_list("n")).alias("s"))  # one number a sector
    return s.where(F.size("s") > 0).select(F.array_min("s").alias("least"), F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("median"), F.array_max("s").alias("most"), F.round(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("s"), 6).alias("mean"))


def note_tags(table: DataFrame, notes: DataFrame) -> DataFrame:
    """Stored tags (note_path, tag) of notes that are gone, and that the note (path, tags) no longer has."""
    now = notes.select(F.col("path").alias("note_path"), F.explode("tags").alias("tag")).distinct()
    there = notes.select(F.col("path").alias("note_path"))
    gone = table.join(there, "note_path", "left_anti")
    dropped = table.join(there, "note_path", "left_semi").join(now, ["note_path", "tag"], "left_anti")
    return _row("note_tags_missing_note", "error", _n(gone)).unionByName(_row("note_tags_dropped", "error", _n(dropped)))


def quotes(table: DataFrame, entities: DataFrame) -> DataFrame:
    return rows_of_entities("quotes", table, entities)


def figures(table: DataFrame, entities: DataFrame) -> DataFrame:
    return rows_of_entities("company_metrics", table, entities)


def hierarchy_levels(edges: DataFrame, entities: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Orphans of each level, nodes on cycles, and (child, parent) pairs that either the
    edges or the taxonomy lack."""
    from .paths import hierarchy_cycles

    up = edges.where("edge_type = 'belongs_to'")
    held = up.select(F.col("source").alias("name")).distinct()
    has = up.select(F.col("target").alias("name")).distinct()
    parts = [_row("hierarchy_sub_sector_orphans", "error", _n(entities.where("kind = 'sub_sector'").join(held, "name", "left_anti"))), _row("hierarchy_super_sector_orphans", "error", _n(entities.where("kind = 'super_sector'").join(has, "name", "left_anti"))), _row("hierarchy_cycles", "error", _n(hierarchy_cycles(up)))]
    if taxonomy is not None:
        mine, theirs = up.select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct(), taxonomy.select("child", "parent").distinct()
        parts.append(_row("hierarchy_taxonomy", "error", _n(mine.join(theirs, ["child", "parent"], "left_anti").unionByName(theirs.join(mine, ["child", "parent"], "left_anti")))))
    return reduce(DataFrame.unionByName, parts)


def names_and_files(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Entities whose normalised name is not the stem of their file, and files (path) that no entity has."""
    s = F.regexp_replace(F.split_part("file_path", F.lit("/"), F.lit(-1)), r"\.md$", "")
    odd = entities.where(F.col("file_path").isNotNull() & (F.col("file_path") != "") & ~F.col("normalized_name").eqNullSafe(s))
    orphans = paths.join(entities.select(F.col("file_path").alias("path")), "path", "left_anti")
    return _row("normalization_stem", "warning", _n(odd)).unionByName(_row("normalization_orphan_files", "warning", _n(orphans)))


# The folder that each kind of entity keeps its note in.
FOLDERS = {"company": "Companies/", "sector": "Sectors/", "super_sector": "Super_Sectors/"}


def file_paths(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Entities with no path, with one that does not exist, in the wrong folder, or with an ill-formed file name."""
    e = entities.where(F.col("kind").isin(*FOLDERS))
    empty = e.where("file_path is null or file_path = ''")
    full = e.where("file_path <> ''")
    gone = full.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    folder = F.lit(False)
    for kind, start in FOLDERS.items():
        folder |= (F.col("kind") == kind) & ~F.col("file_path").contains(start)
    name = F.split_part("file_path", F.lit("/"), F.lit(-1))
    bad = full.where(~name.rlike(r"^[A-Za-z0-9]+(_[A-Za-z0-9]+)*\.md$"))
    return reduce(DataFrame.unionByName, [_row("file_path_empty", "error", _n(empty)), _row("file_path_missing", "error", _n(gone)), _row("file_path_folder", "error", _n(full.where(folder))), _row("file_path_name", "error", _n(bad))])


def build_meta(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Faults of build metadata (key, value): a generation that is no whole number, and keys of which the value is not the expected one."""
    number = meta.where("key = 'generation'").agg(F.coalesce(F.max(F.when(F.col("value").rlike(r"^\d+$"), 0).otherwise(1)), F.lit(1)).alias("count"))
    parts = [_row("db_meta_generation", "error", number)]
    for k, v in expected.items():
        parts.append(_row(f"db_meta_{k}", "error", meta.where(F.col("key") == k).agg(F.coalesce(F.max(F.when(F.col("value") == v, 0).otherwise(1)), F.lit(1)).alias("count"))))
    return reduce(DataFrame.unionByName, parts)


def fuzzy_names(entities: DataFrame) -> DataFrame:
    from .resolve import fuzzy_duplicates

    return _row("fuzzy_duplicates", "warning", _n(fuzzy_duplicates(entities.where("kind = 'company'").select("name", "ticker"))))


def edge_json(edges: DataFrame) -> DataFrame:
    return _row("relations_json", "error", _n(edges.where(bad_json("properties"))))


def largest_sectors(edges: DataFrame, top: int = 10, bottom: int = 5) -> DataFrame:
    """side, sector, n: the largest and smallest sectors."""
    sizes = edges.where("edge_type = 'has_company'").groupBy(F.col("source").alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    big, small = sizes.orderBy(F.desc("n"), "sector").limit(top), sizes.orderBy("n", "sector").limit(bottom)
    return big.select(F.lit("top").alias("side"), "sector", "n").unionByName(small.select(F.lit("bottom").alias("side"), "sector", "n"))


def hygiene(edges: DataFrame, entities: DataFrame, tags: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """One row: orphan companies, companies without a ticker, self-loops, orphan edges and
    market-cap conflicts; with stored measures also the two newest times and whether the
    measures are stale.  ``entities`` has ``last_updated`` then."""
    names = entities.select("name")
    companies = entities.where("kind = 'company'")
    held = edges.where("edge_type = 'part_of'").select(F.col("source").alias("name")).distinct()
    loops = edges.agg(F.count(F.when(F.col("source") == F.col("target"), 1)).alias("self_loops"))
    whole = edges.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    caps = tags.where(F.col("tag").startswith("market_cap/")).groupBy("entity_name").agg(F.countDistinct("tag").alias("n")).where("n > 1")
    out = n(companies.join(held, "name", "left_anti"), "orphan_companies").crossJoin(n(companies.where("ticker is null or ticker = ''"), "no_ticker")).crossJoin(loops)
    out = out.crossJoin(n(edges, "e_")).crossJoin(n(whole, "w_")).crossJoin(n(caps, "conflicting_market_cap"))  # one row each
    out = out.select("orphan_companies", "no_ticker", "self_loops", (F.col("e_") - F.col("w_")).alias("orphan_edges"), "conflicting_market_cap")
    if table is not None:
        from .analytics import stale

        out = out.crossJoin(stale(entities, table))
    return out


def all_checks(edges: DataFrame, entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Every check that edges, entities (name, kind, ticker) and tags alone allow."""
    return reduce(DataFrame.unionByName, [relations(edges, entities), edge_json(edges), tag_checks(tags, entities), orphan_companies(edges, entities), hierarchy(edges, entities), hierarchy_levels(edges, entities), duplicate_tickers(entities), fuzzy_names(entities), validity(edges)])
