"""Graph patterns, for all entities at once; filter the result for one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MEMBERSHIP
from .rounds import spread
from .temporal import valid_at


PRIORITY_TYPES = ("subsidiary_of", "acquired", "jv_with", "supplier_to", "customer_of", "same_group", "competes_with", "part_of", "exposed_to", "belongs_to", "has_company", "cited_in", "co_mentioned_in")


def _of(edges: DataFrame, *types: str, as_of: str | None = None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types) & valid_at(as_of))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sector_of(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, sector: the first by name, where there are several."""
    return _of(edges, "part_of", as_of=as_of).groupBy(F.col("source").alias("company")).agg(F.min("target").alias("sector"))


def sector_members(edges: DataFrame, entities: DataFrame, market_cap: str | None = None) -> DataFrame:
    """sector, company, market_cap."""
    cap = entities.where("kind = 'company'").select(F.col("name").alias("target"), "market_cap")
    out = _of(edges, "has_company").join(cap, "target").select(F.col("source").alias("sector"), F.col("target").alias("company"), "market_cap")
    return out.where(F.col("market_cap") == market_cap) if market_cap else out


def theme_members(edges: DataFrame) -> DataFrame:
    return _of(edges, "exposed_to").select(F.col("target").alias("theme"), F.col("source").alias("company")).distinct()


def hierarchy(edges: DataFrame) -> DataFrame:
    """super_sector and its sectors in order, with their number."""
    return _of(edges, "belongs_to").groupBy(F.col("target").alias("super_sector")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sectors"), F.countDistinct("source").alias("n"))


def sub_sectors(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """sector, sub_sector: what belongs to a sector and is a sub-sector."""
    subs = entities.where("kind = 'sub_sector'").select(F.col("name").alias("source"))
    return _of(edges, "belongs_to").join(subs, "source", "left_semi").select(F.col("target").alias("sector"), F.col("source").alias("sub_sector")).distinct()


def bundles(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, kind, part, item, n: what a page on a sector, theme, super-sector or
    sub-sector shows: its members, children and parents, and how its members spread over market caps."""
    kinds = entities.select(F.col("name").alias("entity"), "kind").where("kind in ('sector', 'theme', 'super_sector', 'sub_sector')")
    of = lambda t, entity, item, part: _of(edges, t).select(F.col(entity).alias("entity"), F.lit(part).alias("part"), F.col(item).alias("item"))
    rows = _union([of("has_company", "source", "target", "member"), of("exposed_to", "target", "source", "member"), of("belongs_to", "target", "source", "child"), of("belongs_to", "source", "target", "parent")]).distinct()
    caps = rows.where("part = 'member'").join(entities.select(F.col("name").alias("item"), "market_cap"), "item", "left")
    caps = caps.groupBy("entity", F.lit("market_cap").alias("part"), F.coalesce("market_cap", F.lit("unknown")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    both = rows.withColumn("n", F.lit(1).cast("long")).unionByName(caps)
    return both.join(kinds, "entity").select("entity", "kind", "part", "item", "n")


# What each type of edge says, direction included.
SEMANTICS = {t: ("symmetric" if t in ("competes_with", "jv_with", "same_group", "co_mentioned_in") else "membership" if t in MEMBERSHIP else "directed") for t in PRIORITY_TYPES}


def cloud(edges: DataFrame, entities: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (name, kind, degree), edges (source, target, edge_type) and types (edge_type,
    n, semantics; 'unknown' for types that are not listed) of a drawing."""
    e = edges.where(F.col("edge_type").isin(types)) if types else edges
    says = F.create_map(*[F.lit(x) for kv in SEMANTICS.items() for x in kv])
    counts = e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).withColumn("semantics", F.coalesce(says[F.col("edge_type")], F.lit("unknown")))
    return cloud_nodes(edges, entities, types), e.select("source", "target", "edge_type"), counts


def path_or_name(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """query, name of entities (name, file_path) that have the query as their path or name; the first by name."""
    keys = entities.select("name", F.explode(F.array_compact(F.array("name", "file_path"))).alias("key"))
    hits = queries.join(keys, F.col("query") == F.col("key")).groupBy("query").agg(F.min("name").alias("name"))
    return queries.join(hits, "query", "left").select("query", "name")


def neighbours(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """entity, direction, other, label: distinct neighbours at one hop."""
    way = lambda x, d, y: F.struct(F.col(x).alias("entity"), F.lit(d).alias("direction"), F.col(y).alias("other"))
    both = F.explode(F.array(way("source", "out", "target"), way("target", "in", "source")))
    # edges that are told apart have rows that are told apart
    one = spread(edges.where(valid_at(as_of)).select("source", "target", "edge_type"), "source", "target", "edge_type").distinct()
    return one.select(both.alias("w"), F.col("edge_type").alias("label")).select("w.*", "label")


def peers(walk: DataFrame, kind: str = "competes_with", as_of: str | None = None) -> DataFrame:
    """The other ends of symmetric edges."""
    return _of(walk, kind, as_of=as_of).select(F.col("a").alias("company"), F.col("b").alias("peer")).distinct()


def jv_partners(walk: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, partner, venture ('' if unnamed); repeats stay."""
    return _of(walk, "jv_with", as_of=as_of).select(F.col("a").alias("company"), F.col("b").alias("partner"), F.coalesce(F.get_json_object("properties", "$.venture"), F.lit("")).alias("venture"))


def acquisitions(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    return _of(edges, "acquired", as_of=as_of).select(F.col("source").alias("company"), "target", F.coalesce(F.get_json_object("properties", "$.year"), F.lit("")).alias("year"))


def parents(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, parent: the first by name."""
    return _of(edges, "subsidiary_of", as_of=as_of).groupBy(F.col("source").alias("company")).agg(F.min("target").alias("parent"))


def suppliers_and_customers(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, role, other.  A supplies B says the same as B is a customer of A."""
    e = _of(edges, "supplier_to", "customer_of", as_of=as_of)
    seller = F.when(F.col("edge_type") == "supplier_to", F.col("source")).otherwise(F.col("target"))
    buyer = F.when(F.col("edge_type") == "supplier_to", F.col("target")).otherwise(F.col("source"))
    both = e.select(seller.alias("seller"), buyer.alias("buyer"))
    return both.select(F.explode(F.array(F.struct(F.col("buyer").alias("company"), F.lit("supplier").alias("role"), F.col("seller").alias("other")), F.struct(F.col("seller").alias("company"), F.lit("customer").alias("role"), F.col("buyer").alias("other")))).alias("x")).select("x.*").distinct()


def ego_arms(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, arm, other, detail: everything next to each company, from one pass over the edges."""

    def arm(name: str, a: str, b: str, key: str | None = None) -> Column:
        detail = F.coalesce(F.get_json_object("properties", f"$.{key}"), F.lit("")) if key else F.lit("")
        return F.struct(F.col(a).alias("company"), F.lit(name).alias("arm"), F.col(b).alias("other"), detail.alias("detail"))

    def both(name: str, key: str | None = None) -> Column:
        return F.array(arm(name, "source", "target", key), arm(name, "target", "source", key))

    of = {
        "part_of": F.array(arm("sector", "source", "target")),
        "exposed_to": F.array(arm("theme", "source", "target")),
        "competes_with": both("peer"),
        "same_group": both("sibling"),
        "jv_with": both("jv", "venture"),
        "acquired": F.array(arm("acquired", "source", "target", "year")),
        "subsidiary_of": F.array(arm("parent", "source", "target")),
        "supplier_to": F.array(arm("customer", "source", "target"), arm("supplier", "target", "source")),
        "customer_of": F.array(arm("supplier", "source", "target"), arm("customer", "target", "source")),
        "co_mentioned_in": both("co_mention"),
    }
    arms = F.lit(None)
    for name, rows in of.items():
        arms = F.when(F.col("edge_type") == name, rows).otherwise(arms)
    return _of(edges, *of, as_of=as_of).select(F.explode(arms).alias("x")).select("x.*")


def ego_bundle(edges: DataFrame, companies: DataFrame, as_of: str | None = None) -> DataFrame:
    """company, arm, n, others: the distinct neighbours of each company by arm, in order."""
    arms = ego_arms(edges, as_of).join(companies.select(F.col("name").alias("company")), "company", "left_semi")
    item = F.when(F.col("detail") == "", F.col("other")).otherwise(F.concat("other", F.lit(":"), "detail"))
    bundle = arms.groupBy("company", "arm").agg(F.sort_array(F.collect_set(item)).alias("items"))
    return bundle.select("company", "arm", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("others"))


def cap_histogram(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """sector, market_cap ('unknown' if none), n."""
    return sector_members(edges, entities).groupBy("sector", F.coalesce("market_cap", F.lit("unknown")).alias("market_cap")).agg(F.count(F.lit(1)).alias("n"))


def co_mention_top(edges: DataFrame, n: int = 15) -> DataFrame:
    """The entities that come first in most co-mentions (one row an edge is kept, under its first name)."""
    return _of(edges, "co_mentioned_in").groupBy(F.col("source").alias("entity")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(n)


def cross_sector_bridges(edges: DataFrame) -> DataFrame:
    """edge_type, sector_a, sector_b, n: deals between companies of different sectors."""
    of = sector_of(edges)
    e = _of(edges, "jv_with", "acquired").join(of.withColumnRenamed("sector", "sector_a"), F.col("source") == F.col("company")).drop("company")
    e = e.join(of.withColumnRenamed("sector", "sector_b"), F.col("target") == F.col("company"))
    return e.where("sector_a <> sector_b").groupBy("edge_type", "sector_a", "sector_b").agg(F.count(F.lit(1)).alias("n"))


def cloud_nodes(edges: DataFrame, entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """name, kind ('unknown' if not listed), degree over edges of the types."""
    e = edges.where(F.col("edge_type").isin(types)) if types else edges
    ends = e.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    return ends.join(entities.select("name", "kind"), "name", "left").select("name", F.coalesce("kind", F.lit("unknown")).alias("kind"), "degree")


def expansion(walk: DataFrame, seeds: DataFrame, hops: int = 2, leave_out: tuple[str, ...] = ("co_mentioned_in", "cited_in")) -> DataFrame:
    """name, hop: what is reached from the seeds over structured edges."""
    step = walk.where(~F.col("edge_type").isin(*leave_out)).select("a", "b").distinct()
    seen = seeds.select("name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        new = step.join(front.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        front = new.join(seen, "name", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


# How much a fact of each type matters; less is more.
PRIORITY = {t: i for i, t in enumerate(PRIORITY_TYPES)}


def top_facts(edges: DataFrame, names: DataFrame, budget: int) -> DataFrame:
    """The facts about a set of names that fit a budget: by priority, weight, names."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    hit = names.select("name")
    e = edges.withColumn("priority", rank[F.col("edge_type")])
    touch = e.join(hit, e.source == hit.name, "left_semi").unionByName(e.join(hit, e.target == hit.name, "left_semi").join(hit, e.source == hit.name, "left_anti"))
    cols = ["priority", F.desc("weight"), "source", "target", "edge_type"]
    return touch.orderBy(*cols).limit(budget).select("source", "edge_type", "target", "priority", "weight")


def sector_rollup(names: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(names.select("name"), "name", "left_semi").where("sector is not null").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def context_pack(facts: DataFrame, title: str) -> tuple[str, int]:
    """A Markdown text of facts within a budget (so few rows) and its estimated tokens."""
    lines = [f"# {title}", ""] + [f"- {r.source} {r.edge_type} {r.target}" for r in facts.collect()]
    text = "\n".join(lines) + "\n"
    return text, -(-len(text) // 4)


def entity_page(entities: DataFrame, tags: DataFrame, kind: str, sector: str | None = None, cap: str | None = None, like: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of entities by name, with the total of all pages."""
    out = entities.where(F.col("kind") == kind)
    has = lambda c: out.join(tags.where(c).select(F.col("entity_name").alias("name")), "name", "left_semi")
    if sector:
        out = has(F.lower("tag") == f"sector/{sector.lower()}")
    if cap:
        out = has(F.lower("tag") == f"market_cap/{cap.lower()}")
    if like:
        by_tag = tags.where(F.lower("tag").contains(like.lower())).select(F.col("entity_name").alias("name")).distinct().withColumn("t", F.lit(True))
        out = out.join(by_tag, "name", "left").where(F.lower("name").contains(like.lower()) | F.coalesce("t", F.lit(False))).drop("t")
    total = out.agg(F.count(F.lit(1)).alias("total"))
    page = out.orderBy("name").offset(offset).limit(limit).select("name", "kind", "sector", "market_cap")
    return page.crossJoin(F.broadcast(total))  # one row


def entity_tags(entities: DataFrame) -> DataFrame:
    """entity_name, tag: ``sector/..`` and ``market_cap/..`` of companies."""
    c = entities.where("kind = 'company'")
    tags = F.array_compact(F.array(F.concat(F.lit("sector/"), F.lower("sector")), F.concat(F.lit("market_cap/"), "market_cap")))
    return c.select(F.col("name").alias("entity_name"), F.explode(tags).alias("tag"))


def tags_by_entity(tags: DataFrame) -> DataFrame:
    """entity_name, tags in order, market_cap: the rest of the least market-cap tag."""
    prefix = "market_cap/"
    cap = F.min(F.when(F.col("tag").startswith(prefix), F.col("tag")))
    return tags.groupBy("entity_name").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"), F.substr(cap, F.lit(len(prefix) + 1)).alias("market_cap"))


def resolve(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """query, name, step: exact name (1), else without regard to ASCII case (2), else ticker (3)."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = _union([entities.select(k.alias("key"), "name", F.lit(i).alias("step")).where("key is not null") for i, k in enumerate((F.col("name"), fold(F.col("name")), fold(F.col("ticker"))), 1)])
    q = _union([queries.select("query", k.alias("key"), F.lit(i).alias("step")) for i, k in enumerate((F.col("query"), fold(F.col("query")), fold(F.col("query"))), 1)])
    hits = q.join(keys, ["key", "step"]).groupBy("query").agg(F.min(F.struct("step", "name")).alias("m"))
    return queries.join(hits, "query", "left").select("query", F.col("m.name").alias("name"), F.col("m.step").alias("step"))


def metric_top(values: DataFrame, n: int) -> DataFrame:
    """The n largest values with the total of rows: two aggregations, no global window."""
    total = values.agg(F.count(F.lit(1)).alias("total"))
    return values.orderBy(F.desc("value"), "name").limit(n).crossJoin(F.broadcast(total))  # one row


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


STRUCTURAL = tuple(t for t in PRIORITY if t not in MEMBERSHIP)
