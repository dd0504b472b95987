"""The graph model as views over order data: who supplies whom, who is met with whom.

Every view has a twin in SQL (``MODEL_SQL``), so that queries over it can be
checked against another engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import staged

#: The tables that the model is derived from.
SOURCES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]
URGENT = "1-URGENT"
YEAR = 1995
PAIR_TYPES = ("acquired", "jv_with", "competes_with", "same_group", "subsidiary_of", "customer_of")


def cap_of(balance: Column) -> Column:
    return F.when(balance < 0, "micro_cap").when(balance < 3000, "small_cap").when(balance < 6000, "mid_cap").otherwise("large_cap")


@dataclass
class Model:
    """Entities, edges, tags and embeddings of one data directory."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def built(self) -> dict[str, DataFrame]:
        """Entities, edges (files apart by type) and the part graph, written once for all queries."""
        tables = {"entity": self._entities, "edge": self._edges, "part_edge": self._part_graph}
        return staged(self.spark, self.root, SOURCES, tables, {"edge": "edge_type"})

    @property
    def entities(self) -> DataFrame:
        """name, kind, sector, market_cap, ticker."""
        return self.built["entity"]

    @property
    def edges(self) -> DataFrame:
        """source, target, edge_type, weight, valid_from, valid_to, properties."""
        return self.built["edge"]

    @property
    def part_graph(self) -> DataFrame:
        """Parts met in the same urgent order, as undirected edges (src < dst)."""
        return self.built["part_edge"]

    def _entities(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_name")
        supplier = self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        customer = self.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        none = F.lit(None).cast("string")
        parts = [
            supplier.select(F.col("s_name").alias("name"), F.lit("company").alias("kind"), F.col("n_name").alias("sector"), cap_of(F.col("s_acctbal")).alias("market_cap"), F.concat(F.lit("S"), "s_suppkey").alias("ticker")),
            customer.select(F.col("c_name").alias("name"), F.lit("company").alias("kind"), F.col("n_name").alias("sector"), cap_of(F.col("c_acctbal")).alias("market_cap"), none.alias("ticker")),
            nation.select(F.col("n_name").alias("name"), F.lit("sector").alias("kind"), none.alias("sector"), none.alias("market_cap"), none.alias("ticker")),
            self.table("region").select(F.col("r_name").alias("name"), F.lit("super_sector").alias("kind"), none.alias("sector"), none.alias("market_cap"), none.alias("ticker")),
            self.table("part").select(F.col("p_brand").alias("name")).distinct().select("name", F.lit("theme").alias("kind"), none.alias("sector"), none.alias("market_cap"), none.alias("ticker")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def companies(self) -> DataFrame:
        return self.entities.where("kind = 'company'")

    @cached_property
    def urgent_lines(self) -> DataFrame:
        orders = self.table("orders").where((F.col("o_orderpriority") == URGENT) & (F.year("o_orderdate") == YEAR)).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Suppliers met in the same urgent order: a, b (keys, a < b), n, first, last."""
        seen = self.urgent_lines.select("l_orderkey", "day", "l_suppkey").distinct()
        x, y = seen.alias("x"), seen.alias("y")
        both = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.l_suppkey") < F.col("y.l_suppkey")))
        return both.groupBy(F.col("x.l_suppkey").alias("a"), F.col("y.l_suppkey").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("x.day").alias("first"), F.max("x.day").alias("last"))

    def _edges(self) -> DataFrame:
        nothing, day = F.lit(None).cast("string"), F.lit(None).cast("date")

        def rows(df: DataFrame, source: str, target: str, kind: Column | str, weight: Column | None = None, start: Column | None = None, end: Column | None = None, props: Column | None = None) -> DataFrame:
            kind = F.lit(kind) if isinstance(kind, str) else kind
            return df.select(F.col(source).alias("source"), F.col(target).alias("target"), kind.alias("edge_type"), (F.lit(1.0) if weight is None else weight).alias("weight"), (day if start is None else start).alias("valid_from"), (day if end is None else end).alias("valid_to"), (nothing if props is None else props).alias("properties"))

        nation, region, supplier = self.table("nation"), self.table("region"), self.table("supplier").select("s_suppkey", "s_name")
        up = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        one = lambda a, b, t: F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(t).alias("t"))
        of = self._entities().where("kind = 'company'").select(F.explode(F.array(one("name", "sector", "part_of"), one("sector", "name", "has_company"))).alias("e")).select("e.*")
        exposed = self.table("lineitem").where("l_quantity >= 45").select("l_suppkey", "l_partkey")
        exposed = exposed.join(self.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).cast("double").alias("n")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        supplied = self.urgent_lines.groupBy("l_suppkey", "o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("day").alias("first"))
        supplied = supplied.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        p = self.pairs.join(supplier.select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("a_name")), "a").join(supplier.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("b_name")), "b")
        k = (F.col("a") + F.col("b")) % 7
        kind = F.try_element_at(F.array(*[F.lit(t) for t in PAIR_TYPES]), (k + 1).cast("int"))
        props = F.when(k == 0, F.concat(F.lit('{"year": "'), F.year("first").cast("string"), F.lit('"}'))).when(k == 1, F.concat(F.lit('{"venture": "V'), ((F.col("a") * 31 + F.col("b")) % 97).cast("string"), F.lit('"}')))
        end = F.when((k <= 1) & (F.col("n") > 1), F.date_add("last", 365))
        as_edge = lambda t, w, start, end, props: F.struct(t.alias("edge_type"), w.alias("weight"), start.alias("valid_from"), end.alias("valid_to"), props.alias("properties"))
        met, typed = as_edge(F.lit("co_mentioned_in"), F.col("n"), day, day, nothing), as_edge(kind, F.lit(1.0), F.col("first"), end, props)
        parts = [
            rows(up, "n_name", "r_name", "belongs_to"),
            rows(of, "source", "target", F.col("t")),
            rows(exposed, "s_name", "p_brand", "exposed_to", F.col("n")),
            rows(supplied, "s_name", "c_name", "supplier_to", F.col("n"), F.col("first")),
            p.select("a_name", "b_name", F.explode(F.array_compact(F.array(met, F.when(k < 6, typed)))).alias("e")).select(F.col("a_name").alias("source"), F.col("b_name").alias("target"), "e.*"),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    @cached_property
    def walk(self) -> DataFrame:
        """Every edge in both directions: a, b, edge_type, valid_from, valid_to, properties."""
        way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
        both = F.explode(F.array(way("source", "target"), way("target", "source")))
        return self.edges.select(both.alias("w"), "edge_type", "weight", "valid_from", "valid_to", "properties").select("w.*", "edge_type", "weight", "valid_from", "valid_to", "properties")

    def _part_graph(self) -> DataFrame:
        seen = self.urgent_lines.select("l_orderkey", "l_partkey").distinct()
        x, y = seen.alias("x"), seen.alias("y")
        both = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.l_partkey") < F.col("y.l_partkey")))
        return both.select(F.col("x.l_partkey").alias("src"), F.col("y.l_partkey").alias("dst")).distinct()


_CAP = "CASE WHEN {0} < 0 THEN 'micro_cap' WHEN {0} < 3000 THEN 'small_cap' WHEN {0} < 6000 THEN 'mid_cap' ELSE 'large_cap' END"
MODEL_SQL = f"""
urgent AS (
  SELECT l_orderkey, l_suppkey, l_partkey, o_custkey, CAST(o_orderdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderpriority = '{URGENT}' AND year(o_orderdate) = {YEAR}),
entity AS (
  SELECT s_name AS name, 'company' AS kind, n_name AS sector, {_CAP.format("s_acctbal")} AS market_cap, 'S' || s_suppkey AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'company', n_name, {_CAP.format("c_acctbal")}, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'sector', NULL, NULL, NULL FROM nation
  UNION ALL SELECT r_name, 'super_sector', NULL, NULL, NULL FROM region
  UNION ALL SELECT DISTINCT p_brand, 'theme', NULL, NULL, NULL FROM part),
seen AS (SELECT DISTINCT l_orderkey, day, l_suppkey FROM urgent),
pair AS (
  SELECT x.l_suppkey AS a, y.l_suppkey AS b, CAST(count(*) AS DOUBLE) AS n, min(x.day) AS first, max(x.day) AS last
  FROM seen x JOIN seen y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2),
named AS (
  SELECT p.*, s1.s_name AS a_name, s2.s_name AS b_name, (p.a + p.b) % 7 AS k
  FROM pair p JOIN supplier s1 ON s1.s_suppkey = p.a JOIN supplier s2 ON s2.s_suppkey = p.b),
edge AS (
  SELECT n_name AS source, r_name AS target, 'belongs_to' AS edge_type, 1.0::DOUBLE AS weight, NULL::DATE AS valid_from, NULL::DATE AS valid_to, NULL::VARCHAR AS properties FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT name, sector, 'part_of', 1.0, NULL, NULL, NULL FROM entity WHERE kind = 'company'
  UNION ALL SELECT sector, name, 'has_company', 1.0, NULL, NULL, NULL FROM entity WHERE kind = 'company'
  UNION ALL SELECT s_name, p_brand, 'exposed_to', CAST(count(*) AS DOUBLE), NULL, NULL, NULL FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 GROUP BY 1, 2
  UNION ALL SELECT s_name, c_name, 'supplier_to', CAST(count(*) AS DOUBLE), min(day), NULL, NULL FROM urgent JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
  UNION ALL SELECT a_name, b_name, 'co_mentioned_in', n, NULL, NULL, NULL FROM named
  UNION ALL SELECT a_name, b_name, CASE k {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PAIR_TYPES))} END, 1.0, first,
    CASE WHEN k <= 1 AND n > 1 THEN CAST(last + INTERVAL 365 DAY AS DATE) END,
    CASE k WHEN 0 THEN '{{"year": "' || year(first) || '"}}' WHEN 1 THEN '{{"venture": "V' || ((a * 31 + b) % 97) || '"}}' END FROM named WHERE k < 6),
walk AS (
  SELECT source AS a, target AS b, edge_type, weight, valid_from, valid_to, properties FROM edge
  UNION ALL SELECT target, source, edge_type, weight, valid_from, valid_to, properties FROM edge),
part_edge AS (
  SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM urgent) x JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM urgent) y
  ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey)
"""


def sql(body: str) -> str:
    """A query over the model's views, for the other engine."""
    return f"WITH RECURSIVE {MODEL_SQL.strip()} {body}"
