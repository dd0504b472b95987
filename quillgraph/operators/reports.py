"""Reports over a snapshot, and its writing and checking."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MEMBERSHIP
from .rounds import spread


def edge_growth(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce(F.year("valid_from").cast("string"), F.lit("undated")).alias("year"), "edge_type").agg(F.count(F.lit(1)).alias("n"))


def sector_growth(entities: DataFrame, first_seen: DataFrame) -> DataFrame:
    """sector, companies, latest, new: new ones are of the latest year over all sectors."""
    year = F.year("first")
    top = first_seen.agg(F.max(year).alias("top"))
    rows = entities.where("kind = 'company' and sector is not null").join(first_seen, "name", "left").crossJoin(F.broadcast(top))  # one row
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.max(year).alias("latest"), F.count(F.when(year == F.col("top"), 1)).alias("new"))


def top_entities(edges: DataFrame, n: int = 15) -> DataFrame:
    """name, degree (without membership edges), co_mentions, first_year."""
    ends = edges.where(~F.col("edge_type").isin(*MEMBERSHIP)).select(F.explode(F.array("source", "target")).alias("name"), "edge_type", "valid_from")
    out = ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("edge_type") == "co_mentioned_in", 1)).alias("co_mentions"), F.min(F.year("valid_from")).alias("first_year"))
    return out.orderBy(F.desc("degree"), "name").limit(n)


def coverage(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """theme, sector, companies, mentions, and the totals of each theme (sector null)."""
    e = spread(edges.where("edge_type = 'exposed_to'").select("source", "target", "weight"), "source").join(entities.select(F.col("name").alias("source"), "sector"), "source")
    return e.rollup("target", "sector").agg(F.countDistinct("source").alias("companies"), F.sum("weight").alias("mentions")).where("target is not null").withColumnRenamed("target", "theme")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table (footer counts where a table is plain Parquet)."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def write_snapshot(tables: dict[str, DataFrame], to: str) -> None:
    """One folder a table, gzip, each part sorted by all columns; edges apart by type."""
    for name, df in tables.items():
        plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
        w = df.sortWithinPartitions(*plain).write.mode("overwrite").option("compression", "gzip")
        (w.partitionBy("edge_type") if "edge_type" in df.columns else w).parquet(f"{to}/{name}")


def verify_snapshot(tables: dict[str, DataFrame], at: str) -> DataFrame:
    """name, live, stored counts."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        live, stored = df.agg(F.count(F.lit(1)).alias("live")), spark.read.parquet(f"{at}/{name}").agg(F.count(F.lit(1)).alias("stored"))
        row = live.crossJoin(F.broadcast(stored)).select(F.lit(name).alias("name"), "live", "stored")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def exported_schema(tables: dict[str, DataFrame], order: list[str] | None = None) -> str:
    """A JSON text of all schemas, tables that others refer to first if ``order`` says so."""
    names = [n for n in order or [] if n in tables] + sorted(n for n in tables if n not in (order or []))
    return json.dumps([{"table": n, "schema": json.loads(tables[n].schema.json())} for n in names], indent=1)


def restore_snapshot(spark: SparkSession, at: str, schemas: dict, references: list[tuple[str, str, str, str]] = (), to: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot.

    ``references`` (table, column, of table, of column) must hold: a value that
    the other table lacks is an error, and nothing is written then.  With ``to``
    the tables are written to a folder beside it, which then takes its place.
    """
    out = {name: spark.read.schema(schema).parquet(f"{at}/{name}") for name, schema in schemas.items()}
    for table, column, of, key in references:
        gone = out[table].where(F.col(column).isNotNull()).join(out[of].select(F.col(key).alias(column)), column, "left_anti")
        if (row := gone.select(column).first()) is not None:
            raise ValueError(f"{table}.{column}: {row[0]!r} is not in {of}.{key}")
    if to is None:
        return out
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, old = f"{to}.{uuid.uuid4().hex}", f"{to}.{uuid.uuid4().hex}.old"
    for name, df in out.items():
        df.write.parquet(f"{draft}/{name}")
    fs = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(to)):
        fs.rename(path(to), path(old))
    fs.rename(path(draft), path(to))
    fs.delete(path(old), True)
    return {name: spark.read.schema(schema).parquet(f"{to}/{name}") for name, schema in schemas.items()}
