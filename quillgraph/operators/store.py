"""Writes as the resulting state of a table.

There is no transactional store: each function returns the new rows, to be
written to a fresh folder and swapped in.  All are idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ["source", "target", "edge_type"]


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str] = EDGE_KEY) -> DataFrame:
    """The table with those new rows of which it lacks the key, one a key."""
    fresh = new.where("source <> target") if {"source", "target"} <= set(new.columns) else new
    order = Window.partitionBy(*key).orderBy(*([c for c in new.columns if c not in key] or key))
    fresh = fresh.join(table.select(*key), key, "left_anti").withColumn("k_", F.row_number().over(order)).where("k_ = 1").drop("k_")
    return table.unionByName(fresh.select(table.columns))


def dry_run(table: DataFrame, new: DataFrame, key: list[str] = EDGE_KEY) -> int:
    """How many new rows have keys that the table lacks; repeats within them count."""
    return new.join(table.select(*key), key, "left_anti").count()


def replace_prefix(table: DataFrame, new: DataFrame, prefix: str, content: list[str]) -> DataFrame:
    """The rows whose source_ref has the prefix become the new ones.

    Rows are matched by content as multisets: equal ones keep all their columns
    (an id, a time of creation), others go or come.
    """
    mine = table.where(F.col("source_ref").startswith(prefix))
    rest = table.where(~F.coalesce(F.col("source_ref").startswith(prefix), F.lit(False)))
    others = [c for c in table.columns if c not in content]
    number = lambda df, order: df.withColumn("k_", F.row_number().over(Window.partitionBy(*content).orderBy(*order)))
    old, now = number(mine, others or content), number(new, [c for c in new.columns if c not in content] or content)
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*content, "k_"]]
    on = same[0]
    for s in same[1:]:
        on &= s
    kept = old.alias("o").join(now.alias("n"), on, "left_semi").drop("k_")
    added = now.alias("n").join(old.alias("o"), on, "left_anti").drop("k_")
    return rest.unionByName(kept).unionByName(added, allowMissingColumns=True).select(table.columns)


def upsert(table: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """New rows replace those of the same key, which hand on their ``keep`` columns."""
    old = table.select(*key, *[F.col(c).alias(f"old_{c}") for c in keep])
    fresh = new.join(old, key, "left")
    for c in keep:
        fresh = fresh.withColumn(c, F.coalesce(f"old_{c}", c)).drop(f"old_{c}")
    return table.join(new.select(*key), key, "left_anti").unionByName(fresh.select(table.columns))


def rename_cascade(table: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Replaces old by new names (old, new) in every reference column."""
    for c in columns:
        table = table.join(names.select(F.col("old").alias(c), F.col("new").alias("new_")), c, "left").withColumn(c, F.coalesce("new_", c)).drop("new_")
    return table


def delete_cascade(table: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    for c in columns:
        table = table.join(names.select(F.col("name").alias(c)), c, "left_anti")
    return table


def move_sector(edges: DataFrame, company: str, to: str, entities: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Moves a company to a sector: its old part_of and has_company rows go, the new
    pair comes in if it is not there; all other rows stay as they are.  With
    ``entities`` (name, sector) their table is returned too, the company's row changed."""
    part, has = (F.col("edge_type") == "part_of") & (F.col("source") == company), (F.col("edge_type") == "has_company") & (F.col("target") == company)
    rest = edges.where(~(part | has) | (part & (F.col("target") == to)) | (has & (F.col("source") == to)))
    pair = edges.sparkSession.createDataFrame([(company, to, "part_of"), (to, company, "has_company")], "source string, target string, edge_type string")
    others = [F.lit(None).cast(t).alias(c) for c, t in edges.dtypes if c not in EDGE_KEY]
    out = insert_or_ignore(rest, pair.select("*", *others).select(edges.columns))
    if entities is None:
        return out
    return out, entities.withColumn("sector", F.when(F.col("name") == company, F.lit(to)).otherwise(F.col("sector")))


def rebuilt(table: DataFrame, schema, key: list[str]) -> DataFrame:
    """The rows under a target schema: its columns in its order and types, one row a key.

    A value that the new type cannot hold, and a null in a column that must have
    one, is an error, so that nothing is lost on the way."""
    casts = [(F.col(f.name) if f.name in table.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    out = table.select(*casts, *[F.col(f.name).alias(f"was_{f.name}") for f in schema.fields if f.name in table.columns])
    lost = F.lit(False)
    for f in schema.fields:
        if f.name in table.columns:
            lost |= F.col(f.name).isNull() & F.col(f"was_{f.name}").isNotNull()
        if not f.nullable:
            lost |= F.col(f.name).isNull()
    if (row := out.where(lost).first()) is not None:
        raise ValueError(f"no such row in the new schema: {row}")
    return out.select(*[f.name for f in schema.fields]).dropDuplicates(key)
