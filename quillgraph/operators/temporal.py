"""Validity of edges at a date."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_as_of(text: str | None) -> str | None:
    """``YYYY`` and ``YYYY-MM`` mean their first day; blank means no date; other shapes raise."""
    if text is None or not text.strip():
        return None
    text = text.strip()
    if not re.fullmatch(r"\d{4}(-\d{2}){0,2}", text):
        raise ValueError(f"not a year, month or date: {text!r}")
    return text + "-01-01"[3 * (text.count("-")) :] if len(text) < 10 else text


def valid_at(as_of: str | datetime.date | None, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether an edge holds on a day: both ends count, an open end holds for ever."""
    if as_of is None:
        return F.lit(True)
    day = F.lit(normalise_as_of(str(as_of))).cast("date")
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day))


def edges_by_year(edges: DataFrame) -> DataFrame:
    """Edges a year and type, of all types that have a start."""
    dated = edges.where("valid_from is not null")
    return dated.groupBy(F.year("valid_from").cast("string").alias("year"), "edge_type").agg(F.count(F.lit(1)).alias("n"))


def timeline(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Events of each entity in order: undated ones last, then by date and id."""
    if kinds:
        events = events.where(F.col("event_type").isin(kinds))
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy(F.col("event_date").asc_nulls_last(), "id")
    return events.withColumn("place", F.row_number().over(w))


def validity_coverage(edges: DataFrame) -> DataFrame:
    """A row a type: how many edges have a start, how many lack one, how many have an end."""
    got = lambda c: F.coalesce(F.sum(F.col(c).isNotNull().cast("long")), F.lit(0))
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("total"), got("valid_from").alias("with_from"), F.sum(F.col("valid_from").isNull().cast("long")).alias("missing"), got("valid_to").alias("with_to"))
