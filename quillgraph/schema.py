"""Logical schemas of the tables and the vocabulary of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(*(x := c.split())[:1], _TYPES[x[1]]) for c in columns.split(", ")])


ENTITIES = _struct("name string, kind string, sector string, market_cap string, ticker string")
EDGES = _struct("source string, target string, edge_type string, weight double, valid_from date, valid_to date, properties string, source_ref string")
EVENTS = _struct("id long, entity string, event_type string, event_date date, period string, date_precision string, magnitude string, counterparty string, source_quote string, as_of_edition string, source_ref string, properties string")
QUOTES = _struct("entity string, quote_text string, speaker_name string, speaker_title string, as_of_edition string, source_ref string")
FIGURES = _struct("entity string, metric_label string, value_raw string, value_num double, unit string, period string, source_quote string")
ANALYTICS = _struct("entity_name string, metric string, value string, computed_at timestamp")
TAGS = _struct("entity_name string, tag string")


@dataclass(frozen=True)
class EdgeType:
    """Kinds at both ends (None: any), whether one row stands for both directions."""

    name: str
    source_kinds: tuple[str, ...] | None = None
    target_kinds: tuple[str, ...] | None = None
    symmetric: bool = False


# The edge types, kinds and event types that queries refer to.
EDGE_TYPES = {
    e.name: e
    for e in (
        EdgeType("part_of", ("company",), ("sector",)),
        EdgeType("has_company", ("sector",), ("company",)),
        EdgeType("belongs_to", ("sector", "sub_sector"), ("super_sector", "sector")),
        EdgeType("exposed_to", ("company", "sector"), ("theme",)),
        EdgeType("cited_in", None, ("edition",)),
        EdgeType("competes_with", ("company",), ("company",), True),
        EdgeType("jv_with", ("company",), ("company",), True),
        EdgeType("same_group", ("company",), ("company",), True),
        EdgeType("supplier_to", ("company",), ("company",)),
        EdgeType("customer_of", ("company",), ("company",)),
        EdgeType("acquired", ("company",), ("company",)),
        EdgeType("subsidiary_of", ("company",), ("company",)),
        EdgeType("co_mentioned_in", ("company",), ("company",), True),
    )
}
KINDS = ("company", "sector", "super_sector", "sub_sector", "theme", "edition")
MARKET_CAPS = ("large_cap", "mid_cap", "small_cap", "micro_cap")
EVENT_TYPES = ("acquisition", "jv", "guidance", "management_change")
#: Membership edges, which say where an entity stands and not what it does.
MEMBERSHIP = ("part_of", "has_company", "belongs_to", "exposed_to")
LINK_PREDICTION_TYPES = ("co_mentioned_in", "jv_with", "competes_with", "same_group")
