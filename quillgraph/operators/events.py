"""Events of companies: from dated edges and from what notes say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How periods, figures, forecasts, changes of office and titles are written.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
MONTH_NUMBERS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
NOISE = r"(?i)\b(?:Yahoo\s+Finance|Bloomberg|Source:\s*Yahoo|as\s+of\s+\w+\s+20\d{2})[^\n]*"
FISCAL = r"(?i)\b(?:Q[1-4]\s*)?FY\s?\d{2,4}\b"
QUARTER = r"(?i)\bQ[1-4]\s*CY\s?\d{2,4}\b"
MONTH_YEAR = rf"(?i)\b(?:{MONTHS})\.?\s+20\d{{2}}\b"
PERCENT = r"\b\d[\d,]*\s*[-–to ]+\s*\d+\s*%|\b\d+\s*%"
MONEY = r"(?i)₹|rs\.?\s|inr|\brevenue\b|\bmargin[s]?\b|\border book\b|\bgrowth\b|\btarget\b|\bcapex\b|\baum\b|\bmarket share\b|\bcapacity\b"
FORWARD = r"(?i)\b(target|targets|targeting|expect|expects|expected|guidance|guide|guided|plan|plans|planning|aim|aims|project|projects|projected|eye|eyes|reiterate|reiterated|outlook|aspire|aspiration|aspirational|conservatively|capex|ramp|will\s+(?:reach|cross|hit|grow|deliver|achieve|generate|be|do))\b"
CHANGE = r"(?i)\b(appointed|takes over|took over|taking over|stepped down|stepping down|resigned|rejoined|succeeds|to succeed|promoted to|elevated to|assumes charge|set to (?:lead|head|take over)|incoming)\b"
NO_CHANGE = r"(?i)\bappointed\s+(actuary|auditor|receiver|liquidator|trustee)s?\b"
TITLE = r"(?i)\b(CEO|CFO|COO|CTO|MD|Managing Director|Chief Executive Officer|Chief Financial Officer|Chief Operating Officer|Chief Technology Officer|Chairman|Executive Chairman|Vice Chairman|Whole.time Director|Director)\b"
PERSON = r"([A-Z][a-zA-Z.]+(?:\s+[A-Z][a-zA-Z.]+){1,3})"
OF_EDGE = {"acquired": "acquisition", "jv_with": "jv"}
AMOUNTS = ("stake", "amount", "aum", "value", "premium", "consideration")
FIRST_YEAR = 2018
COLUMNS = ["entity", "event_type", "event_date", "period", "date_precision", "magnitude", "counterparty", "source_quote", "as_of_edition", "source_ref", "properties"]


def day_of(text: Column, this_year: int) -> Column:
    """The day (first of a month or year, as text) that a passage is about: a month
    with its year, else a fiscal quarter (the year begins in April), else the
    earliest year from 2018 to ``this_year``; null without any."""
    clean = F.regexp_replace(text, NOISE, " ")
    month = F.lower(F.substring(F.regexp_extract(clean, rf"(?i)\b({MONTHS})\.?\s+(20\d{{2}})\b", 1), 1, 3))
    year = F.regexp_extract(clean, rf"(?i)\b({MONTHS})\.?\s+(20\d{{2}})\b", 2)
    number = F.lit(None).cast("int")
    for m, i in MONTH_NUMBERS.items():
        number = F.when(month == m, i).otherwise(number)
    by_month = F.when(number.isNotNull(), F.format_string("%s-%02d-01", year, number))
    q, fy = (F.regexp_extract(clean, r"\bQ([1-4])\s*(?:FY|fy)\s*(\d{2})\b", k).try_cast("int") for k in (1, 2))
    by_quarter = F.when(q.isNotNull(), F.format_string("%04d-%02d-01", 2000 + fy - F.when(q == 4, 0).otherwise(1), F.when(q == 4, 1).otherwise(q * 3 + 1)))
    years = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(FIRST_YEAR, this_year))
    by_year = F.when(F.size(years) > 0, F.format_string("%04d-01-01", F.array_min(years)))
    return F.coalesce(by_month, by_quarter, by_year)


def period_of(text: Column) -> Column:
    """The first fiscal period, calendar quarter or month and year, as written."""
    some = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit(""))
    return F.coalesce(some(FISCAL), some(QUARTER), some(MONTH_YEAR))


def precision_of(day: Column) -> Column:
    return F.when(day.isNull(), "none").when(day.endswith("-01-01"), "year").when(day.endswith("-01"), "month").otherwise("day")


def windows(notes: DataFrame) -> DataFrame:
    """Distinct (entity, edition, window) of (entity, edition, body): lines, and sentences of 25 characters or more."""
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), F.trim), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), F.trim), lambda y: F.length(y) >= 25)))
    return notes.select("entity", "edition", F.explode(F.array_distinct(F.concat(lines, parts))).alias("window"))


def _row(df: DataFrame, kind: str, ref: str, magnitude: Column, properties: Column, this_year: int) -> DataFrame:
    w = F.col("window")
    day = day_of(w, this_year)
    none = F.lit(None).cast("string")
    out = df.withColumn("day", day)
    return out.select("entity", F.lit(kind).alias("event_type"), F.col("day").cast("date").alias("event_date"), F.coalesce(period_of(w), F.substring("day", 1, 4)).alias("period"), precision_of(F.col("day")).alias("date_precision"), magnitude.alias("magnitude"), none.alias("counterparty"), w.alias("source_quote"), F.col("edition").alias("as_of_edition"), F.lit(ref).alias("source_ref"), properties.alias("properties"))


def longest(events: DataFrame) -> DataFrame:
    """Of an entity's events of one type, period and magnitude the one with the longest quote."""
    order = Window.partitionBy("entity", "event_type", "period", "magnitude").orderBy(F.desc(F.length("source_quote")), "source_quote", "as_of_edition")
    return events.withColumn("k_", F.row_number().over(order)).where("k_ = 1").drop("k_")


def guidance(notes: DataFrame, this_year: int) -> DataFrame:
    """Forecasts: a fiscal period, a figure or measure, and a word that looks ahead."""
    w = F.col("window")
    share = F.nullif(F.trim(F.regexp_extract(w, PERCENT, 0)), F.lit(""))
    hit = windows(notes).where((w.rlike(FISCAL) | w.rlike(QUARTER)) & (w.rlike(PERCENT) | w.rlike(MONEY)) & w.rlike(FORWARD))
    return longest(_row(hit, "guidance", "derive:events:guidance-prose", share, F.lit("{}"), this_year))


def management(notes: DataFrame, this_year: int) -> DataFrame:
    """Changes of office: a verb of change and a title, but no appointed actuary or the like."""
    w = F.col("window")
    hit = windows(notes).where(w.rlike(CHANGE) & ~w.rlike(NO_CHANGE) & w.rlike(TITLE))
    role, person = F.regexp_extract(w, TITLE, 0), F.nullif(F.trim(F.regexp_extract(w, PERSON, 1)), F.lit(""))
    return longest(_row(hit, "management_change", "derive:events:management-prose", role, F.to_json(F.struct(role.alias("role"), person.alias("person"))), this_year))


def promoted(edges: DataFrame) -> DataFrame:
    """Events from acquisitions and joint ventures among edges."""
    get = lambda k: F.nullif(F.get_json_object("properties", f"$.{k}"), F.lit(""))
    day = F.col("valid_from").cast("string")
    precision = F.when(day.isNull(), None).when(day.endswith("-01-01"), "year").otherwise("month")
    kind = F.lit(None).cast("string")
    for t, e in OF_EDGE.items():
        kind = F.when(F.col("edge_type") == t, e).otherwise(kind)
    rows = edges.where(F.col("edge_type").isin(*OF_EDGE))
    return rows.select(F.col("source").alias("entity"), kind.alias("event_type"), F.col("valid_from").alias("event_date"), get("year").alias("period"), precision.alias("date_precision"), F.coalesce(*[get(k) for k in AMOUNTS]).alias("magnitude"), F.col("target").alias("counterparty"), get("quote").alias("source_quote"), F.coalesce(get("edition"), get("ref")).alias("as_of_edition"), F.lit("derive:events:edge-promotion").alias("source_ref"), F.coalesce("properties", F.lit("{}")).alias("properties"))


def all_events(edges: DataFrame, notes: DataFrame, this_year: int) -> DataFrame:
    return promoted(edges).unionByName(guidance(notes, this_year)).unionByName(management(notes, this_year))
