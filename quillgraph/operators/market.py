"""Market figures, financial measures in prose, the sector hierarchy, and how well search finds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import pairs_within, rows_of

# Measures of a quote service by its field names, with unit and period.
FIELDS = {
    "marketCap": ("market_capitalization", "crore_inr", "latest"),
    "totalRevenue": ("total_revenue", "crore_inr", "TTM"),
    "grossMargins": ("gross_margin", "percent", "TTM"),
    "operatingMargins": ("operating_margin", "percent", "TTM"),
    "profitMargins": ("net_profit_margin", "percent", "TTM"),
    "debtToEquity": ("debt_to_equity", "ratio", "TTM"),
    "trailingPE": ("pe_ratio", "ratio", "latest"),
    "priceToBook": ("price_to_book", "ratio", "latest"),
    "beta": ("beta", "dimensionless", "latest"),
    "revenueGrowth": ("revenue_growth_yoy", "percent", "TTM"),
    "earningsGrowth": ("earnings_growth_yoy", "percent", "TTM"),
    "heldPercentInsiders": ("held_percent_insiders", "percent", "latest"),
    "heldPercentInstitutions": ("held_percent_institutions", "percent", "latest"),
}
USD_IN_INR = 83.0


def market_measures(quotes: DataFrame) -> DataFrame:
    """entity, metric_label, value_num, unit, period of (entity, field, value, currency).

    Shares below 1 become percent; rupees become crores; revenue in dollars is
    converted.  Fields that are not known, and values that are no numbers, go.
    """
    table = quotes.sparkSession.createDataFrame([(k, *v) for k, v in FIELDS.items()], "field string, metric_label string, unit string, period string")
    v = F.col("value").try_cast("double")
    rupees = F.when((F.col("metric_label") == "total_revenue") & (F.col("currency") == "USD"), v * USD_IN_INR).otherwise(v)
    out = F.when((F.col("unit") == "percent") & (rupees < 1), rupees * 100).when(F.col("unit") == "crore_inr", rupees / 1e7).otherwise(rupees)
    rows = quotes.join(F.broadcast(table), "field").withColumn("value_num", out).where("value_num is not null")  # a row a field
    return rows.select("entity", "metric_label", "value_num", "unit", "period")


def industry_competitors(companies: DataFrame) -> DataFrame:
    """source, target: all pairs of companies (name, industry) of one industry."""
    return pairs_within(companies.where("industry is not null and industry <> ''"), "industry", "name").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("competes_with").alias("edge_type"))


# How amounts are written, what makes a number no amount, and the nouns of measures.
AMOUNTS = [
    re.compile(r"(?:₹\s?|rs\.?\s*|inr\s*)[\d,]+(?:\.\d+)?\s*(?:crore[s]?|cr\b|lakh[s]?|bn\b|mn\b|billion|million)", re.I),
    re.compile(r"(?:usd\s|\$)\s?[\d,]+(?:\.\d+)?\s*(?:bn\b|mn\b|billion|million)", re.I),
    re.compile(r"\b\d[\d,]*(?:\.\d+)?\s*[-–to ]+\s*\d+\s*(?:bps|basis points)|\b\d+(?:\.\d+)?\s*(?:bps|basis points)", re.I),
    re.compile(r"\b\d[\d,]*(?:\.\d+)?\s*[-–to ]+\s*\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*%"),
    re.compile(r"\b\d[\d,]*(?:\.\d+)?\s*(?:gw|mw)\b", re.I),
    re.compile(r"\b\d+(?:\.\d+)?x\b"),
]
NO_AMOUNT = re.compile(r"\b(employees?|stores?|outlets?|branches?|customers?|users?|subscribers?|people|passengers?|units?|vehicles?|cars?|two-wheelers?|stores opened|cities|countries|lives|beds|mw installed|screens?)\b", re.I)
RATIO = re.compile(r"(?:debt|ebitda|equity|turnover|multiple|times|ratio|cover|lever(?:age|ed)?)", re.I)
NOUNS = [
    ("margin", r"\bmargin[s]?\b|\bebitda\b|\boperating margin\b"),
    ("revenue", r"\brevenue\b|\bturnover\b|\bnet sales\b|\btopline\b|\btop line\b"),
    ("profit", r"\bprofit\b|\bpat\b|\bnet income\b|\bearnings\b"),
    ("capex", r"\bcapex\b|\bcapital expenditure\b|\bspend\b|\bsanctioned\b"),
    ("aum", r"\baum\b|assets under management"),
    ("order_book", r"\border book\b|\border pipeline\b|\bbid pipeline\b"),
    ("growth", r"\bgrowth\b|\byoy\b|\bcagr\b"),
    ("market_share", r"\bmarket share\b"),
    ("stake", r"\bstake\b"),
    ("debt", r"\bdebt\b|\bborrowings?\b|\bnet debt\b"),
]
PERIODS = (re.compile(r"\b(?:Q[1-4]\s*)?FY\s?\d{2,4}\b|\bQ[1-4]\s*CY\s?\d{2,4}\b", re.I), re.compile(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(20\d{2})\b", re.I))
UNITS = [("crore", r"crore|\bcr\b"), ("lakh", r"lakh"), ("bps", r"bps|basis point"), ("percent", r"%"), ("bn_usd", r"(?=.*(\$|usd)).*(\bbn\b|billion)"), ("mn_usd", r"(?=.*(\$|usd)).*(\bmn\b|million)"), ("gw", r"\bgw\b"), ("mw", r"\bmw\b"), ("x", r"x$")]


def noun_of(text: str) -> str | None:
    for label, pattern in NOUNS:
        if re.search(pattern, text):
            return "ebitda_margin" if label == "margin" and re.search(r"\bebitda\b", text) else label
    return None


def measures_of(text: str | None) -> list[tuple]:
    """(label, raw, value, unit, period, quote) of amounts in sentences.

    Sentences that count people or things have none; a multiple counts only by a
    word of ratios near it.  The label is of the nearest 30 characters before,
    else of the 25 after; of a range the lower bound is the value.
    """
    out, seen = [], set()
    for line in (text or "").splitlines():
        if len(line.strip()) < 15:
            continue
        for sentence in map(str.strip, re.split(r"(?<=[.!?])\s+", line.strip())):
            if len(sentence) < 12 or NO_AMOUNT.search(sentence):
                continue
            period = next((m[0].strip() for p in PERIODS if (m := p.search(sentence))), None)
            for pattern in AMOUNTS:
                for m in pattern.finditer(sentence):
                    raw = m[0].strip()
                    near = sentence[max(0, m.start() - 25) : m.end() + 25]
                    if pattern is AMOUNTS[-1] and not RATIO.search(near) or (raw, sentence[:60]) in seen:
                        continue
                    seen.add((raw, sentence[:60]))
                    label = noun_of(sentence[max(0, m.start() - 30) : m.start()].lower()) or noun_of(sentence[m.start() : m.start() + len(raw) + 25].lower())
                    number = re.search(r"\d[\d,]*(?:\.\d+)?", raw)
                    unit = next((u for u, p in UNITS if re.search(p, raw.lower())), None)
                    out.append((label, raw, float(number[0].replace(",", "")) if number else None, unit, period, sentence))
    return out


def measures(docs: DataFrame) -> DataFrame:
    """id, label, raw, value, unit, period, quote of (id, text)."""
    return rows_of(docs, measures_of, ["label", "raw", "value", "unit", "period", "quote"], "id long, label string, raw string, value double, unit string, period string, quote string")


def built_hierarchy(taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, kind) and belongs_to edges (source, target) of (child, parent, kind)
    rows, where kind is the child's: sector or sub_sector."""
    tops = taxonomy.where("kind = 'sector'").select(F.col("parent").alias("name"), F.lit("super_sector").alias("kind")).distinct()
    subs = taxonomy.where("kind = 'sub_sector'").select(F.col("child").alias("name"), "kind").distinct()
    edges = taxonomy.select(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("belongs_to").alias("edge_type")).distinct()
    return tops.unionByName(subs), edges


def taxonomy_faults(taxonomy: DataFrame, sectors: DataFrame) -> DataFrame:
    """fault, name: sectors (name) that nothing maps, mapped twice or not there; parents of
    sub-sectors that are no sectors; and names of other levels that are a sector's or repeat."""
    of, subs = taxonomy.where("kind = 'sector'"), taxonomy.where("kind = 'sub_sector'")
    live = sectors.select("name").distinct()
    row = lambda df, fault, col="name": df.select(F.lit(fault).alias("fault"), F.col(col).alias("name")).distinct()
    name = lambda df, col: df.select(F.col(col).alias("name")).distinct()
    several = lambda df: df.groupBy("child").agg(F.countDistinct("parent").alias("n")).where("n > 1")
    parts = [
        row(name(of, "child").join(live, "name", "left_anti"), "unknown_sector"),
        row(live.join(name(of, "child"), "name", "left_anti"), "unmapped_sector"),
        row(several(of), "mapped_twice", "child"),
        row(name(subs, "parent").join(live, "name", "left_anti"), "unknown_parent"),
        row(name(of, "parent").join(live, "name", "left_semi"), "super_sector_collides"),
        row(name(subs, "child").join(live, "name", "left_semi"), "sub_sector_collides"),
        row(several(subs), "sub_sector_repeats", "child"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall_at(questions: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """category, mode, n, recall: the share of questions (question, category, expect) of which
    one of the expected is among the first k hits (question, mode, place from 0, found)."""
    modes = hits.select("mode").distinct()
    asked = questions.select("question", "category").distinct().crossJoin(F.broadcast(modes))  # a few modes
    good = hits.where(F.col("place") < k).join(questions, (hits.question == questions.question) & (F.col("found") == F.col("expect"))).select(hits.question.alias("question"), "mode").distinct().withColumn("hit", F.lit(1))
    got = asked.join(good, ["question", "mode"], "left")
    return got.groupBy("category", "mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall"))


def same_label_share(neighbours: DataFrame, least: int = 3) -> DataFrame:
    """One row: of the rows asked about (query, label, found_label) how many have ``least`` or more neighbours of their own label."""
    per = neighbours.groupBy("query").agg(F.count(F.when(F.col("label") == F.col("found_label"), 1)).alias("same"))
    return per.agg(F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("same") >= least, 1)).alias("good"))

