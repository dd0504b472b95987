"""Names to entities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import checkpointed

# Endings of company names and words too common to tell names apart.
SUFFIXES = ("Limited", "Ltd", "Private", "Pvt", "Inc", "Corporation", "Corp", "Company", "Co")
# Words left out of names when they are compared as sets, and words that alone do not tell names apart.
STOPWORDS = ("limited", "ltd", "corporation", "corp", "company", "co", "inc", "incorporated", "the", "and", "of", "at", "to", "in", "on", "for", "with", "by", "per", "a", "an", "india", "indian")
GENERIC = (
    "asset", "management", "financial", "finance", "capital", "markets", "services", "solutions", "industries", "holdings", "group", "ventures", "enterprises", "international", "global", "india", "indian", "life", "general", "insurance", "mutual", "fund", "securities",
    "investment", "investments", "credit", "housing", "bank", "banking", "power", "energy", "oil", "gas", "steel", "cement", "pharma", "healthcare", "technology", "technologies", "retail", "consumer",
)
# The same for names that prose mentions.
MENTION_STOPWORDS = ("ltd", "ltd.", "limited", "pvt", "private", "company", "co", "co.", "inc", "inc.", "corp", "corporation", "the", "of", "and", "&")
MENTION_GENERIC = ("bank", "financial", "finance", "services", "holdings", "industries", "capital", "group", "technologies", "technology", "energy", "power", "oil", "gas", "insurance", "auto", "motors", "chemicals", "pharma", "steel", "cement", "realty", "retail", "enterprises")
OF_COUNTRY = r"(?i)^(?:the|a|an|sweden'?s|japan'?s|germany'?s|korea'?s|france'?s|usa'?s|u\.s\.'?s|china'?s|uk'?s|india'?s)\s+"


def normalised_name(c: Column) -> Column:
    """Words with capital first letters joined by underscores; applying it twice changes nothing."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "_")


def without_suffix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?i)(\s+({'|'.join(SUFFIXES)})\.?)+\s*$", ""))


def words_of(c: Column) -> Column:
    """Distinct words of a name, without those that are left out."""
    clean = F.lower(F.regexp_replace(c, r"[&.\-]", " "))
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS)))


def mention_words(c: Column) -> Column:
    clean = F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & ~w.isin(*MENTION_STOPWORDS)))


#: Words of names that are compared by sets of words.
SHORT = 6


def overlap_match(queries: DataFrame, names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """query, name, score: the best name by shared words.

    A query within a name, or a name within the query, counts 1, and the first
    name (by ``place``) for which that holds is the answer (of texts of four
    characters or more).  Else shared words over the larger side, above the
    threshold and with one that is not generic; ties go to the earlier name.
    Candidates share a word that is not generic, or the rarest run of four
    characters of the shorter text.
    """
    clean = lambda c: F.lower(F.trim(c))
    q = queries.select("query").distinct().select("query", clean(F.col("query")).alias("ql"), words_of(F.col("query")).alias("qw")).where("ql <> ''")
    n = names.select("name", "place", clean(F.col("name")).alias("nl"), words_of(F.col("name")).alias("nw"))
    # by shared words that tell names apart
    telling = lambda w: F.filter(w, lambda x: ~x.isin(*GENERIC))
    # short ones meet in the sets of words that they may share, of which the first name by place is enough
    few = lambda w: F.size(w) <= SHORT
    sets = lambda w: F.transform(F.sequence(F.lit(1), F.expr(f"shiftleft(1, size({w})) - 1")), lambda m: F.filter(F.array_sort(w), lambda x, i: F.getbit(m, i) == 1))
    use = (F.size("s") > threshold * F.col("k")) & (F.size(telling(F.col("s"))) > 0)
    each = lambda df, w: df.where(few(w) & (F.size(w) > 0)).withColumn("s", F.explode(sets(w))).withColumn("k", F.size(w)).where(use)
    first = each(n, "nw").groupBy("s", F.col("k").alias("nk")).agg(F.min(F.struct("place", "name")).alias("f"))
    score = F.size("s") / F.greatest("k", "nk")
    short = each(q, "qw").select("query", "s", "k").join(first, "s").select("query", "f.name", "f.place", score.alias("score"))
    qt, nt = q.withColumn("w", F.explode(telling(F.col("qw")))), n.withColumn("w", F.explode(telling(F.col("nw"))))
    pair = lambda x, y: x.select("query", "qw", "w").join(y.select("name", "place", "nw", "w"), "w")
    both = pair(qt.where(~few("qw")), nt).unionByName(pair(qt.where(few("qw")), nt.where(~few("nw")))).dropDuplicates(["query", "name", "place"])
    long = both.select("query", "name", "place", (F.size(F.array_intersect("qw", "nw")) / F.greatest(F.size("qw"), F.size("nw"))).alias("score"))
    shared = short.unionByName(long).where(F.col("score") > threshold).select("query", "name", "place", "score", F.lit(1).alias("way"))
    # by containment: the shorter text's rarest run of four characters is in the longer one
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 3)), lambda i: F.substr(c, i, F.lit(4))))

    def within(small: DataFrame, large: DataFrame, sl: str, ll: str) -> DataFrame:
        at = large.withColumn("g", F.explode(runs(F.col(ll))))
        df = at.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        own = small.withColumn("g", F.explode(runs(F.col(sl)))).join(df, "g", "left").groupBy(*small.columns).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r"))
        # a run that no text has is in none, so neither is the whole
        return own.where("r.df > 0").withColumn("g", F.col("r.g")).drop("r").join(at, "g").where(F.contains(F.col(ll), F.col(sl)))

    inside = within(q.select("query", "ql"), n.select("name", "place", "nl"), "ql", "nl").select("query", "name", "place")
    holds = within(n.select("name", "place", "nl").where("nl <> ''"), q.select("query", "ql"), "nl", "ql").select("query", "name", "place")
    hits = inside.unionByName(holds).distinct().select("query", "name", "place", F.lit(1.0).alias("score"), F.lit(0).alias("way")).unionByName(shared)
    return hits.groupBy("query").agg(F.min(F.struct("way", (-F.col("score")).alias("neg"), "place", "name")).alias("b")).select("query", F.col("b.name").alias("name"), (-F.col("b.neg")).alias("score"))


def resolved_mentions(mentions: DataFrame, names: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """mention, name of the distinct mentions that are a known name (name, place), in steps:

    1 an alias of the whole mention, 2 of its first word after an article or a
    country, 3 the name but for case, 4 without a legal ending, 5 by words: a
    mention of one word the name that has this word alone; a longer one the name
    with most shared words, two at least, where all words of one side are shared
    and one of them is not generic.  Ties go to the earlier name.
    """
    spark = mentions.sparkSession
    m = mentions.select("mention").distinct().withColumn("m", F.regexp_replace(F.trim("mention"), r"[.,;:]+$", "")).where("m <> ''")
    n = names.select("name", "place", F.lower("name").alias("low"))
    table = spark.createDataFrame(list((aliases or {}).items()) or [("", "")], "alias string, name string").join(n.select("name"), "name", "left_semi")
    first = F.lower(F.element_at(F.split(F.regexp_replace("m", OF_COUNTRY, ""), r"[\s,/]+"), 1))
    hit = lambda df, step: df.select("mention", F.lit(step).alias("step"), F.lit(0).alias("shared"), "place", "name")
    zero = F.lit(0).cast("long").alias("place")
    one = hit(m.join(table, F.lower("m") == F.col("alias")).select("mention", "name", zero), 1)
    two = hit(m.withColumn("first", first).where(F.col("first") != F.lower("m")).join(table, F.col("first") == F.col("alias")).select("mention", "name", zero), 2)
    three = hit(m.join(n, F.lower("m") == F.col("low")), 3)
    bare = F.lower(F.trim(F.regexp_replace("m", r"(?i)\s+(Limited|Ltd\.?|Private|Pvt\.?|Company|Co\.?)$", "")))
    four = hit(m.join(n, bare == F.col("low")), 4)
    mw, nw = m.withColumn("mw", mention_words(F.col("m"))).where(F.size("mw") > 0), n.withColumn("nw", mention_words(F.col("name"))).where(F.size("nw") > 0)
    both = mw.withColumn("w", F.explode("mw")).join(nw.withColumn("w", F.explode("nw")), "w")
    alone = hit(both.where((F.size("mw") == 1) & (F.size("nw") == 1)), 5)
    # all words of the smaller side are shared: candidates meet at its rarest word only
    df = nw.select(F.explode("nw").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = lambda rows, words: rows.withColumn("w", F.explode(words)).join(df, "w", "left").groupBy(*rows.columns).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("r")).withColumn("w", F.col("r.w")).drop("r")
    cut = mw.where((F.size("mw") > 1) & (F.size(F.filter("mw", lambda w: ~w.isin(*MENTION_GENERIC))) > 0))
    small = rarest(cut, "mw").join(nw.withColumn("w", F.explode("nw")), "w").where(F.size(F.array_except("mw", "nw")) == 0)
    large = cut.withColumn("w", F.explode("mw")).join(rarest(nw.where(F.size("nw") > 1), "nw"), "w").where(F.size(F.array_except("nw", "mw")) == 0)
    several = small.select("mention", "mw", "name", "place", "nw").unionByName(large.select("mention", "mw", "name", "place", "nw")).distinct()
    inter = F.array_intersect("mw", "nw")
    several = several.where((F.size(inter) >= 2) & (F.size(F.filter(inter, lambda w: ~w.isin(*MENTION_GENERIC))) > 0))
    six = several.select("mention", F.lit(6).alias("step"), (-F.size(inter)).alias("shared"), "place", "name")
    out = one.unionByName(two).unionByName(three).unionByName(four).unionByName(alone).unionByName(six)
    return out.groupBy("mention").agg(F.min(F.struct("step", "shared", "place", "name")).alias("b")).select("mention", F.col("b.name").alias("name"))


def fuzzy_duplicates(names: DataFrame) -> DataFrame:
    """a, b (a < b): names of which the words of one are all in the other's, at
    least one of them telling; pairs come from the rarest word they share."""
    n = names.select("name", "ticker", words_of(F.col("name")).alias("w"))
    t = n.select("name", "ticker", F.size("w").alias("k"), F.explode("w").alias("t"))
    freq = t.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # all words of the smaller side are shared, its rarest too
    rare = t.join(freq, "t").groupBy("name").agg(F.min(F.struct("df", "t")).alias("r")).select("name", F.col("r.t").alias("t"))
    small = n.join(rare, "name").select(F.col("name").alias("s"), F.col("w").alias("sw"), F.col("ticker").alias("st"), "t")
    large = t.join(n.select("name", "w"), "name").select(F.col("name").alias("l"), F.col("w").alias("lw"), F.col("ticker").alias("lt"), "t")
    telling = F.size(F.filter("sw", lambda w: ~w.isin(*GENERIC))) > 0
    hit = small.join(large, "t").where((F.col("s") != F.col("l")) & (F.size(F.array_except("sw", "lw")) == 0) & telling & (F.col("st").isNull() | F.col("lt").isNull() | (F.col("st") != F.col("lt"))))
    return hit.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()


def folded(text: str) -> str:
    """A key without accents, case and punctuation."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def fold(texts: pd.Series) -> pd.Series:
    return texts.map(folded)


def edit_match(queries: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """query, name, distance: the nearest name by edits among those that sound alike."""
    q, n = queries.withColumn("s", F.soundex("query")), names.select("name").withColumn("s", F.soundex("name"))
    hit = q.join(n, "s").withColumn("distance", F.levenshtein(F.lower("query"), F.lower("name"))).where(F.col("distance") <= most)
    return hit.groupBy("query").agg(F.min(F.struct("distance", "name")).alias("m")).select("query", "m.name", "m.distance")


def abbreviated(queries: DataFrame, short: dict[str, str]) -> DataFrame:
    """query, name: of the abbreviations the query itself, else the first (in the
    order given) of three letters or more that is within it.  The name need not be a known one."""
    up = F.upper(F.trim("query"))
    own = F.lit(None).cast("string")
    for k, v in reversed(short.items()):
        if len(k) >= 3:
            own = F.when(up.contains(k.upper()), v).otherwise(own)
    whole = F.lit(None).cast("string")
    for k, v in short.items():
        whole = F.when(up == k, v).otherwise(whole)
    return queries.select("query", F.coalesce(whole, own).alias("name")).where("name is not null")


def staged_match(queries: DataFrame, names: DataFrame, short: dict[str, str] | None = None) -> DataFrame:
    """query, name, stage: exact (1), an abbreviation or without a legal ending (2), by words (3), by sound and edits (4); the first that answers."""
    exact = queries.join(names.select("name", F.lower("name").alias("k")), F.lower("query") == F.col("k")).select("query", "name", F.lit(1).alias("stage"))
    bare = queries.join(names.select("name", F.lower(without_suffix(F.col("name"))).alias("k")), F.lower(without_suffix(F.col("query"))) == F.col("k")).select("query", "name", F.lit(2).alias("stage"))
    words = overlap_match(queries, names).select("query", "name", F.lit(3).alias("stage"))
    bare = bare.unionByName(abbreviated(queries, short or {}).withColumn("stage", F.lit(2)))
    # by edits only what nothing else answers: names that sound alike all meet there
    said = checkpointed(exact.unionByName(bare).unionByName(words))
    edits = edit_match(queries.join(said.select("query"), "query", "left_anti"), names).select("query", "name", F.lit(4).alias("stage"))
    best = said.unionByName(edits).groupBy("query").agg(F.min(F.struct("stage", "name")).alias("m"))
    return queries.join(best, "query", "left").select("query", F.col("m.name").alias("name"), F.col("m.stage").alias("stage"))


def classified(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """name, line, kind, likely of candidates (name, line): ``existing`` by its name in
    any case, ``uncertain`` if words or edits suggest a name, else ``new``.  Of
    candidates that differ in case alone the first line's is kept."""
    one = candidates.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("line", "name")).alias("c")).select("low", "c.name", "c.line")
    known = names.select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    rows = one.join(known, "low", "left")
    asked = rows.where("known is null").select(F.col("name").alias("query"))
    likely = staged_match(asked, names).select(F.col("query").alias("name"), F.col("name").alias("likely"))
    out = rows.join(likely, "name", "left")
    kind = F.when(F.col("known"), "existing").when(F.col("likely").isNotNull(), "uncertain").otherwise("new")
    return out.select("name", "line", kind.alias("kind"), F.when(F.col("known").isNull(), F.col("likely")).alias("likely"))


def guessed_sector(texts: DataFrame, rules: list[tuple[str, tuple[str, ...]]], present: list[str], fallback: str = "Diversified") -> DataFrame:
    """id, sector of (id, text): the first rule, in order, whose sector is present and of
    which the text holds a word; else the fallback, if present."""
    low = F.lower(F.coalesce("text", F.lit("")))
    out = F.lit(fallback if fallback in present else None).cast("string")
    for sector, words in reversed(rules):
        if sector in present:
            hit = F.lit(False)
            for w in words:
                hit |= low.contains(w)
            out = F.when(hit, sector).otherwise(out)
    return texts.select("id", out.alias("sector"))


def section_entities(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """name, entity of headings (name): by name, else by normalised name, in any case."""
    e = entities.select(F.col("name").alias("entity"), F.lower("name").alias("low"), F.lower("normalized_name").alias("norm"))
    r = rows.select("name").distinct().withColumn("k", F.lower(F.trim("name")))
    by_name = r.join(e, F.col("k") == F.col("low")).select("name", F.lit(1).alias("way"), "entity")
    by_norm = r.join(e, F.regexp_replace("k", r"[^a-z0-9]+", "_") == F.col("norm")).select("name", F.lit(2).alias("way"), "entity")
    best = by_name.unionByName(by_norm).groupBy("name").agg(F.min(F.struct("way", "entity")).alias("b"))
    return best.select("name", F.col("b.entity").alias("entity"))
