"""From text to rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import checkpointed


#: Members of a group that meet in one cell of :func:`pairs_within`.
PAIR_BLOCK = 2048
#: Pairs of a task where groups are larger than that.
TASK_PAIRS = 4_000_000


def pairs_within(rows: DataFrame, group: str, member: str, once: bool = False, block: int = PAIR_BLOCK) -> DataFrame:
    """group, a, b: all pairs a < b of distinct members, as relations between groups' members ask for.

    ``once`` gives a pair of members of several groups in its least group only.  A
    group of more than ``block`` members is cut into blocks, and every two blocks
    are a cell of their own, so that no task gets a large group; pairs are not
    shuffled.
    """
    r = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null").distinct()
    if once:
        sets = r.groupBy("m").agg(F.sort_array(F.collect_list("g")).alias("gs"))
        r = sets.select("m", F.explode("gs").alias("g"), F.when(F.size("gs") > 1, F.col("gs")).alias("gs"))
    r = checkpointed(r)
    sizes = r.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    top, pairs = sizes.agg(F.max("n"), F.sum(F.col("n") * F.col("n") / 2)).first()
    if (top or 0) <= block:
        x, y = r.alias("x"), r.alias("y")
        both = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.m") < F.col("y.m")))
    else:
        k = sizes.select(F.col("g").alias("of"), F.ceil(F.col("n") / block).cast("int").alias("k"))
        cut = r.join(k, F.col("g") == F.col("of")).drop("of").withColumn("own", F.pmod(F.xxhash64("m"), "k").cast("int"))
        tasks = int(min(4096, max(r.sparkSession.sparkContext.defaultParallelism, pairs / TASK_PAIRS)))
        cells = lambda lo, hi, at: cut.withColumn("o", F.explode(at)).withColumns({"lo": lo, "hi": hi}).drop("own", "o", "k").repartition(tasks, "g", "lo", "hi")
        x = cells(F.col("own"), F.col("o"), F.sequence(F.col("own"), F.col("k") - 1)).alias("x")
        y = cells(F.col("o"), F.col("own"), F.sequence(F.lit(0), F.col("own"))).alias("y")
        same = (F.col("x.g") == F.col("y.g")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
        both = x.hint("merge").join(y, same & ((F.col("x.lo") < F.col("x.hi")) | (F.col("x.m") < F.col("y.m"))))
    if once:
        one = F.col("x.gs").isNull() | F.col("y.gs").isNull()
        both = both.where(one | (F.array_intersect("x.gs", "y.gs")[0] == F.col("x.g")))
    return both.select(F.col("x.g").alias(group), F.least("x.m", "y.m").alias("a"), F.greatest("x.m", "y.m").alias("b"))


def theme_exposure(docs: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """id, theme, aliases found in a text, in order; one pass, whatever the number of aliases."""
    text = F.lower(F.coalesce("text", F.lit("")))
    per = [F.struct(F.lit(theme).alias("theme"), F.array_join(F.array_compact(F.array(*[F.when(text.contains(a.lower()), F.lit(a)) for a in sorted(set(words))])), ",").alias("found")) for theme, words in aliases.items()]
    return docs.select("id", F.explode(F.array(*per)).alias("x")).select("id", "x.*").where("found <> ''")


def sentences(docs: DataFrame) -> DataFrame:
    """id, place, sentence."""
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+")
    return docs.select("id", F.posexplode(parts).alias("place", "sentence")).where(F.trim("sentence") != "")


def picked(docs: DataFrame, patterns: list[str], key: Column) -> DataFrame:
    """id, key, sentence: sentences that match all patterns; of one key the longest, then the least."""
    s = sentences(docs)
    for p in patterns:
        s = s.where(F.col("sentence").rlike(p))
    order = Window.partitionBy("id", "key").orderBy(F.desc(F.length("sentence")), "sentence")
    return s.withColumn("key", key).withColumn("k_", F.row_number().over(order)).where("k_ = 1").select("id", "key", "sentence")


def clean_page(c: Column) -> Column:
    """A page without blocks of markup, tags and repeated white space."""
    c = F.regexp_replace(c, r"(?is)<(script|style|nav|footer)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))


def headings(docs: DataFrame) -> DataFrame:
    """id, line (from 1), level, title of Markdown headings."""
    lines = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "l"))
    return lines.where(F.col("l").rlike(r"^#{1,6}\s+\S")).select("id", (F.col("i") + 1).alias("line"), F.length(F.regexp_extract("l", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("l", r"^#+\s+", "")).alias("title"))


_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?", re.S)


def front_matter(text: str) -> tuple[dict[str, object], str]:
    """The flat keys of a block between two ``---`` lines, lists of ``- x`` included, and the body."""
    m = _FRONT.match(text or "")
    if not m:
        return {}, text or ""
    out: dict[str, object] = {}
    key = None
    for line in m[1].splitlines():
        if re.match(r"\s*-\s+", line) and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(re.sub(r"^\s*-\s+", "", line).strip().strip("\"'"))
        elif (k := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line)) is not None:
            key = k[1]
            out[key] = k[2].strip().strip("\"'")
    return out, text[m.end() :]


_QUOTE_OPEN = re.compile(r"^\s*[\"“]")
_QUOTE_END = re.compile(r"[\"”]\s*$")
_SPEAKER = re.compile(r"^\s*[-–—]+\s*(?P<name>[^,\n]{2,80})(?:,\s*(?P<title>.+))?$")


def quotes_of(text: str, least: int = 30) -> list[tuple[str, str | None, str | None]]:
    """(quote, speaker, title) of paragraphs in quotation marks with a dash line within three lines."""
    lines, out, i = (text or "").split("\n"), [], 0
    while i < len(lines):
        if not _QUOTE_OPEN.match(lines[i]):
            i += 1
            continue
        j = i
        while j < len(lines) and not (_QUOTE_END.search(lines[j]) and (j > i or len(lines[j].strip()) > 1)):
            j += 1
        if j == len(lines):
            i += 1
            continue
        body = re.sub(r"\s+", " ", " ".join(lines[i : j + 1])).strip().strip("\"“”").strip()
        name = title = None
        for k in range(j + 1, min(j + 4, len(lines))):
            if (m := _SPEAKER.match(lines[k])) is not None:
                name, title = m["name"].strip(), (m["title"] or "").strip() or None
                break
        if len(body) >= least:
            out.append((body, name, title))
        i = j + 1
    return out


_FIGURE = re.compile(r"(?P<sign>[-+])?(?P<cur>₹|Rs\.?\s?|\$|€|USD\s?|INR\s?)?(?P<num>\d[\d,]*(?:\.\d+)?)(?:\s?(?:-|–|to)\s?(?P<hi>\d[\d,]*(?:\.\d+)?))?\s?(?P<unit>%|bps|crores?|cr|lakhs?|million|mn|billion|bn|x|times|MW|GW|MT)?(?!\w|\.\w)", re.I)
# Units as written and as given out.
UNITS = {"crores": "crore", "cr": "crore", "crore": "crore", "lakhs": "lakh", "lakh": "lakh", "mn": "million", "million": "million", "bn": "billion", "billion": "billion", "%": "%", "bps": "bps", "x": "x", "times": "x", "mw": "MW", "gw": "GW", "mt": "MT"}
LABELS = ("revenue", "margin", "profit", "growth", "ebitda", "capex", "debt", "volume", "capacity", "order book", "market share", "interest", "sales")


def figures_of(text: str) -> list[tuple[str | None, str, float, str]]:
    """(label, as written, value, unit): numbers with a unit; of a range the lower bound;
    the label is the nearest known word within 30 characters before, else after."""
    out = []
    for m in _FIGURE.finditer(text or ""):
        if not m["unit"]:
            continue
        before, after = text[max(0, m.start() - 30) : m.start()].lower(), text[m.end() : m.end() + 30].lower()
        label = max(((before.rfind(x), x) for x in LABELS if x in before), default=None)
        label = label or min(((after.find(x), x) for x in LABELS if x in after), default=None)
        value = float(m["num"].replace(",", "")) * (-1 if m["sign"] == "-" else 1)
        out.append((label and label[1], m[0].strip(), value, UNITS[m["unit"].lower()]))
    return out


_WORD = r"(?:[A-ZÀ-ÖØ-Þ]|\d+[A-Za-z])[\w&'-]*(?:\.[\w&'-]+)*"
_NAME = rf"{_WORD}(?:[^\S\n]+(?:(?:of|&)[^\S\n]+)?{_WORD}){{0,9}}"
_ONE = rf"(?P<m>{_NAME})"
_SEVERAL = rf"(?P<m>{_NAME}(?:(?:,[^\S\n]+{_NAME})*,?[^\S\n]+(?:and|or)[^\S\n]+{_NAME})?)"
_SPAN = r"(?P<m>[A-ZÀ-ÖØ-Þ](?:[\w&,'\s-]|\.(?=\w)){1,120}?)(?=\s*(?:\.(?!\w)|[;:()\n\"!?]|\s(?:which|that|is|has|will|but|while|when|because|since)\s|$))"
_GOODS = r"(?:[A-Za-z0-9\s,-]{1,60}?\s+)?"
_NO_RIVAL = r"(?!(?i:peers|rivals|competitors|chinese|indian|european|american|japanese|korean|other|many|some|several|various|both|all|its|(?:the|an?)\s))"
#: Edge type, pattern, and the role of the name: "forward" as the edge's target, "reverse"
#: as its source, "symmetric" as either end.
RELATIONS = [
    (t, re.compile(p), role)
    for t, p, role in (
        ("acquired", rf"\b(?i:acquired\s+(?:a\s+(?:majority\s+|controlling\s+)?stake\s+in\s+)?)(?!(?i:by|from)\s){_ONE}", "forward"),
        ("acquired", rf"\b(?i:acquired\s+(?:by|from))\s+{_ONE}", "reverse"),
        ("acquired", rf"\b(?i:acquisition\s+of)\s+{_ONE}", "forward"),
        ("acquired", rf"\b(?i:demerged?\s+from)\s+{_ONE}", "reverse"),
        ("acquired", rf"\b(?i:merged?\s+with|formed\s+through\s+(?:the\s+)?merger\s+(?:of|with))\s+{_ONE}", "reverse"),
        ("jv_with", rf"\b(?i:joint\s+venture\s+(?:with|between|of\s+ours\s+along\s+with))\s+{_SEVERAL}", "symmetric"),
        ("jv_with", rf"\b(?i:JV\s+(?:with|between))\s+{_SEVERAL}", "symmetric"),
        ("jv_with", rf"\b(?i:tie[\s-]?up(?:ped|ping)?|tied[\s-]up|partnership|alliance)\s+(?i:with)\s+{_ONE}", "symmetric"),
        ("subsidiary_of", rf"\b(?i:subsidiary\s+of)\s+{_ONE}", "forward"),
        ("subsidiary_of", rf"\b(?i:parent\s+company\s+of)\s+{_ONE}", "reverse"),
        ("subsidiary_of", rf"\b(?i:(?:listed|indian|overseas|wholly[\s-]owned)\s+subsidiary\s+(?:is\s+|named\s+|called\s+)?){_ONE}", "reverse"),
        ("supplier_to", rf"\b(?i:supplier\s+(?:of\s+{_GOODS})?(?:to|for))\s+{_ONE}", "forward"),
        ("supplier_to", rf"\b(?i:suppl(?:ies|ying|ied)\s+{_GOODS}to)\s+{_ONE}", "forward"),
        ("supplier_to", rf"\b(?i:securing|secured|won|winning|awarded)\s+{_ONE}(?:\s+[a-z][\w-]*){{0,4}}?\s+(?:orders|contracts?|business|deal|RFQ|rfq)\b", "forward"),
        ("supplier_to", rf"\b(?i:provid(?:e|es|ed|ing)\s+(?:about\s+|around\s+|nearly\s+|over\s+)?)\d+(?:\.\d+)?\s*%\s+of\s+{_ONE}", "forward"),
        ("supplier_to", rf"\b(?i:vendor\s+(?:of\s+{_GOODS})?(?:to|for))\s+{_ONE}", "forward"),
        ("supplier_to", rf"\b(?i:sources?|sourcing|procures?|procuring)\s+from\s+{_ONE}", "reverse"),
        ("customer_of", r"\b(?i:major|largest|key|biggest|primary)\s+(?i:customers?)\s*\((?P<m>[^)]{1,200})\)", "forward"),
        ("customer_of", rf"\b(?i:major|largest|key|biggest|primary)\s+(?i:customers?\s+(?:is|are))\s+{_SEVERAL}", "forward"),
        ("competes_with", rf"\b(?i:peers|competitors|rivals|challengers)\s+(?i:like|such\s+as|including|named|namely)\s+{_SPAN}", "symmetric"),
        ("competes_with", rf"\b(?i:competes?\s+with|rival(?:s|ry)?)\s+{_NO_RIVAL}{_SEVERAL}", "symmetric"),
    )
]
_LISTED = re.compile(r"\s*,\s*(?:(?:and|or)\s+)?|\s+(?:and|or)\s+", re.I)
_AMPERSAND = re.compile(r"\s+&\s+")
_STARTS = re.compile(_NAME)
_TRAILING = re.compile(r"\s+(?:the|an?|its|their|our|in|on|at|to|for|and|or)$", re.I)
_LEGAL = frozenset("inc ltd limited llc corp co plc".split())
# Words that are no company: at the end of what was acquired; alone or first in the other types.
_NO_TARGET = re.compile(r"\b(?:land|property|assets|customers|clients|shares|stake|businesses|companies|brands?|portfolios?|new business|last year|this year|this quarter)$", re.I)
_NO_CUSTOMER = frozenset("oems oem industry market customers clients consumers government automakers retailers wholesalers distributors dealers india us usa uk europe china asia the its our their".split())
_NO_CUSTOMERS = frozenset(("public sector", "private sector", "auto makers", "global markets", "original equipment manufacturers"))
_NO_COMPETITOR = frozenset("peers rivals competitors competition incumbents players challengers entrants newcomers startups chinese indian european american japanese korean global domestic foreign multinational oems others many some several various both all the its our their other".split())
_GROUPED = re.compile(r"alongside|(?:grouped|mentioned|classified|bucketed|listed|featured)\s+with", re.I)
_YEAR = re.compile(r"\b(20[1-9]\d)\b")


def _mentions(kind: str, text: str) -> Iterator[str]:
    """The names in what a pattern took, lists taken apart, without those that name no company."""
    several = kind in ("customer_of", "competes_with", "jv_with")
    parts = _LISTED.split(text) if several else [text]
    if kind in ("customer_of", "competes_with"):
        parts = [x for p in parts for x in _AMPERSAND.split(p)]
    for part in parts:
        m = _STARTS.match(part.strip())
        if m is None:
            continue
        name = _TRAILING.sub("", m[0]).strip(" .,;:")
        low = name.lower()
        first = low.split()[0] if low else ""
        if len(name) < 2 or several and len(parts) > 1 and low in _LEGAL:
            continue
        if kind == "acquired" and _NO_TARGET.search(low):
            continue
        if kind in ("supplier_to", "customer_of") and (first in _NO_CUSTOMER or low in _NO_CUSTOMERS):
            continue
        if kind == "competes_with" and first in _NO_COMPETITOR:
            continue
        yield name


def relations_of(text: str, last_year: int = 2100) -> list[tuple[str, str, str, int | None, str]]:
    """(type, mention, quote, year, role) of relations that a text tells of its company; names
    are not resolved, so "joint venture between A and B" gives both."""
    out, seen, text = [], set(), text or ""
    for kind, pattern, role in RELATIONS:
        for m in pattern.finditer(text):
            if kind == "competes_with" and _GROUPED.search(text[max(0, m.start() - 60) : m.start()]):
                continue
            for mention in _mentions(kind, m["m"]):
                if kind == "supplier_to" and mention.endswith("'s"):
                    mention = mention[:-2]
                if (kind, role, mention.lower()) in seen:
                    continue
                seen.add((kind, role, mention.lower()))
                quote = re.sub(r"\s+", " ", text[max(0, m.start() - 120) : m.end() + 120]).strip()[:240]
                years = [int(y) for y in _YEAR.findall(quote) if 2018 <= int(y) <= last_year]
                out.append((kind, mention, quote, min(years, default=None), role))
    return out


def rows_of(docs: DataFrame, extract, columns: list[str], schema: str) -> DataFrame:
    """Applies a text function to (id, text), a row an item: the columns after id as it gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["id"], b["text"], strict=True) for x in extract(t)]
            yield pd.DataFrame(rows, columns=["id", *columns])

    return docs.select("id", "text").mapInPandas(run, schema)


def quotes(docs: DataFrame) -> DataFrame:
    return rows_of(docs, quotes_of, ["quote", "speaker", "title"], "id long, quote string, speaker string, title string")


def figures(docs: DataFrame) -> DataFrame:
    return rows_of(docs, figures_of, ["label", "raw", "value", "unit"], "id long, label string, raw string, value double, unit string")


def relations(docs: DataFrame) -> DataFrame:
    return rows_of(docs, relations_of, ["edge_type", "mention", "quote", "year", "role"], "id long, edge_type string, mention string, quote string, year int, role string")
