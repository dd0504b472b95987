"""Full-text search: postings, BM25, fused ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import checkpointed

K1, B = 1.2, 0.75
RRF = 60


def tokens(text: Column) -> Column:
    """Runs of lower-case letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def postings(docs: DataFrame, stem=None) -> DataFrame:
    """id, term, tf of (id, text); ``stem`` maps a term's column."""
    term = F.explode(tokens(F.col("text")))
    out = docs.select("id", term.alias("term"))
    if stem is not None:
        out = out.withColumn("term", stem(F.col("term")))
    return out.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _is(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, terms: list[str], index: DataFrame | None = None) -> DataFrame:
    """id, score of documents with all the terms.  An empty query is an error."""
    terms = list(dict.fromkeys(t.lower() for t in terms if t))
    if not terms:
        raise ValueError("an empty query")
    if index is None:  # one pass over the texts, without postings
        found = docs.select("id", tokens(F.col("text")).alias("t"))
        light = found.select("id", F.size("t").alias("len"), F.array(*[F.size(F.filter("t", _is(w))) for w in terms]).alias("tf"))
        light = checkpointed(light)
        dfs = F.array(*[F.count(F.when(F.col("tf")[i] > 0, 1)) for i in range(len(terms))])
        stats = light.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), dfs.alias("df"))
        norm = K1 * (1 - B + B * F.col("len") / F.col("avg"))
        score = F.aggregate(F.zip_with("tf", "df", lambda tf, df: F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)), F.lit(0.0), lambda s, x: s + x)
        return light.where(~F.exists("tf", lambda x: x == 0)).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row
    sizes = docs.select("id", F.size(tokens(F.col("text"))).alias("len"))
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    hit = index.where(F.col("term").isin(terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    got = hit.join(F.broadcast(df), "term").join(sizes, "id").crossJoin(F.broadcast(stats))  # one row
    return got.groupBy("id").agg(F.sum(idf * per).alias("score"), F.count(F.lit(1)).alias("k")).where(F.col("k") == len(terms)).select("id", "score")


def fused(text_scores: DataFrame, vector_scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """id, score by reciprocal ranks: the best limit + offset by text, each with
    its rank by vector among all rows; a row without a vector ranks after them."""
    page = text_scores.orderBy(F.desc("score"), "id").limit(limit + offset)
    by_text = page.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # limit + offset rows
    # the rank of each candidate is how many rows are ahead of it: no global sort
    marks = by_text.join(vector_scores, "id", "left").select("id", "r", "sim")
    ahead = F.broadcast(marks).alias("m").join(vector_scores.alias("v"), (F.col("v.sim") > F.col("m.sim")) | ((F.col("v.sim") == F.col("m.sim")) & (F.col("v.id") < F.col("m.id"))), "inner")
    ranks = ahead.groupBy(F.col("m.id").alias("id")).agg(F.count(F.lit(1)).alias("ahead"))
    total = vector_scores.agg(F.count(F.lit(1)).alias("total"))
    place = F.when(F.col("sim").isNull(), F.col("total")).otherwise(F.coalesce("ahead", F.lit(0))) + 1
    out = marks.join(ranks, "id", "left").crossJoin(F.broadcast(total)).select("id", (1.0 / (RRF + F.col("r")) + 1.0 / (RRF + place)).alias("score"))  # one row
    return out.orderBy(F.desc(F.round("score", 9)), "id").offset(offset).limit(limit)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def scan_scores(docs: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """id, score of (id, title, path, text) without an index: 3 a whole word, 2 a
    word's start, 5 in the title, 4 in the path."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    score = F.lit(0)
    for w in words:
        w = w.lower()
        score = score + 3 * occurrences(text, f" {w} ") + 2 * occurrences(text, f" {w}") + 5 * F.lower("title").contains(w).cast("int") + 4 * F.lower("path").contains(w).cast("int")
    return docs.select("id", "title", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "title", "id").limit(max(1, min(limit, 100)))


def snippet(text: Column, word: str, width: int = 140) -> Column:
    """The text around the first occurrence of a word, which is marked."""
    at = F.locate(word.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - width)
    before, hit, after = F.substr(text, start, at - start), F.substr(text, at, F.lit(len(word))), F.substr(text, at + len(word), F.lit(width))
    return F.when(at > 0, F.concat(before, F.lit("<mark>"), hit, F.lit("</mark>"), after)).otherwise(F.substring(text, 1, 2 * width))


def index_stats(index: DataFrame) -> DataFrame:
    """term, df, cf."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# ------------------------------------------------------------------ stemming

_VOWEL = "aeiou"
# The endings of the second to fourth steps of the stemmer.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(w: str) -> str:
    """c for each consonant, v for each vowel; y after a consonant is a vowel."""
    out = ""
    for ch in w:
        out += "v" if ch in _VOWEL or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(w: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c", _consonants(w)))


def _short(w: str) -> bool:
    return _consonants(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    w = word
    if len(w) < 3 or not w.isascii():
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = _longest(w, ("ed", "ing"))
        if end and "v" in _consonants(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(term: Column) -> Column:
    """Stems of terms; apply it to distinct terms, as :func:`stemmed_postings` does."""
    return F.pandas_udf(lambda s: s.map(stem), "string")(term)


def stemmed_postings(docs: DataFrame) -> DataFrame:
    """id, term, tf with stems as terms: each distinct term is stemmed once."""
    plain = postings(docs)
    stems = plain.select("term").distinct().withColumn("stem", stemmed(F.col("term")))
    return plain.join(stems, "term").groupBy("id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def search_page(docs: DataFrame, query: str, limit: int = 20, offset: int = 0, doc_type: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """id, doc_type, title, score, total: a page of the documents (id, doc_type, title,
    text) with all words of the query, the best first, and how many there are.

    Ranks are over all documents; ``doc_type`` keeps one type.  A query without
    words is an error.
    """
    words = re.findall(r"[^\W_]+", query.lower())
    got = bm25(docs, words, index).join(docs.select("id", "doc_type", "title"), "id")
    if doc_type is not None:
        got = got.where(F.col("doc_type") == doc_type)
    total = got.agg(F.count(F.lit(1)).alias("total"))
    page = got.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").offset(max(0, offset)).limit(max(0, limit))
    return page.crossJoin(F.broadcast(total)).select("id", "doc_type", "title", "score", "total")  # one row


def snippet_of(text: str, words: list[str], size: int = 12) -> str:
    """The run of ``size`` words with most different query words, these marked; dots where it is cut."""
    parts = re.findall(r"\S+", text or "")
    keys = [re.sub(r"[\W_]+", "", p.lower()) for p in parts]
    want = {w.lower() for w in words}
    last = max(0, len(parts) - size)
    best = max(range(last + 1), key=lambda i: (len(want & set(keys[i : i + size])), -i), default=0)
    shown = [f"<mark>{p}</mark>" if k in want else p for p, k in zip(parts[best : best + size], keys[best : best + size], strict=True)]
    return ("… " if best else "") + " ".join(shown) + (" …" if best + size < len(parts) else "")


def with_snippets(page: DataFrame, docs: DataFrame, words: list[str], size: int = 12) -> DataFrame:
    """The rows of a page with a ``snippet`` of their text (id, text)."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: snippet_of(t, words, size)), "string")
    return page.join(docs.select("id", "text"), "id").withColumn("snippet", udf("text")).drop("text")
