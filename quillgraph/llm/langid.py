"""Operator 8: language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (one to three letters, with
a blank before and after each word) in order of rank.  A document's own profile
is compared to each language's by the out-of-place distance: the sum over its
n-grams of how far apart their ranks are, or the profile's length where the
language lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import slices

LENGTH = 300
#: Documents a language that a profile is learned from, about, at most.
TRAIN_DOCS = 3000
UNKNOWN = "und"
_BLANK = 1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_runs(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its n-grams, ascending, and their counts.

    Texts are lower-cased; whatever is no letter separates words.  An n-gram is
    a number: 21 bits a character.
    """
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cp = np.frombuffer(("\n" + "\n".join(texts.to_pylist()) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one blank after each word
    place = np.cumsum(keep)  # how many are kept up to each character
    c = np.where(letter, cp, _BLANK)[keep].astype(np.uint64)
    pair = c[:-1] << np.uint64(21) | c[1:]
    triple = pair[:-1] << np.uint64(21) | c[2:]
    out, start = [], 1
    for end in place[ends].tolist():
        # characters start .. end - 1 are the text's words with a blank after each; the blank before is at start - 1
        if end <= start:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        one = c[start:end]
        three = triple[start - 1 : end - 2]
        keys = np.concatenate((one[one != _BLANK], pair[start - 1 : end - 1], three[one[:-1] != _BLANK]))
        keys.sort()
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out.append((keys[at], np.diff(at, append=len(keys))))
        start = end
    return out


def ranked(keys: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams in order; ties go by the n-gram."""
    if len(keys) > 4 * length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.argsort(-counts, kind="stable")[:length]]


@dataclass
class Profiles:
    """Ranks by language of all n-grams of any profile; -1 where a profile lacks one."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    length: int

    @classmethod
    def of(cls, lists: dict[str, list[int]], length: int) -> Profiles:
        languages = sorted(lists)
        keys = np.unique(np.array([k for v in lists.values() for k in v], np.uint64))
        ranks = np.full((len(keys), len(languages)), -1, np.int64)
        for j, name in enumerate(languages):
            ranks[np.searchsorted(keys, np.array(lists[name], np.uint64)), j] = np.arange(len(lists[name]))
        return cls(languages, keys, ranks, length)

    def closest(self, own: np.ndarray) -> tuple[str, float]:
        """The language of the least distance, and 1 less that distance's share of the largest possible one."""
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (len(own) * self.length))


def fit(labelled: DataFrame, length: int = LENGTH, train_docs: int = TRAIN_DOCS) -> Profiles:
    """Learns a profile a language from (doc_id, text, lang).

    About ``train_docs`` documents a language are read, chosen by a hash of
    their identifier; all of them where there are fewer.  What reaches the
    driver is one row a language and n-gram of a profile.
    """
    labelled = labelled.where("lang is not null and text is not null")
    share = {r.lang: min(1.0, train_docs / r.n) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Profiles.of({}, length)
    chance = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for lang, run in zip(part.column(0).to_pylist(), ngram_runs(part.column(1)), strict=True):
                    total.setdefault(lang, []).append(run)
                for lang, runs in total.items():
                    keys, inverse = np.unique(np.concatenate([k for k, _ in runs]), return_inverse=True)
                    total[lang] = [(keys, np.bincount(inverse, np.concatenate([n for _, n in runs]), len(keys)).astype(np.int64))]
        for lang, runs in total.items():
            keys, counts = runs[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "ngram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))).where(F.col("r") <= length)
    lists: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.r)):
        lists.setdefault(r.lang, []).append(r.ngram)
    return Profiles.of(lists, length)


def predicted(docs: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score to each row, as columns ``names``; ``und``
    and 0 where the text is null or has no letter."""
    new, names = names, [c for c in docs.columns if c not in names]
    docs = docs.select(*[f"`{c}`" for c in names])
    place = names.index(text_col)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                got = [profiles.closest(ranked(*run, profiles.length)) for run in ngram_runs(part.column(place))]
                more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*names, *new])

    return docs.mapInArrow(tell, docs.withColumns({new[0]: F.lit(""), new[1]: F.lit(0.0)}).schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the identifier as text leaves 2 on division by 4; not for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    Learns from the rows that are not held out and have a language; a null
    identifier is neither held out nor learned from.  Whole texts are judged,
    however long; of languages at the same distance the first by name is given.
    Repeated rows are predicted alike; an empty table gives no rows; without any
    label all is ``und``; other columns, whatever their names, are ignored.
    """
    seen = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    got = predicted(rows, fit(seen))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
