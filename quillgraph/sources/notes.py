"""Markdown notes as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import front_matter

SCHEMA = "path string, doc_type string, title string, tags array<string>, body string"


def cleaned(c: Column) -> Column:
    """A note's text without embeds, images and tags, white space joined."""
    for pattern in (r"!\[\[[^\]]*\]\]", r"!\[[^\]]*\]\([^)]*\)", r"(?is)<(div|img)\b[^>]*>|</div>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def scan_notes(spark: SparkSession, root: str, prefixes: dict[str, str], other: str = "note") -> DataFrame:
    """path (below the root), doc_type, title, tags, body of all ``*.md`` files.

    ``prefixes`` maps the start of a path to its type, the longest first.  Files
    in ``images`` folders and image maps are left out.  A title that the front
    matter lacks is the first heading, else the file's stem.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = root.split(":", 1)[-1].rstrip("/")
    rows = raw.select(F.expr(f"substring(regexp_replace(url_decode(_metadata.file_path), '^[a-z]+:/*', '/'), {len('/' + base.lstrip('/')) + 2})").alias("path"), F.col("value").alias("text"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)images/|(^|/)image_map\.md$"))
    kind = F.lit(other)
    for prefix in sorted(prefixes, key=len):
        kind = F.when(F.col("path").startswith(prefix), prefixes[prefix]).otherwise(kind)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, doc_type, text in zip(b["path"], b["doc_type"], b["text"], strict=True):
                head, body = front_matter(text)
                first = next((x.lstrip("#").strip() for x in body.splitlines() if x.startswith("#")), "")
                tags = head.get("tags")
                out.append((path, doc_type, head.get("title") or first or path.rsplit("/", 1)[-1].removesuffix(".md"), tags if isinstance(tags, list) else [], body))
            yield pd.DataFrame(out, columns=["path", "doc_type", "title", "tags", "body"])

    return rows.select("path", kind.alias("doc_type"), "text").mapInPandas(parse, SCHEMA).withColumn("body", cleaned(F.col("body")))
