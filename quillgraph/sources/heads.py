"""Front matter of notes as typed columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PARSED = (
    "path string, doc_type string, fault string, names array<string>, fields map<string, string>, tags array<string>, tags_fault boolean, "
    "sources array<struct<id: string, resource: string, title: string, last_modified: string>>, generated struct<by: string, at: string>, verified array<string>, head string, body string, size int"
)
_KEY = re.compile(r"^([A-Za-z_][\w-]*):(?:\s+(.*?))?\s*$")
_ITEM = re.compile(r"^\s*-\s+(.*?)\s*$")
_PAIR = re.compile(r"^\s*(?:-\s+)?([A-Za-z_][\w-]*):(?:\s+(.*?))?\s*$")


def plain(value: str | None) -> str | None:
    """A scalar without its quotes; null for nothing, ``null`` and ``~``."""
    if value is None or value in ("", "null", "~"):
        return None
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def head_of(text: str) -> dict:
    """What a note's block between the first two ``---`` lines says.

    Keys hold scalars, lists of scalars, lists of mappings or one mapping: the
    shapes that notes use.  ``fault`` says why there is nothing to read.
    """
    out = {"fault": None, "names": [], "fields": {}, "tags": None, "tags_fault": False, "sources": [], "generated": None, "verified": [], "head": "", "body": text or "", "size": len(text or "")}
    lines = (text or "").splitlines()
    bars = [i for i, x in enumerate(lines) if x.strip() == "---"]
    if len(bars) < 2:
        return out | {"fault": "no_block"}
    out["body"] = "\n".join(lines[bars[1] + 1 :])
    if bars[1] <= bars[0] + 1:
        return out | {"fault": "empty_block"}
    block = lines[bars[0] + 1 : bars[1]]
    out["head"] = "\n".join(block)
    values: dict[str, object] = {}
    key, item = None, None
    for line in block:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] not in " -\t" and (m := _KEY.match(line)) is not None:
            key, item = m[1], None
            values[key] = plain(m[2])
            continue
        if key is None:
            return out | {"fault": "invalid"}
        m = _ITEM.match(line)
        if m is not None:
            if not isinstance(values[key], list):
                values[key] = []
            pair = _PAIR.match(m[1])
            item = {pair[1]: plain(pair[2])} if pair is not None and key != "tags" else plain(m[1])
            values[key].append(item)
        elif (pair := _PAIR.match(line)) is not None and line[0] in " \t":
            if isinstance(item, dict):
                item[pair[1]] = plain(pair[2])
            else:
                values[key] = {**(values[key] if isinstance(values[key], dict) else {}), pair[1]: plain(pair[2])}
        else:
            return out | {"fault": "invalid"}
    out["names"] = list(values)
    out["fields"] = {k: v for k, v in values.items() if v is None or isinstance(v, str)}
    tags = values.get("tags")
    out["tags_fault"] = "tags" in values and not isinstance(tags, list)
    out["tags"] = [str(t).strip() for t in tags] if isinstance(tags, list) else None
    maps = lambda k: [x for x in values.get(k) or [] if isinstance(x, dict)] if isinstance(values.get(k), list) else []
    out["sources"] = [{f: s.get(f) for f in ("id", "resource", "title", "last_modified")} for s in maps("sources")]
    made = values.get("generated")
    out["generated"] = {"by": made.get("by"), "at": made.get("at")} if isinstance(made, dict) else None
    out["verified"] = [v.get("by") for v in maps("verified")]
    return out


def parsed(notes: DataFrame) -> DataFrame:
    """(path, doc_type, text) with front matter taken apart: one pass over the texts."""
    schema = to_arrow_schema(T.StructType.fromDDL(PARSED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = [{"path": p, "doc_type": t, **head_of(x)} for p, t, x in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return notes.select("path", "doc_type", "text").mapInArrow(read, PARSED)
