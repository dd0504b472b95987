"""Derived tables that are built once and read by all queries.

A build is a folder below the shared one, named by the schema version and a
fingerprint of the source files (names, sizes, times).  A folder that holds its
build record is warm and is read as it is; otherwise the tables are written to a
folder of their own and renamed, so that a build that is lost half way is never
read and two that run at once do no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.rounds import shared_folder

#: Raised whenever a derived table changes its form.
SCHEMA_VERSION = 3
RECORD = "_build.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fingerprint(spark: SparkSession, root: str, names: list[str]) -> str:
    """A hash of the files behind tables: the generation of their data."""
    seen = []
    for name in sorted(names):
        fs, at = _fs(spark, f"{root}/{name}.parquet")
        files = fs.listStatus(at)
        seen += [(name, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files]
    return hashlib.sha256(json.dumps([root, SCHEMA_VERSION, sorted(seen)]).encode()).hexdigest()[:24]


def record(spark: SparkSession, folder: str) -> dict | None:
    """The build record of a warm folder, else None."""
    fs, at = _fs(spark, f"{folder}/{RECORD}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def is_warm(spark: SparkSession, folder: str, sources: str) -> bool:
    """Whether a build of this schema version and these sources is there."""
    got = record(spark, folder)
    return got is not None and got["schema_version"] == SCHEMA_VERSION and got["fingerprint"] == sources


def staged(spark: SparkSession, root: str, sources: list[str], tables: dict[str, Callable[[], DataFrame]], partition_by: dict[str, str] | None = None, rebuild: bool = False, name: str = "build") -> dict[str, DataFrame]:
    """The tables, from a warm build or a new one.

    ``rebuild`` makes a new build whatever is there.  ``partition_by`` names the
    column by which a table's files are kept apart, so that a filter on it reads
    only its own.  The record also holds each table's columns.
    """
    of = fingerprint(spark, root, sources)
    folder = f"{shared_folder(spark)}/quillgraph-{name}-{of}"
    if rebuild:
        fs, at = _fs(spark, folder)
        fs.delete(at, True)
    if not is_warm(spark, folder, of):
        draft, schemas = f"{folder}-{uuid.uuid4().hex}", {}
        for table, make in tables.items():
            df = make()
            schemas[table] = json.loads(df.schema.json())
            key = (partition_by or {}).get(table)
            (df.repartition(key).write.partitionBy(key) if key else df.write).parquet(f"{draft}/{table}")
        fs, at = _fs(spark, f"{draft}/{RECORD}")
        out = fs.create(at)
        out.write(json.dumps({"schema_version": SCHEMA_VERSION, "fingerprint": of, "tables": schemas}).encode())
        out.close()
        target = _fs(spark, folder)[1]
        if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
            fs.delete(_fs(spark, draft)[1], True)  # another session was faster
    from pyspark.sql import types as T

    schemas = record(spark, folder)["tables"]
    read = lambda t: spark.read.schema(T.StructType.fromJson(schemas[t])).parquet(f"{folder}/{t}")
    return {t: read(t).select(*[f["name"] for f in schemas[t]["fields"]]) for t in tables}


def dropped_builds(spark: SparkSession, name: str = "build", keep: str | None = None) -> int:
    """Deletes all builds but one; how many went."""
    fs, at = _fs(spark, shared_folder(spark))
    gone = 0
    for f in fs.listStatus(at):
        own = f.getPath().getName()
        if own.startswith(f"quillgraph-{name}-") and not (keep and keep in own):
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
