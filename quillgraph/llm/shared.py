"""What several operators need: the shared folder, files in it, written tables
and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group, which a writer holds in memory.
GROUP_BYTES = 16 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), a temporary folder is
    made and set; on a cluster that is an error, since executors would not see
    each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few rows while a plan runs: a task's Python worker and its
    JVM both hold whole batches, and rows here are texts and sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back.

    It cuts lineage: an executor lost later costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("parquet.block.size", GROUP_BYTES).option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a :func:`written` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._quill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_file(uri: str, chunks) -> int:
    """Writes byte chunks to a new file under a temporary name, then renames it.

    A task that is lost half way leaves no file of the final name.  Returns the
    number of bytes.
    """
    tmp, n = f"{uri}.{uuid.uuid4().hex}.tmp", 0
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = _local(tmp)
        with open(own, "wb") as f:
            for c in chunks:
                n += f.write(c)
        os.replace(own, path)
        return n
    fs, at = _filesystem(tmp)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    fs.move(at, _filesystem(uri)[1])
    return n


def open_file(uri: str):
    """A seekable file to read from."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    fs, at = _filesystem(uri)
    return fs.open_input_file(at)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one buffer, and n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1])[offsets[0] :], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch of about ``most`` text bytes (a longer row is a part of its own)."""
    n = batch.num_rows
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


def n_words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (id, component).

    ``component`` is the smallest id that is reachable.  Alternates large-star
    and small-star steps, which keep the number of edges at most and end after
    about log n rounds; every step is a min-aggregation (with map-side combine)
    and a join that adaptive execution can split on a hub.  Each round's edges
    are a written table, so nothing is collected and lineage stays short.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "links")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    seen = print_of(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a written table, so that the join's sides are plain: broadcast if small, split at a hub if not
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low_written, low = low, large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "links")
        now = print_of(new)
        dropped(e)
        dropped(low_written)
        e = new
        if now == seen:
            break
        seen = now
    hubs = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(hubs)
