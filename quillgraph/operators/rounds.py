"""Tables between the rounds of a driver loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine) a temporary one is set;
    on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read back.

    Lineage ends here, and a lost executor costs a re-read.  The planner knows
    the size of what it reads, so joins with small tables need no shuffle.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rounds_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of :func:`checkpointed` tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_rounds_path", None)) is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a task of :func:`spread`.
TASK_ROWS = 250_000


def spread(df: DataFrame, *columns: str, rows: int = TASK_ROWS) -> DataFrame:
    """The rows by hash of columns in as many tasks as their number asks for, so that
    what a task holds for an aggregation does not grow with the table.  A table of
    one task's rows stays as it is."""
    n = df.count()
    return df if n <= rows else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), *columns)
