"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import locate

#: The separators of the word pattern ``[^\x20\x09-\x0D]+``, as a regular expression.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Rows of a few numbers that a partition should have.
PART_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder stands in on one machine, and a cluster is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one that nothing reads any more."""
    system, folder = locate(path)
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: later steps don't run it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fitted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpoint or stored table in as few partitions as its rows need, so that small tables don't
    go through many empty tasks and files: what adaptive execution does, with the rows counted before."""
    rows = df.count() if rows is None else rows
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, from its files; for numbers that decide memory and
    speed only, never results."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return found if found < 1 << 60 else 0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The array of words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
