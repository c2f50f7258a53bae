"""Intermediate tables in the shared folder, and expressions that several operators use."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_folder

#: Bytes [\x20\x09-\x0D], the white space of words and lines.
BLANKS = " \t\n\x0b\x0c\r"
#: One word.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Folders staged inside each ``scratch`` that is open.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what was ``staged`` inside; nothing that is used later may read it."""
    _open.append([])
    try:
        yield
    finally:
        for folder in _open.pop():
            drop(spark, folder)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a table of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_at(df: DataFrame, name: str) -> str:
    """Writes ``df`` as Parquet to the shared folder; returns where."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The rows are fixed from then on: a task that runs again after the loss of an executor reads the
    same rows, also where ``df`` numbers them. Later passes read only the columns they name. Inside ``scratch`` the
    table is dropped with it.
    """
    path = written_at(df, name)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files go that no table needs any more.

    They stay on the executors' disks until the driver's collector finds that nothing refers to them, which a driver with
    little to do may not do for long. A job of many rounds asks it to.
    """
    gc.collect()
    spark._jvm.System.gc()


def row_key(*columns: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by the named columns; rows equal in them are interchangeable."""
    seed = [F.coalesce(F.col(c).isNull(), F.lit(True)) for c in columns]
    named = [F.col(c) for c in columns]
    return F.xxhash64(*seed, *named).alias("k1"), F.xxhash64(F.lit(7), *seed, *named).alias("k2")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else; ``lower`` does just that where all characters are ASCII."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns only, under our own names, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in names.items()])
