"""What several operators share: stored tables, row ids, and text in pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasewell.session import new_path, short_batches

#: Bytes of a text that are taken apart at a time, so that a very long text needs little memory.
BLOCK_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage and survives lost executors."""
    short_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    made = _stored.get()
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are ``stored`` inside are deleted at the end, but for those taken out of the list it gives.

    The tables of a scope inside belong to that scope. If the work inside fails, they stay.
    """
    made: list[str] = []
    token = _stored.set(made)
    try:
        yield made
    finally:
        _stored.reset(token)
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words of ``data`` (runs without ASCII white space) in lists, each from about ``size`` bytes."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def row_numbers(df: DataFrame, name: str) -> DataFrame:
    """Add a distinct number per row. Store the result before the numbers are used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())
