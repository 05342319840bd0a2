"""Stage tables: work that is done stays done.

A stage lies in buckets of its key, so that what is stored is found again, and joined by key, where
it lies: of the stored rows none is shuffled. The key and the number of buckets are written next to
the rows and hold for all later runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from phrasewell.operators.ranges import bucket_count
from phrasewell.session import new_path


def content_key(*parts: Column) -> Column:
    """A key that depends on the content alone, so that a repeated run finds its rows again."""
    shown = [F.coalesce(p.cast("string"), F.lit(chr(30))) for p in parts]
    return F.sha2(F.concat_ws(chr(31), *shown), 256)


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """The stage table, or None if nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


@dataclass(frozen=True)
class Layout:
    """How the rows under ``path`` are laid out."""

    path: str
    key: str
    buckets: int

    def _name(self) -> str:
        return f"stage_{hashlib.sha256(self.path.encode()).hexdigest()[:32]}"

    def table(self, spark: SparkSession, schema: T.StructType) -> str:
        """The name of the stage in the session's catalogue, which gets an entry if it has none."""
        name = self._name()
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            place = self.path.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return name

    def rows(self, spark: SparkSession) -> DataFrame | None:
        found = read_stage(spark, self.path)
        if found is None:  # nothing is there, or it has been taken away
            spark.sql(f"DROP TABLE IF EXISTS {self._name()}")
            return None
        name = self.table(spark, found.schema)
        spark.catalog.refreshTable(name)  # other sessions may have added to it
        return spark.table(name)

    def append(self, rows: DataFrame) -> None:
        name = self.table(rows.sparkSession, rows.schema)
        rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name)


def stage_layout(spark: SparkSession, path: str, key: str, buckets: int) -> Layout | None:
    """The layout under ``path``, which is made if nothing is stored there; None for rows without buckets."""
    try:
        told = spark.read.schema("key string, buckets int").json(f"{path}/_layout").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        told = None
    if told is None:
        if read_stage(spark, path) is not None:
            return None
        spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
        return Layout(path, key, buckets)
    if told["key"] != key:
        raise ValueError(f"the rows under {path} are laid out by {told['key']!r}, not by {key!r}")
    return Layout(path, key, told["buckets"])


def _by_key(rows: DataFrame, others: DataFrame, key: str, how: str) -> DataFrame:
    """A join that looks the keys of ``others`` up, partition by partition, and sorts no row."""
    return rows.join(others.select(key).hint("shuffle_hash"), key, how)


def resume_stage(
    source: DataFrame,
    path: str,
    key: str,
    compute: Callable[[DataFrame], DataFrame],
    slices: int = 1,
    error: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The stored rows of ``source``, after those that were missing have been computed and appended.

    ``key`` is unique in ``source`` and kept by ``compute``; it must tell apart all that the result
    depends on, as ``content_key`` of the inputs and parameters does. Rows that other inputs have
    stored under ``path`` stay there and are not returned. The rows are written before anything
    reads them, so a task that is run again never asks a generator for an already stored answer.

    The first run lays the table out in ``buckets`` of the key, by default as many as a shuffle has partitions; a bucket
    should fit a task. What is missing is found by reading stored keys only, and
    the rows that are returned are picked where they lie: of both joins only keys and inputs of ``source`` are shuffled.

    ``error`` names a column of ``compute`` that says why a row has failed. Failed rows are stored
    with their reason, are not returned, and are computed again by the next run; see ``failures``.

    With ``slices`` the rows are computed and stored in that many parts by the hash of the key, so
    that a run that breaks loses the part it was at; what is missing is then stored by part first,
    so the source is read once.
    """
    spark = source.sparkSession
    layout = stage_layout(spark, path, key, buckets or bucket_count(source))

    def stored() -> DataFrame | None:
        return read_stage(spark, path) if layout is None else layout.rows(spark)

    def good(rows: DataFrame) -> DataFrame:
        return rows.where(F.col(error).isNull()).drop(error) if error else rows

    def append(rows: DataFrame) -> DataFrame:
        """The stage after ``rows`` have been added; without any row yet it is an empty table."""
        if layout is None:
            rows.write.mode("append").parquet(path)
            return spark.read.parquet(path)
        layout.append(rows)
        return spark.table(layout.table(spark, rows.schema))

    def dealt(rows: DataFrame) -> DataFrame:
        """By key, so that each task writes to its own bucket."""
        return rows if layout is None else rows.repartition(layout.buckets, key)

    done = stored()
    todo = source if done is None else _by_key(source, good(done), key, "left_anti")
    if slices == 1:
        found = append(compute(dealt(todo) if done is None else todo))
    else:
        aside = new_path(spark, "todo")
        kinds = T.StructType([*todo.schema.fields, T.StructField("_slice", T.LongType())])
        part = F.pmod(F.xxhash64(key), F.lit(slices)).alias("_slice")
        todo.select("*", part).write.partitionBy("_slice").parquet(aside)
        for i in range(slices):
            missing = spark.read.schema(kinds).parquet(aside).where(F.col("_slice") == i)
            found = append(compute(dealt(missing.drop("_slice"))))
    return _by_key(good(found), source, key, "left_semi")


def failures(spark: SparkSession, path: str, key: str, error: str) -> DataFrame:
    """Rows (key, error) of a stage that have failed and have not been computed since; a key once per try."""
    if read_stage(spark, path) is None:
        raise ValueError(f"nothing is stored under {path}")
    layout = stage_layout(spark, path, key, 1)
    rows = read_stage(spark, path) if layout is None else layout.rows(spark)
    failed, fine = rows.where(F.col(error).isNotNull()).select(key, error), rows.where(F.col(error).isNull())
    return _by_key(failed, fine, key, "left_anti")


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A whole table that is read if it exists and written first if not."""
    if read_stage(spark, path) is None:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
