"""Ordered work without a one-task sort.

Rows are put into buckets that are a function of the ordering key alone: cut points come from
approximate quantiles, fetched once as at most one number per bucket. A recomputed task hence puts
a row into the same bucket again. Each bucket is one shuffle partition and is ordered on its own;
bucket totals, one row per bucket, carry the offset from the buckets before it.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BUCKET = "_bucket"
_AS_DOUBLE = "_bucket_key"


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows hashed by a unique key into as many partitions as a shuffle has, or into ``parts``.

    The number is given so that small texts, which grow when they are taken apart, are not put
    together into few tasks.
    """
    return df.repartition(parts or bucket_count(df), key)


NUMBERS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)

#: Keys per bucket that are drawn to find cut points of keys that are no numbers.
DRAWN = 32


def _cut_points(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` keys that cut ``df`` into about equal parts, in order; a bounded sample is drawn for them."""
    whole, wanted = df.count(), DRAWN * n
    keys = df.select(key).where(F.col(key).isNotNull())
    some = keys if whole <= wanted else keys.sample(min(1.0, 1.2 * wanted / whole), 7)
    drawn = [r[0] for r in some.orderBy(key).collect()]
    cuts = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def _bucket_of(df: DataFrame, key: str, cuts: list) -> Column:
    """How many of ``cuts`` are at most the key; looked up in parts, so that few cuts are compared."""
    kind = df.schema[key].dataType
    step = max(1, math.isqrt(len(cuts)))

    def constant(value: Any, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType) and value is not None:
            return F.struct(*[constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
        return F.lit(value).cast(kind)

    def told(values: list) -> Column:
        return F.array(*[constant(value, kind) for value in values])

    part = F.size(F.filter(told(cuts[::step]), lambda c: c <= F.col(key)))
    inside = F.size(F.filter(F.slice(told(cuts), F.greatest(F.lit(1), (part - 1) * step + 1), step), lambda c: c <= F.col(key)))
    return F.when(part > 0, (part - 1) * step + inside).otherwise(0)


def with_bucket(
    df: DataFrame, key: str, buckets: int | None = None, basis: DataFrame | None = None
) -> DataFrame:
    """Add ``_bucket``, which never falls when ``key`` grows. ``key`` is of any type that has an order.

    The cut points are taken from ``basis``, by default ``df`` itself. For counts of distinct values
    the raw rows are a good basis: they need no shuffle, and a bucket of few rows has few values.
    Numbers, dates and times are cut at approximate quantiles. Other keys, such as texts and structs
    of several columns, are cut at keys of a bounded sample, in their own order.
    """
    n = buckets or bucket_count(df)
    if not isinstance(df.schema[key].dataType, NUMBERS):
        cuts = _cut_points(df if basis is None else basis, key, n)
        return df.withColumn(BUCKET, _bucket_of(df, key, cuts) if cuts else F.lit(0))

    def keyed(rows: DataFrame) -> DataFrame:
        value = F.col(key)
        if isinstance(df.schema[key].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(value.cast("timestamp"))
        return rows.withColumn(_AS_DOUBLE, value.cast("double"))

    cuts = keyed(df if basis is None else basis).approxQuantile(
        _AS_DOUBLE, [i / n for i in range(1, n)], 1 / (4 * n)
    )
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placed = Bucketizer(
        splits=splits, inputCol=_AS_DOUBLE, outputCol=BUCKET, handleInvalid="keep"
    ).transform(keyed(df))
    # A missing key sorts first, as it does in the window of its bucket.
    return placed.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(0))).drop(_AS_DOUBLE)


def _place(placed: DataFrame, per_bucket: DataFrame, buckets: int | None) -> DataFrame:
    """Send bucket i to partition i and give its rows the columns of ``per_bucket``.

    ``per_bucket`` has one row per bucket, so the broadcast cannot grow with the data.
    """
    parts = (buckets or bucket_count(placed)) + 1
    return placed.repartitionById(parts, BUCKET).join(F.broadcast(per_bucket), BUCKET, "left")


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    descending: bool = False,
    buckets: int | None = None,
    following: str | None = None,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums in the order of ``key``, which must be unique.

    ``sums`` maps new column names to the columns that are summed up; the sum over all rows is
    added too, with ``_total`` at the end of the name. ``following`` names a column for the next
    key in order, NULL in the last row; ``basis`` is that of ``with_bucket``.
    """
    placed = with_bucket(df, key, buckets, basis)
    head = F.max(key) if descending else F.min(key)
    totals = placed.groupBy(BUCKET).agg(
        *[F.sum(c).alias(f"_in_{new}") for new, c in sums.items()], head.alias("_head")
    )
    # One row per bucket from here on, so ordering them all in one task is no burden.
    line = Window.partitionBy(F.lit(0)).orderBy(F.col(BUCKET).desc() if descending else F.col(BUCKET))
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        BUCKET,
        F.lead("_head").over(line).alias("_next_head"),
        *[F.coalesce(F.sum(f"_in_{new}").over(earlier), F.lit(0)).alias(f"_before_{new}") for new in sums],
        *[F.sum(f"_in_{new}").over(every).alias(f"{new}_total") for new in sums],
    )
    local = Window.partitionBy(BUCKET).orderBy(F.col(key).desc() if descending else F.col(key))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    after = [F.coalesce(F.lead(key).over(local), F.col("_next_head")).alias(following)] if following else []
    return _place(placed, offsets, buckets).select(
        *df.columns,
        *[(F.col(f"_before_{new}") + F.sum(c).over(upto)).alias(new) for new, c in sums.items()],
        *[f"{new}_total" for new in sums],
        *after,
    )


def with_position(
    df: DataFrame, key: str, out: str = "row_id", buckets: int | None = None
) -> DataFrame:
    """Add the dense 0-based position of each row in the order of the unique ``key``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    counted = running_totals(one, key, {"_upto": "_one"}, buckets=buckets)
    return counted.select(*df.columns, (F.col("_upto") - 1).alias(out))


def with_next(
    df: DataFrame, key: str, columns: dict[str, str], buckets: int | None = None
) -> DataFrame:
    """Add columns of the next row in the order of ``key``; the last row sees the first one.

    ``columns`` maps new names to the columns taken from the next row.
    """
    placed = with_bucket(df, key, buckets).withColumn("_own", F.struct(*columns.values()))
    # The heads are found by their keys alone; only theirs of the other columns are taken up.
    heads = placed.groupBy(BUCKET).agg(F.min(key).alias("_head"))
    ring = Window.partitionBy(F.lit(0)).orderBy(BUCKET)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = heads.select(
        BUCKET, F.coalesce(F.lead("_head").over(ring), F.first("_head", ignorenulls=True).over(whole)).alias("_ahead")
    )
    first_rows = placed.join(F.broadcast(heads.select("_head")), placed[key] == F.col("_head"), "left_semi")
    following = ahead.join(first_rows.select(F.col(key).alias("_ahead"), F.col("_own").alias("_following")), "_ahead").drop("_ahead")
    local = Window.partitionBy(BUCKET).orderBy(key)
    chosen = F.coalesce(F.lead("_own").over(local), F.col("_following"))
    joined = _place(placed, following, buckets).withColumn("_next", chosen)
    return joined.select(
        *df.columns, *[F.col("_next")[source].alias(new) for new, source in columns.items()]
    )
