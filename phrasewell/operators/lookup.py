"""Joins with a table that holds each key once, safe against keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasewell.operators.ranges import bucket_count
from phrasewell.session import BROADCAST_BYTES, fits, new_path


#: Salts per share of a partition. Salted keys are hashed to partitions, and smaller pieces even out.
PIECES = 8


def popular_keys(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys that hold more than one part in ``parts`` of the rows, and how many salts they get.

    There are fewer than ``parts`` of them, however large the table is. NULL can be one.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("whole")).scalar()
    return (
        counts.withColumn("_share", F.col("_n") * parts / whole)
        .where("_share > 1")
        .select(F.col(key).alias("_popular"), F.ceil(F.col("_share") * PIECES).alias("_salts"))
    )


def numbered_copies(rows: DataFrame, out: str) -> DataFrame:
    """Equal rows told apart by a number from 0 on.

    Equal rows are counted before the shuffle and written out again after it, so a row's number does
    not depend on the order in which a task has read it. Maps cannot be compared; rows that hold one
    all have number 0.
    """
    if "map<" in rows.schema.simpleString():
        return rows.withColumn(out, F.lit(0).cast("bigint"))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    return counted.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias(out))


def salted_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on ``key`` with popular keys salted, each over as many partitions as its share asks for.

    The salt of a row is a function of the row and of its number among equal ones, so a repeated task
    sends it to the same place and equal rows are spread too. NULL keys, which match nothing, are
    spread like others.
    """
    # Bounded by the number of partitions, so the broadcast cannot grow with the data.
    popular = F.broadcast(popular_keys(rows, key, bucket_count(rows)))

    def salts(df: DataFrame) -> DataFrame:
        return df.join(popular, F.col(key).eqNullSafe(F.col("_popular")), "left").drop("_popular")

    # Rows of rare keys need no number; only equal rows of popular ones crowd.
    known = salts(rows).select(*rows.columns, "_salts")
    crowded = numbered_copies(known.where("_salts is not null"), "_copy")
    spread = F.pmod(F.xxhash64(*rows.columns, "_copy"), F.col("_salts")).alias("_salt")
    left = known.where("_salts is null").select(*rows.columns, F.lit(0).cast("bigint").alias("_salt")).unionByName(
        crowded.select(*rows.columns, spread)
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1)
    right = salts(table).select(*table.columns, F.explode(copies).alias("_salt"))
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Bits of the filter that stands for keys too many to be broadcast: 32 MB.
FILTER_BITS = 1 << 28
#: Fixed value: bits that a bitmap of Spark holds.
BITMAP_BITS = 32_768


def _might_be_used(table: DataFrame, ids: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows of ``table`` whose key hashes to a bit that a key of ``ids`` sets, and so at least those of all these keys."""
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = ids.select(spot.alias("_spot")).groupBy(F.bitmap_bucket_number("_spot").alias("_map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits")
    )
    # One row of 4 kB per BITMAP_BITS bits, however many keys there are.
    placed = table.withColumn("_spot", spot).withColumn("_map", F.bitmap_bucket_number("_spot"))
    at = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    return placed.join(F.broadcast(maps), "_map").where(is_set).select(*table.columns)


def used_rows(table: DataFrame, ids: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``table`` that the keys in ``ids`` can ask for, stored in the shared folder.

    ``ids`` holds each key once. The table is read once where it lies and not shuffled: keys that fit are sent to it,
    more of them as a filter of ``bits`` bits, which lets some rows through that are not asked for.
    """
    found = table.join(F.broadcast(ids), key, "left_semi") if fits(ids, broadcast_bytes) else _might_be_used(table, ids, key, bits)
    path = new_path(table.sparkSession, "used")
    found.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows with the columns of ``table``: broadcast if measured to be small, else ``salted_join``."""
    if fits(table, broadcast_bytes):
        return rows.join(F.broadcast(table), key, how)
    return salted_join(rows, table, key, how)


def join_in_place(rows: DataFrame, table: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join with a table that holds each key once and lies in buckets of it, which stays where it lies.

    Rows of rare keys are sent to the buckets. A popular key's rows stay where they are, and its row of
    the table is sent to them: there are fewer popular keys than partitions, and should their rows not
    fit, these are joined with salts.
    """
    popular = popular_keys(rows, key, bucket_count(rows)).collect()  # fewer than there are partitions
    popular = [r["_popular"] for r in popular if r["_popular"] is not None]
    if not popular:
        return rows.join(table, key)
    spark = rows.sparkSession
    names = F.broadcast(spark.createDataFrame([(k,) for k in popular], f"_popular {rows.schema[key].dataType.simpleString()}"))
    at = F.col(key) == F.col("_popular")
    rare = rows.join(names, at, "left_anti").join(table, key)
    hot, own = rows.join(names, at, "left_semi"), table.join(names, at, "left_semi")
    return rare.unionByName(hot.join(F.broadcast(own), key) if fits(own, broadcast_bytes) else salted_join(hot, own, key, "inner"))
