"""Row selection: positions, first and last rows, slices and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from phrasewell.functions.text import text_or_missing
from phrasewell.operators.ranges import BUCKET, with_bucket, with_position
from phrasewell.session import reliable_checkpoint

_ORDERED_AS_NUMBERS = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_index(df: DataFrame, *keys: str, out: str = "row_id", buckets: int | None = None) -> DataFrame:
    """Dense 0-based position in the order of ``keys``, which together are unique.

    One numeric or time key needs one shuffle. Text or composite keys are range-partitioned and
    written to the checkpoint folder first, so that positions and counts see the same partitions.
    """
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, _ORDERED_AS_NUMBERS):
        return with_position(df, keys[0], out, buckets)
    # The id holds the partition number in its upper 31 bits and the place in the lower 33.
    ranged = reliable_checkpoint(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # One row per partition, so the broadcast cannot grow with the data.
    joined = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*df.columns, (F.col("_before") + place).alias(out))


#: Rows that one task may gather and order; more are selected by their rank.
AT_ONCE = 10_000


def _selected(df: DataFrame, n: int, keys: tuple[str, ...], last: bool, buckets: int | None) -> DataFrame:
    """The first or last ``n`` rows: whole ranges of the first key, and the one at the edge in part.

    Ranges are counted, their numbers come to the driver, one per range; only the rows of the range at the edge are ordered.
    """
    placed = with_bucket(df, keys[0], buckets)
    counts = {r[BUCKET]: r["n"] for r in placed.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
    left, whole, edge = n, [], None
    for bucket in sorted(counts, reverse=last):
        if counts[bucket] > left:
            edge = bucket
            break
        whole.append(bucket)
        left -= counts[bucket]
    within = Window.partitionBy(BUCKET).orderBy(*[F.desc(k) if last else F.asc(k) for k in keys])
    at = F.col(BUCKET)
    beyond = placed.where(at >= min(whole) if last else at <= max(whole)) if whole else placed.where(F.lit(False))
    if edge is None or not left:
        return beyond.drop(BUCKET)
    cut = placed.where(at == edge).withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= left)
    return beyond.unionByName(cut.drop("_rank")).drop(BUCKET)


def head_n(df: DataFrame, n: int, *keys: str, at_once: int = AT_ONCE, buckets: int | None = None) -> DataFrame:
    """First ``n`` rows in the order of ``keys``. Beyond ``at_once`` rows no task gathers them."""
    if n <= at_once:
        return df.orderBy(*keys).limit(n)
    return _selected(df, n, keys, False, buckets).orderBy(*keys)


def tail_n(df: DataFrame, n: int, *keys: str, at_once: int = AT_ONCE, buckets: int | None = None) -> DataFrame:
    """Last ``n`` rows in the order of ``keys``, kept in that order. Beyond ``at_once`` rows no task gathers them."""
    if n <= at_once:
        last = df.orderBy(*[F.col(k).desc() for k in keys]).limit(n)
    else:
        last = _selected(df, n, keys, True, buckets)
    return last.orderBy(*keys)


def slice_rows(df: DataFrame, start: int, stop: int, row_id: str = "row_id") -> DataFrame:
    """Rows at positions ``start`` to ``stop - 1``, renumbered from 0."""
    at = F.col(row_id)
    return df.where((at >= start) & (at < stop)).withColumn(row_id, at - start)


def slice_split(df: DataFrame, train: int, test: int, row_id: str = "row_id") -> DataFrame:
    """First ``train`` rows and the ``test`` rows after them, marked in ``split``, each from 0."""
    at = F.col(row_id)
    kept = df.where(at < train + test)
    return kept.withColumn("split", F.when(at < train, "train").otherwise("test")).withColumn(
        row_id, F.when(at < train, at).otherwise(at - train)
    )


def drop_failed(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def score_filter(df: DataFrame, score: str, limit: float | Column) -> DataFrame:
    """Keep scores at or above the limit; missing scores drop."""
    return df.where(F.col(score) >= limit)


def project_final(df: DataFrame, response: str, score: str = "eval_bert") -> DataFrame:
    return df.select(
        "question", "paraphrased_question", "sparql_wikidata", "wikidata_translated", response, score
    )


def coalesce_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text_or_missing(F.col(c)) for c in columns})
