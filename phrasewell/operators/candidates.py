"""Vectors of candidates: pooling, group scores, selection and the score record.

Candidates of one query come from ``candidate_fanout`` and hence number ``k``; they are gathered by
one shuffle into an array and scored inside the row. Groups without such a bound, as clusters of
vectors, have operators of their own at the end that never gather a group.
"""

from __future__ import annotations

import math
from typing import Any

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasewell.functions import fixed_values as fixed, vectors as V
from phrasewell.functions.text import tokens
from phrasewell.operators.lookup import salted_join, used_rows
from phrasewell.operators.ranges import BUCKET, bucket_count, spread, with_bucket
from phrasewell.session import BROADCAST_BYTES, fits, new_path

SCORE_DIGITS = 9


def hashed_embedding(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """Key and unit-length vector of hashed token counts; ``key`` is unique.

    Tokens are counted where their text lies: what is shuffled is a number per text and dimension.
    """
    token = df.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    bucket = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % dims
    counted = token.groupBy(key, bucket.cast("int").alias("dim")).agg(
        F.count("*").cast("double").alias("n")
    )
    filled = F.map_from_entries(F.collect_list(F.struct("dim", "n")))
    gathered = counted.groupBy(key).agg(filled.alias("counts"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda d: F.coalesce(F.try_element_at("counts", d), F.lit(0.0)),
    )
    return gathered.select(key, V.l2_normalize(dense).alias("vector"))


#: Rows with a vector, and rows with a number, that one task orders.
AT_ONCE, NUMBERS_AT_ONCE = 200_000, 1_000_000


def mean_pool(
    token_rows: DataFrame,
    table: DataFrame,
    key: str,
    token: str,
    position: str,
    dims: int,
    max_tokens: int = fixed.MAX_TOKENS,
    broadcast_bytes: int = BROADCAST_BYTES,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Mean of the vectors of the first ``max_tokens`` tokens of each text, counted from 0.

    ``table`` holds ``token`` and ``vector``. Equal tokens of a text are counted before they meet
    their vector; the counts are stored in the shared folder. A text without a known token gets
    NULL. A table that is not small is first reduced to the tokens at hand. If it is then measured to
    be few, counts are spread by text, about ``at_once`` of them in a task, and meet their vectors
    there; otherwise popular tokens are salted, and each task sends one sum of vectors per text.
    """
    spark, path = token_rows.sparkSession, new_path(token_rows.sparkSession, "counted")
    made = token_rows.where(F.col(position) < max_tokens).groupBy(key, token).agg(F.count("*").alias("_c"))
    made.write.parquet(path)
    counted = spark.read.schema(made.schema).parquet(path)
    vectors = table.select(token, V.doubles(F.col("vector")).alias("_v"))
    if not fits(vectors, broadcast_bytes):
        vectors = used_rows(vectors, counted.select(token).where(F.col(token).isNotNull()).distinct(), token, broadcast_bytes)
    if fits(vectors, broadcast_bytes):
        parts = max(bucket_count(counted), math.ceil(counted.count() / at_once))
        joined = spread(counted, key, parts).join(F.broadcast(vectors), token, "left")
    else:
        joined = salted_join(counted, vectors, token)
    known = F.col("_v").isNotNull()
    weighted = array_to_vector(F.coalesce("_v", F.array_repeat(F.lit(0.0), dims)))
    sums = joined.groupBy(key).agg(
        F.sum(F.when(known, F.col("_c"))).alias("_n"),
        vector_to_array(Summarizer.sum(weighted, F.when(known, F.col("_c")).otherwise(1).cast("double"))).alias("_sums"),
    )
    return sums.select(key, F.when(F.col("_n") > 0, F.transform("_sums", lambda x: x / F.col("_n"))).alias("vector"))


def gather_candidates(df: DataFrame, key: str, idx: str, *columns: str) -> DataFrame:
    """One row per query with the array ``candidates`` of (idx, columns...) in index order."""
    entry = F.struct(idx, *columns)
    return df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("candidates"))


def field(name: str, candidates: str = "candidates") -> Column:
    """One field of all candidates, as an array."""
    return F.transform(candidates, lambda c: c[name])


def best(vectors: Column, target: Column) -> Column:
    """``at`` and ``score`` of the vector nearest to the target, the first one on a tie.

    Scores are compared at 9 digits, so that noise of summation does not decide a tie.
    """
    scored = F.transform(vectors, lambda v: V.cosine(target, v))
    ranked = F.transform(
        scored,
        lambda s, i: F.struct(
            F.round(s, SCORE_DIGITS).alias("rounded"), (-i).alias("back"), s.alias("score")
        ),
    )
    top = F.array_max(ranked)
    return F.when(top.isNotNull(), F.struct((-top["back"]).alias("at"), top["score"].alias("score")))


def pairwise_cosine(df: DataFrame, key: str, idx: str, vector: str) -> DataFrame:
    gathered = gather_candidates(df, key, idx, vector)
    return gathered.select(key, V.mean_pairwise_cosine(field(vector)).alias("avg_cosine_similarity"))


def pairwise_distance(df: DataFrame, key: str, idx: str, vector: str) -> DataFrame:
    gathered = gather_candidates(df, key, idx, vector)
    return gathered.select(key, V.mean_pairwise_distance(field(vector)).alias("avg_pairwise_distance"))


def median_vector(df: DataFrame, key: str, idx: str, vector: str) -> DataFrame:
    gathered = gather_candidates(df, key, idx, vector)
    return gathered.select(key, V.median_vector(field(vector)).alias("median_vector"))


def _picked(df: DataFrame, key: str, target: Column, idx: str, vector: str) -> DataFrame:
    return (
        df.withColumn("_target", target)
        .withColumn("_best", best(field(vector), F.col("_target")))
        .select(key, F.get("candidates", F.col("_best.at"))[idx].alias(idx), "_best.score")
    )


def pick_by_median(df: DataFrame, key: str, idx: str, vector: str) -> DataFrame:
    """The candidate nearest to the median vector of its group."""
    gathered = gather_candidates(df, key, idx, vector)
    return _picked(gathered, key, V.median_vector(field(vector)), idx, vector)


def pick_by_query(
    df: DataFrame, queries: DataFrame, key: str, idx: str, vector: str, query_vector: str
) -> DataFrame:
    """The candidate nearest to the vector of its query."""
    gathered = gather_candidates(df, key, idx, vector).join(queries.select(key, query_vector), key)
    return _picked(gathered, key, F.col(query_vector), idx, vector)


def select_winners(df: DataFrame) -> DataFrame:
    """Add winners by median and by query vector, and the group means.

    The input has one row per query: ``candidates`` of (cand_idx, text, text_vector, query_space)
    and ``query_vector``. ``text_vector`` lies in the space of the ground-truth question,
    ``query_space`` in the one of the query.
    """
    in_text, in_query = field("text_vector"), field("query_space")
    return (
        df.withColumn("_median", V.median_vector(in_text))
        .withColumn("_near_median", best(in_text, F.col("_median")))
        .withColumn("_near_query", best(in_query, F.col("query_vector")))
        .withColumn("_dist", F.get("candidates", F.col("_near_median.at")))
        .withColumn("_query", F.get("candidates", F.col("_near_query.at")))
        .withColumn("avg_pairwise_distance", V.mean_pairwise_distance(in_text))
        .withColumn("avg_cosine_similarity", V.mean_pairwise_cosine(in_text))
        .drop("_median", "_near_median", "_near_query")
    )


def assess_scores(df: DataFrame) -> DataFrame:
    """The score record: each of three winners against the query and the true question.

    The input is that of ``select_winners`` plus ``truth_vector``, ``critique``,
    ``critique_text_vector`` and ``critique_query_space``.
    """
    won = select_winners(df)

    def against(text_vector: Column, query_space: Column) -> tuple[Column, Column]:
        return (
            V.cosine(F.col("query_vector"), query_space),
            V.cosine(text_vector, F.col("truth_vector")),
        )

    by_query = against(F.col("_query.text_vector"), F.col("_query.query_space"))
    by_dist = against(F.col("_dist.text_vector"), F.col("_dist.query_space"))
    by_critique = against(F.col("critique_text_vector"), F.col("critique_query_space"))
    return won.select(
        *[c for c in df.columns if c != "candidates"],
        "candidates",
        by_query[0].alias("bert_q_nl_score_Q"),
        by_query[1].alias("bert_nl_nl_gt_score_Q"),
        by_dist[0].alias("bert_q_nl_score_dist"),
        by_dist[1].alias("bert_nl_nl_gt_score_dist"),
        by_critique[0].alias("bert_q_nl_score_critique"),
        by_critique[1].alias("bert_nl_nl_gt_score_critique"),
        F.col("_query.text").alias("best_translation_Q"),
        F.col("_dist.text").alias("best_translation_dist"),
        F.col("critique").alias("best_translation_llm_critique"),
        F.col("_query.text_vector").alias("best_translation_embedding_Q"),
        F.col("_dist.text_vector").alias("best_translation_embedding_dist"),
        F.col("critique_text_vector").alias("best_translation_embedding_llm_critique"),
        "avg_pairwise_distance",
        "avg_cosine_similarity",
    )


# Groups of any size.


def cluster_cosine(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Mean pairwise cosine of groups of any size, by one sum of vectors.

    With unit vectors u the sum over all pairs is (|sum u|^2 - n) / 2, so each task sends one
    partial sum per group and no pair is ever made. A zero vector counts as cosine 0.
    """
    lengths = df.select(key, V.doubles(F.col(vector)).alias("_v")).withColumn("_n", V.norm(F.col("_v")))
    none = F.array_repeat(F.lit(0.0), dims)
    unit = F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n"))).otherwise(none)
    sums = lengths.select(key, "_n", array_to_vector(F.coalesce(unit, none)).alias("_u")).groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_n") > 0).alias("ones"),
        vector_to_array(Summarizer.sum(F.col("_u"))).alias("sums"),
    )
    n = F.col("n")
    return sums.select(
        key, n, F.try_divide(V.squared_norm(F.col("sums")) - F.col("ones"), n * (n - 1)).alias("avg_cosine_similarity")
    )


#: Rows of a group up to which each pair is measured, and directions that larger groups are seen from.
EXACT_ROWS, DIRECTIONS = 4096, 512


def _directions(dims: int, n: int, seed: int = 11) -> Any:
    """``n`` unit vectors, each run of ``dims`` of them at right angles, times the factor that makes a mean of lengths.

    A difference of vectors, seen from all directions, is on average its length over this factor.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dims, dims)))[0].T for _ in range(-(-n // dims))]
    factor = math.sqrt(math.pi) * math.exp(math.lgamma((dims + 1) / 2) - math.lgamma(dims / 2))
    return factor * np.concatenate(bases)[:n]


def _sliced_distance(members: DataFrame, key: str, rows: int, directions: int, buckets: int | None, at_once: int) -> DataFrame:
    """Key, pairs, estimate of the mean distance and its standard error, for ``rows`` members (key, _v, _n)."""
    made = _directions

    @F.arrow_udf("array<double>")
    def seen(vectors: pa.Array) -> pa.Array:
        import numpy as np

        known: dict[int, Any] = {}
        out = []
        for v in vectors:
            x = np.asarray(v.as_py(), float)
            if len(x) not in known:
                known[len(x)] = made(len(x), directions)
            out.append(known[len(x)] @ x)
        return pa.array(out, pa.list_(pa.float64()))

    values = members.select(key, "_n", F.posexplode(seen("_v")).alias("_d", "x"))
    placed = with_bucket(values, "x", buckets)
    parts = max(bucket_count(members), math.ceil(rows * directions / at_once))
    inside = Window.partitionBy(key, "_d", BUCKET).orderBy("x")
    # Of n sorted values the differences of all pairs add up to the sum of x (2 rank - n - 1). Ranks are those inside
    # a range, and what they lack is the same for all its rows: how many rows are in the ranges before it.
    ranked = placed.repartition(parts, key, "_d", BUCKET).withColumn("_rank", F.row_number().over(inside))
    ranges = ranked.groupBy(key, "_n", "_d", BUCKET).agg(
        F.count("*").alias("_c"), F.sum("x").alias("_x"), F.sum(F.col("x") * (2 * F.col("_rank") - F.col("_n") - 1)).alias("_in")
    )
    by_range = Window.partitionBy(key, "_d").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(by_range), F.lit(0))
    terms = ranges.select(key, "_n", "_d", (F.col("_in") + 2 * before * F.col("_x")).alias("_t"))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    means = terms.groupBy(key, "_n", "_d").agg(F.sum("_t").alias("_s")).withColumn("_mean", F.col("_s") / pairs)
    return means.groupBy(key, "_n").agg(
        F.avg("_mean").alias("avg_pairwise_distance"), (F.stddev("_mean") / math.sqrt(directions)).alias("standard_error")
    ).select(key, pairs.cast("bigint").alias("pairs"), "avg_pairwise_distance", "standard_error")


def cluster_distance(
    df: DataFrame,
    key: str,
    idx: str,
    vector: str,
    block_rows: int = 512,
    broadcast_bytes: int = BROADCAST_BYTES,
    exact_rows: int = EXACT_ROWS,
    directions: int = DIRECTIONS,
    buckets: int | None = None,
    at_once: int = NUMBERS_AT_ONCE,
) -> DataFrame:
    """Mean pairwise Euclidean distance of groups of any size: key, pairs, mean and its standard error.

    In groups of up to ``exact_rows`` members all pairs are measured, but none is emitted: the
    members, told apart by ``idx``, are hashed into blocks of about ``block_rows``. Each block goes
    to every block it has to meet, and a task measures one pair of blocks. The error is 0.

    A larger group is seen from ``directions`` directions. From one of them its vectors are numbers,
    whose mean difference follows from their order; ranks are counted by ranges of values, so no
    task orders a whole group, and a task has about ``at_once`` of the numbers. The mean over the directions estimates the mean distance; the work grows with n log n.
    With 512 directions the standard error is below 1 % of the mean for groups that are not all on
    one line, and at most 3.4 % for those.
    """
    members = df.select(key, F.col(idx).alias("_i"), V.doubles(F.col(vector)).alias("_v"))
    sized = members.groupBy(key).agg(F.count("*").alias("_n"))
    large = sized.where(F.col("_n") > exact_rows)
    exact = _measured_distance(members, sized.where(F.col("_n") <= exact_rows), df, key, block_rows, broadcast_bytes)
    exact = exact.withColumn("standard_error", F.lit(0.0))
    rows = large.agg(F.sum("_n")).first()[0]
    if not rows:
        return exact
    # A group in this table holds over exact_rows rows, so its keys are few against the rows.
    known = F.broadcast(large) if fits(large, broadcast_bytes) else large
    return exact.unionByName(_sliced_distance(members.join(known, key).select(key, "_v", "_n"), key, rows, directions, buckets, at_once))


def _measured_distance(
    members: DataFrame, sized: DataFrame, df: DataFrame, key: str, block_rows: int, broadcast_bytes: int
) -> DataFrame:
    """Key, pairs and the mean distance of all pairs."""
    spans = sized.select(key, F.ceil(F.col("_n") / block_rows).alias("_blocks"))
    if fits(spans, broadcast_bytes):
        spans = F.broadcast(spans)
    placed = members.join(spans, key).withColumn(
        "_block", F.pmod(F.xxhash64("_i"), F.col("_blocks"))
    )
    met = placed.select(
        key, "_i", "_v", "_block",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_other"),
    )
    paired = met.select(
        key,
        F.least("_block", "_other").alias("_low"),
        F.greatest("_block", "_other").alias("_high"),
        (F.col("_block") < F.col("_other")).alias("_left"),
        F.col("_i"),
        F.col("_v"),
    )
    key_type = df.schema[key].dataType.simpleString()

    def measure(pdf: Any) -> Any:
        import numpy as np
        import pandas as pd

        same = pdf["_low"].iloc[0] == pdf["_high"].iloc[0]
        points = np.stack(pdf["_v"].to_numpy())
        left = points if same else points[pdf["_left"].to_numpy()]
        right = points if same else points[~pdf["_left"].to_numpy()]
        summed, count = 0.0, 0
        for place, row in enumerate(left):
            others = right[place + 1:] if same else right
            summed += float(np.sqrt(((others - row) ** 2).sum(axis=1)).sum())
            count += len(others)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "_sum": [summed], "_count": [count]})

    parts = paired.groupBy(key, "_low", "_high").applyInPandas(
        measure, f"`{key}` {key_type}, _sum double, _count bigint"
    )
    return parts.groupBy(key).agg(
        F.sum("_count").alias("pairs"),
        F.try_divide(F.sum("_sum"), F.sum("_count")).alias("avg_pairwise_distance"),
    )


def cluster_median(
    df: DataFrame,
    key: str,
    vector: str,
    buckets: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Element-wise median of groups of any size: key, dim, median.

    Values are put into global ranges of equal depth and counted per group, dimension and range.
    Only the range that holds the middle is then looked at, as counts of distinct values, so no
    task needs a whole group and one range holds no more than its share of all values.
    """
    values = df.select(key, F.posexplode(V.doubles(F.col(vector))).alias("dim", "x")).where(
        F.col("x").isNotNull()
    )
    placed = with_bucket(values, "x", buckets)
    counts = placed.groupBy(key, "dim", BUCKET).agg(F.count("*").alias("c"))
    # A group has one row per range here, so this window and its sort stay small.
    by_range = Window.partitionBy(key, "dim")
    ranges = counts.select(
        key,
        "dim",
        BUCKET,
        F.sum("c").over(by_range).alias("n"),
        F.sum("c").over(by_range.orderBy(BUCKET)).alias("upto"),
        "c",
    )
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = ranges.where((F.col("upto") - F.col("c") <= high) & (F.col("upto") > low)).select(
        key, "dim", BUCKET, "n", (F.col("upto") - F.col("c")).alias("before")
    )
    # With few groups only the values of middle ranges are shuffled.
    few = fits(middle, broadcast_bytes)
    near = (
        placed.join(F.broadcast(middle) if few else middle, [key, "dim", BUCKET])
        .groupBy(key, "dim", BUCKET, "n", "before", "x")
        .agg(F.count("*").alias("c"))
    )
    inside = Window.partitionBy(key, "dim", BUCKET).orderBy("x")
    ranked = near.withColumn("upto", F.col("before") + F.sum("c").over(inside))
    hit = ranked.where((F.col("upto") > low) & (F.col("upto") - F.col("c") <= high))
    return hit.groupBy(key, "dim").agg(((F.min("x") + F.max("x")) / 2).alias("median"))
