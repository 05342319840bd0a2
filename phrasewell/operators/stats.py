"""Statistics and evaluation of scores and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.functions import fixed_values as fixed, ratios as R
from phrasewell.operators.lookup import lookup, salted_join
from phrasewell.operators.ranges import running_totals
from phrasewell.session import BROADCAST_BYTES, fits


def attach_labels(
    df: DataFrame, labels: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hand-made 0/1 labels put next to the rows; NULL where a row has none."""
    return lookup(df, labels, key, "left", broadcast_bytes)


def confusion(df: DataFrame, manual: str = "eval_manual", judge: str = "eval_llm") -> DataFrame:
    """One row: tp, fp, fn, tn, agreements, labelled rows, positives and negatives, all rows."""
    m, j = F.col(manual), F.col(judge)
    return df.agg(
        F.count_if((m == 1) & (j == 1)).alias("tp"),
        F.count_if((m == 0) & (j == 1)).alias("fp"),
        F.count_if((m == 1) & (j == 0)).alias("fn"),
        F.count_if((m == 0) & (j == 0)).alias("tn"),
        F.count_if(m == j).alias("same"),
        F.count(m).alias("labelled"),
        F.count_if(m == 1).alias("manual_true"),
        F.count_if(m == 0).alias("manual_false"),
        F.count_if(j == 1).alias("judge_true"),
        F.count("*").alias("total"),
    )


def classifier_metrics(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of a ``confusion`` row; NULL where a denominator is 0.

    Accuracy is over the labelled rows, or over ``n`` if given.
    """
    p, r = R.precision(F.col("tp"), F.col("fp")), R.recall(F.col("tp"), F.col("fn"))
    return counts.select(
        R.accuracy(F.col("same"), F.lit(n) if n else F.col("labelled")).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        R.f1(p, r).alias("f1"),
    )


def judge_summary(counts: DataFrame, n: int | None = None) -> DataFrame:
    """What the two models got right, from a ``confusion`` row."""
    return counts.select(
        F.col("judge_true").alias("judged_correct"),
        "total",
        F.col("manual_true").alias("first_correct"),
        F.col("manual_false").alias("first_mistakes"),
        (F.col("fp") + F.col("fn")).alias("judge_mistakes"),
        F.col("tp").alias("good"),
        (F.lit(n).cast("bigint") if n else F.col("labelled")).alias("out_of"),
    )


def present_scores(df: DataFrame, score: str) -> DataFrame:
    """The score as DOUBLE in ``score``, without missing ones; other columns stay."""
    others = [c for c in df.columns if c != "score"]
    named = df.select(*others, F.col(score).cast("double").alias("score"))
    return named.where(F.col("score").isNotNull() & ~F.isnan("score"))


def score_stats(df: DataFrame, score: str) -> DataFrame:
    """One row: min, max, mean, median and mode of a score, the smallest of tied modes.

    All are taken from the counts of distinct values; the median comes from running sums over
    value ranges, so no task has to hold all values.
    """
    present = present_scores(df, score).select("score")
    counted = present.groupBy("score").agg(F.count("*").alias("c"))
    counts = running_totals(counted, "score", {"upto": "c"}, basis=present)
    n, value = F.col("upto_total"), F.col("score")
    middle = F.when(
        (F.col("upto") > F.floor((n - 1) / 2)) & (F.col("upto") - F.col("c") <= F.floor(n / 2)), value
    )
    return counts.agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.try_divide(F.sum(value * F.col("c")), F.sum("c")).alias("mean"),
        ((F.min(middle) + F.max(middle)) / 2).alias("median"),
        F.max_by(value, F.struct(F.col("c"), -value)).alias("mode"),
    )


def histogram(
    df: DataFrame,
    score: str,
    bins: int,
    by: str | None = None,
    groups: Sequence[float | int | str] = (),
    threshold: float | Column | None = None,
) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins appear.

    Columns bin, left, right, n; with ``by`` one histogram over its own range for each of
    ``groups``; with ``threshold`` also ``below``, whether the left edge lies under it. If all
    values are equal the range is widened by 0.5 on both sides.
    """
    parts = list(groups) if by else [None]
    # Missing scores become a missing bin, which no bin of the result matches.
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    place = F.lit(0)
    for i, group in enumerate(parts):
        if by:
            place = F.when(F.col(by) == group, i).otherwise(place)
    present = (df.where(F.col(by).isin(parts)) if by else df).select(
        value.alias("x"), place.cast("int").alias("_part")
    )
    low, high = F.min("x"), F.max("x")
    half = F.when(low == high, 0.5).otherwise(0.0)
    # One row per histogram, so the broadcast cannot grow with the data.
    bounds = F.broadcast(
        present.groupBy("_part")
        .agg((low - half).alias("lo"), (high + half).alias("hi"))
        .withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    )
    scale = bins / (F.col("hi") - F.col("lo"))
    scaled = present.join(bounds, "_part").withColumn(
        "b",
        F.least(F.floor((F.col("x") - F.col("lo")) * scale), F.lit(bins - 1).cast("bigint")),
    )
    # A value that rounding put on the wrong side of an edge goes to the bin the edges name.
    b, x = F.col("b"), F.col("x")
    down = (x < b * F.col("w") + F.col("lo")).cast("int")
    up = ((b < bins - 1) & (x >= (b + 1) * F.col("w") + F.col("lo"))).cast("int")
    counted = scaled.select("_part", (b - down + up).alias("bin")).groupBy("_part", "bin").agg(
        F.count("*").alias("n")
    )
    spine = df.sparkSession.range(bins * len(parts)).select(
        F.floor(F.col("id") / bins).cast("int").alias("_part"), (F.col("id") % bins).alias("bin")
    )
    at, lo, w = F.col("bin"), F.col("lo"), F.col("w")
    shown = spine.join(bounds, "_part", "left").join(counted, ["_part", "bin"], "left").select(
        *([F.get(F.array(*[F.lit(g) for g in parts]), F.col("_part")).alias(by)] if by else []),
        "bin",
        (at * w + lo).alias("left"),
        F.when(at == bins - 1, F.col("hi")).otherwise((at + 1) * w + lo).alias("right"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    return shown if threshold is None else shown.withColumn("below", F.col("left") < threshold)


def histogram_flagged(df: DataFrame, score: str, threshold: float | Column, bins: int = 200) -> DataFrame:
    return histogram(df, score, bins, threshold=threshold)


def _digest(key: str) -> Column:
    """A short stand-in for a text key; a missing key has one of its own."""
    return F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit("missing")).alias("_key")


def _first(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def accepted_labels(
    accepted: DataFrame,
    evaluated: DataFrame,
    key: str = "question",
    order: Sequence[str] = (),
    n: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The first ``n`` accepted rows with the evaluated rows of the same key.

    Missing keys match each other, equal keys multiply rows, other names present on both sides get
    ``_x`` and ``_y``. Rows that match and rows that do not are made apart: a question that fills
    much of the evaluated table then never has to sit on the unsplittable side of an outer join,
    and accepted rows that are measured to be few are broadcast.
    Otherwise popular questions are salted.
    """
    both = (set(accepted.columns) & set(evaluated.columns)) - {key}

    def renamed(df: DataFrame, end: str) -> list[Column]:
        return [F.col(c).alias(c + end if c in both else c) for c in df.columns if c != key]

    left = _first(accepted, order, n).select(_digest(key), key, *renamed(accepted, "_x"))
    right = evaluated.select(_digest(key), *renamed(evaluated, "_y"))
    wanted, there = left.select("_key").distinct(), right.select("_key").distinct()
    seen = wanted.join(there, "_key", "left_semi")
    if fits(left, broadcast_bytes):
        matched = right.join(F.broadcast(left), "_key")
    else:
        matched = salted_join(right, left, "_key", "inner")
    alone = salted_join(left, seen, "_key", "left_anti").drop("_key")
    columns = [*left.columns[1:], *right.columns[1:]]
    return matched.select(*columns).unionByName(alone, allowMissingColumns=True)


def label_share(
    accepted: DataFrame,
    evaluated: DataFrame,
    key: str = "question",
    label: str = "eval_manual",
    order: Sequence[str] = (),
    n: int | None = None,
) -> DataFrame:
    """One row: rows of label 1 and 0 in ``accepted_labels``, with percentages of both to one digit.

    Both sides are counted per key before they meet, so equal keys are never multiplied out.
    """
    left = _first(accepted, order, n).groupBy(_digest(key)).agg(F.count("*").alias("times"))
    right = evaluated.groupBy(_digest(key)).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    counted = left.join(right, "_key").agg(
        F.coalesce(F.sum(F.col("times") * F.col("pos")), F.lit(0)).alias("true_count"),
        F.coalesce(F.sum(F.col("times") * F.col("neg")), F.lit(0)).alias("false_count"),
    )
    both = F.col("true_count") + F.col("false_count")
    return counted.select(
        "true_count",
        "false_count",
        F.round(F.try_divide(100.0 * F.col("true_count"), both), 1).alias("true_percent"),
        F.round(F.try_divide(100.0 * F.col("false_count"), both), 1).alias("false_percent"),
    )


def share_split(counts: DataFrame, total: int | None = None) -> DataFrame:
    """Three shares of a total from a ``confusion`` row: two cut down to whole rows, then the rest."""
    whole = F.lit(total).cast("bigint") if total else F.col("labelled")

    def part(hits: str) -> Column:
        return F.floor(F.try_divide(F.col(hits).cast("double"), F.col("labelled")) * whole)

    sized = counts.select(whole.alias("whole"), part("tn").alias("tn"), part("tp").alias("tp"))
    rest = F.col("whole") - F.col("tn") - F.col("tp")
    named = {"true negatives": F.col("tn"), "true positives": F.col("tp"), "false negatives": rest}
    entries = [F.struct(F.lit(name).alias("share"), size.alias("size")) for name, size in named.items()]
    return sized.select(F.explode(F.array(*entries)).alias("s")).select("s.share", "s.size")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, Pearson r and standard error of the slope."""
    n, r = F.col("n"), F.col("r")
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("r"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_count(y, x).alias("n"),
    ).select(
        "slope",
        "intercept",
        "r",
        F.when(n > 2, F.sqrt(F.try_divide((1 - r * r) * F.col("syy"), F.col("sxx") * (n - 2)))).alias("stderr"),
        "n",
    )


def threshold_step(
    df: DataFrame,
    score: str,
    start: float = fixed.THRESHOLD_START,
    rate: float = fixed.THRESHOLD_RATE,
    steps: int = fixed.THRESHOLD_STEPS,
) -> DataFrame:
    """One row: mean score, and the threshold after ``steps`` steps towards it, kept in [0, 1]."""
    moved = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)) if steps > 0 else F.array().cast("array<int>"),
        F.lit(float(start)),
        lambda t, _: F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), t + rate * F.when(F.col("mean_score") < t, -1.0).otherwise(1.0)),
        ),
    )
    return df.agg(F.avg(score).alias("mean_score")).select("mean_score", moved.alias("threshold"))


def score_counts(present: DataFrame, label: str) -> DataFrame:
    """Per distinct score the rows with label 1 and with label 0."""
    return present.where(F.col(label).isNotNull()).groupBy("score").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """For each distinct score as inclusive limit: tp, fp, fn, tn, precision, recall, F1."""
    present = present_scores(df, score)
    running = running_totals(
        score_counts(present, label), "score", {"tp": "pos", "fp": "neg"}, descending=True, basis=present
    )
    full = running.select(
        F.col("score").alias("threshold"), "tp", "fp",
        (F.col("tp_total") - F.col("tp")).alias("fn"), (F.col("fp_total") - F.col("fp")).alias("tn"),
    )
    p, r = R.precision(F.col("tp"), F.col("fp")), R.recall(F.col("tp"), F.col("fn"))
    return full.select("*", p.alias("precision"), r.alias("recall"), R.f1(p, r).alias("f1"))


def threshold_sweep(df: DataFrame, score: str, label: str, target: float = 1.0) -> DataFrame:
    """One row: the smallest limit with at least the wanted precision; NULLs if there is none."""
    good = threshold_curve(df, score, label).where(F.col("precision") >= target)
    best = good.agg(
        F.min_by(F.struct("threshold", "tp", "fp", "fn", "tn", "precision", "recall"), "threshold").alias("b")
    )
    return best.select("b.threshold", "b.tp", "b.fp", "b.fn", "b.tn", "b.precision", "b.recall")
