"""Positive and shifted negative pairs, and how well a similarity tells them apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.functions import ratios as R, vectors as V
from phrasewell.operators.candidates import SCORE_DIGITS
from phrasewell.operators.generate import Encoder, encode_texts
from phrasewell.operators.lookup import lookup
from phrasewell.operators.ranges import running_totals, with_next
from phrasewell.operators.rows import head_n
from phrasewell.operators.stats import histogram, present_scores, score_counts
from phrasewell.session import new_path


def contrastive_pairs(
    df: DataFrame, key: str | tuple[str, ...], query: str, question: str, split: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Two rows per input row: its own question with label 1, that of the next row with label 0.

    The last row is paired with the first one, with ``split`` that of its own split; rows without a
    split are left out. ``key``, one column or several of any types that have an order, is unique within a split and
    gives the order. All splits are ordered together, by split and key, so a split of any size is
    spread like other rows, and any number of splits is one plan.
    """
    keys = (key,) if isinstance(key, str) else tuple(key)
    others = [split] if split is not None else []
    rows = df.select(*others, *keys, query, question)
    if split is None:
        at = keys[0] if len(keys) == 1 else "_at"
        ordered = rows if len(keys) == 1 else rows.withColumn(at, F.struct(*keys))
        ringed = with_next(ordered, at, {"_next": question}, buckets)
    else:
        ordered = rows.where(F.col(split).isNotNull()).withColumn("_at", F.struct(split, *keys))
        ahead = with_next(ordered, "_at", {"_next": question, "_next_split": split}, buckets)
        # The last row of a split, and it alone, looks up the first one.
        last = F.when(F.col("_next_split") != F.col(split), F.col(split))
        heads = ordered.groupBy(F.col(split).alias("_last")).agg(F.min_by(F.struct(F.col(question).alias("q")), "_at").alias("_first"))
        ringed = lookup(ahead.withColumn("_last", last), heads, "_last").withColumn(
            "_next", F.when(F.col("_last").isNotNull(), F.col("_first.q")).otherwise(F.col("_next"))
        )
    own, shifted = [
        F.struct(F.col(c).alias("sentence_1"), F.lit(label).alias("label"))
        for c, label in ((question, 1.0), ("_next", 0.0))
    ]
    return ringed.select(
        *keys, *others, F.col(query).alias("sentence_0"), F.explode(F.array(own, shifted)).alias("p")
    ).select(*keys, "sentence_0", "p.sentence_1", "p.label", *others)


def pair_vectors(
    df: DataFrame, key: str, query: str, question: str, encoder: Callable[[], Encoder], split: str | None = None
) -> DataFrame:
    """Pairs as vectors. Rows are encoded once and stored in the shared folder; pairs are made of these."""
    others = [split] if split else []
    encoded = encode_texts(df.select(key, query, question, *others), (query, "_q", encoder), (question, "_n", encoder))
    path = new_path(df.sparkSession, "encoded")
    encoded.select(key, *others, "_q", "_n").write.parquet(path)
    return contrastive_pairs(df.sparkSession.read.parquet(path), key, "_q", "_n", split)


@dataclass(frozen=True)
class PairReport:
    """How a similarity tells true pairs from false ones."""

    pairs: DataFrame
    histograms: DataFrame
    binary: DataFrame
    similarity: DataFrame


def evaluate_pairs(
    rows: DataFrame,
    key: str,
    query: str,
    question: str,
    encoder: Callable[[], Encoder],
    n: int | None = None,
    split: str | None = None,
    bins: int = 30,
) -> PairReport:
    """The whole evaluation: the first ``n`` rows, paired and encoded, their similarities, and what they tell.

    The scored pairs are stored once, and every report is read off them.
    """
    some = rows if n is None else head_n(rows, n, key)
    path = new_path(rows.sparkSession, "pairs")
    scored = score_pairs(pair_vectors(some, key, query, question, encoder, split))
    # Rounded, so that pairs that are equally alike have equal scores.
    scored = scored.withColumn("similarity", F.round("similarity", SCORE_DIGITS))
    scored.drop("sentence_0", "sentence_1").write.parquet(path)
    pairs = rows.sparkSession.read.parquet(path)
    return PairReport(
        pairs, pair_similarity(pairs, bins), binary_eval(pairs, "similarity", "label"), similarity_eval(pairs, "similarity", "label")
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Cosine of each pair of vectors, as ``similarity``."""
    similarity = V.cosine(V.doubles(F.col("sentence_0")), V.doubles(F.col("sentence_1")))
    return pairs.withColumn("similarity", similarity)


def pair_similarity(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Histograms of the similarities of true and of false pairs, each over its own range."""
    return histogram(scored, "similarity", bins, by="label", groups=(1.0, 0.0))


def binary_eval(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: best accuracy, best F1 with its precision and recall, their limits, and AP.

    A limit lies halfway between two neighbouring distinct scores; the lowest score itself is not
    tried as one. On a tie the higher limit wins. AP sums precision times gain of recall.
    """
    present = present_scores(df, score)
    running = running_totals(
        score_counts(present, label), "score", {"tp": "pos", "fp": "neg"},
        descending=True, following="lower", basis=present,
    )
    tp, fp, all_pos, all_neg = (F.col(c) for c in ("tp", "fp", "tp_total", "fp_total"))
    p, r = R.precision(tp, fp), F.try_divide(tp.cast("double"), all_pos)
    rated = running.select(
        "score",
        ((F.col("score") + F.col("lower")) / 2).alias("limit"),
        p.alias("precision"),
        r.alias("recall"),
        F.coalesce(R.f1(p, r), F.lit(0.0)).alias("f1"),
        R.accuracy(tp + all_neg - fp, all_pos + all_neg).alias("accuracy"),
        (p * F.try_divide(F.col("pos").cast("double"), all_pos)).alias("gain"),
    )
    entry = F.struct("limit", "accuracy", "f1", "precision", "recall")

    def top(measure: str) -> Column:
        return F.max_by(entry, F.when(F.col("limit").isNotNull(), F.struct(measure, "score")))

    return rated.agg(
        top("accuracy").alias("a"), top("f1").alias("f"), F.sum("gain").alias("average_precision")
    ).select(
        F.col("a.accuracy").alias("accuracy"),
        F.col("a.limit").alias("accuracy_threshold"),
        F.col("f.f1").alias("f1"),
        F.col("f.limit").alias("f1_threshold"),
        F.col("f.precision").alias("precision"),
        F.col("f.recall").alias("recall"),
        "average_precision",
    )


def similarity_eval(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: Pearson and Spearman correlation of a score with a 0/1 label.

    Ranks are averages over equal values, measured from the middle rank. They come from counts of
    distinct scores; the two ranks of the label follow from the number of rows of each.
    """
    present = present_scores(df, score)
    counts = score_counts(present, label).withColumn("c", F.col("pos") + F.col("neg"))
    running = running_totals(counts, "score", {"upto": "c", "_pos": "pos", "_neg": "neg"}, basis=present)
    pos, neg = F.col("_pos_total").cast("double"), F.col("_neg_total").cast("double")
    rank = F.col("upto") - (F.col("c") - 1) / 2 - (pos + neg + 1) / 2
    # Ranks of the label, from the middle: zeros lie pos/2 below it, ones neg/2 above it.
    sums = running.withColumn("rank", rank).agg(
        F.sum(F.col("rank") * F.col("rank") * F.col("c")).alias("rr"),
        F.sum(F.col("rank") * (F.col("pos") * neg - F.col("neg") * pos) / 2).alias("rl"),
        F.max(pos * neg * (pos + neg) / 4).alias("ll"),
        F.sum(F.col("c")).alias("n"),
    )
    spearman = F.try_divide(F.col("rl"), F.sqrt("rr") * F.sqrt("ll"))
    pearson = present.agg(F.corr("score", F.col(label).cast("double")).alias("p")).scalar()
    return sums.select(pearson.alias("pearson"), spearman.alias("spearman"), "n")
