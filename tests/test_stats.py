import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewell.operators import pairs as P, stats as S


def scores(spark, values):
    return spark.createDataFrame([(v,) for v in values], "s double").repartition(3)


def test_score_stats_with_ties_and_missing(spark):
    values = [0.5, 0.25, 0.5, 0.25, 0.75, 0.9, None, float("nan")]
    present = values[:6]
    row = S.score_stats(scores(spark, values), "s").collect()[0]
    assert (row.min, row.max, row.mode) == (0.25, 0.9, 0.25)
    assert row.mean == pytest.approx(statistics.mean(present))
    assert row.median == pytest.approx(statistics.median(present))


def test_mode_of_distinct_values_is_the_minimum(spark):
    assert S.score_stats(scores(spark, [0.3, 0.1, 0.2]), "s").collect()[0].mode == 0.1


def test_median_with_one_value_in_most_rows(spark):
    values = [0.5] * 400 + [i / 1000 for i in range(300)] + [0.9 + i / 10000 for i in range(301)]
    assert S.score_stats(scores(spark, values), "s").collect()[0].median == statistics.median(values)


def test_histogram_is_numpys(spark):
    values = [i / 10 for i in range(101)] + [0.3, 0.7, 9.9]
    for bins in (10, 30, 200):
        counts, edges = np.histogram(values, bins)
        got = S.histogram(scores(spark, values), "s", bins).orderBy("bin").collect()
        assert [r.n for r in got] == counts.tolist()
        assert [r.left for r in got] == pytest.approx(edges[:-1].tolist())
        assert got[-1].right == edges[-1]


def test_histogram_of_equal_values(spark):
    got = S.histogram(scores(spark, [2.0] * 5), "s", 10).orderBy("bin").collect()
    counts, edges = np.histogram([2.0] * 5, 10)
    assert [r.n for r in got] == counts.tolist() and got[0].left == edges[0] and got[-1].right == edges[-1]


def test_flag_is_by_left_edge(spark):
    got = S.histogram_flagged(scores(spark, [0.0, 1.0]), "s", 0.5, bins=4).orderBy("bin").collect()
    assert [r.below for r in got] == [True, True, False, False]


def flags(spark, rows):
    return spark.createDataFrame(rows, "eval_manual int, eval_llm int")


def test_metrics_without_positives(spark):
    row = S.classifier_metrics(S.confusion(flags(spark, [(1, 0), (0, 0)]))).collect()[0]
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, None, 0.0, None)
    row = S.classifier_metrics(S.confusion(flags(spark, [(1, 1), (None, 1)])), n=4).collect()[0]
    assert (row.accuracy, row.precision) == (0.25, 1.0)


def test_shares_cut_and_rest(spark):
    rows = [(0, 0)] * 24 + [(1, 1)] * 30 + [(1, 0)] * 46
    got = {r.share: r["size"] for r in S.share_split(S.confusion(flags(spark, rows)), 200).collect()}
    assert got == {"true negatives": 48, "true positives": 60, "false negatives": 92}


def test_accepted_labels_with_missing_and_equal_keys(spark):
    accepted = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "question string, id int")
    evaluated = spark.createDataFrame([("a", 10, 1), ("a", 11, 0), (None, 12, 1), ("b", 13, 1)], "question string, id int, eval_manual int")
    wanted = sorted([("a", 1, 10), ("a", 1, 11), ("a", 2, 10), ("a", 2, 11), ("z", 4, -1), ("", 3, 12)])
    for limit in (0, 10**6):
        joined = S.accepted_labels(accepted, evaluated, broadcast_bytes=limit)
        assert sorted((r.question or "", r.id_x, r.id_y or -1) for r in joined.collect()) == wanted
    share = S.label_share(accepted, evaluated).collect()[0]
    assert (share.true_count, share.false_count, share.true_percent, share.false_percent) == (3, 2, 60.0, 40.0)
    first = S.label_share(accepted, evaluated, order=["id"], n=1).collect()[0]
    assert (first.true_count, first.false_count) == (1, 1)


def test_label_share_of_a_question_in_most_rows_is_not_multiplied_out(spark):
    same = spark.range(200_000).select(F.lit("q").alias("question"), (F.col("id") % 2).cast("int").alias("eval_manual"))
    row = S.label_share(same.select("question"), same).collect()[0]
    assert (row.true_count, row.false_count) == (200_000 * 100_000,) * 2


def test_linear_fit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    y = 2 * x + 1 + rng.normal(size=60)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    row = S.linear_fit(df, "x", "y").collect()[0]
    slope, intercept = np.polyfit(x, y, 1)
    residual = y - slope * x - intercept
    assert (row.slope, row.intercept, row.r) == pytest.approx((slope, intercept, np.corrcoef(x, y)[0, 1]))
    assert row.stderr == pytest.approx(np.sqrt((residual**2).sum() / 58 / ((x - x.mean()) ** 2).sum()))


def test_threshold_steps(spark):
    assert S.threshold_step(scores(spark, [0.9, 0.8]), "s").collect()[0].threshold == 0.6000000000000004
    assert S.threshold_step(scores(spark, [5.0]), "s", start=0.99, steps=10).collect()[0].threshold == 1.0
    assert S.threshold_step(scores(spark, [-1.0]), "s", start=0.05, steps=10).collect()[0].threshold == 0.0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "s double, y int").repartition(3)


def test_threshold_sweep_excludes_all_bad_rows(spark):
    df = labelled(spark, [(0.9, 1), (0.8, 1), (0.87, 1), (0.79, 0), (0.7, 1)])
    row = S.threshold_sweep(df, "s", "y").collect()[0]
    assert (row.threshold, row.tp, row.fp, row.fn) == (0.8, 3, 0, 1)
    assert S.threshold_sweep(labelled(spark, [(0.9, 0)]), "s", "y").collect()[0].threshold is None


def brute_binary(rows):
    """Limits halfway between distinct neighbours, higher one on a tie; AP over distinct scores."""
    values = sorted({s for s, _ in rows}, reverse=True)
    positives = sum(y for _, y in rows)
    best_acc, best_f1, ap, last = (-1, None), (-1, None), 0.0, 0.0
    for i, v in enumerate(values):
        tp = sum(y for s, y in rows if s >= v)
        n = sum(1 for s, _ in rows if s >= v)
        ap += (tp / positives - last) * tp / n
        last = tp / positives
        if i + 1 < len(values):
            limit = (v + values[i + 1]) / 2
            acc = (tp + (len(rows) - positives) - (n - tp)) / len(rows)
            f1 = 2 * tp / (n + positives)
            best_acc = max(best_acc, (acc, limit))
            best_f1 = max(best_f1, (f1, limit))
    return best_acc, best_f1, ap


def test_binary_eval_with_equal_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 25, 200) / 25, rng.integers(0, 2, 200))]
    row = P.binary_eval(labelled(spark, rows), "s", "y").collect()[0]
    acc, f1, ap = brute_binary(rows)
    assert (row.accuracy, row.accuracy_threshold) == pytest.approx(acc)
    assert (row.f1, row.f1_threshold) == pytest.approx(f1)
    assert row.average_precision == pytest.approx(ap)


def test_rank_correlation_with_equal_scores(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"s": rng.integers(0, 30, 300) / 30, "y": rng.integers(0, 2, 300)})
    frame["s"] += frame["y"] * 0.2
    row = P.similarity_eval(labelled(spark, [(float(s), int(y)) for s, y in frame.values]), "s", "y").collect()[0]
    ranks = frame.rank()
    assert row.pearson == pytest.approx(frame["s"].corr(frame["y"]))
    assert row.spearman == pytest.approx(ranks["s"].corr(ranks["y"]))


def test_pairs_of_one_row(spark):
    df = spark.createDataFrame([(1, "q", "n")], "k int, q string, n string")
    got = sorted((r.sentence_0, r.sentence_1, r.label) for r in P.contrastive_pairs(df, "k", "q", "n").collect())
    assert got == [("q", "n", 0.0), ("q", "n", 1.0)]


def test_pairs_by_encoder(spark):
    from checks.views import hashing_encoder

    df = spark.createDataFrame([(i, f"a{i} b", f"a{i} b") for i in range(6)], "k int, q string, n string")
    scored = P.score_pairs(P.pair_vectors(df, "k", "q", "n", hashing_encoder(256))).collect()
    assert all(r.similarity == pytest.approx(1) for r in scored if r.label == 1)
    assert all(r.similarity < 0.99 for r in scored if r.label == 0)


def told_pairs(rows, keys, split=None):
    """Brute force: pairs of each row with its own question and with the next one of its split."""
    groups = {}
    for r in rows:
        groups.setdefault(r[split] if split else None, []).append(r)
    found = []
    for name, own in groups.items():
        if split and name is None:
            continue
        own.sort(key=lambda r: tuple(r[k] for k in keys))
        for i, r in enumerate(own):
            for question, label in ((r["n"], 1.0), (own[(i + 1) % len(own)]["n"], 0.0)):
                found.append((r["q"], question, label))
    return sorted(found)


@pytest.mark.parametrize("key", ["t", ("a", "t"), "d"])
@pytest.mark.parametrize("split", [None, "s"])
def test_pairs_by_keys_of_any_type(spark, key, split):
    df = spark.range(400).selectExpr(
        "concat('é', (id * 37) % 1000) AS t", "id % 7 AS a", "date_add(date'2020-01-01', CAST((id * 53) % 997 AS INT)) AS d",
        "IF(id % 11 = 0, NULL, concat('s', id * id % 5)) AS s", "concat('q', id) AS q", "concat('n', id) AS n",
    )
    got = P.contrastive_pairs(df, key, "q", "n", split, buckets=5)
    keys = (key,) if isinstance(key, str) else key
    assert sorted((r.sentence_0, r.sentence_1, r.label) for r in got.collect()) == told_pairs(df.collect(), keys, split)
    assert got.columns == [*keys, "sentence_0", "sentence_1", "label", *([split] if split else [])]


def test_ten_thousand_splits_are_one_plan(spark):
    df = spark.range(30_000).selectExpr("id", "CAST(id % 10000 AS STRING) AS s", "id AS q", "id AS n")
    got = P.contrastive_pairs(df, "id", "q", "n", "s", buckets=6)
    wrong = got.where("label = 0 AND sentence_1 <> (sentence_0 + 10000) % 30000 OR label = 1 AND sentence_1 <> sentence_0").count()
    assert got.count() == 60_000 and wrong == 0
