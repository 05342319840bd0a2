import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasewell.functions import vectors as V
from phrasewell.operators import candidates as C


def column(spark, expression, **arrays):
    fields = ", ".join(f"{n} {'array<array<double>>' if v and isinstance(v[0], list) else 'array<double>'}" for n, v in arrays.items())
    return spark.createDataFrame([tuple(arrays.values())], fields).select(expression.alias("x")).collect()[0].x


def test_cosine_of_zero_and_unequal_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert column(spark, V.cosine(a, b), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert column(spark, V.cosine(a, b), a=[0.0, 0.0], b=[4.0, 3.0]) is None
    assert column(spark, V.cosine(a, b), a=[1.0], b=[4.0, 3.0]) is None


def test_median_of_odd_and_even_counts(spark):
    m = V.median_vector(F.col("a"))
    assert column(spark, m, a=[[1.0, 9.0], [5.0, 1.0], [3.0, 2.0]]) == [3.0, 2.0]
    assert column(spark, m, a=[[1.0, 9.0], [5.0, 1.0]]) == [3.0, 5.0]


def test_pair_means_below_two_vectors(spark):
    for f in (V.mean_pairwise_cosine, V.mean_pairwise_distance):
        assert column(spark, f(F.col("a")), a=[[1.0, 2.0]]) is None


def test_pair_means_with_numpy(spark):
    points = np.random.default_rng(1).normal(size=(5, 8))
    i, j = np.triu_indices(5, 1)
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    arrays = {"a": points.tolist()}
    assert column(spark, V.mean_pairwise_cosine(F.col("a")), **arrays) == pytest.approx((units @ units.T)[i, j].mean())
    assert column(spark, V.mean_pairwise_distance(F.col("a")), **arrays) == pytest.approx(np.linalg.norm(points[i] - points[j], axis=1).mean())


def test_two_candidates_tie_at_the_median(spark):
    points = np.random.default_rng(5).normal(size=(2, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(points)], "g int, i int, v array<double>")
    assert C.pick_by_median(df, "g", "i", "v").collect()[0].i == 0


def clusters(spark):
    """One group holds most of the rows; another holds a single one."""
    rng = np.random.default_rng(7)
    members = {0: rng.normal(size=(90, 6)), 1: rng.normal(size=(21, 6)), 2: rng.normal(size=(1, 6))}
    members[0][:40, 2] = 0.5
    data = [(g, g * 1000 + i, v.tolist()) for g, vs in members.items() for i, v in enumerate(vs)]
    return members, spark.createDataFrame(data, "g int, id int, v array<double>").repartition(6)


def test_clusters_of_any_size(spark):
    members, df = clusters(spark)
    cosine = {r.g: r.avg_cosine_similarity for r in C.cluster_cosine(df, "g", "v", 6).collect()}
    distance = {r.g: r.avg_pairwise_distance for r in C.cluster_distance(df, "g", "id", "v", block_rows=8).collect()}
    median = {(r.g, r.dim): r.median for r in C.cluster_median(df, "g", "v", buckets=5).collect()}
    wide = {(r.g, r.dim): r.median for r in C.cluster_median(df, "g", "v", broadcast_bytes=0).collect()}
    assert cosine[2] is None and distance[2] is None
    for g, points in members.items():
        for dim in range(6):
            assert median[g, dim] == wide[g, dim] == pytest.approx(np.median(points[:, dim]))
        if g < 2:
            i, j = np.triu_indices(len(points), 1)
            units = points / np.linalg.norm(points, axis=1, keepdims=True)
            assert cosine[g] == pytest.approx((units @ units.T)[i, j].mean())
            assert distance[g] == pytest.approx(np.linalg.norm(points[i] - points[j], axis=1).mean())


def test_cluster_distance_counts_every_pair_once(spark):
    members, df = clusters(spark)
    for block in (4, 16, 512):
        got = {r.g: r.pairs for r in C.cluster_distance(df, "g", "id", "v", block_rows=block).collect()}
        assert got == {g: len(v) * (len(v) - 1) // 2 for g, v in members.items()}


def test_mean_pool_cuts_and_takes_both_ways(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 0)], "k int, pos int, tok int")
    table = spark.createDataFrame([(0, [0.0, 2.0]), (1, [4.0, 6.0])], "tok int, vector array<double>")
    for limit in (0, 10**6):
        got = C.mean_pool(rows, table, "k", "tok", "pos", 2, max_tokens=2, broadcast_bytes=limit).collect()
        assert got[0].vector == [2.0, 4.0]
        more = rows.union(spark.createDataFrame([(2, 0, 9)], rows.schema))
        pooled = {r.k: r.vector for r in C.mean_pool(more, table, "k", "tok", "pos", 2, max_tokens=2, broadcast_bytes=limit).collect()}
        assert pooled == {1: [2.0, 4.0], 2: None}


def test_hashed_embedding_has_unit_length_and_is_stable(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "a b a")], "k int, t string")
    got = {r.k: r.vector for r in C.hashed_embedding(df, "k", "t", 16).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) for v in got.values())
    assert got[1] == got[4] and got[2] == got[3]


def test_stacks_are_flattened_and_checked(spark):
    stack = spark.createDataFrame([([[[1.0, 2.0]], [[3.0, 4.0]]],)], "m array<array<array<double>>>")
    assert stack.select(V.flatten_stack(F.col("m")).alias("x")).collect()[0].x == [[1.0, 2.0], [3.0, 4.0]]
    assert not column(spark, V.same_length(F.col("a")), a=[[1.0], [1.0, 2.0]])


def test_unequal_vectors_end_the_job(spark):
    assert column(spark, V.checked_stack(F.col("a")), a=[[1.0, 3.0], [1.0, 2.0]]) == [[1.0, 3.0], [1.0, 2.0]]
    with pytest.raises(Exception, match="unequal lengths: \\[1,2\\]"):
        column(spark, V.checked_stack(F.col("a")), a=[[1.0], [1.0, 2.0]])


def test_large_groups_are_seen_from_directions(spark):
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=(300, 24)), 1: rng.normal(size=(250, 24)) * np.linspace(0.01, 3, 24) + 5, 2: rng.normal(size=(20, 24))}
    rows = [(g, i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    got = {r.g: r for r in C.cluster_distance(df, "g", "id", "v", exact_rows=100, buckets=7).collect()}
    for g, points in groups.items():
        i, j = np.triu_indices(len(points), 1)
        exact = np.linalg.norm(points[i] - points[j], axis=1).mean()
        assert got[g].pairs == len(i) and abs(got[g].avg_pairwise_distance / exact - 1) < (0.01 if g < 2 else 1e-9)
        assert (got[g].standard_error == 0) == (g == 2) and got[g].standard_error < 0.02 * exact


def test_texts_are_counted_where_they_lie(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k int, t string")
    made = C.hashed_embedding(df, "k", "t", 8)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert all("t#" not in line for line in plan.splitlines() if "Exchange" in line)
    assert {r.k: round(sum(x * x for x in r.vector), 9) for r in made.collect()}[1] == 1


def test_mean_pool_has_more_tasks_for_more_rows(spark):
    """A table over the limit of which few tokens are asked for is reduced and broadcast; sums of vectors are not shuffled."""
    rows = spark.range(2000).selectExpr("id AS k", "0 AS pos", "id % 5 AS tok")
    table = spark.range(5000).selectExpr("id AS tok", "array(CAST(id AS DOUBLE), 1D) AS vector")
    for limit in (5_000, 10**7):
        made = C.mean_pool(rows, table, "k", "tok", "pos", 2, broadcast_bytes=limit, at_once=100)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") == 1 and ", 20)" in plan and "BroadcastHashJoin" in plan
        assert {r.k: r.vector for r in made.collect()} == {i: [i % 5, 1.0] for i in range(2000)}


def test_a_large_cluster_is_ordered_in_more_tasks(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(1, i, p.tolist()) for i, p in enumerate(points)], "g int, id int, v array<double>")
    made = C.cluster_distance(df, "g", "id", "v", exact_rows=100, buckets=7, directions=60, at_once=1000)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert ", 18)" in plan and plan.count("ArrowEvalPython") == 1
    i, j = np.triu_indices(300, 1)
    seen = np.sort(points @ C._directions(6, 60).T, axis=0)
    wanted = (seen * (2 * np.arange(1, 301) - 301)[:, None]).sum(axis=0).mean() / len(i)
    assert made.collect()[0].avg_pairwise_distance == pytest.approx(wanted)
