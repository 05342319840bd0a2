import random

from pyspark.sql import functions as F

from phrasewell.operators import ranges, rows


def test_row_index_of_sparse_keys_over_many_buckets(spark):
    keys = random.Random(3).sample(range(-(10**12), 10**12), 2000)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7)
    got = {r.k: r.row_id for r in rows.row_index(df, "k", buckets=16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_row_index_of_text_and_composite_keys(spark):
    df = spark.createDataFrame([(f"t{i % 5}", i) for i in range(200)], "a string, b int").repartition(6)
    got = {(r.a, r.b): r.row_id for r in rows.row_index(df, "a", "b").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_a_missing_key_comes_first(spark):
    df = spark.createDataFrame([(4,), (None,), (9,), (-3,)], "k bigint")
    assert {r.k: r.row_id for r in rows.row_index(df, "k", buckets=3).collect()} == {None: 0, -3: 1, 4: 2, 9: 3}
    down = ranges.running_totals(df.withColumn("c", F.lit(1)), "k", {"t": "c"}, descending=True, buckets=3)
    assert {r.k: r.t for r in down.collect()} == {9: 1, 4: 2, -3: 3, None: 4}


def test_row_index_of_few_rows(spark):
    assert rows.row_index(spark.range(5, 6), "id").collect()[0].row_id == 0
    assert rows.row_index(spark.range(0), "id").count() == 0


def test_head_and_tail_keep_the_order(spark):
    df = spark.range(100).repartition(5)
    assert [r.id for r in rows.head_n(df, 3, "id").collect()] == [0, 1, 2]
    assert [r.id for r in rows.tail_n(df, 3, "id").collect()] == [97, 98, 99]
    assert rows.tail_n(df, 1000, "id").count() == 100


def test_slices_start_from_zero_and_may_be_empty(spark):
    df = spark.range(10).withColumn("row_id", F.col("id"))
    split = {(r.split, r.row_id): r.id for r in rows.slice_split(df, 6, 3).collect()}
    assert split == {**{("train", i): i for i in range(6)}, **{("test", i): 6 + i for i in range(3)}}
    assert rows.slice_rows(df, 6000, 6300).count() == 0


def test_score_filter_is_inclusive_and_drops_missing(spark):
    df = spark.createDataFrame([(0.86,), (0.87,), (0.9,), (None,)], "s double")
    assert sorted(r.s for r in rows.score_filter(df, "s", 0.87).collect()) == [0.87, 0.9]


def test_running_totals_both_ways(spark):
    values = {float(v): v % 4 + 1 for v in range(50)}
    df = spark.createDataFrame(list(values.items()), "k double, c int").repartition(5)
    up = {r.k: r.t for r in ranges.running_totals(df, "k", {"t": "c"}, buckets=8).collect()}
    down = {r.k: r.t for r in ranges.running_totals(df, "k", {"t": "c"}, descending=True, buckets=8).collect()}
    for k in values:
        assert up[k] == sum(c for v, c in values.items() if v <= k)
        assert down[k] == sum(c for v, c in values.items() if v >= k)


def test_next_row_wraps_around(spark):
    df = spark.range(0, 300, 3)
    got = {r.id: r.after for r in ranges.with_next(df, "id", {"after": "id"}, buckets=9).collect()}
    assert got == {i: (i + 3) % 300 for i in range(0, 300, 3)}
    one = ranges.with_next(spark.range(1), "id", {"after": "id"}).collect()
    assert [(r.id, r.after) for r in one] == [(0, 0)]


def test_next_row_keeps_a_missing_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, t string")
    got = {r.k: r.n for r in ranges.with_next(df, "k", {"n": "t"}, buckets=2).collect()}
    assert got == {1: None, 2: "c", 3: "a"}


def test_ordered_work_never_sorts_the_table_in_one_task(spark):
    plan = rows.row_index(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    single = plan.split("SinglePartition")
    # The only gathering is that of bucket totals, which sits under an aggregate.
    assert len(single) == 2 and "HashAggregate(keys=[_bucket" in single[1]


def test_many_first_and_last_rows_are_selected_by_rank(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "concat('t', (id * 31) % 5000) AS t", "id % 3 AS few", "IF(id % 50 = 0, NULL, id) AS gaps")
    for keys in (("k",), ("t",), ("few", "k"), ("gaps", "k")):
        for n in (1, 1700, 9000):
            first, last = (f(df, n, *keys, at_once=0, buckets=9).collect() for f in (rows.head_n, rows.tail_n))
            assert first == rows.head_n(df, n, *keys).collect() and last == rows.tail_n(df, n, *keys).collect()
    plan = rows.head_n(df, 500, "k", at_once=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan
    assert rows.head_n(df.limit(0), 5, "k", at_once=0).count() == 0
