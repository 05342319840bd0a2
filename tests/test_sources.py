import pytest
from pyspark.sql import functions as F

from phrasewell.sources import stages, tables
from phrasewell.streaming.incremental import append_batches, append_results, file_stream


def test_csv_keeps_breaks_quotes_and_spaces(spark, path):
    rows = [("a,b", 'say "x"', " lead\nbreak "), ("é", None, "\\back")]
    df = spark.createDataFrame(rows, tables.QUERY_SCHEMA)
    tables.write_results(df, path, form="csv")
    read = tables.scan_pairs(spark, path, position="at")
    assert sorted((r.question, r.paraphrased_question, r.sparql_wikidata) for r in read.collect()) == sorted(rows)
    assert read.select("at").distinct().count() == 2


def test_a_run_replaces_its_own_folder_only(spark, path):
    tables.write_results(spark.range(3), path, run_id="a")
    tables.write_results(spark.range(5), path, run_id="b")
    tables.write_results(spark.range(1), path, run_id="a")
    got = {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert got == {"a": 1, "b": 5}


def test_a_resumed_stage_computes_missing_rows_only(spark, path):
    seen = []

    def compute(todo):
        seen.append(sorted(r.id for r in todo.collect()))
        return todo.withColumn("twice", F.col("id") * 2)

    stages.resume_stage(spark.range(3), path, "id", compute)
    again = stages.resume_stage(spark.range(1, 6), path, "id", compute)
    assert seen == [[0, 1, 2], [3, 4, 5]]
    assert sorted((r.id, r.twice) for r in again.collect()) == [(i, 2 * i) for i in range(1, 6)]
    assert spark.read.parquet(path).count() == 6
    assert stages.resume_stage(spark.range(2), path, "id", compute).count() == 2


def test_a_second_run_reads_keys_and_shuffles_no_stored_row(spark, path):
    source = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    seen = []

    def compute(todo):
        seen.append(todo)
        return todo.withColumn("vector", F.array_repeat(F.col("id").cast("double"), 50))

    stages.resume_stage(source.where("id < 4000"), path, "k", compute)
    whole = stages.resume_stage(source, path, "k", compute)
    assert whole.count() == 5000 and spark.read.parquet(path).count() == 5000
    again = stages.resume_stage(source, path, "k", compute)

    def lines(df):
        return df._jdf.queryExecution().executedPlan().toString().splitlines()

    missing = lines(seen[2])
    # Only the source is shuffled; of the stage the keys alone are read.
    scans = [line for line in missing if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 1 and "ReadSchema: struct<k:string>" in scans[0]
    assert sum("Exchange" in line for line in missing) == 1
    returned = lines(again)
    at = next(i for i, line in enumerate(returned) if "FileScan" in line and "Bucketed: true" in line)
    exchanges = [i for i, line in enumerate(returned) if "Exchange" in line]
    assert len(exchanges) == 1 and exchanges[0] > at  # that of the source's keys, on the other side
    assert not any("Sort" in line for line in returned)


def test_a_stage_of_no_rows(spark, path):
    for _ in range(2):
        got = stages.resume_stage(spark.range(0), path, "id", lambda todo: todo.withColumn("x", F.lit("a")))
        assert got.columns == ["id", "x"] and got.count() == 0
    assert stages.resume_stage(spark.range(2), path, "id", lambda todo: todo.withColumn("x", F.lit("a"))).count() == 2


def test_stages_of_other_layouts(spark, path):
    spark.range(3).withColumn("x", F.col("id")).write.parquet(path + "/plain")
    got = stages.resume_stage(spark.range(5), path + "/plain", "id", lambda todo: todo.withColumn("x", -F.col("id")))
    assert sorted((r.id, r.x) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, -3), (4, -4)]
    stages.resume_stage(spark.range(3), path + "/keyed", "id", lambda todo: todo.withColumn("x", F.col("id")), buckets=3)
    with pytest.raises(ValueError):
        stages.resume_stage(spark.range(3).withColumn("y", F.col("id")), path + "/keyed", "y", lambda todo: todo)
    # A session that does not know the table yet, and one whose table has been taken away.
    for table in spark.catalog.listTables():
        if table.name.startswith("stage_"):
            spark.sql(f"DROP TABLE {table.name}")
    got = stages.resume_stage(spark.range(5), path + "/keyed", "id", lambda todo: todo.withColumn("x", F.col("id")), buckets=7)
    assert got.count() == 5 and spark.read.parquet(path + "/keyed").count() == 5
    assert stages.stage_layout(spark, path + "/keyed", "id", 99).buckets == 3


def test_failed_rows_are_kept_with_their_reason_and_tried_again(spark, path):
    def compute(todo):
        return todo.withColumns({"x": F.col("id"), "why": F.when(F.col("id") == 7, "odd")})

    got = stages.resume_stage(spark.range(10), path, "id", compute, error="why")
    assert got.columns == ["id", "x"] and sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert [tuple(r) for r in stages.failures(spark, path, "id", "why").collect()] == [(7, "odd")]
    asked = []

    def mended(todo):
        asked.extend(r.id for r in todo.collect())
        return todo.withColumns({"x": F.col("id"), "why": F.lit(None).cast("string")})

    assert stages.resume_stage(spark.range(10), path, "id", mended, error="why").count() == 10
    assert asked == [7] and stages.failures(spark, path, "id", "why").count() == 0


def test_a_broken_run_keeps_its_finished_slices(spark, path):
    calls = []

    def compute(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            raise RuntimeError("broken")
        return todo.withColumn("x", F.col("id"))

    with pytest.raises(RuntimeError):
        stages.resume_stage(spark.range(200), path, "id", compute, slices=4)
    kept = spark.read.parquet(path).count()
    assert kept == calls[0] + calls[1] > 0
    assert stages.resume_stage(spark.range(200), path, "id", compute, slices=4).count() == 200
    assert sum(calls[3:]) == 200 - kept


def test_content_keys_tell_missing_from_empty(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), ("a", ""), ("ab", "")], "x string, y string")
    keyed = df.select(stages.content_key(F.col("x"), F.col("y")).alias("k"))
    assert keyed.distinct().count() == 4


def test_load_or_build_builds_once(spark, path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    assert stages.load_or_build(spark, path, build).count() == 4
    assert stages.load_or_build(spark, path, build).count() == 4
    assert calls == [1]


def test_stored_threshold(spark, path):
    tables.write_threshold(spark.sql("SELECT 0.6D AS threshold"), path)
    assert tables.threshold_table(spark, path).collect()[0].threshold == 0.6


def test_types_can_be_read_off_the_data(spark, path):
    tables.write_results(spark.createDataFrame([("a", 0.5)], "question string, score double"), path, form="csv")
    read = tables.scan_pairs(spark, path, schema=None)
    assert read.dtypes == [("question", "string"), ("score", "double")]


def test_stream_equals_batch_and_goes_on(spark, path):
    source, out, checkpoint = path + "/in", path + "/out", path + "/checkpoint"
    schema = spark.range(1).schema

    def run():
        append_results(file_stream(spark, source, schema), lambda df: df.withColumn("x", F.col("id") + 1), out, checkpoint)

    spark.range(10).write.parquet(source)
    run()
    spark.range(10, 25).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.x) for r in spark.read.parquet(out).collect()) == [(i, i + 1) for i in range(25)]


def test_batches_handed_over_twice_are_stored_once(spark, path):
    source, out = path + "/in", path + "/out"
    spark.range(10).write.parquet(source)

    def handle(batch, _):
        stages.resume_stage(batch, out, "id", lambda todo: todo.withColumn("x", F.col("id") + 1))

    for checkpoint in ("/one", "/two"):
        append_batches(file_stream(spark, source, spark.range(1).schema), handle, path + checkpoint)
    assert spark.read.parquet(out).count() == 10


def test_unknown_prompt_style(spark):
    from phrasewell.operators import prompts

    with pytest.raises(ValueError):
        prompts.translate_prompt(F.lit("q"), F.array(F.lit("d")), "other")
