import pytest
from pyspark.sql import functions as F

from checks import views
from phrasewell.plans.assess import RESULT_COLUMNS, STRATEGIES, accepted, assess, assess_stream, failed, results, run_table
from phrasewell.plans.filtering import add_bleu, evaluate_answers, filter_answers, stored_threshold
from phrasewell.plans.preprocess import preprocess
from phrasewell.sources import tables
from phrasewell.streaming.incremental import file_stream


def rows(spark):
    data = [(f"what is {i}", f"ASK wd:Q{i}", f"ASK [thing {i}]", [f"[thing {i}] is {i}"]) for i in range(5)]
    return spark.createDataFrame(
        data, "question string, sparql_wikidata string, sparql_wikidata_translated string, descriptions array<string>"
    )


def run(spark, path, **options):
    return assess(
        rows(spark), path, views.echo_generator(), views.shortest_critic(), views.hashing_encoder(),
        views.hashing_encoder(32), **options,
    )


def test_assess_twice_is_assess_once(spark, path):
    first = results(run(spark, path, k=3)).orderBy("query_id").collect()
    second = results(run(spark, path, k=3)).orderBy("query_id").collect()
    assert first == second and len(first) == 5
    assert list(first[0].asDict()) == list(RESULT_COLUMNS)
    assert spark.read.parquet(path + "/answers").count() == 5


def test_one_candidate_has_no_pair_scores(spark, path):
    for row in results(run(spark, path, k=1)).collect():
        assert row.avg_pairwise_distance is None and row.avg_cosine_similarity is None
        assert row.best_translation_Q == row.best_translation_dist == row.instantiated_query + "?"


def test_query_mode_changes_the_query_side_only(spark, path):
    raw = {r.original_query: r for r in results(run(spark, path + "/a")).collect()}
    named = {r.original_query: r for r in results(run(spark, path + "/b", mode="instantiated")).collect()}
    assert all(raw[q].bert_q_nl_score_dist < named[q].bert_q_nl_score_dist for q in raw)
    assert all(raw[q].bert_nl_nl_gt_score_dist == named[q].bert_nl_nl_gt_score_dist for q in raw)


def test_candidates_stay_in_their_row(spark, path):
    from phrasewell.operators import generate as G

    df = rows(spark).withColumnRenamed("sparql_wikidata_translated", "query")
    lists = G.answer_lists(df, 3, views.echo_generator(), rounds=2)
    long = G.answer_candidates(df, 3, views.echo_generator(), rounds=2)
    assert sorted((r.query, i, t) for r in lists.collect() for i, t in enumerate(r.texts)) == sorted(
        (r.query, r.cand_idx, r.text) for r in long.collect()
    )
    plan = run(spark, path, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert [r.texts for r in G.answer_lists(df, 0, views.echo_generator()).collect()] == [[]] * 5


def test_every_input_row_gets_its_result(spark, path):
    """Equal rows, another translation of the same query, another input on the same stage, other parameters."""
    one = rows(spark)
    other = one.where("question = 'what is 1'").withColumn("sparql_wikidata_translated", F.lit("ASK [else]"))
    mixed = one.unionByName(one).unionByName(other)
    models = (views.echo_generator(), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    got = results(assess(mixed, path, *models, k=2)).collect()
    assert len(got) == 11 and len({r.query_id for r in got}) == 6
    assert sorted(r.instantiated_query for r in got if r.original_question == "what is 1") == ["ASK [else]", "ASK [thing 1]", "ASK [thing 1]"]
    assert results(assess(other, path, *models, k=2)).count() == 1
    assert {F.size: len(r.candidates) for r in assess(other, path, *models, k=4).collect()} == {F.size: 4}


def test_the_final_text_is_that_of_the_strategy(spark, path):
    assessed = run(spark, path, k=3, mode="instantiated")
    for strategy, (text, score) in STRATEGIES.items():
        kept = accepted(assessed, strategy, 0.5).collect()
        assert all(r.final_translation == r[text] and r.final_score == r[score] >= 0.5 for r in kept)
        assert len(kept) == assessed.where(F.col(score) >= 0.5).count()
    with pytest.raises(ValueError):
        accepted(assessed, "best")


def test_answers_follow_their_texts(spark, path):
    """A new text under an old key is answered anew, and equal texts give a row each."""
    kinds = "row_id int, question string, paraphrased_question string, sparql_wikidata string, wikidata_translated string"
    labels = spark.createDataFrame([(0, 1)], "row_id int, eval_manual int")
    line = lambda i, q: (i, q, q, "s", q)
    ask = lambda data: evaluate_answers(
        spark.createDataFrame(data, kinds), path, views.shot_generator(), views.length_judge(), views.hashing_encoder(), labels, views.SHOTS, views.JUDGE_SHOTS
    )
    first = ask([line(0, "the one"), line(1, "the one"), line(2, "the two")]).collect()
    assert sorted((r.row_id, r.response, r.eval_manual) for r in first) == [(0, "the so one", 1), (1, "the so one", None), (2, "the so two", None)]
    assert [(r.row_id, r.response) for r in ask([line(0, "the new")]).collect()] == [(0, "the so new")]


def test_a_stream_without_files_is_empty(spark, path):
    import pathlib

    pathlib.Path(path.removeprefix("file:") + "/in").mkdir(parents=True)
    models = (views.echo_generator(), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    stream = file_stream(spark, path + "/in", rows(spark).schema)
    got = assess_stream(stream, path + "/out", path + "/stage", path + "/checkpoint", *models, k=2)
    assert got.collect() == [] and got.columns == list(RESULT_COLUMNS)


def test_a_stream_of_rows_is_assessed_once(spark, path):
    source = path + "/in"
    models = (views.echo_generator(), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    batch = {r.query_id: r for r in results(run(spark, path + "/batch", k=2)).collect()}
    for part in rows(spark).randomSplit([0.5, 0.5], 1):
        part.write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows(spark).schema)
        got = assess_stream(stream, path + "/out", path + "/stage", path + "/checkpoint", *models, k=2)
    assert {r.query_id: r for r in got.collect()} == batch
    assert got.count() == 5


def logged(folder, answer):
    """A generator that leaves a file per call with the number of prompts."""

    def make():
        import os
        import uuid

        def call(prompts, samples):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
                log.write("\n".join(p.replace("\n", " ") for p in prompts))
            return answer(prompts, samples)

        return call

    return make


def asked(folder):
    return sorted(line for file in folder.iterdir() for line in file.read_text().splitlines() if line)


def test_a_query_of_an_earlier_batch_is_not_asked_again(spark, path, tmp_path):
    source = path + "/in"
    echo = views.echo_generator()()
    models = (logged(str(tmp_path), echo), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    one = rows(spark).where("question IN ('what is 0', 'what is 1')")
    parts = [one, rows(spark).where("question = 'what is 1'").unionByName(rows(spark).where("question = 'what is 2'")), one.unionByName(one)]
    for n, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows(spark).schema)
        got = assess_stream(stream, path + "/out", path + "/stage", path + "/checkpoint", *models, k=1, rounds=0)
        assert len(asked(tmp_path)) == (2, 3, 3)[n]
    counts = {r.original_question: r["count"] for r in got.groupBy("original_question").count().collect()}
    assert counts == {"what is 0": 3, "what is 1": 4, "what is 2": 1}
    assert got.dropDuplicates().count() == 3


def test_forgotten_queries_are_asked_again(spark, path, tmp_path):
    import time

    source = path + "/in"
    models = (logged(str(tmp_path), views.echo_generator()()), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    one = rows(spark).where("question = 'what is 0'")
    for n in range(3):
        (one if n != 1 else rows(spark).where("question = 'what is 3'")).coalesce(1).write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows(spark).schema)
        got = assess_stream(stream, path + "/out", path + "/stage", path + "/checkpoint", *models, k=1, rounds=0, expiry_ms=1)
        time.sleep(0.1)
    assert len(asked(tmp_path)) == 3 and got.count() == 3


def test_a_failed_query_is_left_out_and_asked_again(spark, path):
    def failing(broken):
        def make():
            def call(prompts, samples):
                if broken and any("thing 2" in p for p in prompts):
                    raise ConnectionError("gone")
                return [f"{len(p)}?" for p in prompts]

            return call

        return make

    def go(broken):
        return assess(rows(spark), path, failing(broken), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32), k=2, retries=1)

    with pytest.raises(Exception, match="gone"):
        assess(rows(spark), path + "/other", failing(True), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32), k=2)
    assert sorted(r.original_question for r in go(True).collect()) == [f"what is {i}" for i in (0, 1, 3, 4)]
    told = failed(spark, path).collect()
    assert [(r.step, r.error) for r in told] == [("answers", "ConnectionError: gone")]
    assert go(False).count() == 5 and failed(spark, path).count() == 0


def test_rows_that_are_equal_are_joined_where_they_lie(spark, path):
    """A third of the rows is one query: its scores are sent to the rows, and scores are worked out once."""
    many = spark.range(300).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('q', id)) AS question", "IF(id % 3 = 0, 'ASK wd:Q0', concat('ASK wd:Q', id)) AS sparql_wikidata",
        "IF(id % 3 = 0, 'ASK [0]', concat('ASK [', id, ']')) AS sparql_wikidata_translated", "array('d') AS descriptions",
    )
    models = (views.echo_generator(), views.shortest_critic(), views.hashing_encoder(), views.hashing_encoder(32))
    got = assess(many, path, *models, k=2)
    assert got.count() == 300 and got.where("original_question = 'hot'").count() == 100
    plan = accepted(got)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # the stored score is read


def test_threshold_is_stored_once(spark, path):
    high = spark.createDataFrame([(0.9,)], "s double")
    assert stored_threshold(spark, path, high, "s").collect()[0].threshold == 0.6000000000000004
    low = spark.createDataFrame([(0.0,)], "s double")
    assert stored_threshold(spark, path, low, "s").collect()[0].threshold == 0.6000000000000004


def test_documents_round_trip(spark, path):
    assessed = run(spark, path + "/stage", k=2)
    tables.write_nested(tables.nested_documents(assessed), path + "/documents")
    read = spark.read.json(path + "/documents")
    assert read.count() == 5
    assert read.select(F.size("NL_embeddings")).distinct().collect()[0][0] == 2
    assert read.select(F.size("q_embedding")).distinct().collect()[0][0] == 64
    assert run_table(assessed, "r", k=2).collect()[0].asDict() == {"run_id": "r", "k": "2"}


def test_preprocess_limits_and_joins(spark):
    split = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("row_id"), F.concat(F.lit("wd:Q"), "id").alias("sparql_wikidata"))
    labels = spark.createDataFrame([("Q1", "one", "first")], "id string, label string, description string")
    got = {r.row_id: r for r in preprocess([split(0, 10), split(10, 20)], labels, limit=12).collect()}
    assert sorted(got) == list(range(12))
    assert (got[1].sparql_wikidata_translated, got[1].descriptions) == ("[one]", ["[one] is first"])
    assert (got[2].sparql_wikidata_translated, got[2].descriptions) == ("wd:Q2", [])


def test_filter_reports(spark):
    data = [(i, f"q{i}", f"p{i} a b c d", f"p{i} a b c x", i / 10, i % 2, 1) for i in range(10)]
    evaluated = spark.createDataFrame(
        data, "row_id int, question string, paraphrased_question string, answer string, eval_bert double, eval_manual int, eval_llm int"
    ).withColumns({"sparql_wikidata": F.lit("s"), "wikidata_translated": F.lit("t")})
    report = filter_answers(add_bleu(evaluated, "answer"), "answer", limit=0.5, labelled_rows=3)
    assert sorted(r.question for r in report.final.collect()) == ["q5", "q6", "q7", "q8", "q9"]
    assert report.final.columns == [
        "question", "paraphrased_question", "sparql_wikidata", "wikidata_translated", "answer", "eval_bert",
    ]
    share = report.shares.collect()[0]
    assert (share.true_count, share.false_count) == (2, 1)
    assert report.accepted.count() == 3
    assert report.metrics.collect()[0].precision == pytest.approx(0.5)
    assert report.bleu_histogram.agg(F.sum("n")).collect()[0][0] == 10
    assert report.accepted_histogram.count() == 200
