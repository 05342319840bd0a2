"""Assessment job: k candidates per query, three winners, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasewell.functions import fixed_values as fixed
from phrasewell.functions.vectors import doubles
from phrasewell.operators.candidates import assess_scores
from phrasewell.operators.entities import query_text
from phrasewell.operators.generate import (
    Encoder,
    Generator,
    answer_lists,
    critique_select,
    encode_texts,
)
from phrasewell.operators.lookup import join_in_place
from phrasewell.operators.prompts import TAGGED
from phrasewell.operators.rows import score_filter
from phrasewell.sources.stages import content_key, failures, read_stage, resume_stage
from phrasewell.sources.tables import write_results
from phrasewell.session import new_path
from phrasewell.streaming.incremental import append_batches, with_first_batch

# The columns of a result record.
RESULT_COLUMNS = (
    "query_id", "original_query", "instantiated_query", "original_question",
    "bert_q_nl_score_Q", "bert_nl_nl_gt_score_Q",
    "bert_q_nl_score_dist", "bert_nl_nl_gt_score_dist",
    "bert_q_nl_score_critique", "bert_nl_nl_gt_score_critique",
    "best_translation_Q", "best_translation_dist", "best_translation_llm_critique",
    "avg_pairwise_distance", "avg_cosine_similarity",
)


INPUT = ("question", "sparql_wikidata", "sparql_wikidata_translated", "descriptions")


def query_id(
    run_id: str = "", models: str = "", k: int = 2, rounds: int = 1, mode: str = "uninstantiated", style: str = TAGGED, raw_body: bool = False, **_: Any
) -> Column:
    """What an answer depends on, as the key of a row."""
    told = [F.lit(str(x)) for x in (run_id, models, k, rounds, mode, style, raw_body)]
    content = [F.col(c) for c in ("sparql_wikidata", "question", "sparql_wikidata_translated")]
    return content_key(*told, *content, F.to_json("descriptions"))


def assess(
    rows: DataFrame,
    stage: str,
    generator: Callable[[], Generator],
    critic: Callable[[], Generator],
    query_encoder: Callable[[], Encoder],
    text_encoder: Callable[[], Encoder],
    k: int = 2,
    rounds: int = 1,
    mode: str = "uninstantiated",
    style: str = TAGGED,
    run_id: str = "",
    concurrency: int | None = None,
    raw_body: bool = False,
    slices: int = 1,
    models: str = "",
    retries: int | None = None,
) -> DataFrame:
    """Assessed rows: ``RESULT_COLUMNS`` and the vectors behind them, one row per input row.

    The input has question, sparql_wikidata, sparql_wikidata_translated and descriptions. Answers,
    critiques and scores are stored under ``stage`` before they are used, by what they depend on: the run,
    the parameters, ``models`` (the name the caller gives to them) and all of the input. A second run
    asks for missing ones only, equal rows are asked for once, and rows of other inputs or other
    parameters that lie under ``stage`` are not returned. The ``k`` candidates of a query stay in its row from the
    first prompt to the last score, and stages lie in buckets of their key, so no vector is ever shuffled. ``concurrency`` is the number of
    tasks that call the models at a time; ``slices`` is that of ``resume_stage``.

    With ``retries`` a query whose calls fail is tried that many times more and then left out of the
    result; ``failed`` tells the reasons, and the next run asks again. Without it such a call ends the job.
    """
    error = None if retries is None else ERROR
    tries = retries or 0
    keyed = rows.withColumn("query_id", query_id(run_id, models, k, rounds, mode, style, raw_body))
    queries = keyed.select(
        "query_id",
        F.col("sparql_wikidata").alias("original_query"),
        F.col("sparql_wikidata_translated").alias("instantiated_query"),
        F.col("question").alias("original_question"),
        F.col("sparql_wikidata_translated").alias("query"),
        "descriptions",
        query_text(mode, "sparql_wikidata", "sparql_wikidata_translated").alias("_asked"),
    ).dropDuplicates(["query_id"])

    def spread(todo: DataFrame) -> DataFrame:
        return todo.repartition(concurrency, "query_id") if concurrency else todo

    def answered(todo: DataFrame) -> DataFrame:
        made = answer_lists(spread(todo), k, generator, rounds=rounds, style=style, raw_body=raw_body, error=error, retries=tries)
        encoded = encode_texts(
            made,
            ("texts", "_text_vectors", text_encoder),
            ("texts", "_query_spaces", query_encoder),
            ("_asked", "query_vector", query_encoder),
            ("original_question", "truth_vector", text_encoder),
        )
        candidates = F.transform(
            "texts",
            lambda text, i: F.struct(
                i.alias("cand_idx"),
                text.alias("text"),
                F.get("_text_vectors", i).alias("text_vector"),
                F.get("_query_spaces", i).alias("query_space"),
            ),
        )
        return encoded.withColumn("candidates", candidates).drop(
            "texts", "_text_vectors", "_query_spaces", "_asked"
        )

    def criticised(todo: DataFrame) -> DataFrame:
        asked = spread(todo).withColumn("_texts", F.transform("candidates", lambda c: c["text"]))
        chosen = critique_select(asked, critic, candidates="_texts", style=style, raw_body=raw_body, error=error, retries=tries)
        return encode_texts(
            chosen.drop("_texts"),
            ("critique", "critique_text_vector", text_encoder),
            ("critique", "critique_query_space", query_encoder),
        )

    def as_doubles(stored: DataFrame) -> DataFrame:
        candidates = F.transform(
            "candidates",
            lambda c: F.struct(
                c["cand_idx"].alias("cand_idx"), c["text"].alias("text"),
                doubles(c["text_vector"]).alias("text_vector"), doubles(c["query_space"]).alias("query_space"),
            ),
        )
        vectors = ("query_vector", "truth_vector", "critique_text_vector", "critique_query_space")
        return stored.withColumns({**{c: doubles(F.col(c)) for c in vectors}, "candidates": candidates})

    def scored(todo: DataFrame) -> DataFrame:
        made = assess_scores(as_doubles(todo))
        return made.select("query_id", *[c for c in made.columns if c not in todo.columns])

    answers = resume_stage(queries, f"{stage}/answers", "query_id", answered, slices, error)
    critiques = resume_stage(answers, f"{stage}/critiques", "query_id", criticised, slices, error)
    scores = resume_stage(critiques, f"{stage}/scores", "query_id", scored, slices)
    known = as_doubles(critiques).join(scores, "query_id")
    return join_in_place(keyed.select("query_id"), known, "query_id")


ERROR = "error"


def failed(spark: SparkSession, stage: str) -> DataFrame:
    """Rows (step, query_id, error) of the queries of a stage that have no answer or no critique yet."""
    steps = [step for step in ("answers", "critiques") if read_stage(spark, f"{stage}/{step}") is not None]
    told = [failures(spark, f"{stage}/{step}", "query_id", ERROR).select(F.lit(step).alias("step"), "query_id", ERROR) for step in steps]
    return reduce(DataFrame.unionByName, told)


# Names of the strategies, and the columns of their winners and scores.
STRATEGIES = {
    "distance": ("best_translation_dist", "bert_q_nl_score_dist"),
    "q_nl_score": ("best_translation_Q", "bert_q_nl_score_Q"),
    "llm_critique": ("best_translation_llm_critique", "bert_q_nl_score_critique"),
}


def accepted(assessed: DataFrame, strategy: str = "distance", limit: float | Column = fixed.SCORE_LIMIT) -> DataFrame:
    """Rows whose final text is close enough to its query, with ``final_translation`` and ``final_score``.

    ``strategy`` says which winner is final; its score is the cosine with the query, and the limit,
    such as one that ``stored_threshold`` gives, is inclusive. Rows without a score are dropped.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    text, score = STRATEGIES[strategy]
    final = assessed.withColumns({"final_translation": F.col(text), "final_score": F.col(score)})
    return score_filter(final, "final_score", limit)


def results(assessed: DataFrame) -> DataFrame:
    """The flat result record."""
    return assessed.select(*RESULT_COLUMNS)


def assess_stream(
    stream: DataFrame, out: str, stage: str, checkpoint: str, *models: Callable, expiry_ms: int | None = None, **options: Any
) -> DataFrame:
    """Assess rows as they arrive; the result table grows batch by batch.

    ``models`` and ``options`` are those of ``assess``. Each batch has folders of its own for its
    answers and its results: one that is handed over again after a failure goes on with its stored
    answers and replaces its results. The stream's state tells in which batch a query came first; one that comes again
    gets the result of that batch, of which no other rows are read, and is not asked for again. It is
    asked for again if it failed there, or if it has not come for ``expiry_ms``.
    """
    spark = stream.sparkSession
    keyed = stream.select(*INPUT, query_id(**options).alias("query_id"))

    def handle(batch: DataFrame, number: int) -> None:
        here = f"{stage}/batch={number}"
        batch.write.mode("overwrite").parquet(f"{here}/rows")  # the state is asked once
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{here}/rows")
        if rows.isEmpty():  # a batch that lets states expire
            return
        known = rows.where(F.col("first_batch") < number).select("query_id", "first_batch")
        earlier = [r[0] for r in known.select("first_batch").distinct().collect()]  # fewer than there were batches
        new = rows.where(F.col("first_batch") == number)
        parts = []
        if earlier:
            stored = rows.sparkSession.read.option("basePath", out).parquet(*[f"{out}/batch={n}" for n in earlier])
            own = stored.join(known.distinct(), (F.col("batch") == F.col("first_batch")) & (stored["query_id"] == known["query_id"]), "left_semi")
            told = own.dropDuplicates(["query_id"]).select(*RESULT_COLUMNS)
            parts = [join_in_place(known.select("query_id"), told, "query_id").select(*RESULT_COLUMNS)]
            new = new.unionByName(rows.where(F.col("first_batch") < number).join(told.select("query_id"), "query_id", "left_anti").select(*rows.columns))
        parts.append(results(assess(new.select(*INPUT), here, *models, **options)))
        write_results(reduce(DataFrame.unionByName, parts), f"{out}/batch={number}")

    append_batches(with_first_batch(keyed, "query_id", expiry_ms=expiry_ms), handle, checkpoint)
    if read_stage(spark, out) is None:  # nothing has arrived yet
        empty = spark.createDataFrame([], stream.schema)
        return results(assess(empty, new_path(spark, "nothing"), *models, **options))
    return spark.read.parquet(out).drop("batch")


def run_table(assessed: DataFrame, run_id: str, **parameters: object) -> DataFrame:
    """One row with the parameters of a run, kept next to its results."""
    one = assessed.sparkSession.range(1)
    return one.select(
        F.lit(run_id).alias("run_id"), *[F.lit(str(v)).alias(name) for name, v in parameters.items()]
    )
