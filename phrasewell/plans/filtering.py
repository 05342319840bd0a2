"""Filter job: answer the queries, score the answers, report on them, keep the good ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasewell.functions import fixed_values as fixed
from phrasewell.functions.vectors import cosine, doubles
from phrasewell.operators.generate import Encoder, Generator, batch_generate, encode_texts, judge_verdict
from phrasewell.operators.lookup import join_in_place
from phrasewell.operators.overlap import bleu
from phrasewell.operators.prompts import answer_prompt, judge_prompt
from phrasewell.operators.rows import project_final, score_filter
from phrasewell.operators.stats import (
    accepted_labels,
    attach_labels,
    classifier_metrics,
    confusion,
    histogram,
    histogram_flagged,
    judge_summary,
    label_share,
    score_stats,
    share_split,
    threshold_step,
)
from phrasewell.sources.stages import content_key, resume_stage
from phrasewell.sources.tables import threshold_table, write_threshold


@dataclass(frozen=True)
class FilterReport:
    """Tables of one filter run; each is planned, and what it needs is run, when it is asked for."""

    evaluated: DataFrame
    response: str
    limit: float | Column
    key: str
    labelled_rows: int | None
    bins: int
    fine_bins: int

    @cached_property
    def passed(self) -> DataFrame:
        return score_filter(self.evaluated, "eval_bert", self.limit)

    @cached_property
    def final(self) -> DataFrame:
        return project_final(self.passed, self.response)

    @cached_property
    def counts(self) -> DataFrame:
        return confusion(self.evaluated)

    @cached_property
    def metrics(self) -> DataFrame:
        return classifier_metrics(self.counts)

    @cached_property
    def summary(self) -> DataFrame:
        return judge_summary(self.counts)

    @cached_property
    def bert_stats(self) -> DataFrame:
        return score_stats(self.evaluated, "eval_bert")

    @cached_property
    def bleu_stats(self) -> DataFrame:
        return score_stats(self.evaluated, "eval_bleu")

    @cached_property
    def bert_histogram(self) -> DataFrame:
        return histogram(self.evaluated, "eval_bert", self.bins)

    @cached_property
    def bleu_histogram(self) -> DataFrame:
        return histogram(self.evaluated, "eval_bleu", self.bins)

    @cached_property
    def accepted_histogram(self) -> DataFrame:
        return histogram_flagged(self.evaluated, "eval_bert", self.limit, self.fine_bins)

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return self.passed.select(self.key, "question", "eval_bert"), self.evaluated.select("question", "eval_manual", "eval_llm")

    @cached_property
    def accepted(self) -> DataFrame:
        return accepted_labels(*self._sides(), order=[self.key], n=self.labelled_rows)

    @cached_property
    def shares(self) -> DataFrame:
        return label_share(*self._sides(), order=[self.key], n=self.labelled_rows)

    @cached_property
    def split(self) -> DataFrame:
        return share_split(self.counts)


def add_bleu(rows: DataFrame, response: str) -> DataFrame:
    """Rows with ``eval_bleu`` against both wordings of the question."""
    scored = bleu(F.col("paraphrased_question"), F.col("question"), F.col(response))
    return rows.withColumn("eval_bleu", scored["eval_bleu"])


def add_similarity(
    rows: DataFrame, response: str, encoder: Callable[[], Encoder], out: str = "eval_bert"
) -> DataFrame:
    """Rows with the cosine of paraphrased question and response."""
    encoded = encode_texts(
        rows, ("paraphrased_question", "_wanted", encoder), (response, "_given", encoder)
    )
    score = cosine(doubles(F.col("_wanted")), doubles(F.col("_given")))
    return encoded.withColumn(out, score).drop("_wanted", "_given")


def evaluate_answers(
    rows: DataFrame,
    stage: str,
    generator: Callable[[], Generator],
    judge: Callable[[], Generator],
    encoder: Callable[[], Encoder],
    labels: DataFrame,
    shots: str,
    judge_shots: str,
    key: str = "row_id",
    response: str = "response",
    concurrency: int | None = None,
    raw_body: bool = False,
    slices: int = 1,
    models: str = "",
    retries: int | None = None,
) -> DataFrame:
    """Rows with a response, eval_llm, verdict_valid, eval_bert, eval_bleu and eval_manual.

    The input has question, paraphrased_question, sparql_wikidata and wikidata_translated; ``labels``
    has the key and eval_manual for some rows. ``shots`` and ``judge_shots`` are the prompts made
    of worked examples. Answers, and verdicts with similarities, are stored under ``stage`` by what
    they depend on: the texts, the prompts and ``models``, the name the caller gives to the models.
    So a row that changes under its key is answered anew, and equal rows are answered once. Every
    row of the input gives one row; but with ``retries`` a row whose calls fail is tried that many
    times more, stored with its reason under ``error`` and left out, and the next run asks again.
    """
    error = None if retries is None else "error"
    tries = retries or 0
    told = [F.lit(x) for x in (models, shots, judge_shots, str(raw_body))]
    made = "_answer_key"
    rows = rows.withColumn(made, content_key(*told, F.col("wikidata_translated"), F.col("paraphrased_question")))
    asked_for = rows.select(made, "wikidata_translated", "paraphrased_question").dropDuplicates([made])

    def spread(todo: DataFrame) -> DataFrame:
        return todo.repartition(concurrency, made) if concurrency else todo

    def answered(todo: DataFrame) -> DataFrame:
        asked = spread(todo).withColumn("_prompt", answer_prompt(F.lit(shots), F.col("wikidata_translated")))
        return batch_generate(asked, "_prompt", response, generator, None, None, raw_body, error, tries).drop("_prompt")

    def judged(todo: DataFrame) -> DataFrame:
        asked = spread(todo).withColumn(
            "_prompt", judge_prompt(F.lit(judge_shots), F.col("paraphrased_question"), F.col(response))
        )
        verdicts = judge_verdict(asked, "_prompt", judge, "eval_llm", None, raw_body, error, tries).drop("_prompt")
        return add_similarity(verdicts, response, encoder)

    answers = resume_stage(asked_for, f"{stage}/answers", made, answered, slices, error)
    scored = resume_stage(answers, f"{stage}/evaluated", made, judged, slices, error)
    results = scored.drop("wikidata_translated", "paraphrased_question")
    every = join_in_place(rows, results, made).drop(made)
    return attach_labels(add_bleu(every, response), labels.select(key, "eval_manual"), key)


def stored_threshold(spark: SparkSession, path: str, scores: DataFrame, score: str) -> DataFrame:
    """The limit stored at ``path``; if there is none it is stepped towards the mean and stored."""
    try:
        return threshold_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    write_threshold(threshold_step(scores, score), path)
    return threshold_table(spark, path)


def filter_answers(
    evaluated: DataFrame,
    response: str,
    limit: float | Column = fixed.SCORE_LIMIT,
    key: str = "row_id",
    labelled_rows: int | None = None,
    bins: int = 10,
    fine_bins: int = 200,
) -> FilterReport:
    """Final table and reports from rows with eval_manual, eval_llm, eval_bert and eval_bleu.

    ``labelled_rows`` is the number of accepted rows, in order of ``key``, that are compared with
    the hand-made labels; by default all.
    """
    return FilterReport(evaluated, response, limit, key, labelled_rows, bins, fine_bins)
