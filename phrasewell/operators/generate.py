"""Stages that call user-supplied text generators and encoders, by Arrow batches.

A factory is called once per task and returns the function that is given the batches. All columns
pass through as Arrow data; Python sees the text only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from phrasewell.functions.text import response_text, text_or_missing
from phrasewell.operators.lookup import salted_join
from phrasewell.operators.prompts import (
    TAGGED,
    candidate_fanout,
    critique_prompt,
    refine_prompt,
    translate_prompt,
)
from phrasewell.session import short_batches

Generator = Callable[[list[str], list[int]], list[str]]
Encoder = Callable[[list[str]], list[Iterable[float]]]


#: Rows that Python takes up at a time of what Spark hands over, and bytes of these rows' Arrow data: a table's
#: size does not change what a task holds as Python objects. A single row may be larger.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4_000_000


@dataclass(frozen=True)
class Call:
    """One model call per row: input columns, new column, its type, and what makes the model.

    With ``nested`` the inputs are arrays of equal lengths; the model is given their elements and
    the new column is an array of ``kind``. ``error`` names a column for the reason why a row has
    failed: such a row has no value and does not end the job.
    """

    inputs: tuple[str, ...]
    out: str
    kind: T.DataType
    factory: Callable[[], Callable]
    nested: bool = False
    error: str | None = None
    retries: int = 0

    @property
    def column_type(self) -> T.DataType:
        return T.ArrayType(self.kind) if self.nested else self.kind


def _attach(df: DataFrame, *calls: Call) -> DataFrame:
    """Add the column of each call, all in one pass over the Arrow batches.

    The column of reasons is added where a call names one; rows that have a reason already are not
    asked for.
    """
    reasons = [c.error for c in calls if c.error and c.error not in df.columns]
    named = [(c.out, c.column_type) for c in calls] + [(e, T.StringType()) for e in dict.fromkeys(reasons)]
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in named]])
    order = [f.name for f in schema.fields]
    rows_at_once, bytes_at_once = ROWS_AT_ONCE, BYTES_AT_ONCE
    # Plain tuples, so that tasks need nothing of this package.
    plans = [(c.inputs, c.out, to_arrow_type(c.kind), c.factory, c.nested, c.error, c.retries) for c in calls]

    def asked(model: Callable, given: list[list], retries: int) -> tuple[list, list[str | None]]:
        """Values and reasons of failure of all rows of ``given``, one list per input.

        A batch that fails is asked for in halves until the rows that make it fail stand alone; these
        are asked for ``retries`` times more.
        """
        n = len(given[0])
        if not n:
            return [], []
        for _ in range(1 if n > 1 else retries + 1):
            try:
                made = list(model(*given))
                if len(made) != n:
                    raise ValueError(f"{len(made)} answers to {n} prompts")
                return made, [None] * n
            except Exception as failed:  # whatever a model may raise is the row's failure, and is stored
                reason = f"{type(failed).__name__}: {failed}"
        if n == 1:
            return [None], [reason]
        halves = [asked(model, [x[part] for x in given], retries) for part in (slice(0, n // 2), slice(n // 2, n))]
        return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        models = [plan[3]() for plan in plans]

        def guarded(model: Callable, lists: list[list], lengths: Any, told: list, retries: int) -> list:
            """Values of the elements of rows without a reason; ``told`` gets the reasons."""
            row = np.repeat(np.arange(len(told)), lengths)
            ask = [i for i, r in enumerate(row.tolist()) if told[r] is None]
            made, why = asked(model, [[x[i] for i in ask] for x in lists], retries)
            values: list = [None] * len(row)
            for i, value, reason in zip(ask, made, why):
                values[i] = value
                if reason is not None and told[row[i]] is None:
                    told[row[i]] = reason
            return [None if told[r] is not None else value for r, value in zip(row.tolist(), values)]

        def pieces() -> Iterator[Any]:
            for batch in batches:
                size = batch.nbytes // max(1, len(batch)) + 1
                step = max(1, min(rows_at_once, bytes_at_once // size))
                for at in range(0, len(batch), step):
                    yield batch.slice(at, step)

        for batch in pieces():
            columns = dict(zip(batch.schema.names, batch.columns))
            for model, (inputs, out, kind, _, nested, error, retries) in zip(models, plans):
                given = [columns[name] for name in inputs]
                lengths = np.ones(len(batch), int)
                if nested:
                    lengths = pc.fill_null(pc.list_value_length(given[0]), 0).to_numpy(zero_copy_only=False)
                    given = [lists.flatten() for lists in given]
                lists = [values.to_pylist() for values in given]
                if error:
                    told = columns[error].to_pylist() if error in columns else [None] * len(batch)
                    made = pa.array(guarded(model, lists, lengths, told, retries), type=kind)
                    columns[error] = pa.array(told, pa.string())
                else:
                    made = pa.array(model(*lists), type=kind)
                if nested:
                    ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
                    made = pa.ListArray.from_arrays(pa.array(ends), made)
                columns[out] = made
            yield pa.RecordBatch.from_arrays([columns[name] for name in order], order)

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch_generate(
    df: DataFrame,
    prompt: str,
    out: str,
    generator: Callable[[], Generator],
    sample: str | None = None,
    concurrency: int | None = None,
    raw_body: bool = False,
    error: str | None = None,
    retries: int = 0,
) -> DataFrame:
    """Add the generated text of each prompt.

    The generator is given prompts and sample numbers, so that a seeded model answers a retried
    task in the same way. ``concurrency`` caps the number of calls under way; ``raw_body`` says
    that the generator returns bodies that still have to be parsed. Without ``error`` a call that
    fails ends the job; with it a row that fails has no text, the reason is in the column of that
    name, and the other rows of its batch keep theirs. Such a row is tried ``retries`` times more.
    """
    asked = df if sample else df.withColumn("_sample", F.lit(0))
    if concurrency:
        asked = asked.repartition(concurrency)
    made = _attach(asked, Call((prompt, sample or "_sample"), out, T.StringType(), generator, error=error, retries=retries))
    if raw_body:
        made = made.withColumn(out, response_text(F.col(out)))
    return made if sample else made.drop("_sample")


def answer_candidates(
    df: DataFrame,
    k: int,
    generator: Callable[[], Generator],
    query: str = "query",
    context: str = "descriptions",
    rounds: int = 1,
    style: str = TAGGED,
    concurrency: int | None = None,
    raw_body: bool = False,
) -> DataFrame:
    """``k`` candidates per query, each refined ``rounds`` times; adds ``cand_idx`` and ``text``."""
    asked = candidate_fanout(df, k).withColumn(
        "_prompt", translate_prompt(F.col(query), F.col(context), style)
    )
    made = batch_generate(asked, "_prompt", "text", generator, "cand_idx", concurrency, raw_body)
    made = made.drop("_prompt")
    return refine_rounds(made, rounds, generator, "text", query, context, style, raw_body)


def refine_rounds(
    df: DataFrame,
    rounds: int,
    generator: Callable[[], Generator],
    text: str = "text",
    query: str = "query",
    context: str = "descriptions",
    style: str = TAGGED,
    raw_body: bool = False,
    sample: str = "cand_idx",
) -> DataFrame:
    """Replace ``text`` ``rounds`` times by the answer to a prompt that shows the last text."""
    for _ in range(rounds):
        asked = df.withColumn(
            "_prompt", refine_prompt(F.col(query), F.col(context), F.col(text), style)
        ).withColumnRenamed(text, "_last")
        made = batch_generate(asked, "_prompt", text, generator, sample, raw_body=raw_body)
        df = made.select(*df.columns)
    return df


def answer_lists(
    df: DataFrame,
    k: int,
    generator: Callable[[], Generator],
    query: str = "query",
    context: str = "descriptions",
    rounds: int = 1,
    style: str = TAGGED,
    raw_body: bool = False,
    out: str = "texts",
    error: str | None = None,
    retries: int = 0,
) -> DataFrame:
    """Like ``answer_candidates`` with the ``k`` answers in one array per query.

    The candidates of a query never leave its row, so nothing has to be gathered by a shuffle.
    ``error`` and ``retries`` are those of ``batch_generate``; a query fails if one of its candidates does.
    """
    asked, context_column = F.col(query), F.col(context)
    numbers = F.sequence(F.lit(0), F.lit(k - 1)) if k > 0 else F.array().cast("array<int>")
    first = F.array_repeat(translate_prompt(asked, context_column, style), k)
    columns = df.columns
    df = df.withColumns({"_samples": numbers, out: first})
    for turn in range(rounds + 1):
        prompts = F.transform(out, lambda last: refine_prompt(asked, context_column, last, style))
        shown = df.withColumn("_prompts", prompts if turn else F.col(out)).drop(out)
        df = _attach(shown, Call(("_prompts", "_samples"), out, T.StringType(), generator, True, error, retries))
        if raw_body:
            df = df.withColumn(out, F.transform(out, lambda body: response_text(body)))
        df = df.drop("_prompts")
    return df.select(*columns, out, *[error] if error else [])


def critique_select(
    df: DataFrame,
    generator: Callable[[], Generator],
    query: str = "query",
    candidates: str = "candidates",
    style: str = TAGGED,
    concurrency: int | None = None,
    raw_body: bool = False,
    error: str | None = None,
    retries: int = 0,
) -> DataFrame:
    """Add the reply ``critique`` and ``critique_idx``, its place among the candidates or NULL."""
    asked = df.withColumn("_prompt", critique_prompt(F.col(query), F.col(candidates), style))
    made = batch_generate(
        asked, "_prompt", "critique", generator, None, concurrency, raw_body, error, retries
    ).withColumn("critique", F.trim("critique"))
    place = F.array_position(F.transform(candidates, F.trim), F.col("critique"))
    return made.drop("_prompt").withColumn(
        "critique_idx", F.when(place > 0, (place - 1).cast("bigint"))
    )


def verdict(reply: Column) -> Column:
    """1 for a reply that starts with yes, else 0."""
    return F.when(F.lower(F.substring(reply, 1, 3)) == "yes", 1).otherwise(0)


def verdict_valid(reply: Column) -> Column:
    """Whether the reply starts with yes or no."""
    starts = (F.lower(F.substring(reply, 1, 3)) == "yes") | (F.lower(F.substring(reply, 1, 2)) == "no")
    return F.coalesce(starts, F.lit(False))


def judge_verdict(
    df: DataFrame,
    prompt: str,
    generator: Callable[[], Generator],
    out: str = "eval_llm",
    concurrency: int | None = None,
    raw_body: bool = False,
    error: str | None = None,
    retries: int = 0,
) -> DataFrame:
    """Add the verdict on each prompt and whether it could be read."""
    made = batch_generate(df, prompt, "_reply", generator, None, concurrency, raw_body, error, retries)
    return made.withColumns(
        {out: verdict(F.col("_reply")), "verdict_valid": verdict_valid(F.col("_reply"))}
    ).drop("_reply")


def encode_text(
    df: DataFrame,
    text: str,
    out: str,
    encoder: Callable[[], Encoder],
    concurrency: int | None = None,
) -> DataFrame:
    """Add the vector of each text; a missing text is encoded as its placeholder."""
    asked = df.repartition(concurrency) if concurrency else df
    return encode_texts(asked, (text, out, encoder))


def encode_texts(df: DataFrame, *wanted: tuple[str, str, Callable[[], Encoder]]) -> DataFrame:
    """Add several vectors, each (text, new column, encoder), in one pass.

    An array of texts gives an array of vectors.
    """
    texts = {text: f"_text_{i}" for i, text in enumerate(dict.fromkeys(text for text, _, _ in wanted))}
    lists = {text: isinstance(df.schema[text].dataType, T.ArrayType) for text in texts}
    asked = df.withColumns(
        {
            shown: F.transform(text, lambda t: text_or_missing(t)) if lists[text] else text_or_missing(F.col(text))
            for text, shown in texts.items()
        }
    )
    kind = T.ArrayType(T.FloatType())
    calls = [Call((texts[text],), out, kind, encoder, lists[text]) for text, out, encoder in wanted]
    return _attach(asked, *calls).drop(*texts.values())


def encode_distinct(
    df: DataFrame, text: str, out: str, encoder: Callable[[], Encoder], concurrency: int | None = None
) -> DataFrame:
    """Like ``encode_text`` for tables with many equal texts: each distinct text is encoded once.

    A text that fills much of the table is salted in the join that brings the vectors back.
    """
    keyed = df.withColumn("_key", F.sha2(text_or_missing(F.col(text)), 256))
    once = keyed.select("_key", text).dropDuplicates(["_key"])
    vectors = encode_text(once, text, out, encoder, concurrency).select("_key", out)
    return salted_join(keyed, vectors, "_key").drop("_key")
