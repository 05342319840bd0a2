"""Prompts as columns, and the two prompts that are built from many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.functions import fixed_values as fixed
from phrasewell.functions.text import fill, list_text
from phrasewell.operators.rows import slice_rows, tail_n

TAGGED = "tagged"
CHAT = "chat"


def _first_lines(style: str) -> list[str]:
    if style == TAGGED:
        return [
            fixed.BEGIN + fixed.SYSTEM_TURN,
            fixed.TRANSLATOR_ROLE + fixed.USER_TURN,
            fixed.TASK + fixed.WORKED_QUERY,
            fixed.ASSISTANT_TURN + " " + fixed.WORKED_QUESTION,
            fixed.USER_TURN + " " + fixed.CONTEXT + "{context}",
            fixed.ASSISTANT_TURN + " OK.",
            fixed.USER_TURN,
            fixed.TASK + "'{query}' " + fixed.ASSISTANT_TURN,
        ]
    if style == CHAT:
        return [
            fixed.TRANSLATOR_ROLE + ".",
            f"Example query: {fixed.WORKED_QUERY}, Answer: {fixed.WORKED_QUESTION}",
            "Context information: {context}",
            fixed.TASK + "'{query}'",
        ]
    raise ValueError(f"unknown prompt style: {style}")


def translate_prompt(query: Column, context: Column, style: str = TAGGED) -> Column:
    """First prompt of a query; ``context`` is the list of its descriptions."""
    template = ("\n" + fixed.FIRST_INDENT).join(_first_lines(style))
    return fill(template, query=query, context=list_text(context))


def refine_prompt(query: Column, context: Column, answer: Column, style: str = TAGGED) -> Column:
    """Prompt that shows the last answer and asks for a better one."""
    lines = _first_lines(style)
    if style == TAGGED:
        lines += ["{answer}" + fixed.USER_TURN, fixed.REFLECT + fixed.ASSISTANT_TURN]
    else:
        lines += ["{answer}", fixed.REFLECT + "."]
    template = ("\n" + fixed.REFINE_INDENT).join(lines)
    return fill(template, query=query, context=list_text(context), answer=answer)


def critique_prompt(query: Column, candidates: Column, style: str = TAGGED) -> Column:
    """Prompt that lists the candidates and asks for the best one."""
    if style == TAGGED:
        lines = [
            fixed.BEGIN + fixed.SYSTEM_TURN,
            fixed.CRITIC_ROLE + fixed.USER_TURN,
            fixed.CRITIC_TASK + fixed.ASSISTANT_TURN,
        ]
    elif style == CHAT:
        lines = [fixed.CRITIC_ROLE, fixed.CRITIC_TASK]
    else:
        raise ValueError(f"unknown prompt style: {style}")
    template = ("\n" + fixed.FIRST_INDENT).join(lines)
    return fill(template, query=query, candidates=list_text(candidates))


def answer_prompt(shots: Column, query: Column) -> Column:
    """Few-shot prompt followed by one query."""
    return F.concat(shots, query, F.lit("assistant"))


def judge_prompt(shots: Column, reference: Column, response: Column) -> Column:
    """Worked comparisons, as made from an edited template, followed by one pair to compare."""
    return fill(
        "{shots}{reference}\n{response}" + fixed.ASSISTANT_TURN,
        shots=shots, reference=reference, response=response,
    )


def fewshot_prompt(
    df: DataFrame, query: str, answer: str, row_id: str = "row_id", size: int = fixed.FEWSHOT_ROWS
) -> DataFrame:
    """One row with the prompt made of the last ``size`` rows in order; its length follows ``size``."""
    piece = F.concat(
        F.lit(fixed.TASK), F.col(query), F.lit(fixed.ASSISTANT_TURN + "\n"),
        F.col(answer), F.lit(fixed.USER_TURN + "\n"),
    )
    shots = tail_n(df.select(row_id, piece.alias("piece")), size, row_id)
    head = fixed.BEGIN + fixed.SYSTEM_TURN + "\n" + fixed.TRANSLATOR_ROLE + fixed.USER_TURN + "\n"
    return shots.agg(
        F.array_sort(F.collect_list(F.struct(row_id, "piece"))).alias("pieces")
    ).select(
        F.concat(
            F.lit(head), F.array_join(F.transform("pieces", lambda p: p["piece"]), ""), F.lit(fixed.TASK)
        ).alias("prompt")
    )


def compare_template(
    df: DataFrame,
    reference: str,
    response: str,
    row_id: str = "row_id",
    size: int = fixed.COMPARE_ROWS,
    last_n: bool = False,
) -> DataFrame:
    """Lines of a comparison template to be edited by hand: ``place`` and ``block``.

    By default the rows at positions ``size`` down to 1; with ``last_n`` the last ``size`` rows.
    """
    if last_n:
        chosen = tail_n(df, size, row_id)
        place = -F.col(row_id)
    else:
        chosen = slice_rows(df, 1, size + 1, row_id)
        place = F.lit(size - 1) - F.col(row_id)
    block = F.concat(
        F.lit(fixed.JUDGE_TASK + "\n"), F.col(reference), F.lit("\n"), F.col(response),
        F.lit(fixed.ASSISTANT_TURN + "\n" + fixed.JUDGE_BLANK + fixed.USER_TURN),
    )
    return chosen.select(place.cast("bigint").alias("place"), block.alias("block")).orderBy("place")


def candidate_fanout(df: DataFrame, k: int) -> DataFrame:
    """``k`` rows per query, numbered in ``cand_idx``."""
    numbers = F.sequence(F.lit(0), F.lit(k - 1)) if k > 0 else F.array().cast("array<int>")
    return df.select("*", F.explode(numbers).alias("cand_idx"))
