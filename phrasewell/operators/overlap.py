"""N-gram overlap of a response with two references."""

from __future__ import annotations

import math
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.functions.text import ngrams as ngram_array, text_or_missing, tokens

MAX_N = 4


def ngrams(df: DataFrame, key: str, text: str, max_n: int = MAX_N) -> DataFrame:
    """One row per n-gram of each text: key, n, pos, gram."""
    words = df.select(key, tokens(F.col(text)).alias("_words"))
    sized = words.select(key, "_words", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
    grams = F.when(F.col("n") == 1, ngram_array(F.col("_words"), 1))
    for n in range(2, max_n + 1):
        grams = grams.when(F.col("n") == n, ngram_array(F.col("_words"), n))
    return sized.select(key, "n", F.posexplode(grams).alias("pos", "gram"))


def _matches(response: list[str], references: list[list[str]], n: int) -> tuple[int, int]:
    """Grams of length ``n`` of the response that a reference has too, each as often at most, and all of them."""
    own = Counter(zip(*[response[i:] for i in range(n)]))
    best: dict[tuple, int] = {}
    for words in references:
        for gram, k in Counter(g for g in zip(*[words[i:] for i in range(n)]) if g in own).items():
            best[gram] = max(k, best.get(gram, 0))
    return sum(min(own[g], k) for g, k in best.items()), max(0, len(response) - n + 1)


def _score(matched: list[tuple[int, int]], length: int, closest: int) -> float:
    if matched[0][0] == 0:
        return 0.0
    logs = [math.log(m / max(1, total)) if m else math.log(sys.float_info.min) for m, total in matched]
    penalty = 1.0 if length > closest else math.exp(1 - closest / length)
    return penalty * math.exp(sum(logs) / len(logs))


def bleu(first: Column, second: Column, response: Column, max_n: int = MAX_N) -> Column:
    """The overlap of a response with two references as a struct, worked out inside the row.

    Counting is a matter of one row, so nothing is shuffled or joined back; a text is taken apart
    when it is its turn, and a task holds the grams of one row.
    """
    counts = [f"{name}_{n}" for name in ("match", "total") for n in range(1, max_n + 1)]
    fields = [*counts, "response_length", "reference_length"]

    @F.arrow_udf(f"struct<{','.join(f'{f}:bigint' for f in fields)},eval_bleu:double>")
    def of(responses: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = []
        for r, a, b in zip(responses, firsts, seconds):
            references = [x.as_py().split(" ") for x in (a, b)]
            # The reference nearest in length; on a tie the shorter one.
            if not r.is_valid:
                rows.append((*[0] * len(counts), 0, min(map(len, references)), None))
                continue
            words = r.as_py().split(" ")
            matched = [_matches(words, references, n) for n in range(1, max_n + 1)]
            closest = min((abs(len(x) - len(words)), len(x)) for x in references)[1]
            rows.append((*[m for m, _ in matched], *[t for _, t in matched], len(words), closest, _score(matched, len(words), closest)))
        columns = list(zip(*rows)) if rows else [()] * (len(fields) + 1)
        kinds = [pa.int64()] * len(fields) + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*fields, "eval_bleu"])

    return of(response, text_or_missing(first), text_or_missing(second))


def bleu_score(
    df: DataFrame, key: str, first: str, second: str, response: str, max_n: int = MAX_N
) -> DataFrame:
    """Sentence score of the response: geometric mean of clipped precisions, uniform weights.

    A gram is worth the larger of its counts in the two references. No match of single words gives
    0. A longer gram without a match counts as the smallest positive number, so such a score is
    tiny but not 0. A missing response gives NULL.
    """
    return df.select(key, bleu(F.col(first), F.col(second), F.col(response), max_n).alias("_b")).select(key, "_b.*")
