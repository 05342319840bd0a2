import math
import sys
from collections import Counter

import pytest

from phrasewell.operators import overlap


def expected(first, second, response):
    """Sentence score by the published definition, with Counter arithmetic."""
    hyp = response.split(" ")
    refs = [r.split(" ") for r in (first if first is not None else "n/a", second if second is not None else "n/a")]
    logs = []
    for n in range(1, 5):
        grams = [Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)) for t in (hyp, *refs)]
        match = sum(min(c, max(grams[1][g], grams[2][g])) for g, c in grams[0].items())
        if n == 1 and match == 0:
            return 0.0
        logs.append(math.log(match / max(1, sum(grams[0].values())) if match else sys.float_info.min))
    length = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
    penalty = 1.0 if len(hyp) > length else math.exp(1 - length / len(hyp))
    return penalty * math.exp(sum(logs) / 4)


CASES = [
    ("the cat sat on the mat", "a cat is on the mat", "the cat sat on the mat"),
    ("the cat sat on the mat", "there is a cat on the mat", "the the the the the the the"),
    ("what is it", "what is that", "what is"),
    ("a b c d e f g", "a b c d", "a b c d e"),
    ("a b c d", "a b c d e f", "a b x c d"),
    ("one two", "three four", "five six seven eight"),
    (None, "is it n/a ok", "n/a is it ok"),
    ("a  b", "a b", "a  b c d"),
    ("x", "y", ""),
    ("", "y", ""),
]


def test_bleu_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "k int, a string, b string, h string")
    got = {r.k: r.eval_bleu for r in overlap.bleu_score(df, "k", "a", "b", "h").collect()}
    for i, case in enumerate(CASES):
        assert got[i] == pytest.approx(expected(*case), rel=1e-9, abs=1e-90), case


def test_missing_response_gives_null(spark):
    df = spark.createDataFrame([(1, "a b", "c", None)], "k int, a string, b string, h string")
    assert overlap.bleu_score(df, "k", "a", "b", "h").collect()[0].eval_bleu is None


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a b", "c", "a")], "k int, a string, b string, h string")
    plan = overlap.bleu_score(df, "k", "a", "b", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_ngrams_keep_empty_tokens(spark):
    df = spark.createDataFrame([(1, "a  b")], "k int, t string")
    got = {(r.n, r.pos): r.gram for r in overlap.ngrams(df, "k", "t").collect()}
    assert got == {(1, 0): "a", (1, 1): "", (1, 2): "b", (2, 0): "a ", (2, 1): " b", (3, 0): "a  b"}
