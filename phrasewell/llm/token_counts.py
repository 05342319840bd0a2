"""Token counts under a unigram vocabulary: the Viterbi algorithm without its path.

An Aho-Corasick automaton names all pieces in a text; dynamic programming carries the best score and
its number of pieces. Of equal scores the earliest start wins, as in the tokenizer, so counts are
those that encoding would give.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasewell.llm.common import short_batches
from phrasewell.llm.unigram import Vocabulary

#: Words that a Python worker remembers before it begins anew.
MEMO = 250_000


class Counter:
    """Counts pieces of whole texts. Words that have been counted are remembered."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through a part that other parts do not depend on."""
        low = float("-inf")
        as_bytes = bool(self.vocabulary.bytes)
        best, count, unknown = [0.0, *[low] * len(word)], [0] * (len(word) + 1), [False] * (len(word) + 1)
        for end, begin, score, piece in self.vocabulary.edges(word):
            candidate = best[begin] + score
            if candidate > best[end]:
                best[end] = candidate
                unknown[end] = piece < 0
                if piece >= 0:
                    count[end] = count[begin] + 1
                elif as_bytes:
                    count[end] = count[begin] + len(word[begin:end].encode())
                else:  # unknown characters in a row are one piece
                    count[end] = count[begin] + (not unknown[begin])
        return count[-1], best[-1]

    def count(self, text: str) -> tuple[int, float]:
        """Number of pieces, and the score of the best path."""
        memo, n, total = self.memo, 0, 0.0
        if len(memo) > MEMO:
            memo.clear()
        for w in self.vocabulary.words(self.vocabulary.normalized(text)):
            found = memo.get(w)
            if found is None:
                found = self.word(w)
                if len(w) < 64:
                    memo[w] = found
            n += found[0]
            total += found[1]
        return n, total


def counted(text: Column, model: bytes, spark: SparkSession) -> Column:
    """Number of pieces and score of a text as a struct (n_tokens, score). Null counts as empty: 0 pieces."""
    shared = spark.sparkContext.broadcast(model)
    ready: list[Counter] = []

    @F.arrow_udf("struct<n_tokens:bigint,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Counter(shared.value))
        found = [ready[0].count(x.as_py() or "") for x in texts]
        n, score = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["n_tokens", "score"])

    return of(text)


def count_tokens(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, score), one per row of ``docs`` and without a shuffle.

    Whole texts count, without begin or end marks. Null and empty texts have no tokens and score 0;
    null and repeated keys and repeated rows keep a row each; other columns are not read.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col(key), counted(F.col(text), model, docs.sparkSession).alias("c")).select(key, "c.*")
