"""Periodic stretches of words: all maximal runs of each text, by recompression.

A run with period p holds a multiple i of p, with i + p in it too. So the pairs (i, i + p) of all p,
about n log n of them, are the only places to look at; a pair that can lie in a long enough run is
extended both ways by questions to a run-length grammar, which gives the run exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.recompression import Grammar

#: Words of texts that one grammar is made for; a longer text has one of its own.
GRAMMAR_WORDS = 300_000
#: Up to so many words the pairs of a text are looked up in a table; beyond, they are taken period by period.
TABLE_WORDS = 1 << 16
#: Pairs that are extended at a time.
PAIRS = 1 << 20

#: Words on one side of a pair that have to agree too. A shortest run agrees at least 6 times in a row, hence 3 times on one side.
BESIDE = 3

RUN = "start:bigint,length:bigint,period:bigint"


class Pairs:
    """The pairs (i, i + p) with i a multiple of p, in the order of i + p: those of a text of n words come first."""

    def __init__(self) -> None:
        self.words = 0

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.words:
            self.words = size = max(4096, 1 << (n - 1).bit_length())
            right = np.concatenate([np.arange(p, size, p, dtype=np.int32) for p in range(1, size // 2 + 1)])
            left = right - np.repeat(np.arange(1, size // 2 + 1, dtype=np.int32), [(size - 1) // p for p in range(1, size // 2 + 1)])
            order = np.argsort(right, kind="stable")
            self.left, self.right = left[order], right[order]
            self.ends = np.searchsorted(self.right, np.arange(size + 1))
        end = self.ends[n]
        return self.left[:end], self.right[:end]


PAIRS_OF = Pairs()


def _agreeing(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose words are equal."""
    n = len(words)
    if n <= TABLE_WORDS:
        left, right = PAIRS_OF.of(n)
        same = np.flatnonzero(words[left] == words[right])
        yield left[same], right[same]
        return
    held, count = [], 0
    for p in range(1, n // 2 + 1):
        at = np.flatnonzero(words[: n - p : p] == words[p::p]) * p
        if len(at):
            held.append((at, at + p))
            count += len(at)
        if count >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _hopeful(line: np.ndarray, i: np.ndarray, j: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether pairs that agree at ``i`` and ``j`` of ``line`` can lie in a run of a text of that many words."""
    ahead = (2 * (j - i) <= words).copy()
    behind = ahead.copy()
    for k in range(1, BESIDE + 1):
        ahead &= line[i + k] == line[j + k]
        behind &= line[i - k] == line[j - k]
    return ahead | behind


def find_runs(texts: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, by start, then period; a text is an array of word numbers.

    ``least`` is at least 12.
    """
    found = [np.zeros((0, 3), np.int64)] * len(texts)
    chosen = [k for k, t in enumerate(texts) if len(t) >= least]
    if not chosen:
        return found
    # Words that lie before, between and after texts are all different, so nothing agrees across an end.
    apart = 1 + max(int(texts[k].max()) for k in chosen)
    pad = BESIDE + 1

    def joined(some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(texts[k]) for k in some])
        starts = pad + np.concatenate(([0], np.cumsum(sizes[:-1] + pad)))
        line = apart + np.arange(pad + int((sizes + pad).sum()))
        for k, at in zip(some, starts.tolist()):
            line[at : at + len(texts[k])] = texts[k]
        return line, starts

    line, starts = joined(chosen)
    words = np.array([len(texts[k]) for k in chosen])
    hopes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def sift() -> None:
        """Keep the pairs of ``held`` that can lie in a run."""
        owner = np.repeat([c for c, _, _ in held], [len(i) for _, i, _ in held])
        i, j = (np.concatenate([h[x] for h in held]).astype(np.int64) for x in (1, 2))
        good = np.flatnonzero(_hopeful(line, i + starts[owner], j + starts[owner], words[owner]))
        hopes.append((owner[good], i[good], j[good]))
        held.clear()

    for c, k in enumerate(chosen):
        for i, j in _agreeing(texts[k]):
            held.append((c, i, j))
            count += len(i)
        if count >= PAIRS:
            sift()
            count = 0
    if held:
        sift()
    owner, i, j = map(np.concatenate, zip(*hopes))
    if not len(owner):
        return found

    some = np.unique(owner).tolist()
    line, starts = joined([chosen[c] for c in some])
    owner = np.searchsorted(some, owner)
    grammar = Grammar(line, least=4 * len(some))
    made = np.zeros((0, 4), np.int64)
    for turn in range(0, len(owner), PAIRS):
        part = slice(turn, turn + PAIRS)
        at = starts[owner[part]]
        a, period = i[part] + at, j[part] - i[part]
        before = grammar.extensions(a, a + period, forward=False)
        length = before + grammar.extensions(a, a + period) + period
        long = length >= np.maximum(least, 2 * period)
        runs = np.stack([owner[part], a - before - at, length, period], axis=1)[long]
        made = _least_periods(np.concatenate([made, runs]))
    ends = np.searchsorted(made[:, 0], np.arange(len(some) + 1))
    for c, own in enumerate(some):
        found[chosen[own]] = made[ends[c] : ends[c + 1], 1:]
    return found


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), in this order but for the length, each stretch with its least period.

    A multiple of the least period gives the same stretch, and nothing else does.
    """
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word is outside all runs or in the first period of those that hold it."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _batches(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    held: list[list[bytes]] = []
    count = 0
    for x in texts.cast(pa.binary()):
        words = (x.as_py() or b"").split()
        if held and count + len(words) > GRAMMAR_WORDS:
            yield held
            held, count = [], 0
        held.append(words)
        count += len(words)
    if held:
        yield held


def told(text: Column, least: int = 12) -> Column:
    """Struct of n_words, runs (start, length, period) and the collapsed text."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    @F.arrow_udf(f"struct<n_words:bigint,runs:array<struct<{RUN}>>,collapsed:string>")
    def of(texts: pa.Array) -> pa.Array:
        counts, runs, collapsed = [], [], []
        for some in _batches(texts):
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            lists = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in some]
            for words, own in zip(some, find_runs(lists, least)):
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
                left = [words[i] for i in np.flatnonzero(_kept(len(words), own)).tolist()] if len(own) else words
                collapsed.append(b" ".join(left))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"]
        )

    return of(text)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Rows (key, n_words, runs, collapsed): the periodic stretches of the words of each text.

    Words are separated by ASCII white space. A run is a stretch of at least ``least`` words (12 or more) and of
    two periods that no neighbouring word extends; its period is the least one, and ``runs`` is ordered by start, then period.
    ``collapsed`` is the text without the words that lie in any run behind its first period, joined
    by one space. Each row gives one row: null, empty and blank texts have no word, no run and the
    empty text; repeated keys and rows keep a row each; other columns are not read; an empty table
    gives an empty result. Texts are read whole. One text is worked on by one task, in memory of a few
    hundred bytes per word; nothing is shuffled.
    """
    if least < 12:
        raise ValueError("runs of less than 12 words are not looked for")
    return docs.select(F.col(key).alias("_key"), told(F.col(text), least).alias("_t")).select(F.col("_key").alias(key), "_t.*")


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text) in which a tenth of the texts, chosen by a hash of the key, repeats itself from some word on.

    Let h be the CRC-32 of the key as text, and g a tenth of it. If h ends in 0, word i from a = g % n on becomes
    word a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8), both rounded down. Null keys, and texts
    without a word, stay as they are.
    """
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(F.col(key).cast("string")), F.size("_words").cast("bigint")
    planted = docs.select(F.col(key), F.col(text), h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    g = F.floor(F.col("_h") / 10).cast("bigint")
    at = g % n
    period = 1 + F.floor((n - at) / (3 + g % 8)).cast("bigint")
    placed = planted.withColumns({"_a": F.when(n > 0, at), "_p": F.when(n > 0, period)})
    moved = F.transform(
        "_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    )
    own = F.when(F.col("_a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col(text))
    return placed.select(F.col(key), own.alias(text))
