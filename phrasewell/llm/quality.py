"""Quality rules under weak supervision, in DataFrame functions only.

Rules vote good, bad or abstain. Which votes fall together is counted over the whole corpus; expectation
maximisation on these counts estimates how far each rule can be trusted, and a document's posterior
probability of good quality decides, instead of every rule having to pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.common import stored

# White space between words, symbols, and common short words of the languages at hand.
SPACE = r"[\x20\x09-\x0D]+"
INK = r"[^\x20\x09-\x0D]"
NO_SYMBOLS = r"[^#*$%&|<>]+"
PLAIN = r"^[\p{L}\p{M}'’-]+[.,;:!?]?$"
COMMON = (
    "the", "of", "and", "in", "to", "is", "that", "it", "for", "on", "was", "with", "as", "by", "at", "der", "die", "und", "das",
    "den", "von", "zu", "mit", "de", "la", "le", "les", "des", "et", "un", "une", "en", "el", "los", "que", "y", "por", "con",
)

#: Letters of the languages of ``COMMON`` end here; a text where one in so many words has another is in none of them.
OTHER_LETTERS = r"[\p{L}&&[^a-zA-ZÀ-ÄÇ-ÏÑ-ÔÖÙ-Üß-äç-ïñ-ôöù-üÿŸŒœªº]]"
OTHER_WORDS = 50

#: A line of program text or markup: it ends or begins with brackets, assigns, or opens a block.
CODE = (
    r"[;{}]\s*$|^\s*(?:[})\]]|//|/\*|#include\b|</?[a-zA-Z!])|^\s*[\w.\[\]]+\s*[-+*/|&:]?=\s*\S"
    r"|^\s*(?:def|class|if|elif|else|for|while|try|except|with)\b.*:\s*$|^\s*(?:import|from)\s+[\w.]+(?:\s+import\b|\s*$)|^\s*return\b"
)

#: The share of bad votes on good documents that a rule is given at least, beside that of documents on which all others
#: are sure: one bad vote alone is not enough against all others.
LEAST_WRONG = 0.01
#: The probability of good quality from which the other rules are sure.
SURE = 0.99

RULES = ("length", "symbols", "plain", "windows", "runs", "distinct", "common", "lines")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, n: int = 5) -> Column:
    """Words in windows of ``n`` words that are found twice or more in the same text, first included."""
    last = F.size(words) - n

    def window(i: Column) -> Column:
        return F.array_join(F.slice(words, i + 1, n), " ")

    def hashes() -> Column:
        parts = [lambda i, k=k: F.get(words, i + k) for k in range(n)]
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[p(i) for p in parts]))

    def covered(found: Column) -> Column:
        """Positions of repeated windows, in order, to words: each adds what the one before left over."""
        step = lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(n), i - acc["at"])).alias("n"), i.alias("at")
        )
        first = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("at"))
        return F.aggregate(found, first, step)["n"]

    def positions(texts: Column) -> Column:
        """Where a window stands that equals another; sorted, equal windows are neighbours."""
        numbered = F.array_sort(F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda k: F.coalesce(F.get(s, k)["t"] == F.get(s, k + 1)["t"], F.lit(False))
            marked = F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (same(k) | ((k > 0) & same(k - 1))).alias("r")))
            return F.array_sort(F.transform(F.filter(marked, lambda m: m["r"]), lambda m: m["i"]))

        return let(numbered, repeated)

    # Most texts repeat no window; equal windows have equal hashes, so these end at the hashes.
    exact = covered(positions(F.transform(F.sequence(F.lit(0), last), window)))
    some = let(hashes(), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact))
    return F.when(last < 1, F.lit(0)).otherwise(some)


def measures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of each text: what the base rules and the votes are made of. A null text has no words."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(INK))
    read = docs.select(F.col(key).alias("key"), body.alias("body"), words.alias("words"), lines.alias("lines"))
    share = lambda c: c.cast("bigint")
    code = F.when(F.col("body").rlike(r"[;={}<>:]"), F.size(F.filter("lines", lambda x: x.rlike(CODE)))).otherwise(0)
    return read.select(
        "key",
        share(F.size("words")).alias("n_words"),
        share(F.length(F.array_join("words", ""))).alias("word_chars"),
        share(F.length(F.regexp_replace("body", NO_SYMBOLS, ""))).alias("n_symbols"),
        share(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        share(F.size("lines")).alias("n_lines"),
        share(code).alias("n_code"),
        share(_repeat_words(F.col("words"))).alias("n_repeat_words"),
        share(F.size(F.array_distinct("words"))).alias("n_distinct"),
        share(F.size(F.filter("words", lambda w: w.rlike(PLAIN)))).alias("n_plain"),
        share(F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1)))).alias("n_runs"),
        share(F.size(F.filter("words", lambda w: F.lower(w).isin(*COMMON)))).alias("n_common"),
        share(F.size(F.filter("words", lambda w: (F.octet_length(w) > F.length(w)) & w.rlike(OTHER_LETTERS)))).alias("n_other"),
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote: -1 bad, 1 good, 0 abstain. Common words say nothing of languages they are not of, and
    symbols, letters and common words nothing of texts of which half the lines are code or markup. A text without words gets -1 for its length and abstains."""
    n = F.col("n_words")
    some = n >= 10  # shares of few words say little
    prose = (F.col("n_lines") < 3) | (2 * F.col("n_code") < F.col("n_lines"))

    def share(count: str, of: Column, bad_over: float, good_under: float) -> Column:
        c = F.col(count)
        return _vote(some & (c > bad_over * of), some & (c <= good_under * of))

    def short_of(count: str, of: Column, bad_under: float, good_over: float) -> Column:
        c = F.col(count)
        return _vote(some & (c < bad_under * of), some & (c >= good_over * of))

    return {
        "length": _vote(n < 10, n >= 30),
        "symbols": F.when((n >= 20) & prose, share("n_symbols", n, 0.1, 0.02)).otherwise(0),
        "plain": F.when((n >= 20) & prose, short_of("n_plain", n, 0.8, 0.9)).otherwise(0),
        "windows": share("n_repeat_words", n, 0.2, 0.05),
        "runs": share("n_runs", n, 0.1, 0.02),
        "distinct": short_of("n_distinct", F.least(n, F.lit(500)), 0.25, 0.4),
        "common": F.when((n >= 30) & prose & (OTHER_WORDS * F.col("n_other") < n), short_of("n_common", n, 0.03, 0.08)).otherwise(0),
        "lines": F.when(F.col("n_lines") >= 4, share("n_dup_lines", F.col("n_lines"), 0.3, 0.1)).otherwise(0),
    }


def fit(counted: Iterable[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.9) -> dict:
    """Expectation maximisation on counts of vote patterns; two classes, rules independent within one.

    Per rule it estimates how often it votes bad and good in either class when it does vote, smoothed
    by pseudo-counts that favour a right vote, with which it also starts, so that the classes cannot
    change places. To abstain says nothing. No pattern at all gives the start values.

    What a rule says of itself is not all that counts: it is fitted again with, as the least share of bad votes on
    good documents, ``LEAST_WRONG`` and its share of bad votes where all other rules are ``SURE`` of good quality.
    Rules are not independent: ``shared`` tells how far two of them vote bad together among bad documents, and
    ``posterior`` counts what they share once.
    """
    rows = [(p, n) for p, n in counted]
    model = _maximised(rows, [LEAST_WRONG] * (len(rows[0][0]) if rows else len(RULES)), rounds, prior)
    model = _maximised(rows, [LEAST_WRONG + x for x in _contradicted(rows, model)], rounds, prior)
    return model | {"shared": _shared(rows, model)}


def _maximised(rows: list[tuple[tuple[int, ...], int]], least: list[float], rounds: int, prior: float) -> dict:
    """Prior and table of each rule's votes per class; ``least`` has the least shares of bad votes on good documents."""
    rules = len(least)
    start = {1: {-1: 0.05, 1: 0.95}, 0: {-1: 0.6, 1: 0.4}}
    table = [{c: dict(start[c]) for c in (0, 1)} for _ in range(rules)]
    pi = prior
    for _ in range(rounds if rows else 0):
        sums = [{c: dict(start[c]) for c in (0, 1)} for _ in range(rules)]
        good = total = 0.0
        for pattern, n in rows:
            p = posterior(pattern, {"prior": pi, "table": table})
            good, total = good + p * n, total + n
            for r, v in enumerate(pattern):
                if v:
                    sums[r][1][v] += p * n
                    sums[r][0][v] += (1 - p) * n
        new = [{c: {v: s[c][v] / sum(s[c].values()) for v in s[c]} for c in (0, 1)} for s in sums]
        for rule, floor in zip(new, least):
            wrong = max(rule[1][-1], floor)
            rule[1] = {-1: wrong, 1: 1 - wrong}
        moved = max(abs(new[r][c][v] - table[r][c][v]) for r in range(rules) for c in (0, 1) for v in (-1, 1))
        table, pi = new, min(max((good + prior) / (total + 1), 0.01), 0.99)
        if moved < 1e-9:
            break
    return {"prior": pi, "table": table}


def _contradicted(rows: list[tuple[tuple[int, ...], int]], model: dict) -> list[float]:
    """Per rule the share of bad votes among its votes on documents of which the others are sure that they are good."""
    out = []
    for r in range(len(model["table"])):
        bad = cast = 0
        for pattern, n in rows:
            if pattern[r] and posterior((*pattern[:r], 0, *pattern[r + 1 :]), model) >= SURE:
                bad, cast = bad + n * (pattern[r] < 0), cast + n
        out.append(min(bad / cast, 0.5 - LEAST_WRONG) if cast else 0.0)
    return out


def _shared(rows: list[tuple[tuple[int, ...], int]], model: dict) -> list[list[float]]:
    """Correlation of each two rules' bad votes among bad documents on which both vote, 0 if it is negative."""
    rules = len(model["table"])
    bad = [(p, n * (1 - posterior(p, model))) for p, n in rows]
    out = [[0.0] * rules for _ in range(rules)]
    for r in range(rules):
        for s in range(r + 1, rules):
            both = [(p[r] < 0, p[s] < 0, w) for p, w in bad if p[r] and p[s]]
            total = sum(w for _, _, w in both) + 1  # one more document, on which they are independent
            a = (sum(w for x, _, w in both if x) + 0.5) / total
            b = (sum(w for _, y, w in both if y) + 0.5) / total
            together = (sum(w for x, y, w in both if x and y) + 0.25) / total
            out[r][s] = out[s][r] = min(max((together - a * b) / math.sqrt(a * (1 - a) * b * (1 - b)), 0.0), 1.0)
    return out


def _weights(rule: dict) -> dict[int, float]:
    return {v: math.log(rule[1][v]) - math.log(rule[0][v]) for v in (-1, 1)}


def posterior(pattern: tuple[int, ...], model: dict) -> float:
    """Probability of good quality given the votes; a bad vote counts the less the more it shares with other bad ones."""
    odds = math.log(model["prior"]) - math.log(1 - model["prior"])
    shared = model.get("shared")
    for r, v in enumerate(pattern):
        if v:
            times = 1 + sum(x for x, u in zip(shared[r], pattern) if u < 0) if shared and v < 0 else 1
            odds += _weights(model["table"][r])[v] / times
    return 1 / (1 + math.exp(-min(max(odds, -60), 60)))


def _probability(model: dict) -> Column:
    odds = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for r, name in enumerate(RULES):
        weight = _weights(model["table"][r])
        vote = F.col(f"vote_{name}")
        times = F.lit(1.0)
        for other, x in zip(RULES, model["shared"][r]):
            if x:
                times = times + F.when(F.col(f"vote_{other}") == -1, x).otherwise(0.0)
        odds = odds + F.when(vote == -1, weight[-1] / times).when(vote == 1, weight[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row per document: key, counts, votes, ``probability``, ``base_failed`` and ``kept``.

    ``kept`` is false if the base rules fail (fewer than 10 words, or over 20 % of the words in
    repeated windows), else whether the probability of good quality is at least ``least``. Null texts
    have no words and fail. Null and repeated keys and repeated rows keep a row each; other columns
    are not read. An empty table gives an empty result.

    Texts are read once; their counts are stored, and patterns of votes are counted over all
    documents. There are at most ``3 ** len(RULES)`` patterns, which alone reach the driver.
    """
    voted = measures(docs, key, text).select("*", *[v.cast("int").alias(f"vote_{r}") for r, v in votes().items()])
    voted = stored(voted, "votes")
    names = [f"vote_{r}" for r in RULES]
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    model = fit(sorted((tuple(row[n] for n in names), row["n"]) for row in counted))
    judged = voted.withColumn("probability", _probability(model)).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least)).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns, which it stores along with their counts."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return assess(rows, "row", "text", least).where("kept").select("row.*")
