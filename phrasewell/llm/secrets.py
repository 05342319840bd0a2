"""Secrets in texts: fixed patterns, and values in credential contexts that are costly to guess.

The cost of a value is the least over all ways to cut it into words, dates, repeats, keyboard walks
and brute-force spans, found by dynamic programming over its positions.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.common import short_batches

# The kinds of the base scan in their order, their patterns, and the least characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)

# Names before a credential, in any case, which may stand anywhere within a longer name.
NAME = re.compile(
    r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?id|credential|bearer|authorization",
    re.A | re.I,
)
REST_OF_NAME = re.compile(r"[a-z0-9_-]*+", re.A | re.I)

# What stands between such a name and its value, and the schemes of a header before it.
SEPARATOR = re.compile(r"""["'`]?(?:\s*+(?:=>|:=|[:=])\s*+|\s++is\s++(?=["'`]))""", re.A | re.I)
SCHEME = re.compile(r"(?:bearer|basic|token)\s++(?![:=])", re.A | re.I)
ELEMENT = re.compile(r"[\w:.-]*+", re.A)

# A value is what quotes enclose on one line, or all up to white space or a tag.
QUOTED = re.compile(r""""((?:[^"\\\r\n]|\\[^\r\n])*+)"|'((?:[^'\\\r\n]|\\[^\r\n])*+)'|`([^`\r\n]*+)`""")
BARE = re.compile(r"(?:[^\s<]++|<(?!/?[A-Za-z][^<>\s]*+[\s/>]))*+")
NAME_AT_END = re.compile(r"[:=]+[\w-]+", re.A)  # of the value read backwards

# A value ends before a separator and a further name with its equals sign.
NEXT_NAME = re.compile(r"(?:&(?:amp;)?|;)[A-Za-z_][\w.-]*=", re.A)

# Words that guessers try first, commonest first; ranks give their cost.
WORDS = (
    "password", "pass", "admin", "user", "login", "welcome", "secret", "master", "root", "test", "love", "dragon", "monkey",
    "letmein", "football", "baseball", "princess", "sunshine", "shadow", "super", "hello", "token", "key", "access", "default",
    "changeme", "example", "sample", "your", "here", "none", "null", "true", "false", "private", "public", "server", "client",
    "database", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "august", "michael", "jordan", "charlie",
    "thomas", "daniel", "andrew", "jessica", "soccer", "hockey", "killer", "flower", "cookie", "orange", "purple", "silver",
    "golden", "freedom", "whatever", "computer", "internet", "system", "service", "account", "string", "value", "name", "word",
    "the", "and", "this", "that", "with", "please", "enter", "required", "insert", "placeholder", "redacted", "hidden", "empty",
    "undefined", "environ", "getenv", "config", "settings", "variable", "function", "return", "import", "file", "path", "data",
)

# Common pairs of letters in English, German, French and Spanish, about a quarter of all pairs. Most pairs
# in words are among them, few in random letters are.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro ic "
    "ne me li co ta io ri ce la el ma di ho ch ll be us om ec em ut pe ac so tr un no wa ot il ee nc id ss rs ni mo na ge ie wi "
    "da lo ai po qu ue ei ig au ht sc ck am mi pr ol ad ul pl ag im ir ke ay ap ow iv fo fi ca ct av bl ev sp up su ab ty gh ry "
    "ly os ia ci ga va vi bo ob do br ep ip op mp ns rt rd rm rk rn ls lt pa pi bi bu ba gr cr cl fr fa fe ff fu ki ye".split()
)

#: Decimal logarithm of the guesses from which on a value is a secret.
LEAST_COST = 9.0

#: Letters that look like words are secrets only at so many times the least cost (a sentence of words, or 26 letters).
WORDLIKE_TIMES = 4

#: Three kinds of characters in one value are seldom anything but a secret; a million guesses do then, about five characters.
MIXED_TIMES = 2 / 3

_CASED = re.compile(r"(?:A?a{2,}|A{2,})+")

# Blanks, letters of scripts without case and punctuation outside ASCII part a value that holds prose.
_PROSE = regex.compile(r"(?V1)(?:[\s\p{Lo}\p{Lm}\p{Mn}\p{Mc}]|[\p{P}--[!-~]])+")
_QUOTES = re.compile("[\"'`]")
_MARKS = re.compile(r"[^\w]|_")

# Rows of a keyboard, each shifted half a key to the right of the one above.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

LEET = str.maketrans("@4301$5!7", "aaeoissit")
_DATE = re.compile(r"(?:(?:19|20)\d\d)([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")


def _neighbours() -> dict[str, set[str]]:
    """Keys next to each key: on its row, and up to two on the row above and below."""
    spots = {c: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {c: {d for d, (u, v) in spots.items() if d != c and abs(y - v) <= 1 and abs(x - u) <= 1} for c, (x, y) in spots.items()}


NEXT_KEYS = _neighbours()
#: Characters after each of which a repeat may end; beyond, it ends where it does in the value.
STRETCH = 64

RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))


def _alphabet(c: str) -> int:
    if c.isdigit():
        return 10
    if c.isascii() and c.isalpha():
        return 26
    return 33 if c.isascii() or c.isalpha() else 100


class _Segments:
    """Words, dates, repeats and walks in ``value`` by their start.

    A repeat of one character may end after any of its first ``STRETCH`` ones, or where it ends in the
    value; one of several characters ends there. Ends of repeats are looked for once.
    """

    def __init__(self, value: str):
        self.value, self.lower = value, value.lower()
        self.plain = self.lower.translate(LEET)
        self.ends: dict[int, tuple[int, int]] = {}  # by period: from where and until where it holds

    def _end(self, i: int, size: int) -> int:
        """Where the characters from ``i`` on cease to equal those ``size`` before them."""
        value = self.value
        since, end = self.ends.get(size, (0, 0))
        if not since <= i <= end - size:
            end = i + size
            while end < len(value) and value[end] == value[end - size]:
                end += 1
            self.ends[size] = (i, end)
        return end

    def of(self, i: int, limit: float = math.inf) -> list[tuple[int, float, str]]:
        """Segments (end, cost, kind) from ``i`` on; walks only as far as their turns cost up to ``limit``."""
        value, lower, plain = self.value, self.lower, self.plain
        n, found = len(value), []
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = RANKS.get(lower[i:j]) or RANKS.get(plain[i:j])
            if rank:
                cased = 1 if value[i:j] == lower[i:j] else 2
                swapped = 1 if lower[i:j] in RANKS else 2
                found.append((j, math.log10(rank * cased * swapped + 1), "word"))
        for j in range(i + 4, min(n, i + 10) + 1) if value[i].isdigit() else ():
            if _DATE.fullmatch(value, i, j):
                year = j - i == 4 and value[i : i + 2] in ("19", "20")
                days = 2.1 if year else 4.57  # a year alone, or a day within a hundred years
                found.append((j, days + (0.6 if not value[i:j].isdigit() else 0), "date"))
        end = self._end(i, 1)
        for j in (*range(i + 3, min(end, i + STRETCH) + 1), *((end,) if end > i + STRETCH else ())):
            found.append((j, math.log10(_alphabet(value[i]) * (j - i)), "repeat"))
        for size in range(2, min(16, (n - i) // 2) + 1):
            times = (self._end(i, size) - i) // size if value.startswith(value[i : i + size], i + size) else 1
            if times > 1:
                unit_cost = sum(math.log10(_alphabet(c)) for c in value[i : i + size])
                found.append((i + size * times, unit_cost + math.log10(times), "repeat"))
        turns, j, step = 0, i, None
        while j + 1 < n and turns * 0.6 <= limit and lower[j + 1] in NEXT_KEYS.get(lower[j], ()):
            way = ord(lower[j + 1]) - ord(lower[j])
            turns += step is not None and way != step
            step, j = way, j + 1
            if j - i >= 2:
                found.append((j + 1, math.log10(47 * (j - i)) + turns * 0.6, "walk"))
        for step in (1, -1):
            j = i
            while j + 1 < n and value[j].isalnum() and ord(value[j + 1]) - ord(value[j]) == step:
                j += 1
                if j - i >= 2:
                    found.append((j + 1, math.log10(_alphabet(value[i]) * (j - i + 1)), "walk"))
        return found


def cheap_segments(value: str) -> list[list[tuple[int, float, str]]]:
    """Words, dates, repeats and walks in ``value`` by their end, as (start, cost, kind)."""
    found = _Segments(value)
    segments: list[list[tuple[int, float, str]]] = [[] for _ in range(len(value) + 1)]
    for i in range(len(value)):
        for j, cost, kind in found.of(i):
            segments[j].append((i, cost, kind))
    return segments


def costs_at_least(value: str, least: float) -> bool:
    """Whether ``guess_cost`` of ``value`` is at least ``least``, for values of any length.

    Goes on from the positions reached, nearest first, and drops what costs as much already, as nothing
    that follows makes it cheaper. A value that is hard to guess ends this after few characters, and
    one that is easy consists of few segments.
    """
    n = len(value)
    factorial = lambda k: math.lgamma(k + 1) / math.log(10)
    if not n:
        return 0.0 >= least
    segments = _Segments(value)
    reached: dict[int, dict[tuple[int, bool], float]] = {0: {(0, False): 0.0}}
    order = [0]

    def offer(j: int, state: tuple[int, bool], cost: float) -> None:
        if cost + factorial(state[0]) >= least:
            return
        if j not in reached:
            reached[j] = {}
            heapq.heappush(order, j)
        if cost < reached[j].get(state, math.inf):
            reached[j][state] = cost

    while order:
        i = heapq.heappop(order)
        states = reached.pop(i)
        if i == n:
            return not states
        one = math.log10(_alphabet(value[i]))
        following = segments.of(i, least)
        for (k, brute), cost in states.items():
            offer(i + 1, (k if brute else k + 1, True), cost + one)
            for j, added, _ in following:
                offer(j, (k + 1, False), cost + added)
    return True


@lru_cache(maxsize=4096)
def guess_cost(value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """Decimal logarithm of the guesses for ``value`` and the cheapest segmentation as (kind, start, end).

    A segmentation costs the product of its segments and of their number's factorial, as their order
    must be guessed too; ``best[k][j]`` is the least sum for the first j characters in k segments.
    An empty value costs 0.
    """
    n = len(value)
    if not n:
        return 0.0, ()
    segments = cheap_segments(value)
    # Two states per end j and number of segments k: the last one is brute force, or it is not.
    # Brute force after brute force is one segment, so it goes on with the same k.
    start_state = {(0, False): (0.0, None, "")}
    best: list[dict[tuple[int, bool], tuple]] = [start_state]
    for j in range(1, n + 1):
        here: dict[tuple[int, bool], tuple] = {}

        def offer(state: tuple[int, bool], cost: float, origin: tuple, kind: str) -> None:
            if state not in here or cost < here[state][0]:
                here[state] = (cost, origin, kind)

        one = math.log10(_alphabet(value[j - 1]))
        for (k, brute), (cost, _, _) in best[j - 1].items():
            offer((k if brute else k + 1, True), cost + one, (j - 1, k, brute), "brute")
        for start, added, kind in segments[j]:
            for (k, brute), (cost, _, _) in best[start].items():
                offer((k + 1, False), cost + added, (start, k, brute), kind)
        best.append(here)
    cost, k, brute = min((c[0] + math.lgamma(k + 1) / math.log(10), k, b) for (k, b), c in best[n].items())
    path: list[tuple[str, int, int]] = []
    j = n
    while j:
        _, (start, before, was_brute), kind = best[j][k, brute]
        if kind == "brute" and path and path[-1][0] == "brute" and before_is_same:
            path[-1] = ("brute", start, path[-1][2])
        else:
            path.append((kind, start, j))
        before_is_same = kind == "brute" and was_brute
        j, k, brute = start, before, was_brute
    return cost, tuple(reversed(path))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches (start, end, kind) of the fixed patterns, by start and then by kind as listed."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def wordlike(value: str) -> bool:
    """Whether a value is letters only, cased as words are, with common pairs at half of its places or more.

    Pairs with a letter outside ASCII, of which there is no list, count as common.
    """
    if not value.isalpha() or not _CASED.fullmatch("".join("A" if c.isupper() else "a" for c in value)):
        return False
    lower = value.lower()
    pairs = [lower[i : i + 2] for i in range(len(lower) - 1)]
    return 2 * sum(x in PAIRS or not x.isascii() for x in pairs) >= len(pairs)


def least_for(value: str, least: float) -> float:
    """The cost from which on a value counts, by what it looks like."""
    if wordlike(value):
        return least * WORDLIKE_TIMES
    kinds = {"A" if c.isupper() else "a" if c.isalpha() else "1" if c.isdigit() else "." for c in value}
    return least * MIXED_TIMES if len(kinds) > 2 else least


def costly(value: str, least: float) -> bool:
    """Whether a value, or a part of one that holds blanks or letters without case, costs at least ``least``.

    Words of prose are judged one by one, others as a whole: an apostrophe parts a value only where
    there are words on both sides, and so does any mark within a value that has blanks.
    """
    parts = [p for p in _PROSE.split(value) if p]
    marks = _MARKS if len(parts) > 1 else _QUOTES
    for part in parts:
        part = part.strip(".,;:!?()\"'`")
        pieces = marks.split(part)
        if not all(len(p) < 3 or wordlike(p) for p in pieces):
            pieces = [part]
        if any(costs_at_least(p, least_for(p, least)) for p in pieces):
            return True
    return False


def covered(start: int, end: int, taken: list[tuple[int, int, str]]) -> bool:
    """Whether spans in order of their starts leave no character from ``start`` to ``end`` out."""
    for s, e, _ in taken:
        if s <= start < e:
            start = e
    return start >= end


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values after credentials' names start and end, in order; takes time in proportion to the text."""
    at = bare_end = 0
    while m := NAME.search(text, at):
        since, at = at, REST_OF_NAME.match(text, m.end()).end()
        opened = SEPARATOR.match(text, at)
        if opened:
            start = opened.end()
        elif text.startswith(">", at) and (tag := text.rfind("<", since, m.start())) >= 0 and ELEMENT.fullmatch(text, tag + 1, m.start()):
            start = at + 1
        else:
            continue
        at = start
        scheme = SCHEME.match(text, start)
        if scheme:
            start = scheme.end()
        quoted = QUOTED.match(text, start)
        if quoted:
            at = quoted.end()
            yield quoted.span(quoted.lastindex)
            continue
        # An opening quote without a closing one is not part of the value.
        start += text.startswith(('"', "'", "`"), start)
        if bare_end <= start:
            bare_end = BARE.match(text, start).end()
        inner = NAME.match(text, start)
        if inner and SEPARATOR.match(text, REST_OF_NAME.match(text, inner.end()).end()):
            continue  # a further name, which has the value
        end = bare_end
        # The next of several parameters is judged on its own.
        following = NEXT_NAME.search(text, start, end)
        if following:
            end = following.start()
        named = NAME_AT_END.match(text[start:end][::-1])
        at = max(at, end - named.end()) if named else max(at, end)
        yield start, start + len(text[start:end].rstrip(".,;:!?)\"'`"))


def guess_spans(text: str, least_cost: float, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Values in credential contexts of at least ``least_cost`` that reach beyond the base spans."""
    values = ((s, e) for s, e in context_values(text) if s < e and not covered(s, e, taken))
    return [(s, e, "guess") for s, e in values if costly(text[s:e], least_cost)]


def spans(text: Column, least_cost: float = LEAST_COST) -> Column:
    """All secrets of a text as an array of (start, end, kind), by start and then by kind.

    Positions count code points, ends are exclusive. Kinds are assign, access and hex, which have
    fixed patterns, and guess: a value after a credential's name whose least guess cost is at least
    ``10 ** least_cost`` guesses and which the other spans do not cover; it may overlap them, as the
    fixed pattern ends at the first symbol. A value is what quotes enclose or all up to white space or
    a tag, in any letters and of any length; it may follow the name in an element or, after a scheme,
    in a header. Letters that look like words, which are most often just that, count only from
    ``10 ** (WORDLIKE_TIMES * least_cost)`` guesses on, and letters of scripts without case, such as
    Chinese, not at all; three kinds of characters together from ``10 ** (MIXED_TIMES * least_cost)``
    on. There is no least length beside the cost. A null or empty text has none.
    """

    @F.arrow_udf("array<struct<start:int,end:int,kind:string>>")
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        out = []
        for x in texts:
            text = x.as_py() or ""
            base = base_spans(text)
            every = sorted(base + guess_spans(text, least_cost, base), key=lambda s: (s[0], s[2] == "guess")) if text else []
            out.append([{"start": s, "end": e, "kind": k} for s, e, k in every])
        return pa.array(out, kind)

    return of(text)


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one gap.

    Joined from the pieces between the spans, which only rows with a span do. Null stays null.
    """

    def past(done: Column, s: Column) -> Column:
        # What lies between the end of the span before and this one; nothing if they overlap.
        between = F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        marked = F.concat(done["out"], between, F.lit("["), s["kind"], F.lit("]"))
        out = F.when(s["start"] >= done["at"], marked).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(found, start, past, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def scan(docs: DataFrame, text: str = "text", out: str = "spans", least_cost: float = LEAST_COST) -> DataFrame:
    """``docs`` with the column ``out``: the secrets of each text as ``spans`` gives them.

    Row by row, without a shuffle; every row and column is kept, whatever is null, empty or repeated,
    and a column that is already called ``out`` is replaced. An empty table gives an empty one. A text
    of any length is searched whole by one task, in time that grows with its length.
    """
    short_batches(docs.sparkSession)
    return docs.withColumn(out, spans(F.col(text), least_cost))


def shown(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*kinds))
