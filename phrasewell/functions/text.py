"""Text expressions: templates, mentions, response bodies and n-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from phrasewell.functions import fixed_values as fixed

ANY_MENTION = "|".join(fixed.MENTION_PATTERNS)


def fill(template: str, **columns: Column) -> Column:
    """The template as a concatenation of literals and columns; missing values become empty."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(F.coalesce(columns[piece].cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def text_or_missing(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(fixed.MISSING_TEXT))


def list_text(items: Column) -> Column:
    """An array of strings the way a Python list of strings prints."""

    def quoted(s: Column) -> Column:
        lines = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            lines = F.replace(lines, F.lit(raw), F.lit(shown))
        plain = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
        return F.when(plain, F.concat(F.lit('"'), lines, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(lines, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def mentions(text: Column) -> Column:
    """All identifiers in the text, pattern by pattern, repeats kept."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in fixed.MENTION_PATTERNS]
    return F.concat(*found)


def mention_key(part: Column) -> Column:
    return F.split_part(part, F.lit(":"), F.lit(2))


def response_text(body: Column, unescape: bool = False) -> Column:
    """Text of a raw response body: what stands between the markers of each line, joined."""
    joined = F.array_join(
        F.transform(
            F.split(body, "\n"),
            lambda line: F.split_part(
                F.split_part(line, F.lit(fixed.CHUNK_START), F.lit(2)), F.lit(fixed.CHUNK_END), F.lit(1)
            ),
        ),
        "",
    )
    if not unescape:
        return joined
    return F.from_json(F.concat(F.lit('{"t":"'), joined, F.lit('"}')), "t string")["t"]


def tokens(text: Column) -> Column:
    """Split at every single space; empty tokens stay."""
    return F.split(text, " ")


def ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")
        ),
    ).otherwise(F.array().cast("array<string>"))
