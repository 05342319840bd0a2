"""Packing of token sequences as a cutting-stock problem, solved by column generation.

Documents are cut into pieces of few lengths. The histogram of these lengths, which no input makes
longer, is all that the linear program sees: its columns are patterns of lengths that share a sequence, priced by a knapsack. Rounded
patterns are turned into places, and the items of a length are ranked and take the places in order.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from phrasewell.llm.common import stored
from phrasewell.session import fits

# Fixed value: how byte-level vocabularies cut a text before they merge bytes.
BYTE_LEVEL_CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def padded(length: int, size: int) -> int:
    """What a sequence of ``length`` tokens takes: a power of two itself, else ``size``."""
    return length if length and not length & (length - 1) else size


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by the text of a file of the ``tokenizers`` library, as little-endian bytes.

    Strings of special tokens in a text are ordinary text, or with ``added`` the tokens that the file
    adds, as ``encode(text, add_special_tokens=False)`` of the library has it. A plain byte-level vocabulary whose ids
    follow the order of its merges is handed to ``tiktoken``, which gives the same ids about three
    times as fast; any other file is left to ``tokenizers``.
    """

    def __init__(self, file: str, added: bool = False):
        told = json.loads(file)
        ranks = self._ranks(told, added)
        if ranks:
            import tiktoken

            own = {t["content"]: t["id"] for t in told.get("added_tokens") or ()} if added else {}
            plain = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_CUTS, mergeable_ranks=ranks, special_tokens=own)
            self._encode = (lambda text: plain.encode(text, allowed_special="all")) if own else plain.encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(file)
            tokenizer.encode_special_tokens = not added
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranks(told: dict, added: bool = False) -> dict[bytes, int] | None:
        # Tokens that take white space along, stand alone, or begin like another are left to the library.
        own = [t for t in told.get("added_tokens") or () if added]
        if any(t.get(k) for t in own for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(a["content"] in b["content"] for a in own for b in own if a is not b):
            return None
        model, cuts = told["model"], told.get("pre_tokenizer") or {}
        simple = cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space") and cuts.get("use_regex", True)
        odd = told.get("normalizer") or model.get("dropout") or model.get("ignore_merges")
        if model.get("type") != "BPE" or not simple or odd or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"][m] for m in merged]
        letters = _byte_letters()
        if order != sorted(order) or (order and order[0] < 256) or any(c not in model["vocab"] for c in letters):
            return None
        words = [*letters, *merged]
        return {bytes(letters[c] for c in w): model["vocab"][w] for w in words}

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` ids."""
    grain = max(1, size // 64)
    made = [(at, size) for at in range(0, n - size + 1, size)]
    at = len(made) * size
    for length in (size // 2 if n - at >= size // 2 else 0, None, None):
        length = (n - at) // grain * grain if length is None and n - at >= grain else n - at if length is None else length
        if length:
            made.append((at, length))
            at += length
    return made


PIECE = "doc_tokens:bigint,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>,place:bigint"


def cut_documents(docs: DataFrame, key: str, text: str, tokenizer: str, size: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Rows (key, doc_tokens, start, length, ids_crc32, ids, place): the pieces that documents are cut into.

    Whole sequences come first, then a half one where there is as much left, then a multiple of a
    64th of a sequence, and the rest. So there are few lengths, all of which the program can combine,
    and a document has at most three pieces besides its whole sequences. Added tokens of the file
    that a text spells out are one id each. ``end_id`` follows the ids of each document, so an empty or null text has one id. The checksum is
    that of the piece's ids as little-endian unsigned 32-bit numbers. ``with_ids=False`` leaves the
    ids null once the checksum has been taken. ``place`` counts the pieces of the same length that the
    same task has made before, from 0 on.
    """
    kind = pa.struct([("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())), ("place", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()
    with open(tokenizer, encoding="utf-8") as file:  # read here; executors may lack the file
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    ready: list[Encoder] = []

    @F.arrow_udf(f"array<struct<{PIECE}>>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not ready:
            ready.append(Encoder(shared.value, added=True))
        made: Counter[int] = Counter()  # per length, of which there are few
        for texts in batches:
            out = []
            for x in texts:
                text = x.as_py()
                ids = (ready[0].ids(text) if text else b"") + end
                parts = []
                for at, n in cuts(len(ids) // 4, size):
                    part = ids[4 * at : 4 * (at + n)]
                    own = np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None
                    parts.append({"doc_tokens": len(ids) // 4, "start": at, "length": n, "ids_crc32": zlib.crc32(part), "ids": own, "place": made[n]})
                    made[n] += 1
                out.append(parts)
            yield pa.array(out, pa.list_(kind))

    return docs.select(F.col(key).alias("key"), F.explode(pieces(F.col(text))).alias("p")).select("key", "p.*")


# The linear program


def _knapsack(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of items of lengths 1, 2, ... that fill each capacity exactly, and the last item taken.

    ``values[l - 1]`` is the worth of length l, -inf where there is none. Items repeat freely.
    """
    best = np.full(size + 1, -np.inf)
    best[0] = 0.0
    last = np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        k = min(c, len(values))
        option = values[:k] + best[c - k : c][::-1]
        i = int(option.argmax())
        best[c], last[c] = option[i], i + 1
    return best, last


def _pattern(last: np.ndarray, c: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while c:
        found[int(last[c])] = found.get(int(last[c]), 0) + 1
        c -= int(last[c])
    return found


def solve(demand: dict[int, int], size: int, gap: float = 1e-4, rounds: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used: a solution of the linear program within ``gap`` of the best.

    Revised simplex with delayed columns. A pattern costs what its sequence takes once it is padded;
    each round a knapsack finds the pattern that the prices make cheapest for its cost. Its ratio
    also bounds the optimum from below, which ends the search early.
    """
    lengths = sorted(demand)
    if not lengths:
        return []
    at = {length: i for i, length in enumerate(lengths)}
    m = len(lengths)
    want = np.array([demand[x] for x in lengths], float)
    columns: list[dict[int, int]] = []
    for x in lengths:
        times = size // x
        columns.append({x: times})
    costs = np.array([padded(x * p[x], size) for x, p in zip(lengths, columns)], float)
    inverse = np.diag([1.0 / columns[i][x] for i, x in enumerate(lengths)])
    level = inverse @ want
    all_costs = np.array([padded(c, size) if c else 1 for c in range(size + 1)], float)
    for turn in range(rounds):
        prices = costs @ inverse
        values = np.full(size, -np.inf)
        values[np.array(lengths) - 1] = prices
        best, last = _knapsack(values, size)
        # A pattern of worth w and cost c: scaling all prices by the least c / w makes them feasible.
        ratio = best[1:] / all_costs[1:]
        c = 1 + int(ratio.argmax())
        if ratio[c - 1] <= 1 + gap:
            break
        entering = _pattern(last, c)
        column = np.zeros(m)
        for x, n in entering.items():
            column[at[x]] = n
        moved = inverse @ column
        positive = moved > 1e-9
        if not positive.any():
            break
        steps = np.full(m, np.inf)
        steps[positive] = level[positive] / moved[positive]
        out = int(steps.argmin())
        step = steps[out]
        level = level - step * moved
        level[out] = step
        np.maximum(level, 0, out=level)
        row = inverse[out] / moved[out]
        inverse -= np.outer(moved, row)
        inverse[out] = row
        columns[out], costs[out] = entering, all_costs[c]
        if turn % 200 == 199:  # keeps rounding errors from growing
            basis = np.zeros((m, m))
            for j, p in enumerate(columns):
                for x, n in p.items():
                    basis[at[x], j] = n
            inverse = np.linalg.inv(basis)
            level = np.maximum(inverse @ want, 0)
    return [(p, float(x)) for p, x in zip(columns, level) if x > 1e-9]


def rounded(demand: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns that use up the demand exactly.

    The program's numbers are rounded down. What is left, at most one sequence per length, is filled
    one sequence after another, each as full as the lengths that remain allow.
    """
    left = {x: n for x, n in demand.items() if n > 0}
    made: list[tuple[dict[int, int], int]] = []
    for pattern, times in solve(left, size):
        n = min([int(times + 1e-6), *(left[x] // k for x, k in pattern.items())])
        if n:
            made.append((pattern, n))
            for x, k in pattern.items():
                left[x] -= n * k
    while left := {x: n for x, n in left.items() if n > 0}:
        pattern = _fullest(left, size)
        n = min(left[x] // k for x, k in pattern.items())
        made.append((pattern, n))
        for x, k in pattern.items():
            left[x] -= n * k
    return made


def _fullest(left: dict[int, int], size: int) -> dict[int, int]:
    """The longest length that is left with others that fill its sequence as far as they can."""
    longest = max(left)
    room = size - longest
    # took[c]: the length that first made the sum c reachable; lengths in falling order, each within its number.
    took = np.full(room + 1, -1)
    took[0] = 0
    for x in sorted((y for y in left if y <= room), reverse=True):
        used = np.zeros(room + 1, int)
        n = left[x] - (x == longest)
        for c in range(x, room + 1):
            if took[c] < 0 and took[c - x] >= 0 and used[c - x] < n:
                took[c], used[c] = x, used[c - x] + 1
        if took[room] >= 0:
            break
    c = max(i for i in range(room + 1) if took[i] >= 0)
    pattern = {longest: 1}
    while c:
        x = int(took[c])
        pattern[x] = pattern.get(x, 0) + 1
        c -= x
    return pattern


def places(demand: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: (length, first, last, per, sequence, offset).

    Items of that length with ranks from ``first`` to before ``last`` lie ``per`` to a sequence,
    from the sequence numbered ``sequence`` on, each from ``offset`` on one after another.
    """
    taken = dict.fromkeys(demand, 0)
    rows, sequence = [], 0
    for pattern, n in rounded(demand, size):
        offset = 0
        for x, k in sorted(pattern.items(), reverse=True):
            rows.append((x, taken[x], taken[x] + n * k, k, sequence, offset))
            taken[x] += n * k
            offset += x * k
        sequence += n
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Rows (key, start, length, ids_crc32, ids, doc_tokens, sequence_id, offset): all documents, packed.

    Each id of each document lies in one piece; pieces of a sequence lie one after another from
    offset 0 and make up at most ``size`` ids. Null texts count as empty and have the end id alone.
    Null and repeated keys and repeated rows are documents of their own; other columns are not read.
    An empty table gives an empty result.

    Pieces are stored once, the text is read once. Lengths are counted before the shuffle and their
    histogram, ``size`` numbers at most, goes to the driver; the places that come back are bounded by
    the patterns, no more than two per length. The task that cuts the documents counts its pieces of
    each length as it writes them, so ranks within a length take a number per task and length, and the
    pieces with their ids are seated where they lie.
    """
    spark = docs.sparkSession
    cut = cut_documents(docs, key, text, tokenizer, size, end_id, with_ids)
    made = stored(cut.withColumn("task", F.spark_partition_id()), "pieces")

    sizes = stored(made.groupBy("length", "task").agg(F.count("*").alias("n")), "sizes")
    demand = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if fits(offsets) else offsets

    spots = spark.createDataFrame(
        places(demand, size) if demand else [],
        "p_length bigint, first bigint, last bigint, per bigint, sequence bigint, p_offset bigint",
    )
    ranked = made.join(offsets, ["length", "task"]).withColumn("rank", F.col("place") + F.col("before"))
    # Bounded by the patterns, which are as many as there are lengths.
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    turn = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(spots), at).select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "ids", "doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(turn, F.col("per")) * F.col("length")).cast("bigint").alias("offset"),
    )
