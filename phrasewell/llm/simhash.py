"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 h`` bits have a value within ``h`` bits of both. So every
fingerprint emits all values within ``h`` bits, the values are shuffled, and fingerprints that meet
at a value are linked. Nothing is compared that does not meet, and nothing within the radius is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasewell.llm.common import free_name, stored, word_blocks
from phrasewell.llm.components import components

SEED = 42


def shingles(data: bytes, words: int):
    """Lists of the shingles of a text, space-joined, repeats included; a short text is one shingle."""
    carry: list[bytes] = []
    found = False
    for block in word_blocks(data):
        run = carry + block
        if len(run) >= words:
            found = True
            joined = b" ".join(run)
            ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
            starts = np.concatenate(([0], ends[: len(run) - words] + 1))
            yield [joined[i:j] for i, j in zip(starts.tolist(), ends[words - 1 :].tolist())]
        carry = run[len(run) - words + 1 :] if words > 1 and len(run) >= words else ([] if words == 1 else run)
    if not found and carry:
        yield [b" ".join(carry)]


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> int:
    """The bits that are set in over half of ``n`` hashes, as a signed 64-bit number."""
    packed = np.packbits(2 * sums > n, bitorder="little")
    return int(packed.view("<i8")[0])


def text_fingerprint(data: bytes, words: int) -> int:
    sums, n = np.zeros(64, np.int64), 0
    hashed = xxhash.xxh64_intdigest
    for some in shingles(data.lower(), words):
        for at in range(0, len(some), 1 << 16):
            part = np.array([hashed(s, SEED) for s in some[at : at + (1 << 16)]], np.uint64)
            sums += _bit_sums(part)
            n += len(part)
    return majority(sums, n)


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash of a text column as a long: A-Z in lower case, XXH64 of word shingles, majority per bit.

    A null or empty text, and one of white space only, has fingerprint 0.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        return pa.array([text_fingerprint(x.as_py() or b"", words) for x in raw], pa.int64())

    return of(text)


def masks(width: int, within: int) -> list[int]:
    """All ways to change at most ``within`` of ``width`` bits, as signed 64-bit numbers."""
    found = [sum(1 << b for b in bits) for k in range(within + 1) for bits in combinations(range(width), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def linked(fingerprints: DataFrame, radius: int = 2, width: int = 64) -> DataFrame:
    """Edges (a, b) that link the distinct values of the column ``fingerprint`` within ``radius`` bits.

    All that meet at a value lie within the radius of each other, so an edge from each to the next
    smaller one keeps all links, and what meets is read in order without being held.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even: both sides emit half of it")
    ball = F.transform(F.lit(masks(width, half)), lambda m: F.col("fingerprint").bitwiseXOR(m))
    met = Window.partitionBy("value").orderBy("fingerprint")
    pairs = (
        fingerprints.select("fingerprint", F.explode(ball).alias("value"))
        .select(F.col("fingerprint").alias("a"), F.lag("fingerprint").over(met).alias("b"))
        .where("b is not null")
        .distinct()
    )
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2
) -> DataFrame:
    """Rows (key, fingerprint, component): near-duplicate classes of all texts.

    Every row of ``docs`` gives one row; other columns are not read. Null texts count as empty, and
    all empty ones share fingerprint 0. ``component`` is the smallest key that can be reached by
    links of at most ``radius`` bits; null keys do not count, and if all are null it is null.
    Repeated keys keep a row each. Equal fingerprints are one node of the graph, so exact copies are
    never compared with each other. An empty table gives an empty result.
    """
    marked = stored(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), words).alias("fingerprint")), "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min("key").alias("least"))
    parts = components(linked(nodes.select("fingerprint"), radius))
    placed = nodes.join(parts, nodes["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("part")
    )
    smallest = placed.groupBy("part").agg(F.min("least").alias("component"))
    classes = placed.join(smallest, "part").select("fingerprint", "component")
    return marked.join(classes, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component")
