"""Packing of token sequences by the sum of squares.

N(g) is the number of open sequences with room for g more tokens. A document goes where the sum of
the squares of all N(g) becomes smallest, so no amount of room is left over often, and what is left
over is varied enough for the documents to come. Documents come from long to short, and a sequence
is opened only for a document that no open one has room for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from phrasewell.llm.common import stored
from phrasewell.llm.packing import Encoder

#: Pieces that are packed together, about. More leave less room over and take a task longer.
GROUP_ROWS = 8192

PIECE = "piece:int,start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:array<int>"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` ids: full ones, behind a shorter one if need be."""
    first = n % size
    return ([(0, first)] if first else []) + [(at, size) for at in range(first, n, size)]


def cut_documents(docs: DataFrame, key: str, text: str, tokenizer: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, doc_tokens, ids) of all pieces."""
    kind = pa.struct([("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")], ("ids", pa.list_(pa.int32()))])
    end = np.array([end_id], "<u4").tobytes()
    with open(tokenizer, encoding="utf-8") as file:  # read here; executors may lack the file
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    ready: list[Encoder] = []

    @F.arrow_udf(f"array<struct<{PIECE}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Encoder(shared.value, added=True))
        out = []
        for x in texts:
            ids = (ready[0].ids(x.as_py()) if x.is_valid else b"") + end
            n, made = len(ids) // 4, []
            for i, (at, length) in enumerate(cuts(n, size)):
                part = ids[4 * at : 4 * (at + length)]
                own = np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None
                made.append({"piece": i, "start": at, "length": length, "ids_crc32": zlib.crc32(part), "doc_tokens": n, "ids": own})
            out.append(made)
        return pa.array(out, pa.list_(kind))

    return docs.select(F.col(key).alias("key"), F.explode(pieces(F.col(text))).alias("p")).select("key", "p.*")


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in the order in which they are placed: the first piece of each one's sequence, and its offset there.

    Among the open sequences with room for a piece of length l, one with room for g leaves one with
    room for g - l, which changes the sum of squares by 2 (N(g - l) - N(g) + 1), or by 1 - 2 N(g) if
    it is filled up. On a tie the fuller sequence is taken, of equally full ones the last.
    """
    open_ones = np.zeros(size + 1, np.int64)  # N(g); N(0) stays 0, as filled sequences are not open
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    first, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        there = open_ones[length:size]
        gaps = np.flatnonzero(there)
        if len(gaps):
            change = 2 * (open_ones[gaps] - there[gaps] + 1)
            if gaps[0] == 0:
                change[0] -= 1
            gap = length + int(gaps[change.argmin()])
            open_ones[gap] -= 1
            head = waiting[gap].pop()
            offset[i] = size - gap
        else:
            gap, head = size, i
        first[i] = head
        if gap > length:
            open_ones[gap - length] += 1
            waiting[gap - length].append(head)
    return first, offset


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    end_id: int = 0,
    with_ids: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset): all documents, packed.

    A document of at most ``size`` ids is one piece; a longer one is cut into pieces of ``size`` ids
    behind a first one that takes what is over. ``end_id`` follows the ids of each document, so a null or empty
    text has one id. Pieces of a sequence lie one after another from offset 0 and make up at most
    ``size`` ids; ``sequence_id`` is a number that no other sequence has. Null and repeated keys and
    repeated rows are documents of their own, and other columns are not read. An empty table gives an
    empty result. Very long texts are encoded whole by one task. ``with_ids=False`` leaves ``ids`` null.

    Full pieces are sequences as they are. The others are stored and hashed into groups of about
    ``group_rows``, whatever the size of the table, and a task packs a group, which holds at most
    ``group_rows * size`` ids. So pieces are shuffled once, and equal lengths do not meet.
    """
    made = stored(cut_documents(docs, key, text, tokenizer, size, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = made.where(F.col("length") < size)
    groups = max(1, -(-short.count() // group_rows))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        rows, lengths = held["row"].to_numpy(), held["length"].to_numpy()
        order = np.lexsort((rows, -lengths))
        first, offset = place(lengths[order], size)
        held = held.take(pa.array(order)).append_column("sequence_id", pa.array(rows[order][first])).append_column("offset", pa.array(offset))
        yield from held.combine_chunks().to_batches(max_chunksize=1000)

    kinds = T.StructType([*short.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    grouped = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    seated = grouped.repartitionById(groups, "group").drop("group").mapInArrow(seat, kinds)
    full = made.where(F.col("length") == size).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("bigint")})
    return full.unionByName(seated).withColumnRenamed("key", key).drop("row")

