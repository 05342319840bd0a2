"""SentencePiece encoding and decoding; giant documents are encoded in chunks by a parallel scan.

Between two chunks a piece may hang over by fewer characters than the longest piece has: that
overhang is the state at the boundary. A chunk is a matrix of best scores from the state it is
entered in to that in which it is left. Products of such matrices, with addition for products and
the maximum for sums, are associative: blocks of chunks are multiplied, then blocks of blocks, and
handed down again the products give each chunk the scores of the states it is entered in. With these
a chunk finds, for each state in which it may be left, the one in which the best path enters it.
Such maps are composed from the end of the document in the same way, which tells each chunk its own
end of the best path, and it is traced back independently of the others.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.common import short_batches, stored
from phrasewell.llm.unigram import Vocabulary, best_path

#: Characters of a chunk. A longer document is encoded in chunks of this length.
CHUNK = 65_536

#: Chunks, or blocks of them, that are combined by one task.
BLOCK = 64

MEMO = 250_000
_LOW = float("-inf")


class Encoder:
    """Encodes texts with a vocabulary; words that have been encoded are remembered as bytes of ids."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        if not self.vocabulary.bytes:
            raise ValueError("a vocabulary without bytes cannot be decoded again")
        self.memo: dict[str, tuple[bytes, float]] = {}

    def word(self, word: str) -> tuple[bytes, float]:
        """Ids and score of a part that other parts do not depend on."""
        found = self.memo.get(word)
        if found is None:
            best, back, piece = best_path(self.vocabulary, word)
            found = array("i", self._ids(word, back, piece, len(word))).tobytes(), best[-1]
            if len(self.memo) > MEMO:
                self.memo.clear()
            if len(word) < 64:
                self.memo[word] = found
        return found

    def _ids(self, text: str, back: list[int], piece: list[int], at: int) -> list[int]:
        """Ids of the path that ends at ``at``, from where it begins."""
        ids: list[int] = []
        while back[at] >= 0:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids += reversed(self.vocabulary.ids_of(-1, text[back[at] : at]))
            at = back[at]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        v = self.vocabulary
        return np.frombuffer(b"".join([self.word(w)[0] for w in v.words(v.normalized(text))]), "<i4")

    # A chunk is given as a window: its own ``size`` characters and those a piece may hang over.

    def matrix(self, window: str, size: int, states: int) -> np.ndarray:
        """Best scores from each state of entry to each state of exit; pieces begin within the chunk.

        Paths to ends at which all scores are known meet; a word that follows on such an end moves
        every score by the same number, so only the first and the last word need a score per entry.
        """
        v = self.vocabulary
        cuts = [i for i in range(states - 1, size) if window[i] == "▁" and window[i - 1] != "▁"] if v.words_apart and states > 1 else []
        if cuts and cuts[0] >= states - 1:
            first, last = cuts[0], cuts[-1]
            head = self._scores(window[:first], first, states, 0)[:, 0]
            middle = sum(self.word(w)[1] for w in v.words(window[first:last]))
            tail = self._scores(window[last:], size - last, 1, states)[0]
            return head[:, None] + middle + tail[None, :]
        return self._scores(window, size, states, states)

    def _scores(self, window: str, size: int, entries: int, exits: int) -> np.ndarray:
        """Scores from the first ``entries`` positions to position ``size`` and the ``exits - 1`` after it."""
        n = len(window)
        best = np.full((n + 1, entries), _LOW)
        for t in range(min(entries, n + 1)):
            best[t, t] = 0.0
        for end, begin, score, _ in self.vocabulary.edges(window):
            if begin < size:
                np.maximum(best[end], best[begin] + score, out=best[end])
        out = np.full((entries, max(1, exits)), _LOW)
        for u in range(max(1, exits)):
            # What hangs over ends beyond the chunk; entries that lie beyond it are exits themselves.
            if size + u <= n:
                out[:, u] = best[size + u]
        return out

    def _path(self, window: str, size: int, entry: np.ndarray) -> tuple[list[float], list[int], list[int]]:
        """Best paths from the states of entry, with their scores, to all positions; none begins beyond the chunk."""
        n = len(window)
        best, back, piece = [_LOW] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        for t, score in enumerate(entry.tolist()):
            if t <= n:
                best[t] = score
        for end, begin, score, p in self.vocabulary.edges(window):
            if begin < size and best[begin] + score > best[end]:
                best[end], back[end], piece[end] = best[begin] + score, begin, p
        return best, back, piece

    def entries(self, window: str, size: int, entry: np.ndarray) -> np.ndarray:
        """For each state of exit the state in which the best path to it enters; 0 where there is none."""
        best, back, _ = self._path(window, size, entry)
        out = np.zeros(len(entry), np.int32)
        for u in range(len(entry)):
            at = size + u
            if at <= len(window) and best[at] > _LOW:
                while back[at] >= 0:
                    at = back[at]
                out[u] = at
        return out

    def chunk_ids(self, window: str, size: int, entry: np.ndarray, leave: int) -> np.ndarray:
        _, back, piece = self._path(window, size, entry)
        return np.array(self._ids(window, back, piece, size + leave), np.int32)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _scan(items: DataFrame, count: int, combine: Callable, step: Callable, start: Callable) -> DataFrame:
    """Rows (doc, at, state): what each item is entered with, from rows (doc, at, item) in the order of ``at``.

    ``combine`` joins the items of a block, ``step`` takes a state past an item, and ``start`` gives
    the state of the first. Items are bytes. ``count`` is more than any ``at``. A task holds
    ``BLOCK`` items, however long a document is; levels grow with the logarithm of the length.
    """
    if count > BLOCK:

        def joined(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            whole = rows["item"].iloc[0]
            for item in rows["item"].iloc[1:]:
                whole = combine(whole, item)
            return pd.DataFrame({"doc": [rows["doc"].iloc[0]], "at": [rows["at"].iloc[0] // BLOCK], "item": [whole]})

        block = F.floor(F.col("at") / BLOCK)
        blocks = stored(items.groupBy("doc", block.alias("block")).applyInPandas(joined, "doc bigint, at bigint, item binary"), "blocks")
        entered = _scan(blocks, -(-count // BLOCK), combine, step, start)
        items = items.join(entered.withColumnRenamed("at", "block"), (block == F.col("block")) & (items["doc"] == entered["doc"])).select(
            items["doc"], "at", "item", "state"
        )
    else:
        items = items.withColumn("state", F.lit(None).cast("binary"))

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        state = rows["state"].iloc[0]
        state = start() if state is None else state
        out = []
        for item in rows["item"]:
            out.append(state)
            state = step(state, item)
        return pd.DataFrame({"doc": rows["doc"], "at": rows["at"], "state": out})

    block = F.floor(F.col("at") / BLOCK).alias("block")
    return items.groupBy("doc", block).applyInPandas(along, "doc bigint, at bigint, state binary")


def _giant(texts: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """Rows (doc, ids) from rows (doc, text), all by way of chunks of ``chunk`` characters."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    states = Vocabulary(model).longest  # a piece hangs over by less than its length
    ready: list[Encoder] = []

    def encoder() -> Encoder:
        if not ready:
            ready.append(Encoder(shared.value))
        return ready[0]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                normal = encoder().vocabulary.normalized(text.as_py())
                n = len(normal)
                for i, at in enumerate(range(0, n, chunk)):
                    row = {"doc": [doc], "at": [i], "size": [min(chunk, n - at)], "chunks": [-(-n // chunk)], "window": [normal[at : at + chunk + states - 1]]}
                    kinds = zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))
                    yield pa.RecordBatch.from_pydict(row, pa.schema(list(kinds)))

    # Chunks are spread, whichever document they are of.
    made = texts.mapInArrow(windows, "doc bigint, at bigint, size int, chunks bigint, window string")
    cut = stored(made.repartition("doc", "at"), "chunks")
    count = cut.agg(F.max("chunks")).first()[0] or 0

    @F.arrow_udf("binary")
    def matrix(window: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([encoder().matrix(w.as_py(), s.as_py(), states).tobytes() for w, s in zip(window, size)], pa.binary())

    @F.arrow_udf("binary")
    def entries(window: pa.Array, size: pa.Array, state: pa.Array) -> pa.Array:
        return pa.array([encoder().entries(w.as_py(), s.as_py(), np.frombuffer(e.as_py())).tobytes() for w, s, e in zip(window, size, state)], pa.binary())

    @F.arrow_udf("array<int>")
    def ids(window: pa.Array, size: pa.Array, state: pa.Array, leave: pa.Array) -> pa.Array:
        rows = zip(window, size, state, leave)
        return pa.array([encoder().chunk_ids(w.as_py(), s.as_py(), np.frombuffer(e.as_py()), int.from_bytes(x.as_py(), "little")) for w, s, e, x in rows], pa.list_(pa.int32()))

    square = lambda raw: np.frombuffer(raw).reshape(states, states)
    matrices = stored(cut.select("doc", "at", matrix("window", "size").alias("item")), "matrices")
    entered = _scan(
        matrices,
        count,
        lambda a, b: max_plus(square(a), square(b)).tobytes(),
        lambda state, item: (np.frombuffer(state)[:, None] + square(item)).max(axis=0).tobytes(),
        lambda: np.array([0.0, *[_LOW] * (states - 1)]).tobytes(),
    )
    entered = stored(entered, "entered")
    known = stored(
        cut.join(entered, ["doc", "at"]).select("doc", "at", "chunks", "state", entries("window", "size", "state").alias("item")), "entries"
    )
    turned = known.select("doc", (F.col("chunks") - 1 - F.col("at")).alias("at"), "item")
    as_map = lambda raw: np.frombuffer(raw, np.int32)
    left = _scan(
        turned,
        count,
        lambda a, b: as_map(b)[as_map(a)].tobytes(),
        lambda state, item: int(as_map(item)[int.from_bytes(state, "little")]).to_bytes(4, "little"),
        lambda: (0).to_bytes(4, "little"),
    ).withColumnRenamed("state", "leave").withColumnRenamed("at", "turned")
    ends = known.join(left, (known["doc"] == left["doc"]) & (left["turned"] == F.col("chunks") - 1 - F.col("at")))
    ends = ends.select(known["doc"], "at", "state", "leave")
    parts = cut.join(ends, ["doc", "at"]).select("doc", "at", ids("window", "size", "state", "leave").alias("part"))
    # A document's ids are one value, as its text is.
    in_order = F.array_sort(F.collect_list(F.struct("at", "part")))
    return parts.groupBy("doc").agg(F.flatten(F.transform(in_order, lambda p: p["part"])).alias("ids"))


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (key, ids), one per row of ``docs``: the ids of each text, without begin or end marks.

    A null text has null ids, an empty one none. Texts of more than ``chunk`` characters are encoded
    in chunks, with the same result. Null and repeated keys and repeated rows keep a row each; other
    columns are not read. An empty table gives an empty result. Sums of scores are of double precision,
    and of equal ones the path with the longest last piece wins, wherever it crosses a chunk.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    ready: list[Encoder] = []

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Encoder(shared.value))
        found = [None if x.as_py() is None else ready[0].encode(x.as_py()) for x in texts]
        return pa.array(found, pa.list_(pa.int32()))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    is_giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    small = rows.where(~is_giant).select("key", ids("text").alias("ids"))
    giant = stored(rows.where(is_giant).withColumn("doc", F.monotonically_increasing_id()), "giant")
    encoded = _giant(giant.select("doc", "text"), model, chunk)
    return small.unionAll(giant.select("key", "doc").join(encoded, "doc").select("key", "ids")).withColumnRenamed("key", key)


def decoded(ids: Column, model: bytes, spark) -> Column:
    """The text of a column of ids: pieces joined, with spaces for U+2581 and without the one before the text."""
    shared = spark.sparkContext.broadcast(model)
    ready: list[Vocabulary] = []

    @F.arrow_udf("string")
    def of(all_ids: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Vocabulary(shared.value))
        return pa.array([None if x.as_py() is None else ready[0].decoded(x.values.to_numpy(zero_copy_only=False)) for x in all_ids], pa.string())

    return of(ids)


def summary(ids: Column, model: bytes, spark) -> Column:
    """What can be told of ids, as a struct: their number, their CRC-32 as little-endian 32-bit numbers, their text.

    One function, so that ids that are made by another one are made once. Nulls for null ids.
    """
    shared = spark.sparkContext.broadcast(model)
    ready: list[Vocabulary] = []

    @F.arrow_udf("struct<n_ids:bigint,ids_crc32:bigint,text:string>")
    def of(all_ids: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Vocabulary(shared.value))
        rows = []
        for x in all_ids:
            own = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
            rows.append((None, None, None) if own is None else (len(own), zlib.crc32(own.astype("<u4").tobytes()), ready[0].decoded(own)))
        columns = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["n_ids", "ids_crc32", "text"])

    return of(ids)


def there_and_back(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (key, ids, text): each text encoded and decoded again."""
    coded = encode(docs, model, key, text, chunk)
    return coded.select(key, "ids", decoded(F.col("ids"), model, docs.sparkSession).alias("text"))
