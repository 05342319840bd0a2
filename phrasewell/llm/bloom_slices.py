"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are kept in blocks. A block is a matrix of bits with a column per document; a term that a
document holds sets a few bits of its column, and for each step of its number of occurrences a few
more. The rows of a term at a step, taken together bit by bit, tell which documents of the block
have it that often; they may name too many documents and never too few. So a query's terms give each
document an upper bound of its score. Only documents whose bound reaches the scores already found
are scored exactly, from their texts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from phrasewell.session import new_path

#: Numbers of occurrences that a signature tells apart; a document's length bounds the largest.
STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 26, 32, 44, 64, 96, 128, 192, 256, 512, 1024, 4096], np.int64)
#: Bits per entry of the fullest signature of a class, and bits that an entry sets.
BITS, HASHES = 12, 8
#: Rows of a matrix. Beyond, signatures are fuller and bounds looser, but nothing is lost.
MOST_ROWS = 1 << 22
#: What ends a block. A longer document has a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: Queries that are answered in one pass over the blocks, by their number and by their terms.
QUERIES, QUERY_TERMS = 2000, 100_000

BLOCK = "block bigint, rows int, keys array<bigint>, lengths array<bigint>, bits binary, texts array<string>"

# Fixed value: bytes that are part of a term; all others separate terms.
_TERM_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(range(0x80, 0x100))
_LOWERED = bytes((ord(chr(b).lower()) if b < 0x80 else b) if b in _TERM_BYTES else 0x20 for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters; only A-Z is lower-cased."""
    return data.translate(_LOWERED).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damping(length, n_docs: int, n_terms: int):
    """m of documents of that many terms."""
    return 25 + (75 * length * n_docs) // n_terms


def _bit_rows(hashes: np.ndarray, step: int, rows: int) -> np.ndarray:
    """The rows that each term sets at a step."""
    with np.errstate(over="ignore"):
        mixed = (hashes + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(rows)).astype(np.int64)


# The index


class _Hashes(dict):
    """64-bit hashes of terms, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        found = self[term] = xxhash.xxh3_64_intdigest(term)
        return found


def _rows_of(entries: int) -> tuple[int, int]:
    """Class and rows of the signatures of documents with that many entries."""
    kind = max(5, (max(1, entries) - 1).bit_length())
    return kind, min(BITS << kind, MOST_ROWS)


def _block(rows: int, docs: list[tuple]) -> dict:
    keys, texts, lengths, hashes, times = zip(*docs)
    bits = np.zeros((rows, -(-len(docs) // 8) * 8), bool)
    at = np.repeat(np.arange(len(docs)), [len(h) for h in hashes])
    hashed, often = np.concatenate(hashes), np.concatenate(times)
    for step, least in enumerate(STEPS):
        there = often >= least
        at, hashed, often = at[there], hashed[there], often[there]
        bits.reshape(-1)[_bit_rows(hashed, step, rows) * bits.shape[1] + at[:, None]] = True
    number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    return {"block": number, "rows": rows, "keys": list(keys), "lengths": list(lengths), "bits": np.packbits(bits, axis=1).tobytes(), "texts": list(texts)}


_ARROW_BLOCK = pa.schema(
    [("block", pa.int64()), ("rows", pa.int32()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()), ("texts", pa.list_(pa.string()))]
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, made = _Hashes(), 0
    open_ones: dict[tuple[int, int], tuple[list[tuple], int]] = {}

    def closed(kind: tuple[int, int]) -> pa.RecordBatch:
        nonlocal made
        block = _block(kind[1], open_ones.pop(kind)[0])
        block["block"] += made
        made += 1
        return pa.RecordBatch.from_pylist([block], _ARROW_BLOCK)

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            data = text.cast(pa.binary()).as_py() or b""
            counts = Counter(terms(data))
            own = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            kind = _rows_of(int(np.searchsorted(STEPS, times, side="right").sum()))
            docs, size = open_ones.get(kind, ([], 0))
            if docs and size + len(data) > BLOCK_BYTES:
                yield closed(kind)
                docs, size = [], 0
            docs.append((key.as_py(), text.as_py(), int(times.sum()), own, times))
            open_ones[kind] = docs, size + len(data)
            if len(docs) >= BLOCK_DOCS:
                yield closed(kind)
    for kind in list(open_ones):
        yield closed(kind)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the blocks of all documents to the shared folder and give them as a table.

    Documents of like numbers of entries share a block, so signatures are as wide as they need to be.
    Each task makes blocks of what it reads; it holds one open block of at most ``BLOCK_BYTES`` of
    text, or one document, per class, of which there are about twenty.
    """
    path = new_path(docs.sparkSession, "slices")
    made = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(_blocks, BLOCK)
    # Row groups are small, since readers hold one at a time.
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


# Queries


@dataclass
class Plan:
    """Queries over one index: distinct terms, their weights, and which ones each query holds."""

    names: list[bytes]
    weights: np.ndarray
    lists: list[tuple[np.ndarray, np.ndarray]]  # places of the distinct terms, and how often each
    n_docs: int
    n_terms: int

    def __post_init__(self) -> None:
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.names], np.uint64)

    def bounds(self, rows: int, lengths: np.ndarray, bits: bytes) -> np.ndarray:
        """Upper bounds of the scores of each query (rows) in each document of a block (columns)."""
        n = len(lengths)
        matrix = np.frombuffer(bits, np.uint8).reshape(rows, -1)
        reached = np.zeros((len(self.names), n), np.int8)
        active = np.arange(len(self.names))
        for step in range(len(STEPS)):
            met = np.bitwise_and.reduce(matrix[_bit_rows(self.hashes[active], step, rows)], axis=1)
            some = met.any(axis=1)
            active, met = active[some], met[some]
            if not len(active):
                break
            there = np.unpackbits(met, axis=1)[:, :n].astype(bool) & (reached[active] == step)
            reached[active] += there
        # Reaching a step and not the next one bounds the occurrences from above.
        most = np.append(STEPS - 1, np.iinfo(np.int32).max)[:, None]
        times = np.minimum(most, lengths[None, :])
        m = damping(lengths, self.n_docs, self.n_terms)
        worth = (1_000_000_000 * times) // (1000 * times + 8 * m[None, :])
        seen = np.flatnonzero(reached.any(axis=1))
        place = np.full(len(self.names), -1)
        place[seen] = np.arange(len(seen))
        parts = self.weights[seen, None] * worth[reached[seen], np.arange(n)[None, :]]
        out = np.zeros((len(self.lists), n), np.int64)
        for q, (which, times_each) in enumerate(self.lists):
            held = place[which]
            own = held >= 0
            if own.any():
                out[q] = (parts[held[own]] * times_each[own, None]).sum(axis=0)
        return out

    def score(self, q: int, counts: Counter, length: int) -> int:
        m, found = damping(length, self.n_docs, self.n_terms), 0
        for t, times_each in zip(*map(np.ndarray.tolist, self.lists[q])):
            tf = counts.get(self.names[t], 0)
            if tf:
                found += times_each * int(self.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return found


def document_counts(docs: DataFrame, text: str, names: list[bytes]) -> Counter:
    """How many documents hold each of the named terms; counted in the tasks, so a count per term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(names))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                counts.update(shared.value.intersection(terms(value.as_py() or b"")))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    # As many rows as the terms asked for at most, which QUERY_TERMS bounds.
    return Counter({bytes(r["term"]): r["n"] for r in counted.collect()})


def _best_bounds(plan, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(plan.value.lists)
        top = np.zeros((n, 0), np.int64)
        where = np.zeros((2, n, 0), np.int64)
        for batch in batches:
            for block, rows, lengths, bits in zip(*(batch.column(c) for c in ("block", "rows", "lengths", "bits"))):
                lengths = lengths.values.to_numpy()
                found = plan.value.bounds(rows.as_py(), lengths, bits.as_py())
                at = np.stack([np.full(found.shape, block.as_py()), np.broadcast_to(np.arange(len(lengths)), found.shape)])
                top, where = np.concatenate([top, found], axis=1), np.concatenate([where, at], axis=2)
                if top.shape[1] > k:
                    best = np.argpartition(-top, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, best, axis=1)
                    where = np.take_along_axis(where, best[None], axis=2)
        some = np.nonzero(top > 0)
        yield pa.RecordBatch.from_pydict({"query": some[0], "bound": top[some], "block": where[0][some], "at": where[1][some]})

    return run


def _chosen_scores(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, scores = [], []
            for wanted, lengths, texts in zip(*(batch.column(c) for c in ("wanted", "lengths", "texts"))):
                known: dict[int, Counter] = {}
                for pair in wanted.as_py():
                    at = pair["at"]
                    if at not in known:
                        known[at] = Counter(terms(texts.values[at].cast(pa.binary()).as_py() or b""))
                    queries.append(pair["query"])
                    scores.append(plan.value.score(pair["query"], known[at], lengths.values[at].as_py()))
            yield pa.RecordBatch.from_pydict({"query": pa.array(queries, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


_LAST = 1 << 63  # where a missing key comes among equal scores


def _exact(plan, least, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = np.maximum(1, least.value)
        heaps: list[list[tuple[int, int]]] = [[] for _ in plan.value.lists]
        for batch in batches:
            for rows, keys, lengths, bits, texts in zip(*(batch.column(c) for c in ("rows", "keys", "lengths", "bits", "texts"))):
                lengths = lengths.values.to_numpy()
                reach = plan.value.bounds(rows.as_py(), lengths, bits.as_py()) >= limits[:, None]
                for at in np.flatnonzero(reach.any(axis=0)).tolist():
                    counts = Counter(terms(texts.values[at].cast(pa.binary()).as_py() or b""))
                    key = keys.values[at].as_py()
                    for q in np.flatnonzero(reach[:, at]).tolist():
                        score = plan.value.score(q, counts, int(lengths[at]))
                        if score < limits[q]:
                            continue
                        entry = (score, -(_LAST if key is None else key))
                        if len(heaps[q]) < k:
                            heapq.heappush(heaps[q], entry)
                        elif entry > heaps[q][0]:
                            heapq.heapreplace(heaps[q], entry)
                        if len(heaps[q]) == k:
                            limits[q] = max(limits[q], heaps[q][0][0])
        rows = [(q, None if b == -_LAST else -b, s) for q, heap in enumerate(heaps) for s, b in heap]
        query, key, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "key": pa.array(key, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _answers(docs: DataFrame, index: DataFrame, text: str, queries: list[Counter], totals: tuple[int, int], k: int) -> DataFrame:
    """Rows (query, key, score): at least the ``k`` best documents of each query."""
    context = docs.sparkSession.sparkContext
    names = sorted(set().union(*queries))
    place = {t: i for i, t in enumerate(names)}
    found = document_counts(docs, text, names)
    lists = [(np.array([place[t] for t in q], np.int64), np.array(list(q.values()), np.int64)) for q in queries]
    plan = context.broadcast(Plan(names, np.array([weight(totals[0], found[t]) for t in names], np.int64), lists, *totals))

    # A first threshold: the exact scores of the documents with the best bounds.
    rank = Window.partitionBy("query").orderBy(F.desc("bound"), "block", "at")
    bounds = index.select("block", "rows", "lengths", "bits").mapInArrow(_best_bounds(plan, k), "query bigint, bound bigint, block bigint, at bigint")
    top = bounds.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    wanted = top.groupBy("block").agg(F.collect_list(F.struct("query", "at")).alias("wanted"))
    # At most k rows per query, so both the broadcast and what is collected are bounded by the queries of a pass.
    scored = index.select("block", "lengths", "texts").join(F.broadcast(wanted), "block").select("wanted", "lengths", "texts")
    scores = defaultdict(list)
    for r in scored.mapInArrow(_chosen_scores(plan), "query bigint, score bigint").collect():
        scores[r["query"]].append(r["score"])
    least = [sorted(scores[q])[-k] if len(scores[q]) >= k else 0 for q in range(len(queries))]
    limits = context.broadcast(np.array(least, np.int64))
    return index.select("rows", "keys", "lengths", "bits", "texts").mapInArrow(_exact(plan, limits, k), "query bigint, key bigint, score bigint")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    query_key: str = "item_id",
    query_text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """Rows (query_key, rank, key, score): the ``k`` best documents of each query with a score above 0.

    Terms and scores are those of the formula in whole numbers: a term's weight falls with the
    documents that hold it, its occurrences count less and less, the more so in long documents.
    Equal scores are ordered by key, null keys last. Null and empty texts hold no term: such
    documents are never found, and such queries have no row. Repeated rows and keys are documents
    of their own; a key that several queries share gets the rows of each. Other columns are not
    read. Without documents or queries the result is empty. ``index`` is that of ``build_index``
    for the same documents, for use by many searches.

    Queries come to the driver in passes of at most ``QUERIES`` rows and ``QUERY_TERMS`` terms (a
    longer query has a pass of its own), and each pass reads the blocks three times, the texts in
    them only where a bound is reached. A task passes on ``k`` rows per query. Nothing of a size that
    grows with the documents is shuffled, broadcast or collected.
    """
    spark = docs.sparkSession
    index = build_index(docs, key, text) if index is None else index
    length = F.explode("lengths").alias("n")
    n_docs, n_terms = index.select(length).agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = f"_query bigint, `{query_key}` {queries.schema[query_key].dataType.simpleString()}"
    held: list[Counter] = []
    names: list[tuple] = []
    passes: list[DataFrame] = []

    def turn(held: list[Counter], names: list[tuple]) -> None:
        if held and n_terms:
            found = _answers(docs, index, text, held, (n_docs, n_terms), k)
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
            best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            passes.append(best.join(F.broadcast(spark.createDataFrame(names, kinds)), F.col("query") == F.col("_query")))

    for row in queries.select(F.col(query_key).alias("key"), F.col(query_text).cast("string").alias("text")).toLocalIterator():
        own = Counter(terms((row["text"] or "").encode()))
        if not own:
            continue
        if held and (len(held) >= QUERIES or sum(map(len, held)) + len(own) > QUERY_TERMS):
            turn(held, names)
            held, names = [], []
        names.append((len(held), row["key"]))
        held.append(own)
    turn(held, names)
    if not passes:
        return spark.createDataFrame([], f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, rank int, `{key}` bigint, score bigint")
    whole = passes[0]
    for more in passes[1:]:
        whole = whole.unionByName(more)
    return whole.select(F.col(query_key), "rank", F.col("key").alias(key), "score")
