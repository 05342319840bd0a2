"""Near-duplicate texts: SimHash links by ball hashing, verified, then an exact join for all links beyond its radius.

Texts whose fingerprints are equal or within the radius (``simhash.linked``) are compared first, on their sets
of shingles; what these links connect is not compared again. At a similarity of 0.8 most pairs differ in more bits
than balls can hold, so what is left is told by a prefix-filter join, which misses no link.

In one order of all shingles, two sets with a Jaccard similarity of at least t share one of the first
``n - ceil(t * n) + 1`` shingles of each. So every text emits these, rare ones first, and what meets at
a shingle is compared on the whole sets. Each text is compared with the first one there and with the one
before; where that has not connected all that meet, all that is not connected yet is compared in pairs of
hashed blocks inside tasks. So the groups are those of all links, and no list of pairs is made. Parities
of the sets, which never differ in more bits than the sets in members, tell most unlike ones apart first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasewell.llm.common import free_name, stored
from phrasewell.llm.components import components
from phrasewell.llm.simhash import SEED, fingerprint, linked, shingles
from phrasewell.operators.lookup import lookup

#: Ids of rows that are sent to every task at most, 8 bytes each; more of them are joined by a shuffle.
SENT_ROWS = 4_000_000

#: One text in so many is read to learn which shingles are common, and how many of them are told to tasks.
#: They come last in the order of shingles; which ones are known changes the work, never the result.
SAMPLE, KNOWN = 16, 200_000

#: Texts and shingles of a block of texts that meet.
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 2_000_000

#: Longs of parities per set at least: what rules out most pairs before their sets are sent along.
SKETCH = 16


def text_shingles(data: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text in lower case, sorted."""
    parts = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in some], np.uint64) for some in shingles(data.lower(), words)]
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def parities(shingles_: np.ndarray) -> np.ndarray:
    """Parities of a set by its low bits, two per member or more; those of two sets differ in no more bits than the sets in members."""
    bits = 64 * SKETCH
    while bits < 2 * len(shingles_):
        bits *= 2
    odd = np.bincount(shingles_ & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


#: Rows (node, s) of the texts that rows (node) name.
Sets = Callable[[DataFrame], DataFrame]


def shingle_set_and_parities(text: Column, words: int, whole: bool = True) -> Column:
    """Struct of a text's set ``s``, its size ``n`` and its ``parities``; without ``whole`` the set is null."""
    longs = pa.list_(pa.int64())

    @F.arrow_udf("struct<s:array<bigint>,n:int,parities:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [text_shingles(x.as_py() or b"", words) for x in texts.cast(pa.binary())]
        parts = [pa.array(sets if whole else [None] * len(sets), longs), pa.array([len(s) for s in sets], pa.int32()), pa.array([parities(s) for s in sets], longs)]
        return pa.StructArray.from_arrays(parts, ["s", "n", "parities"])

    return of(text)


def most_apart(similarity: float) -> float:
    """Members that only one of two linked sets has, at most, as a share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def common_shingles(nodes: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, and their counts in a sample of texts, drawn by hashes from rows (node, body)."""
    some = nodes.where(F.pmod(F.xxhash64("body"), F.lit(SAMPLE)) == 0).select(F.explode(shingle_set_and_parities(F.col("body"), words)["s"]).alias("s"))
    counted = stored(some.groupBy("s").agg(F.count("*").alias("n")).where("n >= 4"), "common")
    least, told = math.inf, 0
    for n, shingles_ in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        told += shingles_
        if told > KNOWN:
            break
        least = n
    found = counted.where(F.col("n") >= least).toArrow() if told else counted.limit(0).toArrow()
    values, counts = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def prefixes(nodes: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """Rows (node, n, key) from rows (node, body): the shingles by which a text meets others; without any, 0."""
    shared = nodes.sparkSession.sparkContext.broadcast(common)
    kind = pa.struct([("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n:int,keys:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        values, counts = shared.value
        out = []
        for x in texts.cast(pa.binary()):
            s = text_shingles(x.as_py() or b"", words)
            if not len(s):
                out.append({"n": 0, "keys": np.zeros(1, np.int64)})
                continue
            often = np.zeros(len(s), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                often = np.where(values[at] == s, counts[at], 0)
            out.append({"n": len(s), "keys": s[np.lexsort((s, often))[: prefix_size(len(s), similarity)]]})
        return pa.array(out, kind)

    return nodes.select("node", of(F.col("body")).alias("p")).select("node", "p.n", F.explode("p.keys").alias("key"))


def _by_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a table of ids: sent to every task if there are few, counted before, else shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, on, how)


def meetings(keys: DataFrame) -> DataFrame:
    """The rows (node, n, key) that meet others at their key, with the ``first`` one there and the ``last`` before.

    What meets is read in order and not held, however many share a key.
    """
    met = Window.partitionBy("key").orderBy("node")
    others = keys.select("node", "n", "key", F.first("node").over(met).alias("first"), F.lag("node").over(met).alias("last"), F.lead("node").over(met).alias("next"))
    return others.where("last is not null or next is not null").drop("next")


def simhash_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of rows (node, fingerprint) to be compared: each text with the first of its fingerprint, and first ones of linked fingerprints."""
    firsts = stored(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    same = lookup(nodes, firsts, "fingerprint", "inner").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = linked(firsts.select("fingerprint"), radius)
    one = near.join(firsts.select(F.col("fingerprint").alias("a"), F.col("first").alias("x")), "a")
    both = one.join(firsts.select(F.col("fingerprint").alias("b"), F.col("first").alias("y")), "b")
    return same.unionAll(both.select(F.least("x", "y"), F.greatest("x", "y")))


def still_apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) that no component, rows (node, component), holds both of."""
    for x in ("a", "b"):
        pairs = lookup(pairs, parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x)
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, whole: Sets) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least ``similarity``; two empty ones do.

    Of rows (node, n, parities), ``sets``, those that cannot be alike are told first; ``whole`` gives the sets of the others.
    """
    small = lambda x: sets.select(F.col("node").alias(x), F.struct("n", "parities").alias(f"p_{x}"))
    sketched = pairs.join(small("a"), "a").join(small("b"), "b")
    bits = F.aggregate(F.zip_with("p_a.parities", "p_b.parities", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, x: sum_ + x)
    bits = F.when(F.size("p_a.parities") == F.size("p_b.parities"), bits).otherwise(0)
    apart = F.greatest(bits, F.abs(F.col("p_a.n") - F.col("p_b.n")))
    pairs = stored(sketched.where(apart <= most_apart(similarity) * (F.col("p_a.n") + F.col("p_b.n"))).select("a", "b"), "candidates")
    sets = stored(whole(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()), "compared")
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    counted = both.select("a", "b", F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b"), F.size(F.array_intersect("s_a", "s_b")).alias("same"))
    return counted.where(F.col("same") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def unconnected(met: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, node, n, part, texts, shingles) of the keys where more than one part meets, with their sums.

    Of keys at which the same texts meet, which hashes tell, one is enough.
    """
    placed = met.select("key", "node", "n").join(parts.withColumnRenamed("component", "part"), "node", "left")
    placed = placed.withColumn("part", F.coalesce("part", "node"))
    summed = placed.groupBy("key").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("shingles"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    apart = summed.where("low < high").groupBy("texts", "shingles", "x", "y").agg(F.min("key").alias("key"))
    return placed.join(apart.select("key", "texts", "shingles"), "key")


def _links(node: np.ndarray, part: np.ndarray, side: np.ndarray, own: bool, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts that are not connected yet, nor by a link found before."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(ids) + 1, bool)
    _, part = np.unique(part, return_inverse=True)
    found = []
    for i in range(len(node)):
        # Of a block all later ones are compared, of two blocks those of the other one.
        open_ = part != part[i]
        open_ &= (np.arange(len(node)) > i) if own else (side > side[i])
        if not open_.any():
            continue
        mine = ids[ends[i] - sizes[i] : ends[i]]
        mark[mine] = True
        sums = np.concatenate(([0], np.cumsum(mark[ids])))
        mark[mine] = False
        same = sums[ends] - sums[ends - sizes]
        near = np.flatnonzero(open_ & (same >= similarity * (sizes + sizes[i] - same)))
        for j in near.tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                found.append((int(node[i]), int(node[j])))
    return found


def _folded(sketches: np.ndarray, longs: int) -> np.ndarray:
    """Rows of parities as if of ``longs`` longs, which are as many or fewer."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, longs), axis=1)


def _near(part: np.ndarray, side: np.ndarray, own: bool, n: np.ndarray, sketches: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether sizes and parities of a text allow a link with one that it is to be compared with."""
    near = np.zeros(len(n), bool)
    longs = np.array([len(x) for x in sketches])
    kinds = {k: np.flatnonzero(longs == k) for k in np.unique(longs).tolist()}
    whole = {k: np.stack([sketches[i] for i in at]) for k, at in kinds.items()}
    folds: dict[tuple[int, int], np.ndarray] = {}
    for i in range(len(n)):
        most = most_apart(similarity) * (n + n[i])
        open_ = (part != part[i]) & (np.abs(n - n[i]) <= most)
        open_ &= (np.arange(len(n)) > i) if own else (side > side[i])
        if not open_.any():
            continue
        for k, at in kinds.items():
            if not open_[at].any():
                continue
            least = min(k, int(longs[i]))
            if (k, least) not in folds:
                folds[k, least] = _folded(whole[k], least)
            bits = np.bitwise_count(folds[k, least] ^ _folded(sketches[i][None], least)).sum(axis=1, dtype=np.int64)
            open_[at] &= bits <= most[at]
        near |= open_
        near[i] |= open_.any()
    return near


def _by_group(finish):
    """Walk over rows sorted by group; ``finish`` takes the table of a block or of a pair of blocks when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = batch.column("group").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if last is not None and ids[i] != last:
                    yield from finish(pa.Table.from_batches(held))
                    held = []
                last = ids[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def _keep_near(similarity: float):
    def finish(rows: pa.Table) -> list[pa.RecordBatch]:
        cols = {c: rows[c].to_numpy() for c in ("part", "side", "n")}
        sketches = [x.values.to_numpy().view(np.uint64) for x in rows["parities"]]  # signed ones count as their absolute values
        near = _near(cols["part"], cols["side"], rows["own"][0].as_py(), cols["n"].astype(np.int64), sketches, similarity)
        return rows.select(["group", "own", "side", "node", "part"]).filter(pa.array(near)).combine_chunks().to_batches() if near.any() else []

    return _by_group(finish)


def _compare(similarity: float):
    def finish(rows: pa.Table) -> list[pa.RecordBatch]:
        sets = [x.values.to_numpy() for x in rows["s"]]
        links = _links(*(rows[c].to_numpy() for c in ("node", "part", "side")), rows["own"][0].as_py(), sets, similarity)
        return [pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])] if links else []

    return _by_group(finish)


def rest_of_links(rows: DataFrame, sets: DataFrame, similarity: float, block_texts: int = BLOCK_TEXTS, whole: Sets | None = None) -> DataFrame:
    """Links (a, b) that connect what ``unconnected`` rows leave apart and is alike: all of a key are compared.

    ``sets`` has rows (node, n, parities), and the set ``s`` too unless ``whole`` gives it.
    """
    whole = whole or (lambda ids: _by_ids(sets.select("node", "s"), ids, "node", "inner"))
    blocks = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("shingles") / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    numbered = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")),
    )
    sided = numbered.withColumn("m", F.explode(meets)).select(
        F.concat_ws(" ", F.col("key").cast("string"), F.col("m.i").cast("string"), F.col("m.j").cast("string")).alias("group"),
        (F.col("m.i") == F.col("m.j")).alias("own"),
        F.when(F.col("block") == F.col("m.i"), 0).otherwise(1).alias("side"),
        "node", "part",
    )
    together = lambda df: df.repartition("group").sortWithinPartitions("group")
    sketched = together(sided.join(sets.select("node", "n", "parities"), "node"))
    near = sketched.mapInArrow(_keep_near(similarity), "group string, own boolean, side int, node bigint, part bigint")
    near = stored(near, "near")
    full = together(near.join(whole(near.select("node").distinct()), "node"))
    return full.mapInArrow(_compare(similarity), "a bigint, b bigint")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``docs`` without the rows that near-duplicate one before them: of each group the smallest key stays.

    A group is what links of at least ``similarity`` (Jaccard, on distinct shingles of ``words`` words
    in lower case) connect. Equal texts are one node. Null keys come after all others, repeated keys
    and rows are told apart by their place in the stored copy, null texts count as empty, and empty
    ones are copies of each other. Columns may have any names. An empty table gives an empty one.

    Texts whose SimHash over the same shingles differs in at most ``radius`` bits are compared first; a pair that is alike is a
    link. All other links are found too, up to equal 64-bit hashes of unlike shingles, save those between texts that
    other links connect already. Texts are stored once; only rows that meet another are taken up again, and their
    sets are made once more for those that sizes and parities leave, instead of being stored for all.
    Ids of a popular text or group are joined with salts, or where they lie if the other side is measured to be small.
    """
    row, own = free_name(docs, "row"), docs.columns
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = stored(numbered.select(F.col(row).alias("row"), F.col(key).alias("key"), F.unhex(F.md5(body)).alias("digest"), fingerprint(body, words).alias("fingerprint")), "digests")
    nodes = stored(marked.groupBy("digest").agg(F.min("row").alias("node"), F.min("fingerprint").alias("fingerprint")), "texts")
    placed = stored(lookup(marked.select("row", "key", "digest"), nodes.select("digest", "node"), "digest", "inner").select("row", "key", "node"), "nodes")

    copies = placed.where("row != node").select(F.col("row").alias(row))
    texts = _by_ids(numbered.select(row, body.alias("body")), copies, row, "left_anti").select(F.col(row).alias("node"), "body")
    met = stored(meetings(prefixes(texts, common_shingles(texts, words), words, similarity)), "meetings")
    def shingled(ids: DataFrame, whole: bool) -> DataFrame:
        again = _by_ids(numbered.select(row, body.alias("body")), ids.select(F.col("node").alias(row)), row, "inner")
        return again.select(F.col(row).alias("node"), shingle_set_and_parities(F.col("body"), words, whole).alias("p"))

    def whole(ids: DataFrame) -> DataFrame:
        return shingled(ids, True).select("node", "p.s")

    sets = stored(shingled(met.select("node").distinct(), False).select("node", "p.n", "p.parities"), "parities")

    near = stored(verified(simhash_pairs(nodes.select("node", "fingerprint"), radius), sets, similarity, whole), "near")
    some = met.where("last is not null").select("node", F.explode(F.array("first", "last")).alias("other"))
    some = still_apart(some.select(F.col("other").alias("a"), F.col("node").alias("b")).distinct(), components(near))
    links = stored(verified(some, sets, similarity, whole).unionAll(near), "links")
    rest = stored(rest_of_links(unconnected(met, components(links)), sets, similarity, whole=whole), "rest")
    parts = components(links.unionAll(rest))

    grouped = stored(lookup(placed, parts, "node").withColumn("part", F.coalesce("component", "node")).select("row", "key", "part"), "parts")
    order = F.struct(F.col("key").isNull(), "key", "row")
    firsts = grouped.groupBy("part").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(firsts.select("part", F.col("first.row").alias("first")), "firsts")
    gone = lookup(grouped.select("row", "part"), first, "part", "inner").where("row != first").select(F.col("row").alias(row))
    return _by_ids(numbered, stored(gone, "gone"), row, "left_anti").select(*own)
