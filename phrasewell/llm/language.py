"""Language identification with a string kernel.

Two texts are as alike as the n-grams of bytes that are present in both, of all lengths up to
``longest`` at once, over the geometric mean of what is present in each. One-versus-rest kernel ridge
regression on Nystroem landmarks learns from a bounded sample; as the kernel is a scalar product of
presence vectors, (P Z') a = P (Z' a), and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasewell.llm.common import BLOCK_BYTES, short_batches, stored

UNKNOWN = "und"
LONGEST = 3

#: Texts of the sample that the driver compares with the landmarks at a time.
BLOCK_ROWS = 64

#: Codes of the n-grams of up to three bytes: those of one length follow those of the length before.
_FIRST = (0, 1 << 8, (1 << 8) + (1 << 16))
CODES = (1 << 8) + (1 << 16) + (1 << 24)


@dataclass
class Model:
    """Languages, the codes of the n-grams that count, and a weight per n-gram and language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray


def _codes(data: bytes):
    """Codes of all n-grams of a text, in arrays of bounded size; neighbouring blocks overlap."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), BLOCK_BYTES):
        some = raw[at : at + BLOCK_BYTES + LONGEST - 1].astype(np.int32)
        yield some
        pairs = (some[:-1] << 8) | some[1:]
        yield pairs + _FIRST[1]
        yield ((pairs[:-1] << 8) | some[2:]) + _FIRST[2]


def _bytes(text: str) -> bytes:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split()).encode()


def _presence(texts, column_of: np.ndarray, width: int) -> np.ndarray:
    """A row per text: which of the n-grams with a column occur. Column ``width`` takes all others."""
    rows = np.zeros((len(texts), width + 1), np.bool_)
    for row, text in zip(rows, texts):
        for codes in _codes(_bytes(text)):
            row[column_of[codes]] = True
    return rows[:, :width]


def _columns(codes: np.ndarray) -> np.ndarray:
    """The column of each code, the number of columns where it has none."""
    column_of = np.full(CODES, len(codes), np.uint16 if len(codes) < 1 << 16 else np.int32)
    column_of[codes] = np.arange(len(codes))
    return column_of


def sample(docs: DataFrame, label: str, text: str, per_language: int, key: str) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, those whose keys have the smallest hashes.

    Only keys and labels are ranked, and of a language with many texts only hashes that are small
    enough for a few times as many; texts are read for the chosen keys alone, one per key and label.
    """
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 30)), "key")
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = known.select(F.col(key).alias("key"), F.col(label).alias("lang"), F.col(text).alias("text"))
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("size")))  # a row per language
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) * F.col("size") <= F.lit(4 * per_language << 30)
    few = rows.select("key", "lang").join(sizes, "lang").where(drawn).select("key", "lang").distinct()
    ranked = few.withColumn("n", F.row_number().over(order))
    chosen = ranked.where(F.col("n") <= per_language).select("key", "lang")
    return rows.join(F.broadcast(chosen), ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"])


def fit(
    docs: DataFrame,
    label: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    per_language: int = 400,
    landmarks: int = 64,
    vocabulary: int = 16_384,
    ridge: float = 1e-3,
) -> Model:
    """Learn from labelled texts: ``per_language`` of each language, of which ``landmarks`` are landmarks.

    The n-grams that count are the ``vocabulary`` that occur in most texts of the sample. Texts are
    taken apart on the executors; a bit per n-gram and text of the sample reaches the driver. Rows
    without text, label or key teach nothing. Without any the model knows no language.
    """
    texts = sample(docs, label, text, per_language, key)

    def count(batches):
        seen = np.zeros(CODES, np.int32)
        for batch in batches:
            for x in batch.column("text"):
                present = np.unique(np.concatenate([np.unique(c) for c in _codes(_bytes(x.as_py()))] or [np.empty(0, np.int32)]))
                seen[present] += 1
        codes = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(seen[codes], pa.int64())], ["code", "n"])

    texts = stored(texts, "sample").coalesce(8)
    counts = texts.select("text").mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "code").limit(vocabulary).collect()
    codes = np.array(sorted(r["code"] for r in top), np.int64)
    if not len(codes):
        return Model([], codes, np.zeros((0, 0), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def bits(batches):
        column_of = _columns(shared.value)
        for batch in batches:
            rows = _presence(batch.column("text").to_pylist(), column_of, len(shared.value))
            packed = [np.packbits(r).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("lang"), pa.array(packed, pa.binary())], ["key", "lang", "bits"])

    rows = sorted(tuple(r) for r in texts.select("key", "lang", "text").mapInArrow(bits, "key string, lang string, bits binary").collect())
    languages = sorted({lang for _, lang, _ in rows})
    present = np.unpackbits(np.frombuffer(b"".join(b for *_, b in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(codes))
    own = np.array([languages.index(lang) for _, lang, _ in rows])
    return Model(languages, codes, _ridge(present, own, len(languages), landmarks, ridge).astype(np.float32))


def _unit(present: np.ndarray) -> np.ndarray:
    return present / np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))


def _ridge(present: np.ndarray, own: np.ndarray, n: int, landmarks: int, ridge: float) -> np.ndarray:
    """Weights per n-gram: solves (K'K + ridge * rows * M) a = K'Y with K to the landmarks and M among them.

    Besides the landmarks a block of rows at a time is held in double precision.
    """
    picked = np.concatenate([np.flatnonzero(own == c)[:landmarks] for c in range(n)])
    points = _unit(present[picked])
    to = np.concatenate([_unit(present[at : at + BLOCK_ROWS]) @ points.T for at in range(0, len(own), BLOCK_ROWS)])
    among = points @ points.T
    targets = np.where(own[:, None] == np.arange(n)[None, :], 1.0, -1.0)
    # Each language weighs the same, however many texts of it there are.
    weight = (len(own) / (n * np.bincount(own, minlength=n)))[own][:, None]
    left = to.T @ (weight * to) + ridge * len(own) * among + 1e-9 * np.eye(len(picked))
    return points.T @ np.linalg.solve(left, to.T @ (weight * targets))


def predicted(text: Column, model: Model, spark, batch: int = 128) -> Column:
    """The language of a text and a score from 0 to 1, as a struct (lang, score).

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language. The
    score is that of the language with the largest regression value, of two the first by name: 0.5 on
    the boundary, 1 for what the training texts are like. The whole text counts, whatever its length.
    """
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    ready: dict[str, np.ndarray] = {}

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        m = shared.value
        if not ready:
            ready["columns"] = _columns(m.codes)
        langs, scores = [], []
        for at in range(0, len(texts), batch):
            some = [x or "" for x in texts.slice(at, batch).to_pylist()]
            known = [bool(m.languages) and any(c.isalpha() for c in x) for x in some]
            if m.languages:
                values = _unit(_presence(some, ready["columns"], len(m.codes)).astype(np.float32)) @ m.weights
                best = values.argmax(axis=1)
                score = np.clip((values[np.arange(len(some)), best] + 1) / 2, 0, 1).astype(float)
            for i, k in enumerate(known):
                langs.append(m.languages[best[i]] if k else UNKNOWN)
                scores.append(float(score[i]) if k else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return of(text)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text", **options) -> DataFrame:
    """Rows (key, held_out, lang_pred, score), one per row of ``docs``.

    Learns from the documents that are not held out and predicts all from their texts alone. A null
    key is not held out, but nothing is learned from it. Repeated rows get equal predictions; other
    columns are not read. An empty table gives an empty result.
    """
    out = held_out(F.col(key))
    model = fit(docs.where(~out), label, text, key, **options)
    found = docs.select(F.col(key), F.coalesce(out, F.lit(False)).alias("held_out"), predicted(F.col(text), model, docs.sparkSession).alias("p"))
    return found.select(key, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
