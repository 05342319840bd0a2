"""Clean a corpus in stages; each stage is written as Parquet and read again as the next one's input.

Documents whose language is not told are rejected, then those of low quality; of near-duplicates one
stays; secrets are replaced in the texts; what is left is packed into sequences of tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasewell.llm import language, near_texts, packing, quality, secrets
from phrasewell.llm.common import passing_tables, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The least score of a language. One half is the boundary between a language and the others.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without a letter, nor those that are like no language learned.

    Learns from the labels of this stage's own documents; if there are none, all with a letter stay.
    Null texts are rejected, repeated rows get the same answer each; an empty table gives an empty one.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    found = docs.withColumn("_found", language.predicted(F.col("text"), model, spark))
    known = (F.col("_found.lang") != language.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE)
    lettered = F.col("text").rlike(r"\p{L}")
    return found.where(known if model.languages else F.coalesce(lettered, F.lit(False))).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than not.

    Null texts have no words and are rejected, repeated rows get the same answer each; an empty table gives an empty one.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; null ids come last.

    Fingerprints by SimHash that ball hashing links are compared first, and an exact join finds the links beyond its radius.
    Null texts count as empty, repeated rows are copies; an empty table gives an empty one.
    """
    return near_texts.keep_first(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets and n_chars counted anew where that was done.

    Null texts stay null, repeated rows are each replaced alike; an empty table gives an empty one.
    """
    found = secrets.scan(docs.select(*COLUMNS), out="_spans")
    clean = found.withColumn("_clean", secrets.redacted(F.col("text"), F.col("_spans")))
    changed = F.size("_spans") > 0
    return clean.select(
        "doc_id", F.col("_clean").alias("text"), "lang", "source",
        F.when(changed, F.length("_clean").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids and their places in sequences of 1024 tokens.

    Null texts count as empty, repeated rows are documents of their own; an empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", languages),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Neither learning nor dynamic programming is a matter of SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What a stage has read and stored is deleted once the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with passing_tables(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            kept = made.pop()
            made += before
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)
