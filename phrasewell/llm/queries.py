"""The queries of the operators: each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasewell.llm import bloom_slices, language, licenses, near_vectors, packing, periodic_runs, quality, secrets, sentencepieces, simhash, sum_squares, token_counts, warc
from phrasewell.llm.common import stored, table


def pieces_model() -> bytes:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces_model())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("bigint").alias(f"n_{kind}")
    base = secrets.shown(secrets.of_kind(F.col("spans"), "assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"),
    )


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    component = F.col("component")
    return found.select("vec_id", "n_links", component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer, with_ids=False).drop("ids")


def op6_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pieces_model()
    own = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    coded = sentencepieces.encode(docs.withColumn("_own", own), model, key="_own")
    told = coded.select("_own", sentencepieces.summary(F.col("ids"), model, spark).alias("s"))
    same = F.xxhash64("s.text") == F.col("_own.hash")
    return told.select("_own.doc_id", "s.n_ids", "s.ids_crc32", same.alias("round_trip"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), F.col("component").alias("component_id"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(warc.archives(table(spark, sf_dir, "pages")), "archives")
    return warc.records(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_sum_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = sum_squares.pack(table(spark, sf_dir, "documents"), tokenizer, with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_slices.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    # The longest run, of these the first by start, then period.
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_first", first).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_first.s")).alias("start"), F.col("_first.l").alias("length"), (-F.col("_first.p")).alias("period"),
        F.expr("(1000 * _first.l) div (-_first.p)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_licenses": op2_licenses,
    "op3_secrets": op3_secrets,
    "op4_near_vectors": op4_near_vectors,
    "op5_packing": op5_packing,
    "op6_sentencepieces": op6_sentencepieces,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_sum_squares": op11_sum_squares,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
