"""Reading and writing text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERY_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("question", "paraphrased_question", "sparql_wikidata")]
)


def scan_pairs(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = QUERY_SCHEMA,
    multi_line: bool = True,
    position: str | None = None,
) -> DataFrame:
    """Headered, quoted CSV with a given schema; without one the types are read off the data.

    ``multi_line`` allows line breaks inside quotes, as such tables have them, at the price that a
    file is read by one task; turn it off for large files without them. ``position`` adds the place
    of each row: file, start of the block in the file, and row. Places compare in the order of file
    paths and of the rows in a file, whatever files a task reads and in whatever order.
    """
    reader = spark.read.option("inferSchema", True) if schema is None else spark.read.schema(schema)
    table = (
        reader.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    if position is None:
        return table
    # Within a block a task reads rows in order, so ids that grow within a task order them.
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return table.select("*", place.alias(position))


def union_splits(*splits: DataFrame, number: str | None = None) -> DataFrame:
    """All splits as one table. ``number`` adds the place of the split, counted from 0; else it is dropped."""
    if number is not None:
        splits = tuple(s.withColumn(number, F.lit(i)) for i, s in enumerate(splits))
    return reduce(DataFrame.unionByName, splits)


def write_results(
    df: DataFrame, path: str, run_id: str | None = None, form: str = "parquet"
) -> None:
    """Overwrite a table; with ``run_id`` only the folder of that run."""
    out = df if run_id is None else df.withColumn("run_id", F.lit(run_id))
    writer = out.write.mode("overwrite").format(form)
    if form == "csv":
        writer = (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    if run_id is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    writer.save(path)


def nested_documents(assessed: DataFrame, key: str = "query_id") -> DataFrame:
    """One document per query from assessed rows: vectors, candidates in order, winners."""
    return assessed.select(
        key,
        F.col("query_vector").alias("q_embedding"),
        F.col("truth_vector").alias("NL_gt_embedding"),
        F.transform("candidates", lambda c: c["text_vector"]).alias("NL_embeddings"),
        F.transform("candidates", lambda c: c["query_space"]).alias("NL_embeddings_q_model"),
        F.transform("candidates", lambda c: c["text"]).alias("translations"),
        "best_translation_Q",
        "best_translation_embedding_Q",
        "best_translation_dist",
        "best_translation_embedding_dist",
        "best_translation_llm_critique",
        "best_translation_embedding_llm_critique",
    )


def write_nested(documents: DataFrame, path: str) -> None:
    """Nested documents as JSON, one line each."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def threshold_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored limit: text with one number, as a table of one row."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.trim("value").cast("double").alias("threshold")
    )


def write_threshold(df: DataFrame, path: str) -> None:
    df.select(F.col("threshold").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)
