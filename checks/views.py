"""Test tables brought into the shape the operators work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from phrasewell.functions import fixed_values as fixed
from phrasewell.functions.vectors import doubles

CANDIDATES = 4
DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, i (0 is the query and the truth, 1 to 4 are its candidates), v."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("g"),
        (F.col("vec_id") % 5).alias("i"),
        doubles(F.col("embedding")).alias("v"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("i > 0")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("i = 0").select("g", F.col("v").alias("query_vector"))


def entity_queries(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """row_id, sparql: a query text per order, with ids that are prefixes of other ids; ``others`` of its columns follow."""
    c, p = F.col("o_custkey"), F.col("o_orderkey") % 25
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(
            F.lit("SELECT ?v WHERE { wd:Q"), c, F.lit(" wdt:P"), p, F.lit(" ?x . ?x p:P"), p,
            F.lit(" wd:Q"), F.expr("o_custkey div 10"), F.lit(" }"),
        ).alias("sparql"),
        *others,
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, description: customers without a label in the red, and some without description."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Q"), "c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("label"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("description"),
    )
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("P"), "n_nationkey"), "n_name", F.concat(F.lit("region "), "n_regionkey")
    )
    return customers.union(nations)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, query (first user turn), question (last one), and as candidates what the assistant said.

    There are none up to ``CANDIDATES`` of them, in the order of turns. User turns are folded to the
    two wanted ones before the shuffle, and of the assistant's only the first ones are ranked, so a
    long conversation is no burden.
    """
    said = table(spark, sf_dir, "conversations")
    folded = said.where("role = 'user'").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("query"), F.max_by("text", "turn").alias("question")
    )
    place = Window.partitionBy("conv_id").orderBy("turn")
    first = said.where("role = 'assistant'").withColumn("n", F.row_number().over(place)).where(F.col("n") <= CANDIDATES)
    given = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("given"))
    texts = F.coalesce(F.transform("given", lambda g: g["text"]), F.array().cast("array<string>"))
    return folded.join(given, "conv_id", "left").withColumn("candidates", texts).drop("given")


SHOTS = "Shown before: "
JUDGE_SHOTS = fixed.JUDGE_TASK + "\n"


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and two wordings of a question per conversation, each in one line."""

    def line(name: str) -> Column:
        return F.replace(name, F.lit("\n"), F.lit(" "))

    return triples(spark, sf_dir).select(
        F.col("conv_id").alias("row_id"),
        line("query").alias("question"),
        line("question").alias("paraphrased_question"),
        F.concat(F.lit("conversation "), "conv_id").alias("sparql_wikidata"),
        line("query").alias("wikidata_translated"),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("eval_manual"), (1 - F.col("toxic")).alias("eval_llm")
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, label."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, first, second, response: a text, the next one, and a mix of both."""
    from phrasewell.operators.ranges import with_next

    ringed = with_next(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", {"second": "text"}
    )
    own, other = F.split("text", " "), F.split("second", " ")
    tail = F.floor(F.size(other) * 0.2).cast("int")
    mixed = F.concat(
        F.slice(own, F.lit(1), F.floor(F.size(own) * 0.8).cast("int")),
        F.slice(other, F.size(other) - tail + 1, tail),
    )
    return ringed.select(
        "doc_id", F.col("text").alias("first"), "second", F.array_join(mixed, " ").alias("response")
    )


# Callables that stand in for models. They are closures, so that tasks get them by value.


def echo_generator() -> Callable:
    """Answers with a variant of the quoted query, chosen by the sample number.

    A prompt that asks to reflect is answered with the last answer and a question mark.
    """
    reflect = fixed.REFLECT
    user, assistant = fixed.USER_TURN, fixed.ASSISTANT_TURN
    indent = "\n" + fixed.REFINE_INDENT

    def factory() -> Callable:
        def answer(prompts: list[str], samples: list[int]) -> list[str]:
            made = []
            for prompt, sample in zip(prompts, samples):
                if reflect in prompt:
                    shown = prompt.rsplit(user, 1)[0]
                    made.append(shown.rsplit(assistant + indent, 1)[1] + "?")
                    continue
                query = prompt.rsplit("itself: '", 1)[1].rsplit("' " + assistant, 1)[0]
                variants = [query, query + " please", query.replace(" ", "x "), "what is " + query]
                made.append(variants[sample % 4])
            return made

        return answer

    return factory


def shot_generator(shots: str = SHOTS) -> Callable:
    """Answers a few-shot prompt with its query, some words put in."""

    def factory() -> Callable:
        def answer(prompts: list[str], samples: list[int]) -> list[str]:
            queries = [p.removeprefix(shots).removesuffix("assistant") for p in prompts]
            return [q.replace("e ", "e so ") for q in queries]

        return answer

    return factory


def shortest_critic() -> Callable:
    """Chooses the shortest candidate of a critique prompt, the first one on a tie."""

    def factory() -> Callable:
        import ast

        def answer(prompts: list[str], samples: list[int]) -> list[str]:
            made = []
            for prompt in prompts:
                listed = prompt.split("Translations: ", 1)[1].rsplit(", Query: ", 1)[0]
                made.append(min(ast.literal_eval(listed), key=len, default=""))
            return made

        return answer

    return factory


def length_judge() -> Callable:
    """Says yes if the lengths of the last two lines differ by less than a tenth."""
    assistant = fixed.ASSISTANT_TURN

    def factory() -> Callable:
        def answer(prompts: list[str], samples: list[int]) -> list[str]:
            made = []
            for prompt in prompts:
                reference, response = prompt.removesuffix(assistant).split("\n")[-2:]
                if len(response) % 7 == 0:
                    made.append("Maybe")
                elif abs(len(reference) - len(response)) * 10 < len(reference):
                    made.append("Yes.")
                else:
                    made.append("no")
            return made

        return answer

    return factory


def hashing_encoder(dims: int = DIMS) -> Callable:
    """Unit-length vectors of hashed token counts."""

    def factory() -> Callable:
        import hashlib

        import numpy as np

        def encode(texts: list[str]) -> list:
            made = []
            for text in texts:
                vector = np.zeros(dims)
                for token in text.split(" "):
                    vector[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dims] += 1
                made.append((vector / np.sqrt((vector * vector).sum())).tolist())
            return made

        return encode

    return factory
