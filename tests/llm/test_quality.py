import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phrasewell.llm import quality

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    n, repeated = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n)


def compare(rows, texts):
    """Rows and texts in the same order of keys."""
    for r, t in zip(rows, texts):
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain(t), (t or "")[:200]
        assert not (r.base_failed and r.kept)


def test_query_agrees_with_plain_counts(spark):
    from phrasewell.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    compare(rows, [texts[r.doc_id] for r in rows])


def test_labelled_documents(spark):
    got = {r.doc_id: r for r in quality.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    bad = [not got[r.doc_id].kept for r in labels if r.quality == 0]
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(bad) / len(bad) > 0.95 and sum(good) / len(good) > 0.99


def test_odd_rows_and_repeats(spark, odd_docs, no_docs):
    rng = random.Random(1)
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e f", " ".join(rng.choice("ab") for _ in range(400)), "x\n\nx\r\nx\n x", "é#*$%&|<>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    compare(quality.assess(df).orderBy("doc_id").collect(), texts)
    odd = odd_docs.withColumn("n_words", F.lit("clash"))
    assert quality.assess(odd).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 2
    assert quality.assess(no_docs).collect() == []


def test_expectation_maximisation_finds_who_is_right():
    """Votes drawn from known accuracies: estimates come close, and the posterior is Bayes' rule."""
    rng = random.Random(5)
    accuracy = [0.95, 0.9, 0.85, 0.6, 0.8]
    counts = Counter()
    for _ in range(30_000):
        good = rng.random() < 0.8
        counts[tuple((1 if good == (rng.random() < a) else -1) if rng.random() < 0.8 else 0 for a in accuracy)] += 1
    model = quality.fit(counts.items())
    assert abs(model["prior"] - 0.8) < 0.03
    for r, a in enumerate(accuracy):
        assert abs(model["table"][r][1][1] - a) < 0.03 and abs(model["table"][r][0][-1] - a) < 0.05
    assert quality.posterior((1,) * 5, model) > 0.99 and quality.posterior((-1,) * 5, model) < 0.01


def test_no_python_on_executors(spark):
    with_plan = quality.measures(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    plan = with_plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_one_bad_vote_is_no_veto():
    """Rules that never erred on good documents, as in a clean corpus, and bad ones with two bad votes each."""
    rules = len(quality.RULES)
    vote = lambda *bad: tuple(-1 if r in bad else 1 for r in range(rules))
    model = quality.fit([(vote(), 9000), *((vote(r, (r + 1) % rules), 150) for r in range(rules))])
    for r in range(rules):
        assert quality.posterior(vote(r), model) > 0.5 > quality.posterior(vote(r, (r + 1) % rules), model)


def test_clean_documents_of_other_languages_are_kept(spark):
    polish = "Wczoraj wieczorem poszliśmy całą rodziną nad rzekę, żeby obejrzeć zachód słońca, który był wyjątkowo piękny. Później wróciliśmy spacerem przez stary park, gdzie kwitły lipy, a dzieci bawiły się jeszcze długo przy fontannie, zanim zrobiło się chłodno."
    russian = "Вчера вечером мы всей семьёй пошли на реку смотреть закат, который был удивительно красивым. Потом мы вернулись через старый парк, где цвели липы, а дети ещё долго играли у фонтана, пока не стало прохладно и все не захотели домой."
    goods = "wheat barley timber iron copper wool linen salt coal glass paper leather sugar coffee tobacco cotton rice oats honey wax oil wine butter cheese rope sailcloth bricks slate marble tin".split()
    numbers = "Goods that came in by the river: " + ", ".join(f"{w} in {1900 + i} of {i * 37 + 5} tons" for i, w in enumerate(goods))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    added = spark.createDataFrame([(-1, polish), (-2, russian), (-3, numbers)], docs.schema)
    got = {r.doc_id: r for r in quality.assess(docs.unionAll(added)).where("doc_id < 0").collect()}
    assert got[-1].vote_common == got[-2].vote_common == 0
    assert got[-3].vote_plain == -1 and all(r.kept for r in got.values())


def test_a_fault_that_two_rules_see_counts_once():
    """Two rules whose bad votes always fall together weigh like one; the estimate of a rule that errs alone is its own."""
    rules = len(quality.RULES)
    vote = lambda *bad: tuple(-1 if r in bad else 1 for r in range(rules))
    model = quality.fit([(vote(), 9000), (vote(1, 2, 6), 600), (vote(1, 2), 60), (vote(3, 5, 7), 600), (vote(4, 0), 100), (vote(4), 400)])
    assert model["shared"][1][2] > 0.95 and model["shared"][1][3] == 0
    plain = {k: model[k] for k in ("prior", "table")}
    assert quality.posterior(vote(1, 2), plain) < quality.posterior(vote(1, 2), model)
    assert quality.posterior(vote(4), model) > 0.5
    wrong = [t[1][-1] for t in model["table"]]
    assert wrong[4] > 0.03 and max(wrong[:4] + wrong[5:]) < 0.03


def test_probability_in_columns_is_the_posterior(spark):
    got = quality.assess(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    names = [f"vote_{r}" for r in quality.RULES]
    rows = got.groupBy(*names, "probability").count().collect()
    counts = Counter()
    for r in rows:
        counts[tuple(r[n] for n in names)] += r["count"]
    model = quality.fit(sorted(counts.items()))
    for r in rows:
        assert abs(quality.posterior(tuple(r[n] for n in names), model) - r.probability) < 1e-9


def test_clean_code_is_kept(spark):
    java = """package org.example.tools;
import java.util.List;

/* Sums what is asked for. */
public class Adder {
    private final List<Integer> parts;

    public Adder(List<Integer> given) {
        this.parts = given;
    }

    public int total() {
        int sum = 0;
        for (int part : parts) {
            if (part % 2 == 0 && part > 10 || part < -3) {
                sum += part * 3;
            }
        }
        return sum;
    }
}
"""
    python = """import os
from collections import Counter

# How often each ending of a file name occurs.
def endings(folder):
    found = Counter()
    for name in os.listdir(folder):
        found[name.rpartition(".")[2]] += 1
    return found

if __name__ == "__main__":
    for ending, n in endings(".").most_common(5):
        print("%s: %d" % (ending, n))
"""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    added = spark.createDataFrame([(-1, java), (-2, python)], docs.schema)
    got = {r.doc_id: r for r in quality.assess(docs.unionAll(added)).where("doc_id < 0").collect()}
    assert all(r.kept and r.vote_symbols == r.vote_plain == r.vote_common == 0 for r in got.values())
