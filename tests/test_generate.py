from pyspark.sql import functions as F

from checks import views
from phrasewell.functions import fixed_values as fixed, text as X
from phrasewell.operators import generate as G, prompts as M


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).collect()[0].x


def test_lists_print_like_python(spark):
    items = ["plain", "it's", 'both \' and "', "back\\slash", "line\nbreak\tand tab"]
    column = F.array(*[F.lit(i) for i in items])
    assert value(spark, X.list_text(column)) == str(items)
    assert value(spark, X.list_text(F.array().cast("array<string>"))) == "[]"


def test_response_bodies(spark):
    body = '{"response":"a \\"b\\"","done":false}\n\nno marker\n{"response":" c","done":true}'
    assert value(spark, X.response_text(F.lit(body))) == 'a \\"b\\" c'
    assert value(spark, X.response_text(F.lit(body), unescape=True)) == 'a "b" c'
    assert value(spark, X.response_text(F.lit(""))) == ""


def test_first_prompt_reads_as_wanted(spark):
    prompt = value(spark, M.translate_prompt(F.lit("Q {x}"), F.array(F.lit("d"))))
    lines = prompt.split("\n" + fixed.FIRST_INDENT)
    assert lines[0] == "<|begin_of_text|><|start_header_id|>system<|end_header_id|>"
    assert lines[4].endswith("remember it when translating: ['d']")
    assert lines[-1] == fixed.TASK + "'Q {x}' <|eot_id|><|start_header_id|>assistant<|end_header_id|>"
    assert len(lines) == 8


def test_verdicts(spark):
    df = spark.createDataFrame([("Yes.",), ("no",), ("Maybe",), ("",), ("YES it is",), (None,)], "r string")
    got = df.select(G.verdict(F.col("r")).alias("v"), G.verdict_valid(F.col("r")).alias("ok")).collect()
    assert [(r.v, r.ok) for r in got] == [(1, True), (0, True), (0, False), (0, False), (1, True), (0, False)]


def test_rounds_and_samples(spark):
    df = spark.createDataFrame([(1, "who is it", ["d"])], "k int, query string, descriptions array<string>")
    none = G.answer_candidates(df, 3, views.echo_generator(), rounds=0).collect()
    assert {r.cand_idx: r.text for r in none} == {0: "who is it", 1: "who is it please", 2: "whox isx it"}
    three = G.answer_candidates(df, 2, views.echo_generator(), rounds=3, concurrency=2).collect()
    assert {r.cand_idx: r.text for r in three} == {0: "who is it???", 1: "who is it please???"}
    assert G.answer_candidates(df, 0, views.echo_generator()).count() == 0


def test_critique_that_is_no_candidate(spark):
    def stubborn():
        return lambda prompts, samples: [" other " for _ in prompts]

    df = spark.createDataFrame([(1, "q", ["a", "b"])], "k int, query string, candidates array<string>")
    row = G.critique_select(df, stubborn).collect()[0]
    assert (row.critique, row.critique_idx) == ("other", None)
    row = G.critique_select(df.withColumn("candidates", F.array(F.lit("bb "), F.lit("a"))), views.shortest_critic()).collect()[0]
    assert (row.critique, row.critique_idx) == ("a", 1)


def test_raw_bodies_are_parsed(spark):
    def body():
        return lambda prompts, samples: ['{"response":"x","done":false}\n{"response":"y","done":true}' for _ in prompts]

    df = spark.createDataFrame([("p",)], "prompt string")
    assert G.batch_generate(df, "prompt", "out", body, raw_body=True).collect()[0].out == "xy"


def test_equal_texts_are_encoded_once(spark, path):
    import os
    import tempfile

    folder = tempfile.mkdtemp()

    def counting():
        import uuid

        def encode(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
                log.write("\n".join(texts))
            return [[float(len(t))] for t in texts]

        return encode

    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i % 3}") for i in range(60)], "k int, t string")
    got = G.encode_distinct(df, "t", "v", counting).collect()
    seen = [line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n")]
    assert sorted(seen) == ["n/a", "t0", "t1", "t2"]
    assert len(got) == 60 and {r.v[0] for r in got if r.t is None} == {3.0}


def test_fewshot_takes_the_last_rows(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(10)], "row_id int, q string, a string").repartition(3)
    prompt = M.fewshot_prompt(df, "q", "a", size=2).collect()[0].prompt
    assert prompt.index("q8") < prompt.index("a8") < prompt.index("q9") and "q7" not in prompt
    assert prompt.endswith(fixed.TASK)


def test_compare_template_both_ways(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(50)], "row_id bigint, q string, a string")
    default = [r.block.split("\n")[1] for r in M.compare_template(df, "q", "a").collect()]
    assert default == [f"q{i}" for i in range(30, 0, -1)]
    last = [r.block.split("\n")[1] for r in M.compare_template(df, "q", "a", size=3, last_n=True).collect()]
    assert last == ["q49", "q48", "q47"]


def picky():
    """Answers prompts with their length; those that hold an x make the whole call fail."""

    def make():
        def answer(prompts, samples):
            if any("x" in p for p in prompts):
                raise ConnectionError("no answer")
            return [str(len(p)) for p in prompts]

        return answer

    return make


def test_one_bad_prompt_of_many_is_a_failed_row(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") == 437, "x").otherwise(F.repeat(F.lit("a"), F.col("id").cast("int") % 7)).alias("p"))
    got = G.batch_generate(df, "p", "out", picky(), error="why", retries=2).collect()
    assert [(r.id, r.out, r.why) for r in got if r.why] == [(437, None, "ConnectionError: no answer")]
    assert all(r.out == str(r.id % 7) for r in got if r.id != 437) and len(got) == 1000


def test_rows_that_failed_once_are_tried_again(spark):
    def moody():
        seen = {}

        def answer(prompts, samples):
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
            if len(prompts) > 1 or seen[prompts[0]] < 4:
                raise TimeoutError("late")
            return ["ok"]

        return answer

    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    assert [(r.out, r.why) for r in G.batch_generate(df, "p", "out", moody, error="why", retries=3).collect()] == [("ok", None)] * 2
    assert [(r.out, r.why) for r in G.batch_generate(df, "p", "out", moody, error="why", retries=1).collect()] == [(None, "TimeoutError: late")] * 2


def test_a_query_fails_with_one_of_its_candidates(spark):
    df = spark.createDataFrame([("good", ["d"]), ("xbad", ["d"]), ("fine", [])], "query string, descriptions array<string>")
    # The fixed text of prompts holds the letter too.
    def strict():
        def answer(prompts, samples):
            if any("xbad" in p and n == 1 for p, n in zip(prompts, samples)):
                raise ValueError("bad")
            return ["t" for _ in prompts]

        return answer

    got = {r.query: (r.texts, r.error) for r in G.answer_lists(df, 3, strict, rounds=2, error="error").collect()}
    assert got["good"] == got["fine"] == (["t"] * 3, None)
    assert got["xbad"] == ([None] * 3, "ValueError: bad")


def test_answers_that_are_too_few_are_failures(spark):
    short = lambda: lambda prompts, samples: ["one"][: len(prompts) - 1]
    got = G.batch_generate(spark.createDataFrame([("a",), ("b",)], "p string"), "p", "out", short, error="why").collect()
    assert {r.why for r in got} == {"ValueError: 0 answers to 1 prompts"}


def test_python_takes_up_few_rows_at_a_time(spark):
    """However many rows a task gets, a model sees bounded pieces of them, and all of them in order."""
    from phrasewell.operators import generate as G

    def sizes():
        return lambda prompts, samples: [f"{len(prompts)} {sum(map(len, prompts))}" for _ in prompts]

    def lengths():
        return lambda texts: [[float(len(texts)), float(t.split()[0])] for t in texts]

    df = spark.range(0, 9000, 1, 1).selectExpr("id", "concat(id, IF(id < 3000, ' x', repeat(' long', 10000))) AS text")
    seen = [tuple(map(int, r.a.split())) for r in G.batch_generate(df, "text", "a", sizes).collect()]
    assert len(seen) == 9000 and max(n for n, _ in seen) <= 256 and max(b for _, b in seen) < 6_000_000
    vectors = G.encode_texts(df, ("text", "v", lengths)).select("id", "v").collect()
    assert all(r.v[1] == r.id and r.v[0] <= 256 for r in vectors) and len(vectors) == 9000
