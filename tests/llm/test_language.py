import tracemalloc
import zlib

import numpy as np

from phrasewell.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from phrasewell.llm.queries import QUERIES

    wanted = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language"](spark, SF).collect()
    assert len(rows) == len(wanted) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == wanted[r.doc_id] for r in held) / len(held) > 0.98


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(d, per_language=60, landmarks=16).collect())) for d in (docs, wrong))
    assert a == b


def test_odd_rows(spark, odd_docs, no_docs):
    got = language.identify(odd_docs, per_language=10, landmarks=4).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.lang_pred in ("en", "fr", "s", "und")
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(no_docs).collect() == []
    unlabelled = odd_docs.withColumn("lang", odd_docs["lang"].substr(10, 1)).where("lang is null")
    assert all(r.lang_pred == "und" for r in language.identify(unlabelled).collect())


def test_weights_give_kernel_ridge_regression():
    """Brute force: values from the kernel between texts and landmarks, without weights per n-gram."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd" if i % 2 else "cdef"), 60)) for i in range(40)]
    own = np.arange(40) % 2
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    words = sorted(set().union(*grams))
    present = np.array([[w in g for w in words] for g in grams], float)
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    picked = np.concatenate([np.flatnonzero(own == c)[:8] for c in (0, 1)])
    to, among = kernel[:, picked], kernel[np.ix_(picked, picked)]
    y = np.where(own[:, None] == np.arange(2), 1.0, -1.0)
    a = np.linalg.solve(to.T @ to + 0.01 * 40 * among + 1e-9 * np.eye(16), to.T @ y)
    weights = language._ridge(present, own, 2, 8, 0.01)
    assert np.allclose(language._unit(present) @ weights, to @ a, atol=1e-6)


def test_the_driver_holds_no_number_per_text_and_ngram(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = language.sample(docs, "lang", "text", 400, "doc_id").count()
    tracemalloc.start()
    try:
        model = language.fit(docs, landmarks=16)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < texts * len(model.codes) * 8 / 2


def test_weights_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    present, own = (rng.random((90, 40)) < 0.3).astype(np.uint8), np.arange(90) % 3
    weights = []
    for rows in (7, 90):
        monkeypatch.setattr(language, "BLOCK_ROWS", rows)
        weights.append(language._ridge(present, own, 3, 8, 0.01))
    assert np.allclose(*weights, atol=1e-9)


def test_presence_counts_the_whole_text(monkeypatch):
    monkeypatch.setattr(language, "BLOCK_BYTES", 16)
    text = "abc " * 30 + "xyz"
    codes = np.unique(np.concatenate(list(language._codes(language._bytes(text)))))
    raw = language._bytes(text)
    wanted = {raw[i] for i in range(len(raw))} | {256 + (raw[i] << 8 | raw[i + 1]) for i in range(len(raw) - 1)}
    wanted |= {256 + 65536 + (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) for i in range(len(raw) - 2)}
    assert set(codes.tolist()) == wanted
