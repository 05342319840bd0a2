import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from phrasewell.llm import sentencepieces as sp, unigram
from tests.llm.test_token_counts import MODEL, TEXTS, variant

SF = "/root/testdata/sf0.001"


def no_words(text):
    return text.replace(" ", "")


@pytest.mark.parametrize("kind", ["ranks", "ties"])
@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_chunks_give_what_the_library_gives(spark, monkeypatch, kind, chunk):
    """Whole texts in tiny chunks, over two and more levels of blocks, ties across boundaries included."""
    rng = random.Random(4)
    monkeypatch.setattr(sp, "BLOCK", 4)
    model = unigram.as_unigram(MODEL) if kind == "ranks" else variant(lambda: -float(rng.randrange(1, 3)))
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = [r.text[:3000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(4).collect()]
    texts = [t[:700] for t in TEXTS if len(t) > chunk] + docs + [no_words(docs[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.ids for r in sp.encode(df, model, chunk=chunk).collect()}
    assert got == {i: own.encode(t) for i, t in enumerate(texts)}


def test_query_goes_there_and_back(spark):
    from phrasewell.llm.queries import QUERIES

    own = sentencepiece.SentencePieceProcessor(model_proto=unigram.as_unigram(MODEL))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_sentencepieces"](spark, SF).collect()
    assert {r.doc_id: r.n_ids for r in rows} == {k: len(own.encode(t)) for k, t in texts.items()}
    assert all(r.round_trip for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    own = sentencepiece.SentencePieceProcessor(model_proto=unigram.as_unigram(MODEL))
    got = sp.there_and_back(odd_docs, MODEL, chunk=20_000).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.text) for r in got) == order((r.doc_id, r.text) for r in odd_docs.collect())
    assert order((r.doc_id, r.ids) for r in got) == order((r.doc_id, None if r.text is None else own.encode(r.text)) for r in odd_docs.collect())
    assert sp.encode(no_docs, MODEL).collect() == []


def test_matrices_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-9, 0, (5, 5))) for _ in range(3))
    assert np.array_equal(sp.max_plus(sp.max_plus(a, b), c), sp.max_plus(a, sp.max_plus(b, c)))


def test_decoding_is_that_of_the_library():
    own = sentencepiece.SentencePieceProcessor(model_proto=unigram.as_unigram(MODEL))
    words = unigram.Vocabulary(MODEL)
    for t in TEXTS:
        ids = own.encode(t)
        assert words.decoded(np.array(ids, int)) == t.replace("▁", " ")
