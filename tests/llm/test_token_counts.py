import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from phrasewell.llm import token_counts, unigram

SF = "/root/testdata/sf0.001"
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
TEXTS = [
    "", " ", "  two  spaces ", "Hello  wörld 漢字 x", "▁ ▁▁a", "a\nb\tc\r\n", "\U0001f600\U0001f600 é́", "aaaa" * 50, "x" * 5000, "  ", "naïve café " * 2000,
    "0123456789 " * 800, "漢" * 300 + " \x00\x01",
]


def variant(scores=None, fallback=True, trim=False):
    """The model as unigram, with other scores, without bytes, or with spaces trimmed."""
    read = pb.ModelProto()
    read.ParseFromString(unigram.as_unigram(MODEL))
    read.trainer_spec.byte_fallback = fallback
    read.normalizer_spec.remove_extra_whitespaces = trim
    for p in read.pieces:
        if scores and p.type == 1:
            p.score = scores()
        if p.type == 6 and not fallback:
            p.type = 5
    return read.SerializeToString()


def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


@pytest.mark.parametrize("kind", ["ranks", "ties", "logs", "no_bytes", "trim"])
def test_counts_are_those_of_the_library(spark, kind):
    rng = random.Random(3)
    model = {
        "ranks": lambda: variant(),
        "ties": lambda: variant(lambda: -float(rng.randrange(1, 4))),
        "logs": lambda: variant(lambda: -rng.random() * 12),
        "no_bytes": lambda: variant(fallback=False),
        "trim": lambda: variant(trim=True),
    }[kind]()
    counter, own = token_counts.Counter(model), library(model)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    # The library sums in single precision, so long texts are compared where scores are whole numbers.
    texts = [*TEXTS, *docs, *([" ".join(docs)] if kind != "logs" else [])]
    for t in texts:
        assert counter.count(t)[0] == len(own.encode(t)), t[:80]


def test_query_counts_whole_texts(spark):
    from phrasewell.llm.queries import QUERIES

    own = library(variant())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(own.encode(t)) for k, t in texts.items()}


def test_odd_rows(spark, odd_docs, no_docs):
    own = library(variant())
    wanted = sorted((r.doc_id or 0, len(own.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd_docs, MODEL).collect()) == wanted
    assert token_counts.count_tokens(no_docs, MODEL).collect() == []
