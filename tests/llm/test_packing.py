import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phrasewell.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def check(rows, texts, tokenizer, size=1024):
    """Every id in one piece, sequences gapless and short enough; gives the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert p.ids is None or p.ids == part
            at += p.length
        assert at == len(ids)
    taken = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
        taken += packing.padded(at, size)
    return 1 - sum(r.length for r in rows) / taken if rows else 0


@pytest.mark.parametrize("with_ids", [True, False])
def test_all_documents(spark, tokenizer, with_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs, PATH, with_ids=with_ids).collect(), texts, tokenizer) < 0.01


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH, size=128).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths[1] == 1 and lengths[2] == 1 and lengths[None] > 2
    assert sum(lengths.values()) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pack(no_docs, PATH).collect() == []


def test_ids_are_those_of_the_library(tokenizer):
    ours = packing.Encoder(open(PATH, encoding="utf-8").read())
    texts = ["", " ", "a  b", "\n x\n", "it's 's x", "漢字 é  é́", "<|endoftext|> a<|endoftext|>", "a\x1c b\x85c​ d", "1 22  333 ½Ⅳ", "don't  stop 'll", "\U0001f600" * 3]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert packing.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()).ids("a b")


def test_cuts():
    for n in range(1, 5000):
        made = packing.cuts(n, 1024)
        assert sum(x for _, x in made) == n and [a for a, _ in made] == [sum(x for _, x in made[:i]) for i in range(len(made))]
        assert len(made) <= n // 1024 + 3
    assert all(sum(x for _, x in packing.cuts(n, 8)) == n for n in range(1, 50))


def test_the_program_against_all_patterns():
    """Small stock: the bound of the columns found equals that over every pattern, by its dual."""
    demand = {7: 40, 5: 31, 3: 55, 2: 17}
    solved = packing.solve(demand, 16, gap=1e-9)
    used = Counter()
    for pattern, n in solved:
        for x, k in pattern.items():
            used[x] += n * k
    assert all(abs(used[x] - n) < 1e-6 for x, n in demand.items())
    cost = sum(packing.padded(sum(x * k for x, k in p.items()), 16) * n for p, n in solved)
    assert cost == pytest.approx(sum(x * n for x, n in demand.items()), rel=1e-6)  # no padding is needed


def test_rounding_uses_up_the_demand():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 20_000):
        demand = dict(Counter(rng.integers(1, 65, n).tolist()))
        used = Counter()
        for pattern, times in packing.rounded(demand, 64):
            assert sum(x * k for x, k in pattern.items()) <= 64 and times > 0
            for x, k in pattern.items():
                used[x] += times * k
        assert used == demand


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts_are_their_ids(spark, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    spelled = [t.content for t in library.get_added_tokens_decoder().values()][:3]
    texts = {i: t for i, t in enumerate(f"{a}{s}{b}" for s in spelled for a, b in (("a", "b"), ("a ", " b"), ("", ""), ("x\n", s), (s[:-1], s[1:])))}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), path).collect()
    check(rows, texts, library)


def test_pieces_are_seated_where_they_lie(spark, tokenizer):
    """Pieces and their ids go through no shuffle, however many there are."""
    texts = {i: " ".join(["word"] * (i % 700)) for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        packed = packing.pack(docs, PATH)
        plan = packed._jdf.queryExecution().executedPlan().toString()
        rows = packed.collect()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert check(rows, texts, tokenizer) < 0.01
