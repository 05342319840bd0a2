import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phrasewell.llm import sum_squares
from phrasewell.llm.queries import op11_sum_squares

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, size):
    """Every id in one piece, only long documents cut, sequences gapless and short enough; gives the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        ids = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 0]
        pieces = sorted(pieces, key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // size)
        assert all(p.length == size for p in pieces[1:])
        at = 0
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.ids in (None, part)
            at += p.length
        assert at == len(ids) == pieces[0].doc_tokens
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    return len(by_seq)


@pytest.mark.parametrize("with_ids", [True, False])
def test_all_documents(spark, library, with_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sum_squares.pack(docs, PATH, with_ids=with_ids).collect()
    assert all((r.ids is not None) == with_ids for r in rows)
    least = -(-sum(r.length for r in rows) // 2048)
    assert check(rows, texts, library, 2048) <= 1.03 * least + 1


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    result = op11_sum_squares(spark, SF)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"]
    whole = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs)
    assert sum(r.length for r in result.collect()) == whole


def test_groups_are_packed_apart(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sum_squares.pack(docs, PATH, group_rows=50, with_ids=False).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert check(rows, texts, library, 2048) <= 1.15 * least + 4


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sum_squares.pack(odd_docs, PATH, size=128).collect()
    assert [r.length for r in rows if r.doc_id == 1] == [1] and sum(r.doc_id is None for r in rows) >= 2
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.piece == 0)
    assert sum(r.doc_id == 4 and r.piece == 0 for r in rows) == 3
    assert sum_squares.pack(no_docs, PATH).collect() == []


def test_equal_lengths_meet_and_fill(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat('a b ', 8) AS text")
    rows = sum_squares.pack(docs, PATH, size=64, group_rows=100).collect()
    n = rows[0].length
    assert len({r.sequence_id for r in rows}) <= -(-1000 // (64 // n)) + 15


def plain(lengths, size):
    """Sums of squares taken anew for every choice."""
    bins = []
    for i, n in enumerate(lengths):
        best = None
        for b in bins:
            gap = size - b["level"]
            if gap >= n:
                left = [size - c["level"] - (n if c is b else 0) for c in bins]
                squares = sum(left.count(g) ** 2 for g in set(left) if g)
                if best is None or (squares, gap) < best[:2]:
                    best = (squares, gap, b)
        if best is None:
            bins.append({"level": n, "items": [i]})
        else:
            best[2]["level"] += n
            best[2]["items"].append(i)
    return bins


def test_each_choice_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(5)
    for size, n in ((16, 60), (40, 80), (7, 50)):
        for _ in range(10):
            lengths = np.sort(rng.integers(1, size, n))[::-1]
            first, offset = sum_squares.place(lengths, size)
            mine = sorted(sorted(lengths[first == f].tolist()) for f in set(first.tolist()))
            theirs = sorted(sorted(int(lengths[i]) for i in b["items"]) for b in plain(lengths.tolist(), size))
            assert len(mine) == len(theirs) and sum(map(sum, mine)) == lengths.sum()
            assert sorted(size - sum(x) for x in mine) == sorted(size - sum(x) for x in theirs)
            for i, f in enumerate(first):
                assert offset[i] == lengths[:i][first[:i] == f].sum()


def test_cuts():
    assert sum_squares.cuts(2048, 2048) == [(0, 2048)] and sum_squares.cuts(2049, 2048) == [(0, 1), (1, 2048)]
    assert sum_squares.cuts(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and sum_squares.cuts(1, 2048) == [(0, 1)]
