import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from phrasewell.llm import bloom_slices as B
from phrasewell.llm.queries import op12_lexical_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, queries, k=10):
    """Every query against every document: (query key, rank, key, score)."""
    counts = [(key, Counter(split(text))) for key, text in docs]
    filled = [c for _, c in counts if c]
    n_docs, n_terms = len(filled), sum(sum(c.values()) for c in filled)
    df = Counter(t for c in filled for t in c)
    out = []
    for query, text in queries:
        scores = []
        for key, c in counts:
            n, score = sum(c.values()), 0
            for t in split(text):
                if c[t]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(query, i + 1, None if none else key, -score) for i, (score, none, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def told(rows, query="item_id", key="doc_id"):
    return sorted([(r[query], r["rank"], r[key], r["score"]) for r in rows], key=str)


def test_query_against_every_pair(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    queries = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    result = op12_lexical_search(spark, SF)
    assert result.columns == ["item_id", "rank", "doc_id", "score"] and dict(result.dtypes)["rank"] == "int"
    assert told(result.collect()) == plain_search(docs, queries)


def test_terms():
    text = "Ab_c1-D2é ÀB\x00x\x7fy漢字　z{|}~İ 'q\n"
    assert [t.decode() for t in B.terms(text.encode())] == split(text) == ["ab", "c1", "d2é", "Àb", "x", "y漢字　z", "İ", "q"]


def test_bounds_hold_and_few_documents_are_left():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 300, 3000])))) for i in range(300)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [k for k, _ in docs], "t": [t for _, t in docs]})
    blocks = [b.to_pylist()[0] for b in B._blocks([batch])]
    assert sorted(k for b in blocks for k in b["keys"]) == list(range(300))
    queries = [Counter(w.encode() for w in rng.choices(words, k=20)) for _ in range(30)]
    names = sorted(set().union(*queries))
    held = [Counter(split(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, held)), sum(sum(c.values()) for c in held)
    weights = np.array([B.weight(n_docs, sum(t.decode() in c for c in held)) for t in names])
    lists = [(np.array([names.index(t) for t in q]), np.array(list(q.values()))) for q in queries]
    plan = B.Plan(names, weights, lists, n_docs, n_terms)
    bounds, exact = [], []
    for b in blocks:
        bounds.append(plan.bounds(b["rows"], np.array(b["lengths"]), b["bits"]))
        counts = [Counter(B.terms(t.encode())) for t in b["texts"]]
        exact.append([[plan.score(q, c, n) for c, n in zip(counts, b["lengths"])] for q in range(len(queries))])
    bounds, exact = np.concatenate(bounds, axis=1), np.concatenate(exact, axis=1)
    assert (bounds >= exact).all()
    tenth = -np.sort(-exact, axis=1)[:, 9]
    assert (bounds >= tenth[:, None]).mean() < 0.12


def test_ties_repeats_passes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "QUERIES", 3)
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "épsilon", "z9", "漢字"]
    docs = [(rng.randrange(40), " ".join(rng.choices(words, k=rng.randrange(0, 5)))) for _ in range(120)] + [(None, "alpha gamma"), (7, None)]
    queries = [(i % 6, " ".join(rng.choices(words, k=rng.randrange(0, 4)))) for i in range(8)] + [(9, None), (None, "Beta beta")]
    queries = list({q[0]: q for q in queries}.values())
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "item_id int, text string")
    assert told(B.search(d, q, k=4).collect()) == plain_search(docs, queries, 4)
    index = B.build_index(d.repartition(7))
    assert told(B.search(d, q, k=3, index=index).collect()) == plain_search(docs, queries, 3)


def test_odd_rows(spark, odd_docs, no_docs):
    queries = [(1, "ONE two"), (2, "épsilon alpha7"), (3, ""), (4, "nothing of this kind")]
    q = spark.createDataFrame([(*r, 0, "x") for r in queries], "item_id int, text string, rank int, score string")
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert told(B.search(odd_docs, q).collect()) == plain_search(docs, queries)
    nothing = B.search(no_docs, q)
    assert nothing.collect() == [] and nothing.columns == ["item_id", "rank", "doc_id", "score"]
    assert B.search(odd_docs, q.limit(0)).collect() == []


@pytest.mark.parametrize("rows", [64, 1 << 10])
def test_full_signatures_lose_nothing(spark, monkeypatch, rows):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    queries = [(i, " ".join(split(t)[i : i + 12])) for i, (_, t) in enumerate(docs)]
    monkeypatch.setattr(B, "_rows_of", lambda entries: (5, rows))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": [k for k, _ in docs], "t": [t for _, t in docs]})
    counted = [Counter(split(t)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, counted)), sum(sum(c.values()) for c in counted)
    names = sorted({t.encode() for _, x in queries for t in split(x)})
    lists = [(np.array([names.index(t) for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in (Counter(x.encode() for x in split(t)) for _, t in queries)]
    plan = B.Plan(names, np.array([B.weight(n_docs, sum(t.decode() in c for c in counted)) for t in names]), lists, n_docs, n_terms)
    for block in (b.to_pylist()[0] for b in B._blocks([batch])):
        bounds = plan.bounds(block["rows"], np.array(block["lengths"]), block["bits"])
        for at, text in enumerate(block["texts"]):
            counts = Counter(B.terms(text.encode()))
            assert all(plan.score(q, counts, block["lengths"][at]) <= bounds[q, at] for q in range(len(queries)))
