import re
from itertools import combinations

import xxhash

from phrasewell.llm.components import components
from phrasewell.llm.simhash import masks, simhash_components, text_fingerprint
from tests.llm.conftest import smallest_reachable

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, words=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    some = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    """Smallest key reachable per row, from all pairs of rows."""
    prints = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    root = smallest_reachable(range(len(rows)), edges)
    keys = {}
    for i, (k, _) in enumerate(rows):
        keys.setdefault(root[i], []).append(k)
    smallest = {r: min((k for k in ks if k is not None), default=None) for r, ks in keys.items()}
    return sorted(((k, f"{prints[i]:016x}", smallest[root[i]]) for i, (k, _) in enumerate(rows)), key=str)


def test_query_agrees_with_all_pairs(spark):
    from phrasewell.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ours = sorted((tuple(r) for r in QUERIES["op7_simhash"](spark, SF).collect()), key=str)
    assert ours == brute_force([tuple(r) for r in docs])


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    ours = [(r.doc_id, f"{r.fingerprint % (1 << 64):016x}", r.component) for r in simhash_components(odd_docs).collect()]
    assert sorted(ours, key=str) == brute_force(rows)


def test_empty_table(spark, no_docs):
    assert simhash_components(no_docs).collect() == []


def test_blocks_give_the_same_fingerprint(monkeypatch):
    from phrasewell.llm import common, simhash

    text = "".join(f"w{i * i % 97} \t" for i in range(5000))
    monkeypatch.setattr(simhash, "word_blocks", lambda d: common.word_blocks(d, 100))
    for k in (1, 2, 3, 5):
        assert text_fingerprint(text.encode(), k) % (1 << 64) == plain_fingerprint(text, k)


def test_balls_meet():
    assert len(masks(64, 1)) == 65 and len(set(masks(40, 2))) == 1 + 40 + 780


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = path + hub + [(5, 5), (2, 1)]
    ours = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    wanted = smallest_reachable({n for e in edges for n in e}, edges)
    assert ours == {n: c for n, c in wanted.items() if n != c}
