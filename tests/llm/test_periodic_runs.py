import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from phrasewell.llm import periodic_runs as P
from phrasewell.llm.queries import op13_periodic_runs
from phrasewell.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """Every period on its own; a stretch counts with the least period that gives it."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p - start), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:])))


def drawn(rng):
    kind, n = rng.randrange(5), rng.randrange(0, 160)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # nested repeats
        piece = [rng.randrange(2) for _ in range(rng.randrange(1, 5))] * rng.randrange(2, 9) + [7] * rng.randrange(3)
        return (piece * 12)[:n]
    if kind == 2:  # Fibonacci words have as many runs as any
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        return [0] * n
    return [rng.randrange(50) for _ in range(n // 2)] + [rng.randrange(3) for _ in range(4)] * (n // 4)


def test_runs_against_every_period():
    rng = random.Random(3)
    texts = [drawn(rng) for _ in range(400)]
    found = P.find_runs([np.array(t, np.int64) for t in texts])
    assert sum(len(f) for f in found) > 400
    for t, f in zip(texts, found):
        assert [tuple(r) for r in f.tolist()] == sorted(plain_runs(t), key=lambda r: (r[0], r[2]))
        for s, n, p in f.tolist():
            assert smallest_period(t[s : s + n]) == p


def test_long_texts_are_taken_period_by_period(monkeypatch):
    rng = random.Random(4)
    texts = [np.array(drawn(rng), np.int64) for _ in range(60)]
    whole = P.find_runs(texts)
    monkeypatch.setattr(P, "TABLE_WORDS", 20)
    monkeypatch.setattr(P, "PAIRS", 50)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, P.find_runs(texts)))


@pytest.mark.parametrize("least", [1, 20])
def test_extensions_against_letters(least):
    rng = random.Random(6)
    for _ in range(60):
        s = drawn(rng) or [1]
        n = len(s)
        grammar = Grammar(np.array(s), least)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(0, n + 1, 3), np.arange(n + 1)))
        a, b = a[a != b], b[a != b]
        for forward in (True, False):
            for x, y, m in zip(a.tolist(), b.tolist(), grammar.extensions(a, b, forward).tolist()):
                k = 0
                while (max(x, y) + k < n and s[x + k] == s[y + k]) if forward else (min(x, y) - k > 0 and s[x - k - 1] == s[y - k - 1]):
                    k += 1
                assert k == m


def planted(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_against_every_period(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs)
    checked = 0
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        assert r.n_words == len(words)
        if len(words) > 1500:
            continue
        checked += 1
        runs = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == told and r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert checked > 150 and sum(r.n_runs > 0 for r in rows) > 15


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.runs, r.collapsed) == (0, [], "")
    assert {r.n_words for r in rows if r.doc_id in (5, 6)} == {30_000, 30_001}
    assert P.periodic_runs(no_docs).collect() == [] and P.with_planted_runs(no_docs).collect() == []
    assert P.with_planted_runs(odd_docs).count() == odd_docs.count()
    repeated = spark.createDataFrame([(1, "x\ty " + "b  c\n" * 20_000 + "z")], "doc_id int, text string")
    row = P.periodic_runs(repeated).first()
    assert [tuple(x) for x in row.runs] == [(2, 40_000, 2)] and row.collapsed == "x y b c z"
    with pytest.raises(ValueError):
        P.periodic_runs(repeated, least=3)
