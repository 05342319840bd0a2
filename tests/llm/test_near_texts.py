import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from phrasewell.llm import near_texts
from tests.llm.conftest import smallest_reachable


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return not a | b or len(a & b) >= 0.8 * len(a | b)


def test_copies_go_and_others_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(20, 400))]
        texts.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 60))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(words).upper())
    texts += [texts[3], "short one", "short one", "", None, " "]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    root = smallest_reachable(range(len(texts)), links)
    kept = {r.doc_id for r in near_texts.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    wanted = {i for i in root if root[i] == i}
    assert wanted <= kept  # no document goes without a near-duplicate that stays
    assert len(kept - wanted) <= 0.05 * (len(texts) - len(wanted))


def test_a_large_group_and_odd_rows(spark, odd_docs, no_docs):
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:150], f"changed{i}", *words[151:]])) for i in range(400)]
    assert [r.doc_id for r in near_texts.keep_first(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [0]
    kept = near_texts.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [
        (0, "no id at "), (1, ""), (4, "one two"), (4, "other wor"), (5, odd_docs.where("doc_id = 5").first().text[:9]), (8, "x"),
    ]
    assert near_texts.keep_first(no_docs).collect() == []


def exact(spark, texts):
    """Kept keys, and those that brute force keeps."""
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    root = smallest_reachable(range(len(texts)), links)
    kept = {r.doc_id for r in near_texts.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    return kept, {i for i in root if root[i] == i}


def test_copies_among_texts_of_one_vocabulary(spark):
    """The order of words alone tells these texts apart, and each has a near copy far from it."""
    rng = random.Random(11)
    vocabulary = [f"column{i}" for i in range(120)]
    texts = [" ".join(rng.sample(vocabulary, 120)) for _ in range(200)]
    for t in list(texts):
        words = t.split()
        at = rng.randrange(119)
        words[at], words[at + 1] = words[at + 1], words[at]
        texts.append(" ".join(words))
    kept, wanted = exact(spark, texts)
    assert kept == wanted and len(wanted) <= 200


def test_all_that_meet_at_a_shingle_are_compared(spark):
    """Texts that share a passage too short to link them; pairs among them are neither first nor next to each other."""
    rng = random.Random(12)
    shared = [f"shared{i}" for i in range(26)]
    tails = [[f"t{i}x{k}" for k in range(10)] for i in range(40)]
    texts = [" ".join(shared + t) for t in tails] + [" ".join(shared + t[:-1] + ["other"]) for t in tails]
    rng.shuffle(texts)
    kept, wanted = exact(spark, texts)
    assert kept == wanted and len(wanted) == 40
    # The same in many blocks: rows that stand for all texts at one key.
    sets = spark.createDataFrame(list(enumerate(texts)), "node bigint, t string").select("node", near_texts.shingle_set_and_parities(F.col("t"), 5).alias("p")).select("node", "p.*")
    rows = sets.selectExpr("0L as key", "node", "size(s) as n", "node as part", "80L as texts", "2500L as shingles")
    links = near_texts.rest_of_links(rows, sets, 0.8, block_texts=7).collect()
    root = smallest_reachable(range(80), [(r.a, r.b) for r in links])
    assert {i for i in root if root[i] == i} == wanted


def test_links_of_short_texts_at_the_least_similarity(spark):
    """Every link of texts of 20 to 60 words is found, also just above 0.8."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    texts = []
    for size in (20, 25, 40, 60):
        for _ in range(100):
            words = [word() for _ in range(size)]
            texts.append(" ".join(words))
            at = rng.randrange(4)  # near an end a change costs few shingles
            texts.append(" ".join([*words[:at], word(), *words[at + 1 :]]))
    kept, wanted = exact(spark, texts)
    assert kept == wanted and len(wanted) < 700


def test_no_link_is_ruled_out():
    """Sizes and parities, also of unlike lengths, never rule out sets that are alike; they do rule out most others."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (40, 500, 560, 1100, 5000):
        for _ in range(8):
            own = rng.integers(-(2**63), 2**63 - 1, n)
            some = rng.integers(-(2**63), 2**63 - 1, n // 9)
            sets += [np.unique(own), np.unique(np.concatenate((own[n // 9 :], some))), np.unique(np.concatenate((own, some)))]
    sketches = [near_texts.parities(s).view(np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    for i, j in combinations(range(len(sets)), 2):
        at = np.array([i, j])
        near = near_texts._near(at, np.zeros(2), True, n[at], [sketches[i], sketches[j]], 0.8).all()
        same = len(np.intersect1d(sets[i], sets[j]))
        assert near if same >= 0.8 * (n[i] + n[j] - same) else (i // 3 == j // 3 or not near)


def test_links_come_from_simhash_first(spark, monkeypatch):
    """Ball hashing names the pairs within its radius; they are verified, and the exact join has only the others left."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    texts = []
    for _ in range(20):
        words = [word() for _ in range(900)]
        texts += [" ".join(words), " ".join([*words[:-1], word()]), " ".join(words[:450]), " ".join([*words[:450], *[word() for _ in range(450)]])]
    seen = {}
    for name in ("simhash_pairs", "still_apart"):
        def kept(*given, own=getattr(near_texts, name), name=name):
            out = own(*given)
            seen[name] = ({(r.a, r.b) for r in given[0].collect()} if name == "still_apart" else None, {(r.a, r.b) for r in out.collect()})
            return out
        monkeypatch.setattr(near_texts, name, kept)
    kept, wanted = exact(spark, texts)
    assert kept == wanted and len(wanted) == 60
    assert len(seen["simhash_pairs"][1]) >= 15  # most of the 20 pairs that differ in one word
    before, after = seen["still_apart"]
    assert len(before) - len(after) >= 15 and after < before
