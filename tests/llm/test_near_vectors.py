import math

import numpy as np
import pytest

from phrasewell.llm.near_vectors import near_vectors
from tests.llm.conftest import smallest_reachable

SF = "/root/testdata/sf0.001"


def brute_force(rows, least=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links.append((i, j))
    root = smallest_reachable(range(len(rows)), links)
    keys = {}
    for i, (k, _) in enumerate(rows):
        keys.setdefault(root[i], []).append(k)
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in keys.items()}
    return sorted(((k, sum(i in e for e in links), low[root[i]]) for i, (k, _) in enumerate(rows)), key=str)


def test_query_agrees_with_all_pairs(spark):
    from phrasewell.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ours = QUERIES["op4_near_vectors"](spark, SF).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in ours), key=str) == brute_force(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in ours)


def test_query_agrees_with_sql(spark):
    from checks.compare import difference
    from phrasewell.llm.oracles import SQL
    from phrasewell.llm.queries import QUERIES

    assert difference(spark, SF, QUERIES["op4_near_vectors"], SQL["op4_near_vectors"]) is None


def test_odd_vectors_and_a_hot_group_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=48)
    hot = [[float(x) for x in base + rng.normal(size=48) * 0.05] for _ in range(60)]
    other = [[float(x) for x in rng.normal(size=48)] for _ in range(60)]
    odd = [None, [], [0.0] * 48, [math.nan] * 48, [1.0, None] * 24, [math.inf] * 48, [1e300] * 48, [2e-300] * 48, [1.0, 2.0], [2.0, 4.0]]
    vectors = hot + other + odd + hot[:3] + hot[:1]
    rows = list(enumerate(vectors)) + [(None, hot[5]), (None, None), (7, hot[9])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id bigint, embedding array<double>, node int, v string")
    found = near_vectors(df, block_rows=16, pivots=32)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    b = 0.905 * a + math.sqrt(1 - 0.905**2) * r
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack((a, b)))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sum(r.n_links for r in found) / 1200 >= 0.9


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_empty_table(spark, kind):
    assert near_vectors(spark.createDataFrame([], f"vec_id bigint, embedding {kind}")).collect() == []


def test_pivots_are_drawn_without_ordering_the_table(spark):
    from phrasewell.llm import near_vectors as N

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 8)))] + [(9000 + i, [float(i), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "node bigint, v array<double>").repartition(6)
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: seen.append(self) or collect(self)
        points = N.fit_pivots(df, 16, apart=2)
    finally:
        type(df).collect = collect
    hashed = df.selectExpr("node", "v", "xxhash64(v) AS h").where("size(v) = 8").orderBy("h", "node").limit(16).collect()
    expected = np.array([r.v for r in hashed])
    assert np.allclose(points[8], expected / np.linalg.norm(expected, axis=1, keepdims=True)) and len(points[2]) == 16
    assert len(seen[-1].collect()) <= 2 * 64
    under = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert under.index("Window [") < under.index("<= most")  # the bound lies below the window


def test_fewer_pairs_meet_as_tables_grow():
    """Share of pairs that meet in a list, and of pairs at 0.9 that do, for the sizes of four tables."""
    from phrasewell.llm.near_vectors import index_size

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(1500, 64)))
    r = rng.normal(size=a.shape)
    r = unit(r - (r * a).sum(1)[:, None] * a)
    b = 0.9 * a + math.sqrt(1 - 0.81) * r
    shares = []
    for rows in (50_000, 1_000_000, 4_000_000):
        pivots, prefix = index_size(rows)
        points = unit(rng.normal(size=(pivots, 64)))
        near = lambda x: np.argsort(-(x @ points.T), axis=1)[:, :prefix]
        one = np.zeros((len(a), pivots))
        np.put_along_axis(one, near(a), 1, 1)
        two = np.zeros((len(a), pivots))
        np.put_along_axis(two, near(b), 1, 1)
        assert ((one * two).sum(axis=1) >= 2).mean() >= 0.95
        met = one @ one.T >= 2
        shares.append((met.sum() - len(a)) / (len(a) * (len(a) - 1)))
    assert shares[0] > 2.5 * shares[1] > 5 * shares[2]
    assert index_size(0) == index_size(60_000) == (256, 6)
