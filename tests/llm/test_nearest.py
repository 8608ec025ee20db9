import numpy as np
import pytest

from compare import compare, duck
from rollframe.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<double>, rank string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], SCHEMA)


def brute(vectors, asked, k):
    """The plain answer: every pair, sorted."""
    out = {}
    for q, x in asked:
        out[q] = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, x)))), i) for i, v in vectors if i != q)[:k]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("size", [2, 17, 64])
def test_recall(spark, size):
    rng = np.random.default_rng(size)
    data = rng.standard_normal((3000, size)) * rng.choice([0.1, 1, 10], (3000, 1))
    vectors = [(i, row.tolist()) for i, row in enumerate(data)]
    df = table(spark, vectors).repartition(5)
    got, want = lists(nearest.nearest(df, df.where("vec_id % 100 = 0"))), brute(vectors, vectors[::100], 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.99 * 10 * len(want)
    exact = {q: dict((i, s) for s, i in brute(vectors, [vectors[q]], 3000)[q]) for q in list(want)[:3]}
    assert all(s == pytest.approx(exact[q][i], rel=1e-12) for q in exact for s, i in got[q])


def test_ties_and_copies(spark):
    vectors = [(i, [1.0, 0.0]) for i in range(1, 30)] + [(100, [1.0, 0.0]), (31, [0.0, 1.0])]
    df = table(spark, vectors)
    assert lists(nearest.nearest(df, df.where("vec_id = 100"), 5))[100] == [(0.0, i) for i in range(1, 6)]


def test_fewer_candidates_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [0.0, 5.0]), (0, [0.0, 2.0])]
    df = table(spark, rows)
    got = lists(nearest.nearest(df, df))
    assert set(got) == {0, 1, 9}
    assert got[0] == [(pytest.approx(2**0.5), 1), (3.0, 9)]
    empty = table(spark, [])
    assert nearest.nearest(empty, empty).collect() == [] == nearest.nearest(df, empty).collect()


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    data, asked = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    true = ((asked[:, None] - data[None]) ** 2).sum(-1)
    guess, least = nearest.Codes(data, nearest.rotation(64)).bounds(asked, 4.0)
    assert (least <= true).mean() > 0.9999
    assert abs((guess - true).mean()) < 0.05 * true.mean()


def test_sql(spark, sf):
    line, good = compare(spark, duck(sf), "op9", queries.op9_nearest, queries.SQL["op9_nearest"], sf)
    assert good, line
