import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, count=3):
    codes = {i: (label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows}
    out = []
    for a, (label, v) in codes.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, g) for i, (g, w) in codes.items() if i != a)
        for minus, p, _ in [s for s in scores if s[2] == label][:positives]:
            inside = [s for s in scores if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:count]
            out += [(a, p, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def some_vectors(n, size, labels, seed):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((labels, size))
    rows = []
    for i in range(n):
        v = centres[pick.integers(0, labels)] + 0.7 * pick.standard_normal(size)
        rows.append((i, int(pick.integers(0, labels)), np.float32(np.round(v / np.linalg.norm(v), 2)).tolist()))
    return rows


@pytest.mark.parametrize("block_rows, part_rows", [(8192, 1024), (37, 5)])
def test_equal_to_brute_force(spark, block_rows, part_rows):
    rows = some_vectors(400, 6, 4, 1)
    rows += [(1000 + i, i % 2, rows[5][2]) for i in range(60)]  # a vector that stands often: ties by id
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS part", "3 AS score").repartition(3)
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, part_rows=part_rows)
    assert found.columns == COLUMNS
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 300


def test_rows_that_take_no_part(spark):
    good = some_vectors(40, 3, 2, 2)
    odd = [
        (50, None, [1.0, 0.0, 0.0]), (60, 1, None), (70, 1, [1.0, None, 0.0]), (80, 0, [1.0, float("nan"), 0.0]), (90, 0, [float("inf"), 0.0, 0.0]),
        (None, 0, [1.0, 0.0, 0.0]), (100, 1, [1.0, 0.5]), (110, 0, []),
    ]
    zero = [(120, 0, [0.0, 0.0, 0.0]), (121, 1, [0.0, 0.0, 0.0])]  # a zero vector scores 0, which is in its own window
    df = spark.createDataFrame(good + odd + zero + good[:7], SCHEMA)
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(good + zero, lambda i: i % 10 == 0)


def test_repeated_ids_count_once_with_the_smallest_label(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [0.75, 0.0]), (2, 1, [0.75, 0.0])]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, 65536, 49152)]


def test_empty_table_and_no_anchors(spark):
    none = negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0)
    assert none.columns == COLUMNS and none.count() == 0
    some = spark.createDataFrame(some_vectors(5, 3, 2, 3), SCHEMA)
    assert negatives.hard_negatives(some, F.col("vec_id") < 0).count() == 0


def test_large_components(spark):
    """Beyond 53 bits scores are worked out in integers; beyond 64 bits the call fails instead of a wrong score."""
    rows = [(0, 0, [500000.0, 3.0]), (1, 0, [400001.0, 1.0]), (2, 1, [300000.0, 5.0])]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, scale=256)
    assert [tuple(r) for r in found.collect()] == brute(rows, lambda i: i == 0)
    with pytest.raises(ValueError, match="too large"):
        negatives.hard_negatives(spark.createDataFrame([(0, 0, [1e30])], SCHEMA), F.col("vec_id") == 0)


def test_the_threshold_stops_the_search():
    """On lists that fall steeply the first rows are found long before the lists end, with the sign of the anchor."""
    n = 4000
    fall = np.exp2(-np.arange(n) / 40)
    vectors = np.floor(256 * np.stack([fall, -fall], axis=1))
    block = negatives.Lists(np.arange(n), np.zeros(n, dtype=np.int64), vectors)
    take = lambda a, rows: np.ones(len(rows), dtype=bool)
    anchors = np.array([[100.0, -100.0], [-100.0, 100.0]])
    found, scored = negatives.threshold_search(block, anchors[:1], [[(-1 << 40, 1 << 40)]], take, 5)
    assert found[0].first((-1 << 40, 1 << 40), block.ids)[0].tolist() == [0, 1, 2, 3, 4] and scored < n / 10
    # rows tied with the kth: the threshold must fall strictly below it
    tied = negatives.Lists(np.arange(50)[::-1].copy(), np.zeros(50, dtype=np.int64), np.full((50, 2), 3.0))
    found, scored = negatives.threshold_search(tied, np.array([[1.0, 1.0]]), [[(0, 100)]], take, 2)
    assert tied.ids[found[0].first((0, 100), tied.ids)[0]].tolist() == [0, 1] and scored == 50
    # a window below the top: rows above it are passed over
    found, scored = negatives.threshold_search(block, anchors[:1], [[(20000, 30000)]], take, 3)
    scores = vectors @ anchors[0]
    want = np.flatnonzero((scores >= 20000) & (scores <= 30000))[:3]
    assert found[0].first((20000, 30000), block.ids)[0].tolist() == want.tolist() and scored < n


def test_depths_do_not_change_results(monkeypatch):
    rows = some_vectors(300, 4, 3, 5)
    vectors = np.floor(256 * np.array([v for _, _, v in rows]))
    block = negatives.Lists(np.arange(300), np.array([g for _, g, _ in rows]), vectors)
    take = lambda a, rows: block.labels[rows] == a % 3
    windows = [[(0, 40000), (10000, 30000)]] * 20
    results = []
    for depths in ((), (1, 8, 64, 512), tuple(range(1, 300))):
        monkeypatch.setattr(negatives, "DEPTHS", depths)
        found, _ = negatives.threshold_search(block, vectors[:20], windows, take, 3)
        results.append([[s.first(w, block.ids)[0].tolist() for w in windows[0]] for s in found])
    assert results[0] == results[1] == results[2]
