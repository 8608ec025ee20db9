"""Validation, packing, algebra, scoring and error paths on small fixtures."""

import itertools
import math
import random
import re
import time
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollframe.operators import algebra as B
from rollframe.operators import filters as FI
from rollframe.operators import format as M
from rollframe.functions.exprs import hash_uniform
from rollframe.operators import packing as P
from rollframe.operators import retrieval as RT
from rollframe.operators import run_metrics as R
from rollframe.operators import sampling as S
from rollframe.operators import scoring as SC
from rollframe.operators import shape as SH
from rollframe.operators import validation as V
from rollframe.operators.registry import GENERATORS, generate_after_batch, register_generator
from rollframe.sources import readers as RD
from rollframe.sources import writers as WR
from rollframe.streaming import freshness as FR


def metric(df, name):
    return {(r["data_source"], r["metric"]): r["value"] for r in df.collect()}[name]


def test_validation_golden(spark):
    s = spark.createDataFrame([("s1", "p1", "score", 0.8), ("s1", "p1", "score", 0.9), ("s2", "p2", "score", 0.7)], "data_source string, uid string, var string, value double")
    m = V.mean_std_at_n(s)
    assert metric(m, ("s1", "mean@2")) == pytest.approx(0.85) and metric(m, ("s1", "std@2")) == pytest.approx(0.05)
    assert ("s2", "std@1") not in {(r["data_source"], r["metric"]) for r in m.collect()}


def test_best_worst_is_the_exact_law(spark):
    x = [1.0, 2.0, 2.0, 4.0, 5.0]
    s = spark.createDataFrame([("s", "p", "v", v) for v in x], "data_source string, uid string, var string, value double")
    m = V.best_worst_at_n(s)
    draws = list(itertools.product(x, repeat=2))
    assert metric(m, ("s", "best@2/mean")) == pytest.approx(sum(max(d) for d in draws) / 25)
    assert metric(m, ("s", "worst@2/mean")) == pytest.approx(sum(min(d) for d in draws) / 25)
    assert {r["metric"].split("/")[0] for r in m.collect()} >= {"best@2", "best@4", "best@5"}


def test_majority_golden(spark):
    v = spark.createDataFrame([("s", 1, "A", 0.9, 0), ("s", 1, "B", 0.8, 1), ("s", 1, "A", 0.7, 2), ("s", 2, "A", 0.9, 0), ("s", 2, "B", 0.8, 1), ("s", 2, "B", 0.7, 2), ("s", 2, "A", 0.6, 3)],
                              "data_source string, uid long, pred string, value double, order long")
    assert {r["uid"]: r["value"] for r in V.majority_vote(v).collect()} == {1: 0.9, 2: 0.9}


def test_maj_at_two_is_near_its_law(spark):
    """Two draws: equal preds or a tie both give the first draw, so the mean is the plain mean."""
    r = spark.createDataFrame([("s", 1, i, "AB"[i % 2], float(i)) for i in range(6)], "data_source string, uid long, traj_id long, pred string, score double")
    m = V.maj_at_n(r, "score", n_boot=2000)
    assert metric(m, ("s", "maj@2/mean")) == pytest.approx(2.5, abs=0.15)


def vote_law(counts, n):
    """How likely each pred is to win ``n`` draws with replacement, over all sequences of draws."""
    size, wins = sum(counts), [0.0] * len(counts)
    for draws in itertools.product(range(len(counts)), repeat=n):
        seen = [draws.count(i) for i in range(len(counts))]
        first = next(i for i in draws if seen[i] == max(seen))
        wins[first] += math.prod(counts[i] / size for i in draws)
    return wins


@pytest.mark.parametrize("counts, n", [((3, 3), 2), ((5, 2, 1), 4), ((2, 2, 2, 1), 7), ((1, 1, 1, 1, 1), 5), ((7,), 3)])
def test_majority_shares_follow_the_law(counts, n):
    got = V.majority_shares(counts, n, 40_000, 7)
    assert sum(got) == pytest.approx(1)
    assert list(got) == pytest.approx(vote_law(counts, n), abs=0.01)


def test_binomials_are_the_inverse_of_their_sums():
    unit = np.array([1e-9, 0.1, 0.5, 0.9, 1 - 1e-9])
    for n, p in ((1, 0.5), (9, 0.2), (40, 0.97)):
        upto = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert V._binomial(np.full(5, n), p, unit).tolist() == [int((upto <= u).sum()) for u in unit]
    assert V._binomial(np.array([0, 3, 0]), 0.3, np.array([0.9, 0.99999, 0.1])).tolist() == [0, 3, 0]
    draws = V._binomial(np.full(4000, 1 << 20), 0.25, (np.arange(4000) + 0.5) / 4000)
    assert draws.mean() == pytest.approx(1 << 18, rel=1e-3) and draws.std() == pytest.approx((3 / 16 * (1 << 20)) ** 0.5, rel=0.02)


def test_a_prompt_with_very_many_rollouts_costs_its_preds_only():
    start = time.perf_counter()
    got = V.majority_shares((40_000, 38_000, *[1] * 500), 65_536, 1000, 1)
    assert got[0] > 0.99 and time.perf_counter() - start < 20


def test_counted_results_merge_to_those_of_one_run(spark):
    """Mean, std, best, worst and majority of parts in any split and order; null preds and values among them."""
    rnd = random.Random(9)
    rows = [("s", g, g * 100 + i, rnd.choice(["A", "B", None, "C"]), rnd.choice([None, 0.0, 0.5, 1.0]), float(i)) for g in range(6) for i in range(3 * g + 1)]
    d = spark.createDataFrame(rows, "data_source string, uid long, traj_id long, pred string, score double, acc double")
    names = ["score", "acc"]
    show = lambda m: {(r["var"], r["metric"]): r["value"] for r in m.collect()}

    def counted(parts):
        values = V.merge_value_counts(*[V.value_counts(V.melt_vars(p, names)) for p in parts])
        return values, V.merge_vote_counts(*[V.vote_counts(p, names) for p in parts])

    whole = show(V.counts_to_metrics(V.value_counts(V.melt_vars(d, names)), V.vote_counts(d, names), 200))
    split = [d.where(F.col("traj_id") % 3 == k) for k in (2, 0, 1)]
    values, votes = counted(split)
    merged = show(V.counts_to_metrics(values, votes, 200))
    assert merged == pytest.approx(whole) and {m for _, m in whole} >= {"mean@4", "std@4", "best@2/mean", "worst@16/std", "maj@2/mean", "maj@16/std"}
    plain = show(V.mean_std_at_n(V.melt_vars(d, names)).unionByName(V.maj_at_n(d, names, 200)))
    assert {k: whole[k] for k in plain} == pytest.approx(plain)
    assert show(V.full_vote(votes.where("var = 'acc'"))) == pytest.approx(show(V.maj_full_vote(d, "acc")))


def test_throughput_and_timing_golden(spark):
    st = spark.createDataFrame([("gen", 0.5), ("ref", 0.3), ("values", 0.2), ("step", 2.0)], "stage string, seconds double")
    ro = spark.createDataFrame([(3, 3), (3, 3)], "prompt_len long, response_len long")
    t = {r["name"]: r["value"] for r in R.timing_metrics(st, ro).collect()}
    assert t["timing_per_token_ms/gen"] == pytest.approx(0.5 * 1000 / 6) and t["timing_per_token_ms/ref"] == pytest.approx(0.3 * 1000 / 12)
    big = spark.createDataFrame([(100, 200), (100, 200)], "prompt_len long, response_len long")
    for workers, want in ((1, 300.0), (2, 150.0)):
        assert {r["name"]: r["value"] for r in R.throughput_metrics(st, big, workers).collect()}["perf/throughput"] == want


def test_all_aborted_is_an_error(spark):
    t = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)], "traj_id long, t long, mask int, token_score double, token_reward double, advantage double, return double, value double")
    ro = spark.createDataFrame([(1, 2, 0)], "traj_id long, prompt_len long, response_len long")
    with pytest.raises(Exception, match="all rollouts are aborted"):
        R.data_metrics(t, ro, 4, 4).collect()


def test_exact_percentiles(spark):
    import numpy as np

    x = np.random.default_rng(0).integers(0, 50, 301).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = R.exact_percentiles(df, "x", (0.5, 0.95, 0.99)).first()
    assert list(r) == pytest.approx(list(np.percentile(x, [50, 95, 99])))


# ---------------------------------------------------------------- packing
@pytest.mark.parametrize("equal", [True, False])
def test_differencing_invariants(equal):
    rnd = random.Random(0)
    for _ in range(30):
        k = rnd.choice([2, 3, 4, 8])
        w = [rnd.randrange(1, 500) for _ in range(k * rnd.randrange(1, 20))]
        part = P.differencing(w, k, equal)
        load = [sum(x for x, p in zip(w, part) if p == q) for q in range(k)]
        assert set(part) == set(range(k))
        if equal:
            assert all(part.count(q) == len(w) // k for q in range(k))
        assert max(load) - min(load) <= max(w)
    with pytest.raises(ValueError):
        P.differencing([1], 2, False)
    with pytest.raises(ValueError):
        P.differencing([1, 2, 3], 2, True)


def lengths(spark, n=200, size=20):
    rnd = random.Random(4)
    return spark.createDataFrame([(i // size, i, i // 4, rnd.randrange(1, 100)) for i in range(n)], "batch_id long, traj_id long, uid long, response_len long")


def test_partitions_cover_every_row_once(spark):
    d = lengths(spark)
    for out in (P.balance_partitions(d, 4, "response_len"), P.balance_partitions(d, 4, "response_len", method="serpentine"), P.greedy_partitions(d, 4, "response_len")):
        assert out.count() == 200 and out.select("traj_id").distinct().count() == 200
    b = P.balance_batch(d, 4, "response_len").groupBy("batch_id", "part").agg(F.count("slot").alias("n"), F.count_distinct("slot").alias("u"), F.max("slot").alias("m"))
    assert all(r["n"] == r["u"] == r["m"] + 1 == 5 for r in b.collect())


def test_probes_hold_few_rows_at_once(monkeypatch):
    """However many queries come at once and however many lists each of them reads; the rows are the same."""
    import pandas as pd

    rng = np.random.default_rng(3)
    lists = RT.Lists(RT.unit_rows(rng.normal(size=(16, 4))), np.ones(16, dtype="int64"), np.full(16, 3.0))
    chunk = pd.DataFrame({"qid": np.arange(50), "qv": list(rng.normal(size=(50, 4))), "kth": -1.0})
    want = pd.concat(RT._probe(lists, 4, True)([chunk]))
    monkeypatch.setattr(RT, "ASKED", 64)
    parts = list(RT._probe(lists, 4, True)([chunk]))
    assert max(map(len, parts)) <= 64 and len(want) == 50 * 12
    assert [(a, b) for p in parts for a, b in zip(p["qid"], p["list"])] == list(zip(want["qid"], want["list"]))


def test_batches_behind_a_join_stay_whole(spark):
    """The adaptive planner may broadcast the small side at run time and then reads the large one as it lies, unless a window asks for whole batches."""
    rows = 4000
    d = spark.range(rows, numPartitions=4).select(F.expr("id % 500").alias("batch_id"), F.col("id").alias("traj_id"), F.lit(1).alias("response_len"))
    whole = d.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).where("n = 8").select("batch_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    try:
        out = P.balance_partitions(d.join(whole, "batch_id"), 4, "response_len")
        assert "Window" in out._jdf.queryExecution().sparkPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(got) == rows and len({(r["batch_id"], r["part"]) for r in got}) == 500 * 4


@pytest.mark.parametrize("method", ["differencing", "serpentine"])
def test_shape_errors_at_every_size(spark, method):
    with pytest.raises(Exception, match="parts"):
        P.balance_partitions(lengths(spark, 10, 10), 4, "response_len", method=method).collect()
    with pytest.raises(Exception, match="parts"):
        P.balance_partitions(lengths(spark, 3, 3), 4, "response_len", equal_size=False, method=method).collect()


def test_group_balance_keeps_uids_whole(spark):
    d = spark.createDataFrame([(0, 4 * u + i, u, n) for u, n in enumerate((100, 200, 150, 50)) for i in range(4)], "batch_id long, traj_id long, uid long, response_len long")
    out = P.group_balance(d, 2, "response_len")
    assert out.groupBy("uid").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert sorted(r["n"] for r in out.groupBy("part").agg(F.count_distinct("uid").alias("n")).collect()) == [2, 2]


def test_pack_microbatches_budget(spark):
    d = lengths(spark)
    out = P.pack_microbatches(d, 250, "response_len", multiple=2)
    per = out.groupBy("batch_id").agg(F.count_distinct("micro_id").alias("k"), F.sum("response_len").alias("s")).collect()
    assert all(r["k"] % 2 == 0 and r["k"] >= -(-r["s"] // 250) for r in per)
    with pytest.raises(Exception, match="exceeds"):
        P.pack_microbatches(d, 50, "response_len").collect()


@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("k", [2, 4, 8])
def test_blocks_of_a_batch_merge_within_the_heaviest_row(spark, k, equal):
    rnd = random.Random(k)
    rows = [(b, i, rnd.choice([0, 1, 5, 40, 1000, 9000])) for b, n in ((1, 400), (2, 64), (3, 8 if equal else 11)) for i in range(n)]
    d = spark.createDataFrame(rows, "batch_id long, traj_id long, w long").repartition(3)
    got = P.balance_partitions(d, k, "w", equal_size=equal, method="blocks", block_rows=32).collect()
    assert sorted((r["batch_id"], r["traj_id"], r["w"]) for r in got) == sorted(rows)
    for b in (1, 2, 3):
        sums, counts = [0] * k, [0] * k
        for r in got:
            if r["batch_id"] == b:
                sums[r["part"]] += r["w"]
                counts[r["part"]] += 1
        assert max(sums) - min(sums) <= max(w for c, _, w in rows if c == b)
        assert not equal or len(set(counts)) == 1


def test_blocks_that_cannot_be_filled(spark):
    d = spark.createDataFrame([(1, i, 5) for i in range(10)], "batch_id long, traj_id long, w long")
    for k, equal, message in ((16, False, "cannot fill"), (4, True, "left over|not divisible")):
        with pytest.raises(Exception, match=message):
            P.balance_partitions(d, k, "w", equal_size=equal, method="blocks", block_rows=k * 2).collect()


def test_merged_solutions_keep_the_widest_spread():
    rnd = random.Random(5)
    for _ in range(200):
        k, blocks = rnd.randint(1, 6), rnd.randint(1, 9)
        sums = [[rnd.randint(0, 100) for _ in range(k)] for _ in range(blocks)]
        total = [0] * k
        for own, to in zip(sums, P.merge_solutions(sums)):
            assert sorted(to) == list(range(k))
            for part, at in enumerate(to):
                total[at] += own[part]
        assert max(total) - min(total) <= max(max(s) - min(s) for s in sums)


def test_sketched_percentiles_on_skewed_times(spark):
    """Merged in any order, with a hot group, many ties and a long tail, ranks stay within the stated error."""
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", rnd.choice([0.1, rnd.paretovariate(0.5), rnd.expovariate(1)])) for i in range(30_000)] + [("g1", None)]
    d = spark.createDataFrame(rows, "g string, processing_time double").withColumn("p", F.pmod(F.xxhash64("processing_time"), F.lit(4)))
    parts = [R.latency_sketches(d.where(F.col("p") == k), ["g"], size=256) for k in range(4)]
    values = {}
    for g, x in rows:
        if x is not None:
            values.setdefault(g, []).append(x)
    for order in (parts, parts[::-1]):
        for r in R.sketch_percentiles(R.merge_latency_sketches(*order, keys=["g"]), ["g"]).collect():
            own = values[r["g"]]
            assert (r["n"], r["min"], r["max"]) == (len(own), min(own), max(own)) and r["avg"] == pytest.approx(sum(own) / len(own))
            for p, got in ((0.5, r["tp50"]), (0.95, r["tp95"]), (0.99, r["tp99"])):
                low, high = sum(x < got for x in own) / len(own), sum(x <= got for x in own) / len(own)
                assert low - R.sketch_rank_error(256) <= p <= high + R.sketch_rank_error(256)


# ---------------------------------------------------------------- algebra
def test_union_conflict_and_missing_keys(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "traj_id long, x long")
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, spark.createDataFrame([(1, 5), (2, 7)], "traj_id long, x long"), "traj_id").collect()
    with pytest.raises(Exception, match="missing"):
        B.union_columns(a, spark.createDataFrame([(1, 5)], "traj_id long, x long"), "traj_id").collect()


def test_pad_cycles_and_unpads(spark):
    d = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    p = B.pad_to_divisor(d, "id", 8)
    assert [r["id"] for r in p.orderBy("pos").collect()] == [1, 2, 3, 1, 2, 3, 1, 2]
    assert sorted(r["id"] for r in B.unpad(p).collect()) == [1, 2, 3]


def test_slices_match_python(spark):
    d = spark.range(10)
    for cut in ((None, None, 1), (2, None, 1), (None, -3, 2), (-4, -1, 1), (1, 9, 3)):
        assert sorted(r["id"] for r in B.slice_rows(d, "id", *cut).collect()) == list(range(10))[slice(*cut)]


def test_indivisible_is_an_error(spark):
    d = spark.range(10)
    for bad in (lambda: B.chunk(d, "id", 3), lambda: B.minibatches(d, "id", 3), lambda: S.split_equal(d, "id", 3)):
        with pytest.raises(Exception, match="divi"):
            bad().collect()


def test_split_equal_spreads_a_remainder(spark):
    got = S.split_equal(spark.range(12), "id", 5, uneven=True).orderBy("id").collect()
    assert [r["part"] for r in got] == [i * 5 // 12 for i in range(12)]


def test_singletons_are_written_by_many_tasks(spark, tmp_path):
    """However few bytes there are: a task writes one file per question and split, and names it by its number."""
    d = spark.range(60).select(F.col("id").alias("question_id"), F.lit(0).alias("turn"))
    WR.write_singletons(d, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("question_id=*/split=*/part-*.json"))
    assert len(files) == 120 and len({f.name.split("-")[1] for f in files}) > 2
    back = spark.read.schema("question_id long, turn int, copy int, split string").json(str(tmp_path / "out"))
    assert back.where("split = 'train'").count() == 240 and back.where("split = 'test'").count() == 60


def test_singletons_come_back_as_written(spark, tmp_path):
    """Values that a folder's name can't hold, none and empty ones, other columns; no file but the two a question."""
    names = ["a/b", "a=b%", "ü ", "", None, "x:y", "{q}", "1", "a\\b"]
    rows = [(q, i, None if i % 3 else f"line {i}\n\u2028", [1.5, None]) for i, q in enumerate(names * 3)]
    d = spark.createDataFrame(rows, "question_id string, turn int, said string, more array<double>").repartition(5)
    out = str(tmp_path / "out")
    WR.write_singletons(d, out, copies=3)
    want = sorted((q or "", t, s or "", c, split) for q, t, s, _ in rows for split, c in [("train", 0), ("train", 1), ("train", 2), ("test", 0)])
    kind = "question_id string, turn int, said string, more array<double>, copy int, split string"
    for back in (RD.read_singletons(spark, out, kind), spark.read.schema(kind).json(out)):
        got = back.collect()
        assert sorted((r["question_id"] or "", r["turn"], r["said"] or "", r["copy"], r["split"]) for r in got) == want
        assert all(r["more"] == [1.5, None] for r in got)
    files = [f for f in (tmp_path / "out").rglob("*") if f.is_file() and f.name != "_SUCCESS"]
    assert len({f.parent for f in files}) == 2 * (len(names) - 1) and all(f.name.startswith("part-") for f in files)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        WR.write_singletons(d, out)


def test_singletons_of_nothing(spark, tmp_path):
    out, kind = str(tmp_path / "out"), "question_id long, turn int, copy int, split string"
    WR.write_singletons(spark.createDataFrame([], "question_id long, turn int"), out)
    assert RD.read_singletons(spark, out, kind).count() == 0


def test_frames_equal(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    assert B.frames_equal(a, a.repartition(3)).first()["equal"]
    assert not B.frames_equal(a, a.distinct()).first()["equal"]


def test_response_mask_example(spark):
    d = spark.createDataFrame([(0, i, t) for i, t in enumerate([20, 10, 34, 1, 0, 0, 0])], "traj_id long, t long, token long")
    assert [r["mask"] for r in SH.response_mask(d, [1]).orderBy("t").collect()] == [1, 1, 1, 1, 0, 0, 0]


def test_group_index_labels(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([2.0, 2.0, 5.0, 7.0000000001, 5.0, 2.0])], "i long, x double")
    assert SH.group_index(d, "x").select("group_no").distinct().count() == 3


# ---------------------------------------------------------------- text
def test_boxed_and_routes(spark):
    d = spark.createDataFrame([("math", "a \\boxed{\\frac{1}{2}} b", "\\frac{1}{2}")], "data_source string, response string, ground_truth string")
    assert SC.route_scores(d, SC.FEEDBACK_ROUTES).first()["result"]["score"] == 1.0
    with pytest.raises(Exception, match="no scorer"):
        SC.route_scores(d.withColumn("data_source", F.lit("x")), SC.FEEDBACK_ROUTES).collect()


def test_topk_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).astype("float32")
    v[7] = v[3]
    d = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    got = SC.topk_passages(d, d, 4, query_block=16, doc_block=9).collect()
    u = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    for q in range(60):
        want = sorted(range(60), key=lambda j: (-round(sims[q, j], 12), j))[:4]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def some_passages(spark, n=300, size=6, groups=9, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    v = (centres[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, size))).astype("float32")
    v[5] = 0
    v[40:60] = v[40]  # a vector that stands often
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None)]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def nearest_passages(v, k):
    u = v.astype("float64") / np.maximum(np.linalg.norm(v.astype("float64"), axis=1, keepdims=True), 1e-12)
    sims = np.round(u @ u.T, 9)
    return {q: [j for _, j in sorted((-sims[q, j], j) for j in range(len(v)) if j != q)[:k]] for q in range(len(v))}


@pytest.mark.parametrize("n_lists, doc_block, query_block", [(1, 50, 64), (12, 65536, 4096), (40, 7, 30), (300, 65536, 4096)])
def test_exact_search_by_lists_equals_brute_force(spark, n_lists, doc_block, query_block):
    v, d = some_passages(spark)
    got = {}
    for r in SC.topk_passages(d, d, 5, n_lists=n_lists, doc_block=doc_block, query_block=query_block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    assert {q: [found[i] for i in sorted(found)] for q, found in got.items()} == nearest_passages(v, 5)


def test_probing_a_few_lists_reads_few_documents_and_recalls_most(spark):
    v, d = some_passages(spark, 400, seed=8)
    exact = RT.topk_passages(d, d, 5)
    few = RT.topk_passages(d, d, 5, n_lists=12, probes=4)
    got = RT.recall_at_k(few, exact).first()
    assert got["queries"] == 400 and got["wanted"] == 2000 and got["recall"] >= 0.9
    listed, lists = RT.list_documents(d.where("embedding IS NOT NULL"), RT.train_centroids(d.where("embedding IS NOT NULL"), 400, 12, "embedding", "vec_id"), "embedding", "vec_id")
    assert lists.size.sum() == 400 and listed.count() == 400
    unit = RT.unit_rows(v)
    marks = lists.nearest(unit, 4)
    assert (marks.sum(1) <= 4).all() and (marks * lists.size).sum() < 0.6 * 400 * 400
    # no document of a list is nearer than the list's bound
    bounds, sims = lists.bounds(unit), unit @ unit.T
    for r in listed.select("did", "list").collect():
        assert (sims[:, r["did"]] <= bounds[:, r["list"]]).all()


def test_a_query_comes_once_to_a_block_of_lists():
    """With all the lists it reads there, as neighbouring lists share a block; a long list has blocks of its own."""
    import pyarrow as pa

    first, own, ranges = RT.block_lists(np.array([3, 4, 0, 2, 25, 9, 1, 0]), 10)
    assert ranges == [(0, 4), (4, 5), (4, 5), (4, 5), (5, 8)] and first.tolist() == [0, 0, 0, 0, 1, 4, 4, 4] and own.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]
    rng = np.random.default_rng(3)
    lists = RT.Lists(RT.unit_rows(rng.normal(size=(16, 4))), np.ones(16, dtype="int64"), np.full(16, 3.0))
    ranges = RT.block_lists(lists.size, 8)[2]
    vectors = pa.array(rng.normal(size=(50, 4)).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), vectors, pa.array([-1.0] * 50)], ["qid", "qv", "kth"])
    rows = pa.Table.from_batches(RT._ask(lists, ranges, 4, True, False)([batch])).to_pylist()
    assert len(rows) <= 2 * 50
    assert sum(bin(int.from_bytes(r["marks"], "big")).count("1") for r in rows) == 12 * 50
    counts = pa.Table.from_batches(RT._ask(lists, ranges, 4, True, True)([batch])).to_pylist()
    assert sum(r["n"] for r in counts) == len(rows)


@pytest.mark.parametrize("pairs, queries", [(1 << 21, 1024), (64, 5)])
def test_block_finds_the_nearest_among_copies(monkeypatch, pairs, queries):
    """Vectors that stand often, ids that repeat or are missing, and vectors without a finite number, whatever is held at once."""
    import pyarrow as pa

    monkeypatch.setattr(RT, "PAIRS", pairs)
    monkeypatch.setattr(RT, "QUERIES", queries)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(90, 6)).astype("float32")
    v[20:60], v[70], v[75, 2], v[88:] = v[20], 0, np.nan, v[20]
    did = [*range(86, 0, -1), 30, None, None, None]
    at = np.sort(rng.integers(0, 5, 90))
    docs = pa.table({"did": pa.array(did, pa.int64()), "dv": pa.array(v.tolist(), pa.list_(pa.float32())), "list": at})
    docs = docs.take(pa.array(rng.permutation(90)))
    marks = rng.random((90, 5)) < 0.7
    packed = [x.tobytes() for x in np.packbits(marks, axis=1)]
    asking = pa.table({"block": [0] * 90, "qid": pa.array([d or 500 for d in did], pa.int64()), "qv": pa.array(v.tolist(), pa.list_(pa.float32())), "kth": [float("-inf")] * 90, "marks": packed})
    found = RT._best(4, True, [(0, 5)])(asking, docs).to_pandas()
    unit = RT.unit_rows(v)
    want = []
    for q in range(90):
        ids = did[q] or 500
        hits = sorted((-round(float(unit[q] @ unit[j]), 9), did[j] or 1 << 60) for j in range(90) if marks[q, at[j]] and did[j] != ids and j != 75 and q != 75)
        want += [(ids, d, s) for s, d in hits[:4]]
    got = [(int(q), 1 << 60 if np.isnan(d) else int(d), -round(s, 9)) for q, d, s in zip(found["query_id"], found["doc_id"], found["score"])]
    assert sorted(got) == sorted(want)


def test_topk_of_nothing(spark):
    _, d = some_passages(spark, 60)
    assert SC.topk_passages(d, d.limit(0), 3).count() == 0 and SC.topk_passages(d.limit(0), d, 3).count() == 0


def test_topk_is_whole_when_k_exceeds_block(spark):
    d = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    assert SC.topk_passages(d, d, 10, doc_block=2).count() == 20


def test_blank_text_and_unknown_role(spark):
    with pytest.raises(Exception, match="blank"):
        FI.assert_nonblank(spark.createDataFrame([(" \n",)], "d string"), "d").collect()
    c = spark.createDataFrame([([("system", "x")],)], "conversations array<struct<from:string,value:string>>")
    with pytest.raises(Exception, match="unknown role"):
        M.sharegpt_to_messages(c).collect()


def test_unsupported_file(spark):
    with pytest.raises(ValueError, match="unsupported"):
        RD.read_prompts(spark, ["a.csv"])


def test_resample_hits_heavy_rows(spark):
    d = spark.createDataFrame([(i, 3.0 if i == 5 else 0.0) for i in range(400)], "traj_id long, score double")
    out = S.resample_by_score(d)
    assert out.count() == 400 and out.where("traj_id = 5").count() >= 399


@pytest.mark.parametrize("slots", [1, 3, 64])
def test_resample_draws_once_each_whatever_the_weights(spark, slots):
    """Weights from 1e-8 to 1e8 and one row with 99 % of the total, against a search in the running sums."""
    rnd = random.Random(6)
    scores = [rnd.choice([0.0, 1e-4, 1.0, 100.0, 1e4]) for _ in range(700)]
    scores[333] = (99 * sum(x * x for x in scores)) ** 0.5
    d = spark.createDataFrame([(f"id{i:04}", s) for i, s in enumerate(scores)], "traj_id string, score double")
    got = {r["draw"]: r["traj_id"] for r in S.resample_by_score(d, slots=slots).collect()}
    assert len(got) == 700 and S.resample_by_score(d, slots=slots).count() == 700
    total, ends = 0.0, []
    for s in scores:
        total += max(s * s + 1e-8, 1e-8)
        ends.append(total)
    unit = {r["traj_id"]: r["u"] for r in d.select("traj_id", hash_uniform("traj_id").alias("u")).collect()}
    agree = sum(got[f] == f"id{bisect_right(ends, u * total):04}" for f, u in unit.items())
    assert agree >= 698  # sums in another order may move a border by one bit


def test_samples_by_number(spark):
    d = spark.createDataFrame([(f"k{i}", f"t{i % 7}") for i in range(300)], "key string, text string")
    assert sorted(r["key"] for r in S.sample_n(d, "key", 5).collect()) == sorted(f"k{i}" for i in range(300))[:5]
    assert S.sample_n(d, "key", 40, True, 1).count() == 40 == S.sample_for_review(d, "text", "key", 40).count()


def test_generators(spark):
    f = lambda df: df.limit(1)
    GENERATORS.clear()
    register_generator("g", f)
    with pytest.raises(ValueError):
        register_generator("g", lambda df: df)
    d = spark.createDataFrame([(1, 10), (2, 20)], "id long, n long")
    assert generate_after_batch(d, "g", 15, F.col("n")).count() == 3


def test_staleness_limit():
    assert FR.staleness_limit(4, 0.5, 3) == 18


def test_results_list_as_python_prints_it(spark):
    actual = ["a", "it's", 'say "x"', "both ' and \"", "line\nnext\ttab", "back\\slash", None]
    d = spark.createDataFrame([(1, i, a, False) for i, a in enumerate(actual)], "traj_id long, test_idx long, actual string, passed boolean")
    assert SC.code_test_results(d).first()["pred"] == str(actual)
    none = SC.code_test_results(d, unparsed=spark.createDataFrame([(2,)], "traj_id long")).where("traj_id = 2").first()
    assert (none["score"], none["error_in_test_cases"], none["feedback"]) == (0.0, 1, "Failed to parse ground truth test cases.")


def test_folds_must_divide(spark):
    d = spark.createDataFrame([(i,) for i in range(10)], "traj_id long")
    assert sorted(r["fold_id"] for r in B.fold_rows(d, "traj_id", 5, ["traj_id"]).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="fold"):
        B.fold_rows(d, "traj_id", 4, ["traj_id"]).collect()


@pytest.mark.parametrize("line", [
    "-----Input:-----", "## Input format", "  == INPUT / OUTPUT ==", "Input and Output", "input specification", "Input section:",
    "Input - the first line holds n", "input: — a number",
    "------ Examples: ------", "EXAMPLES 2", "--- Example 1: ---", "# example", "As said, for  example : this", "text ```python", "a ----- b", "Input\r",
])
def test_lines_that_end_a_description(spark, line):
    d = spark.createDataFrame([(f"Find the sum of all numbers.\n{line}\nrest Input\n",)], "problem string")
    assert d.select(M.problem_description("problem").alias("d")).first()["d"].strip() == "Find the sum of all numbers."


@pytest.mark.parametrize("line", ["Inputs", "the input is n", "Examples of sums are many", "for example 3", "`` --- ``", "Input 5", "Sample: ----"])
def test_lines_that_do_not_end_a_description(spark, line):
    text = f"Find the sum of all numbers.\n{line}\nrest"
    d = spark.createDataFrame([(text,)], "problem string")
    assert d.select(M.problem_description("problem").alias("d")).first()["d"].strip() == text


def test_a_cache_in_buckets_is_never_shuffled(spark, tmp_path):
    name = "cache_" + tmp_path.name.replace("-", "_")
    texts = [f"t{i % 40}" for i in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sha = F.sha2("text", 256).alias("content_hash")
    old = d.where("id < 30").select(sha, F.lit(1.0).alias("result"))
    cache = SC.add_to_cache(old, name, str(tmp_path / "cache"), 4)
    calls = spark.sparkContext.accumulator(0)

    def count(t):
        calls.add(1)
        return 2.0

    score = lambda m: m.withColumn("result", F.udf(count, "double")("text"))
    scored, fresh = SC.score_cache(d, cache, score, ["text"], "id", buckets=4)
    got = {r["id"]: r["result"] for r in scored.collect()}
    assert got == {i: 1.0 if i % 40 < 30 else 2.0 for i in range(200)} and calls.value == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = SC.score_cache(d, cache, score, ["text"], "id", buckets=4)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth, above = re.search(r"\w", lines[at]).start(), []
    for line in reversed(lines[:at]):
        if re.search(r"\w", line).start() < depth:
            depth = re.search(r"\w", line).start()
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), text
    cache = SC.add_to_cache(fresh, name, str(tmp_path / "cache"), 4)
    again, none = SC.score_cache(d, cache, score, ["text"], "id", buckets=4)
    assert {r["id"]: r["result"] for r in again.collect()} == got and none.count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_folders_are_written_without_a_sort(spark, monkeypatch):
    """A task holds a file per folder open in place of a sort; the rows come back whole and the session's setting stays."""
    from pyspark.sql import DataFrameWriter

    from rollframe.session import OPEN_FILES, WRITERS, cut

    df = spark.range(1000).selectExpr("id", "id % 11 AS part", "cast(id AS string) AS text").repartition(3)
    write, held = DataFrameWriter.parquet, []

    def parquet(self, *args, **more):
        held.append(spark.conf.get(WRITERS))
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(WRITERS, None)
    few = cut(df.where("part < 2"), "part")
    many = cut(df, "part")  # more folders than open files
    cut(df.where("part < 2"))
    assert held[:2] == [OPEN_FILES] * 2 and int(OPEN_FILES) < 11 and spark.conf.get(WRITERS, None) == before
    assert sorted((r.id, r.part, r.text) for r in few.collect()) == [(i, i % 11, str(i)) for i in range(1000) if i % 11 < 2]
    assert sorted(r.id for r in many.collect()) == list(range(1000))
    spark.conf.set(WRITERS, "7")
    try:
        cut(df, "part")
        assert held[-1] == OPEN_FILES and spark.conf.get(WRITERS) == "7"
    finally:
        spark.conf.unset(WRITERS)
