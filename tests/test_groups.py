"""The skew-safe building blocks equal plain windows, for any number of slots, with nulls, ties and text ids."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rollframe.functions import groups as G
from rollframe.functions import select as SEL

SLOTS = [1, 2, 7, 64, 500]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    # one key holds a third of the rows, ids are sparse with one outlier, many values tie, keys and values have nulls
    data = [
        (i * i * 7 + i if i else 1 << 60, None if i % 11 == 0 else 0 if i % 3 == 0 else rnd.randrange(1, 40), rnd.choice([None, *range(6)]), rnd.random())
        for i in range(900)
    ]
    df = spark.createDataFrame(data, "id long, k long, v long, x double")
    return df.withColumn("name", F.md5(F.col("id").cast("string"))).cache()


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    show = lambda df: sorted((tuple(r) for r in df.select(names).collect()), key=str)
    return show(a) == show(b)


def test_attach_group_stats(rows):
    got = G.attach_group_stats(rows, ["k"], [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")])
    want = rows.withColumn("s", F.sum("v").over(W.partitionBy("k"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("k")))
    assert same(got, want)


def test_slots_are_even_whatever_the_ids(rows):
    for order in ("id", "name"):
        sizes = [r["count"] for r in G.with_slot(rows, order, "s", 30).groupBy("s").count().collect()]
        assert len(sizes) > 20 and max(sizes) <= 4 * 30


def test_no_job_runs_while_a_plan_is_built(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    G.number_rows(rows, "name", "a", ["k"])
    G.rank_by_value(rows, "v", "id", "r", ["k"])
    G.attach_group_stats(rows, ["k"], [F.sum("v").alias("s")])
    G.number_by_hash(rows, ["id"])
    G.previous_value(rows, "id", "v", "p")
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("slots", SLOTS)
def test_number_rows(rows, keys, descending, slots):
    order = "name" if slots % 2 else "id"
    got = G.number_rows(rows, order, "rn", keys, slots, descending)
    along = F.desc(order) if descending else F.asc(order)
    want = rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(along)).cast("long"))
    assert same(got, want)


@pytest.mark.parametrize("slots", SLOTS)
def test_running_total_of_doubles(rows, slots):
    got = G.running_total(rows, ["k"], "id", {"c": F.col("x")}, slots).select("id", F.round("c", 9).alias("c"))
    want = rows.withColumn("c", F.sum("x").over(W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    assert same(got, want.select("id", F.round("c", 9).alias("c")))


@pytest.mark.parametrize("slots", SLOTS)
@pytest.mark.parametrize("descending", [False, True])
def test_rank_by_value(rows, slots, descending):
    got = G.rank_by_value(rows, "v", "id", "r", ["k"], descending, slots)
    order = F.desc("v") if descending else F.asc("v")
    want = rows.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(order, "id")).cast("long"))
    assert same(got, want)


@pytest.mark.parametrize("slots", [1, 64])
def test_rank_by_double_and_text_id(rows, slots):
    got = G.rank_by_value(rows, "x", "name", "r", [], False, slots)
    want = rows.withColumn("r", F.row_number().over(W.orderBy("x", "name")).cast("long"))
    assert same(got, want)


def test_number_by_hash_is_a_stable_permutation(rows):
    a = G.number_by_hash(rows, ["id"], 3).select("id", "rn")
    b = G.number_by_hash(rows.repartition(7), ["id"], 3).select("id", "rn")
    assert same(a, b)
    assert sorted(r["rn"] for r in a.collect()) == list(range(1, 901))


@pytest.mark.parametrize("slots", SLOTS)
def test_previous_value(rows, slots):
    got = G.previous_value(rows, "id", "v", "p", slots).select("id", "p")
    want = rows.withColumn("p", F.lag("v").over(W.orderBy("id"))).select("id", "p")
    assert same(got, want)


def test_empty_table(spark, rows):
    none = rows.limit(0)
    assert G.number_rows(none, "id").collect() == [] == G.rank_by_value(none, "v", "id").collect()
    assert G.previous_value(none, "id", "v", "p").collect() == []


@pytest.mark.parametrize("values", [
    [3.0], [1.0] * 50 + [2.0] * 3, [float(i * i) for i in range(200)], [1e308, -1e308, 0.0, 5e-324, 1e-310, 2e-310, -5e-324] * 3,
    [2.0**-i for i in range(300)], [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 20,
])
def test_kth_value_by_refinement(spark, values):
    d = spark.createDataFrame([(v,) for v in values + [None, float("nan")]], "x double").repartition(3)
    along = sorted(values)
    for k in {1, 2, len(values) // 2 + 1, len(values)}:
        if k <= len(values):
            v = along[k - 1]
            assert SEL.kth_value(d, "x", k) == (v, sum(x < v for x in values), values.count(v))
    assert SEL.kth_value(d, "x", len(values) + 1) is None


def test_first_rows_by_several_keys(spark):
    rows = [(i, float(i % 3), float((i * 7) % 5), float((i * 31) % 101)) for i in range(101)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double")
    for k in (1, 17, 34, 60, 101, 500):
        got = {r["id"] for r in d.where(SEL.among_first(d, ["a", "b", "c"], k)).collect()}
        assert got == {r[0] for r in sorted(rows, key=lambda r: r[1:])[:k]}


def test_tokens_are_dealt_over_as_many_tasks_as_their_rows_need(spark, tmp_path, monkeypatch):
    """What a task sorts stays bounded: more rows, more tasks; the rows are those of the undealt view."""
    from rollframe.functions import groups
    from rollframe.plans.views import tokens

    n = 300
    key = F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.expr("id div 4")).alias("l_orderkey")
    x = lambda m, name: (F.col("id") % m / 100.0).alias(name)
    spark.range(n).select(
        key, (F.col("id") % 5).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"), (F.col("id") % 4).alias("l_linenumber"), x(50, "l_quantity"), x(70, "l_extendedprice"),
        x(11, "l_discount"), x(9, "l_tax"), F.when(F.col("id") % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(n // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 6).alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    whole = sorted(tokens(spark, str(tmp_path)).collect())
    monkeypatch.setattr(groups, "TASK_ROWS", 20)
    dealt = tokens(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 15
    assert sorted(dealt.collect()) == whole and len(whole) == 294


def test_tokens_stay_dealt_where_the_session_has_many_partitions(spark, tmp_path, monkeypatch):
    """Many shuffle partitions are no bound by themselves: the adaptive planner merges them into a few large tasks."""
    from rollframe.functions import groups
    from rollframe.plans.views import tokens

    n = 400
    num = lambda name, m: (F.col("id") % m / 100.0).alias(name)
    spark.range(n).select(
        F.expr("id div 4").alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"), (F.col("id") % 4).alias("l_linenumber"),
        num("l_quantity", 50), num("l_extendedprice", 70), num("l_discount", 11), num("l_tax", 9), F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(n // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 6).alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(str(tmp_path / "orders.parquet"))
    whole = sorted(tokens(spark, str(tmp_path)).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(groups, "TASK_ROWS", 40)
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            dealt = tokens(spark, str(tmp_path))
            tasks = [r[0] for r in dealt.select(F.spark_partition_id()).collect()]
            assert max(tasks.count(t) for t in set(tasks)) <= 40
            assert sorted(dealt.collect()) == whole and len(whole) == n
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_deal_is_written_without_a_sort(spark, monkeypatch):
    """Beyond the bypass threshold a writing task would hold all its rows; a session with more partitions keeps its own."""
    monkeypatch.setattr(G, "TASK_ROWS", 3)
    d = spark.range(1000).withColumn("k", F.col("id") % 400)
    assert G.deal(d, 1000, "k").rdd.getNumPartitions() == 200
    assert G.deal(d, 30, "k").rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in G.deal(d, 1000, "k").collect()) == list(range(1000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "230")
    try:
        assert G.deal(d, 1000, "k").rdd.getNumPartitions() == 230
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
