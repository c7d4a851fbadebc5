import random

import pytest
from pyspark.sql import functions as F

from filingforge.operators.ordered import attach, carry_forward, first_per_key, number_rows, running_total


def _rows(seed, n=600):
    """Every third row or more belongs to one hot key; order values leave gaps."""
    pick = random.Random(seed)
    orders = {}
    rows = []
    for _ in range(n):
        key = "hot" if pick.random() < 0.4 else f"k{pick.randrange(40)}"
        orders[key] = orders.get(key, -1) + pick.choice([1, 1, 1, 2, 9])
        rows.append((key, orders[key], pick.choice([None, None, None, pick.randrange(100)])))
    pick.shuffle(rows)
    return rows


def _by_key(rows):
    keys = {}
    for row in sorted(rows):
        keys.setdefault(row[0], []).append(row)
    return keys.values()


@pytest.mark.parametrize("shifts", [(), (2,), (5, 2), (7, 4, 1)])
@pytest.mark.parametrize("exclusive", [False, True])
def test_carry_forward(spark, shifts, exclusive):
    rows = _rows(1)
    want = set()
    for group in _by_key([(k, o, -1 if v is None else v) for k, o, v in rows]):
        known = None
        for key, order, value in group:
            before = known
            known = known if value == -1 else value
            want.add((key, order, before if exclusive else known))
    df = spark.createDataFrame(rows, "key string, ord long, v int")
    got = carry_forward(df, ["key"], "ord", "v", "out", exclusive, shifts).select("key", "ord", "out").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("shifts", [(), (3,), (6, 3)])
def test_running_total_and_number_rows(spark, shifts):
    rows = [(k, o, v or 0) for k, o, v in _rows(2)]
    want = set()
    for group in _by_key(rows):
        total = 0
        for n, (key, order, value) in enumerate(group):
            want.add((key, order, total, n))
            total += value
    df = spark.createDataFrame(rows, "key string, ord long, v int")
    got = number_rows(running_total(df, ["key"], "ord", "v", "t", shifts), ["key"], "ord", "n", shifts)
    assert {tuple(r) for r in got.select("key", "ord", "t", "n").collect()} == want


def test_number_rows_of_whole_frame(spark):
    df = spark.range(0, 50_000, 3).withColumn("x", F.col("id") * 7)
    got = number_rows(df, [], "id", "n", (12, 6))
    assert got.where("n != id div 3").count() == 0 and got.count() == df.count()


def test_number_rows_of_sparse_orders_fills_no_single_task(spark):
    df = spark.range(300_000).select(F.shiftrightunsigned(F.xxhash64("id"), 2).alias("ord"))
    got = number_rows(df.repartition(8), [], "ord", "n")
    ranks = sorted(r[0] for r in df.collect())
    assert [r.n for r in got.orderBy("ord").select("n").collect()] == list(range(len(ranks)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One task adds up the sizes of the ranges; no rows of the frame meet there.
    assert plan.count("SinglePartition") <= plan.count("Window ") and plan.count("HashAggregate") >= 2


def test_attach_keeps_every_row(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "key string, ord long, v int")
    known = df.groupBy("key").agg(F.count("*").alias("n"))
    got = attach(df, known, ["key"], "ord")
    assert got.count() == len(rows)
    assert got.groupBy("key").agg((F.max("n") - F.count("*")).alias("d")).where("d != 0").count() == 0


def test_first_per_key(spark):
    rows = _rows(4)
    df = spark.createDataFrame(rows, "key string, ord long, v int")
    got = {tuple(r) for r in first_per_key(df, ["key"], [F.col("ord")]).collect()}
    assert got == {tuple(group[0]) for group in ([sorted(g, key=lambda r: r[1]) for g in _group(rows)])}


def _group(rows):
    keys = {}
    for row in rows:
        keys.setdefault(row[0], []).append(row)
    return keys.values()


def test_same_result_at_any_partitioning(spark):
    rows = _rows(5)
    results = []
    for n in (1, 8, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = spark.createDataFrame(rows, "key string, ord long, v int").repartition(max(n // 8, 1))
        out = carry_forward(df, ["key"], "ord", "v", "out", shifts=(5, 2))
        results.append(sorted(map(tuple, out.select("key", "ord", F.coalesce("out", F.lit(-1))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]
