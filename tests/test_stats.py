import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filingforge.operators import stats as S
from filingforge.operators import wide as W


@pytest.mark.parametrize("kind", ["spread", "ties", "small", "outliers"])
def test_describe_equals_pandas(spark, kind):
    pick = np.random.default_rng(1)
    values = {
        "spread": pick.normal(size=40_001), "ties": pick.integers(0, 3, size=30_000).astype(float),
        "small": np.array([3.0, 1.0, 2.0, 10.0]), "outliers": np.concatenate([np.zeros(20_000), pick.exponential(1e9, 10_000)]),
    }[kind]
    pdf = pd.DataFrame({"a": values, "b": -values[::-1]})
    pdf.loc[0, "b"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(7)
    want = pdf.describe()
    for row in S.profile_describe(df).collect():
        got = [row["count"], row["mean"], row["std"], row["min"], row["q25"], row["q50"], row["q75"], row["max"]]
        assert got == pytest.approx(list(want[row["column"]]), rel=1e-9, abs=1e-9)


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (None,)], "a double")
    row = S.profile_describe(df).first()
    want = pd.Series([1.0, 2.0, nan]).describe()
    assert [row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))
    assert {tuple(r) for r in S.histogram(df, "a", 4).collect()} == {(1, 1), (4, 1)}
    rows = spark.createDataFrame([("x", 1.0, 1.0), ("x", 2.0, 2.0), ("x", nan, 1.0), ("x", 5.0, nan)], "column string, value double, diff double")
    assert [tuple(r) for r in S.feature_correlation(rows, 1).collect()] == [("x", pytest.approx(1.0), 3)]


def test_quantiles_of_very_many_close_values_and_of_infinite_ones(spark):
    df = spark.range(1_000_000).selectExpr("0.5D + (id * 7919 % 1000003) * 1e-9D as a", "if(id % 4 = 0, double('inf'), if(id % 4 = 1, -double('inf'), cast(id as double))) as b")
    pdf = df.toPandas()
    shares = [0.0, 0.2, 0.5, 0.9, 1.0]
    for r in S.quantiles(df, ["a", "b"], shares).collect():
        want = np.sort(pdf[r.column].values)
        place = (len(want) - 1) * r.share
        low, high = want[int(np.floor(place))], want[int(np.ceil(place))]
        if np.isinf(low) and np.isinf(high) and low != high:
            continue
        assert r.quantile == (low if low == high else pytest.approx(low + (high - low) * (place % 1)))


def test_quantiles_of_a_hot_value(spark):
    df = spark.range(90_000).selectExpr("if(id % 3 = 0, 5.0D, cast(id as double)) as value")
    got = {r.share: r.quantile for r in S.quantiles(df, ["value"], [0.0, 0.1, 0.333, 0.5, 1.0]).collect()}
    values = [5.0 if i % 3 == 0 else float(i) for i in range(90_000)]
    assert got == pytest.approx({s: float(np.quantile(values, s)) for s in got})


def test_mean_difference_and_correlation(spark):
    pick = random.Random(5)
    rows = [(c, pick.choice([0.0, 1.0, 2.0, None]) if c != "flat" else 1.0, pick.choice([-2.0, 0.0, 3.0, None])) for c in ("x", "y", "flat") for _ in range(200)]
    rows += [("up", 1.0, 2.0)] * 5
    df = spark.createDataFrame(rows, "column string, value double, diff double")
    pdf = pd.DataFrame(rows, columns=["column", "value", "diff"])
    got = {r.column: r for r in S.mean_difference_by_sign(df).collect()}
    assert set(got) == {"x", "y", "flat"}
    for c in ("x", "y"):
        one = pdf[pdf.column == c].replace({"value": {0.0: np.nan}})
        want = one[one["diff"] > 0].value.mean() - one[one["diff"] < 0].value.mean()
        assert got[c].difference == pytest.approx(want) and got[c]["count"] == one.value.count()
    found = {r.column: r.correlation for r in S.feature_correlation(df, 100).collect()}
    assert set(found) == {"x", "y", "flat"} and found["flat"] is None
    assert found["x"] == pytest.approx(pdf[pdf.column == "x"][["value", "diff"]].corr().iloc[0, 1])


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    got = {r.bin: r["count"] for r in S.histogram(df, "v", 10).collect()}
    assert got == {b: 10 for b in range(1, 10)} | {10: 11}
    assert [tuple(r) for r in S.histogram(df.where("v = 3"), "v").collect()] == [(1, 1)]


def test_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "element string, value int")
    assert {tuple(r) for r in S.column_counts(rows).collect()} == {("a", 1), ("b", 2)}
    assert [tuple(r) for r in S.low_support_columns(rows, 1).collect()] == [("a", 1)]
    wide = spark.createDataFrame([("s", 1.0, None), ("t", 2.0, 3.0)], "symbol string, x double, y double")
    assert [tuple(r) for r in S.with_total_row(wide, "symbol").orderBy("symbol").collect()][0] == ("Total", 2.0, 1.0)
    assert [tuple(r) for r in S.profile_info(wide).collect()] == [("symbol", "string", 2), ("x", "double", 2), ("y", "double", 1)]
    words = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2)], "column_name string, count long")
    assert [tuple(r) for r in S.group_sum(words).collect()] == [("b", 1), ("a", 5)]


def test_batch_stats(spark):
    assert tuple(S.batch_stats(spark.createDataFrame([("success",)] * 3 + [("failed",)], "status string")).first()) == (4, 3, 1, 75.0)
    assert tuple(S.batch_stats(spark.createDataFrame([], "status string")).first()) == (0, 0, 0, 0.0)


def test_orders(spark):
    df = spark.createDataFrame([(1.0,), (-3.0,), (3.0,), (None,)], "diff double")
    assert [r[0] for r in S.sort_abs(df.where("diff is not null"), "diff").collect()] == [-3.0, 3.0, 1.0]
    assert [r[0] for r in S.largest_diffs(df, ["x"]).collect()] == [3.0, 1.0, -3.0, None]
    assert {tuple(r) for r in S.winners_losers(df).collect()} == {(True, 2), (False, 2)}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id")
    top = S.top_k(df, ["k"], [F.desc("id")], 2)
    assert sorted(r.id for r in top.collect()) == [996, 997, 998, 999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_merge_on(spark):
    left = spark.createDataFrame([("a", 1, 5), (None, 2, 6), ("z", 3, 7)], "symbol string, p int, l int")
    right = spark.createDataFrame([("a", 10, 50), (None, 20, 60)], "symbol string, p int, r int")
    inner = W.merge_on(left, right, ["symbol"])
    assert inner.columns == ["symbol", "p_x", "l", "p_y", "r"]
    assert {tuple(r) for r in inner.collect()} == {("a", 1, 5, 10, 50), (None, 2, 6, 20, 60)}
    assert W.merge_on(left, right, ["symbol"], "left").count() == 3


def test_union_hconcat_distinct(spark):
    a = spark.createDataFrame([(1, "x")], "i long, a string")
    b = spark.createDataFrame([(2, "y"), (5, "z")], "j long, b string")
    assert W.union_by_name(a, b, a).count() == 4
    assert {tuple(r) for r in W.hconcat(a, b, "i", "j").collect()} == {(0, 1, "x", 2, "y"), (1, None, None, 5, "z")}
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, "d")], "k string, n int, v string")
    assert {tuple(r) for r in W.distinct_on(rows, ["k"], [F.col("n")]).collect()} == {("k", 1, "a"), (None, 3, "c")}


@pytest.mark.parametrize("most", [50_000, 3])
def test_quantiles_take_few_passes_whatever_the_spread(spark, monkeypatch, most):
    monkeypatch.setattr(S, "_GATHERED", most)
    df = spark.range(200_000, numPartitions=8).selectExpr(
        "cast(id % 2 as double) AS two", "exp(cast(hash(id) as double) / 4e7) AS wide", "if(id % 3 = 0, 5.0, cast(id as double)) AS hot",
        "if(id % 10 = 0, null, cast(id % 7 as int)) AS few",
    )
    shares = [0.0, 0.25, 0.333, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.share): r.quantile for r in S.quantiles(df, df.columns, shares).collect()}
    rows = df.toPandas()
    assert got == pytest.approx({(c, s): float(np.quantile(rows[c].dropna(), s)) for c in df.columns for s in shares}, rel=1e-12)
