"""Ranks and quantiles against pandas and numpy, with hot values and many pieces."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tutorgauge.operators import ranking, stats
from tutorgauge.functions.significance import student_t_p
from tutorgauge.session import new_folder


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=3000), 2)
    x[::3] = 0.0  # one value holds a third of all rows
    return pd.DataFrame({"g": np.where(np.arange(3000) % 5 < 4, "a", "b"), "x": x, "y": x + np.round(rng.normal(size=3000), 1)})


@pytest.mark.parametrize("rows", [1_000_000, 200, 20, 1])
def test_average_rank(spark, values, rows):
    df = spark.createDataFrame(values)
    got = ranking.average_rank(df, "x", ["g"], "rk", rows).toPandas()
    want = values.assign(rk=values.groupby("g").x.rank()).drop_duplicates(["g", "x"])[["g", "x", "rk"]]
    pd.testing.assert_frame_equal(got.sort_values(["g", "x"]).reset_index(drop=True), want.sort_values(["g", "x"]).reset_index(drop=True))


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_exact_quantiles(spark, values, rows):
    probabilities = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = ranking.exact_quantiles(spark.createDataFrame(values), "y", probabilities, ["g"], rows).collect()
    for row in got:
        part = values[values.g == row.g].y
        assert row.n == len(part)
        assert row.q == pytest.approx(np.quantile(part, probabilities).tolist())
    whole = ranking.exact_quantiles(spark.createDataFrame(values), "y", probabilities, piece_rows=rows).first()
    assert whole.q == pytest.approx(np.quantile(values.y, probabilities).tolist())


def test_spearman(spark, values):
    df = spark.createDataFrame(values)
    got = {r.g: r for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    for g, part in values.groupby("g"):
        assert got[g].rho == pytest.approx(np.corrcoef(part.x.rank(), part.y.rank())[0, 1])
        assert got[g].n == len(part)


def test_spearman_edges(spark):
    rows = [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("one", 1.0, 1.0), ("same", 1.0, 1.0), ("same", 1.0, 2.0), ("same", 1.0, 3.0), ("gap", 1.0, None), ("gap", 2.0, 1.0), ("gap", 3.0, 5.0), ("gap", float("nan"), 5.0), ("gap", 4.0, 9.0)]
    got = {r.g: r for r in stats.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"], 1).collect()}
    assert got["two"].rho == -1.0 and got["two"].p is None
    assert got["one"].rho is None and got["same"].rho is None
    assert got["gap"].n == 3 and got["gap"].rho == pytest.approx(1.0)


def test_p_values():
    assert student_t_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert student_t_p(0.0, 5) == pytest.approx(1.0)
    assert student_t_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert student_t_p(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert student_t_p(-4.0, 3) == pytest.approx(0.0280084, abs=1e-6)


def test_linear_fit(spark, values):
    got = stats.linear_fit(spark.createDataFrame(values), "x", "y").first()
    slope, intercept = np.polyfit(values.x, values.y, 1)
    miss = values.y - slope * values.x - intercept
    stderr = np.sqrt((miss**2).sum() / (len(values) - 2) / ((values.x - values.x.mean()) ** 2).sum())
    assert (got.slope, got.intercept, got.stderr) == pytest.approx((slope, intercept, stderr))


def test_quantile_classes_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3]], "v double")
    codes = pd.qcut(pd.Series([1, 1, 1, 1, 2, 3]), q=3, labels=False, duplicates="drop").tolist()
    got = [r.size_class for r in stats.quantile_classes(df, "v").orderBy("v").collect()]
    assert got == codes


def test_box_stats(spark):
    data = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("b", v) for v in data] + [(None, 5.0)], "bin string, v double")
    got = stats.box_stats(df, "bin", "v").first()
    assert (got.q1, got.median, got.q3, got.whisker_low, got.whisker_high, got.n_outliers, got.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 1, 5)


def test_numbering_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RUN_BITS", 4)
    df = spark.range(3000, numPartitions=7).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'hot', cast(id as string))) g", "id number", "id _n")
    got = ranking.numbered(df.drop("number"), ["g"], "number").toPandas()
    assert len(got) == 3000 and sorted(got["_n"]) == list(range(3000))
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part["number"]) == list(range(1, len(part) + 1))
    assert ranking.numbered(df.drop("number").limit(0), ["g"], "number").count() == 0


def test_ranks_read_their_input_once(spark):
    """What is ranked afterwards is the settled table of counts: the input is not in the plan any more."""
    path = new_folder(spark, "t")
    spark.range(2000).selectExpr("id % 300 x", "if(id % 3 = 0, null, 'g') g").write.parquet(path)
    for rows in (1_000_000, 50):
        got = ranking.cumulative_counts(spark.read.parquet(path), "x", ["g"], rows)
        assert path not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.g: r.e for r in got.groupBy("g").agg(F.max("_end").alias("e")).collect()} == {None: 667, "g": 1333}
        assert {(r.g, r["_n"]) for r in got.collect()} == {(None, 667), ("g", 1333)}
    assert ranking.cumulative_counts(spark.read.parquet(path).limit(0), "x", ["g"]).count() == 0
    assert ranking.exact_quantiles(spark.read.parquet(path).limit(0), "x", [0.5]).count() == 0


def test_ranges_of_one_group_lie_in_many_tasks(spark):
    df = spark.range(5000).selectExpr("cast(id as double) x")
    placed = ranking.cumulative_counts(df, "x", piece_rows=500)
    assert [(int(r.x), r["_end"]) for r in placed.orderBy("x").collect()] == [(i, i + 1) for i in range(5000)]
