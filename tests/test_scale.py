"""Steps whose work per task must not grow with the table: boosted trees and streamed corpora."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.operators import boosting, models
from tutorgauge.operators.boosting import BoostedTreesRegressor
from tutorgauge.plans import queries_jobs
from tutorgauge.session import new_folder


def test_boosted_trees_are_those_of_spark_in_two_jobs_a_tree(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 4)), 2)
    y = x[:, 0] * x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=3000) / 5
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double")
    rows = rows.select(array_to_vector("x").alias("components"), "y").cache()
    spark.sparkContext.setJobGroup("trees", "trees")
    got = models._estimator("boosted", 3000, "y", 1.0).fit(rows)
    spark.sparkContext.setJobGroup("others", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 250  # Spark's own trees take three a tree
    want = GBTRegressor(featuresCol="components", labelCol="y", maxIter=100, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    a = np.array([r.prediction for r in got.transform(rows).select("prediction").collect()])
    b = np.array([r.prediction for r in want.transform(rows).select("prediction").collect()])
    assert a == pytest.approx(b, abs=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-6)
    rows.unpersist()


def test_borders_come_from_the_rows_that_spark_draws(spark):
    """Beyond 10,000 rows Spark places the borders of the bins by a draw; zeros are what is missing of its expected size."""
    x = F.array(F.rand(1), F.floor(F.rand(2) * 50) - 25.0, F.randn(3))
    rows = spark.range(0, 30_000, 1, 2).select(array_to_vector(x).alias("components"), (F.sin("id") + F.rand(4)).alias("y")).cache()
    a = BoostedTreesRegressor("components", "y", 3).fit(rows).transform(rows).select(F.col("prediction").alias("a"))
    b = GBTRegressor(featuresCol="components", labelCol="y", maxIter=3, maxDepth=3, stepSize=0.1, seed=42).fit(rows).transform(rows).select("prediction")
    assert [r.a for r in a.collect()] == pytest.approx([r.prediction for r in b.collect()], abs=1e-9)
    rows.unpersist()


def test_trees_of_a_small_table_start_one_task_a_pass(spark):
    rows = spark.range(0, 1000, 1, 8).select(array_to_vector(F.array(F.col("id") % 7 + 0.5, F.rand(3))).alias("components"), F.sin("id").alias("y")).persist()
    rows.count()
    spark.sparkContext.setJobGroup("passes", "passes")
    BoostedTreesRegressor("components", "y", 4).fit(rows)
    spark.sparkContext.setJobGroup("others", "others")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("passes") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks.count(1) >= 9 and sum(tasks) < 40
    assert [boosting._tasks(n, 12, 6) for n in (10, 600_000, 3_600_000, 40_000_000, 10**9)] == [1, 3, 6, 11, 12]
    rows.unpersist()


def test_streamed_corpus_is_not_gathered_in_three_files(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(queries_jobs, "new_folder", lambda s, name: folders.append(new_folder(s, name)) or folders[-1])
    raw = spark.range(0, 1200, 1, 12).select("id", F.concat(F.lit("t"), "id").alias("inputs"), F.lit("re").alias("targets"), F.lit("deu").alias("language"))
    got = queries_jobs.streamed_corpus(SimpleNamespace(spark=spark), raw, fv.AYA)
    assert got.count() == 1200
    assert len(spark.read.parquet(folders[0]).inputFiles()) == 12
    none = queries_jobs.streamed_corpus(SimpleNamespace(spark=spark), raw.limit(0), fv.AYA)
    assert none.count() == 0
