"""The stored metric table: upserts, partitions left alone, failures, reruns."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tutorgauge.session import new_folder
from tutorgauge.sources.metric_store import read_metrics, store_metrics

SCHEMA = "language string, model string, metric string, value double"
KEYS = ["language", "model", "metric"]


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(df):
    return {(r.language, r.model, r.metric): r.value for r in df.collect()}


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/language=*/*.parquet")}


def test_upsert_and_overwrite(spark):
    path = new_folder(spark, "t")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert read_metrics(spark, path, schema).count() == 0
    first = table(spark, ("de", "a", "length", 1.0), ("01", "a", "length", 2.0), (None, "a", "length", 3.0), ("de", None, "length", 4.0))
    want = content(first)
    assert content(store_metrics(first, path, KEYS, "language")) == want
    before = files(path)
    more = table(spark, ("de", "a", "length", 9.0), ("de", "a", "rubric", 5.0), (None, "a", "length", 9.0), ("de", None, "length", 9.0))
    want |= {("de", "a", "rubric"): 5.0}
    assert content(store_metrics(more, path, KEYS, "language")) == want
    after = files(path)
    same = lambda lang: {p for p in before if f"language={lang}/" in p} <= {p for p in after if before.get(p) == after[p]}
    assert same("01") and same("__HIVE_DEFAULT_PARTITION__") and not same("de")
    # nothing new: nothing is written
    assert content(store_metrics(more, path, KEYS, "language")) == want and files(path) == after
    want |= content(more)
    assert content(store_metrics(more, path, KEYS, "language", overwrite=True)) == want
    assert content(store_metrics(more, path, KEYS, "language", overwrite=True)) == want
    assert content(store_metrics(more.limit(0), path, KEYS, "language", overwrite=True)) == want


def test_failure_leaves_the_old_version(spark):
    path = new_folder(spark, "t")
    first = table(spark, *[("de", f"m{i}", "length", float(i)) for i in range(40)])
    want = content(store_metrics(first, path, KEYS, "language"))
    bad = first.withColumn("value", F.when(F.col("model") == "m17", F.raise_error(F.lit("lost")).cast("double")).otherwise(-1.0))
    with pytest.raises(Exception, match="lost"):
        store_metrics(bad, path, KEYS, "language", overwrite=True)
    assert content(read_metrics(spark, path, first.schema)) == want
    good = first.withColumn("value", F.lit(-1.0))
    assert set(content(store_metrics(good, path, KEYS, "language", overwrite=True)).values()) == {-1.0}


def test_failure_while_the_table_is_written(spark, monkeypatch):
    """Tasks write to a staging folder: a job that fails in them replaces nothing."""
    path = new_folder(spark, "t")
    first = table(spark, ("de", "a", "length", 1.0), ("fr", "a", "length", 2.0))
    want = content(store_metrics(first, path, KEYS, "language"))
    from tutorgauge.sources import metric_store

    fail = F.when(F.col("language") == "fr", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value"))
    monkeypatch.setattr(metric_store, "rebalanced", lambda df, keys: df.withColumn("value", fail))
    with pytest.raises(Exception, match="lost"):
        store_metrics(first.withColumn("value", F.lit(7.0)), path, KEYS, "language", overwrite=True)
    monkeypatch.undo()
    assert content(read_metrics(spark, path, first.schema)) == want


def test_refused(spark):
    path = new_folder(spark, "t")
    with pytest.raises(ValueError, match="repeat"):
        store_metrics(table(spark, ("de", "a", "x", 1.0), ("de", "a", "x", 2.0)), path, KEYS, "language")
    with pytest.raises(ValueError, match="one of the keys"):
        store_metrics(table(spark, ("de", "a", "x", 1.0)), path, ["model", "metric"], "language")
