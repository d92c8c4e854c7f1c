"""Metrics of many runs as a stored table (keys, metric, value), one partition per value of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tutorgauge.operators.joins import released, settled, with_group_keys
from tutorgauge.sources.tables import exists, rebalanced


def read_metrics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows; none where nothing has been stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _without(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose keys are not (or with ``left_semi``: are) in ``other``; null keys are equal to each other."""
    (df, names), (other, _) = with_group_keys(df, keys), with_group_keys(other.select(*keys).distinct(), keys)
    return df.join(other.select(*names), names, how).drop(*names)


def store_metrics(new: DataFrame, path: str, keys: list[str], partition: str, overwrite: bool = False) -> DataFrame:
    """Upsert ``new`` into the table at ``path`` and return the table.

    A key that is stored keeps its row unless ``overwrite``; the first write of a table merges like any other. Only partitions that change are
    written, in whole, and take the place of the old ones when the write job commits (dynamic partition overwrite). What they will hold is settled
    before the table is touched, so a failure up to the commit leaves the stored table as it was, and the same call can be run again:
    it ends with the same table. ``partition`` is one of ``keys``. Null keys are keys; a key that repeats in ``new`` is an error.
    Two writers of one partition at a time are not told apart: give them different partitions.
    """
    spark = new.sparkSession
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys {keys}")
    new = settled(new)
    if not new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"new metrics repeat a key of {keys}")
    old = read_metrics(spark, path, new.schema)
    fresh = new if overwrite else settled(_without(new, old, keys))
    beside = _without(_without(old, fresh, [partition], "left_semi"), fresh, keys)
    whole = settled(beside.unionByName(fresh))
    if not whole.isEmpty():
        rebalanced(whole, [partition]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        spark.catalog.refreshByPath(path)
    table = read_metrics(spark, path, new.schema)
    released(new, whole, *([] if overwrite else [fresh]))
    return table
