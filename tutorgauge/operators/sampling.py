"""Samples of exact size. Which rows are drawn follows from md5(seed|id) alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge.functions.hashing import hash_number, seeded_hash
from tutorgauge.operators.filters import require_columns
from tutorgauge.operators.joins import with_group_keys
from tutorgauge.operators.ranking import first_by_hash, take_by_hash


def strategy_quotas(df: DataFrame, total: int, strategy: str = "strategy", by: list[str] | None = None) -> DataFrame:
    """How many rows each strategy gives: an equal share, then the rest from those with most to spare.

    Works on one counted row per strategy (and per ``by`` group).
    """
    by = list(by or [])
    counts = df.filter(F.col(strategy).isNotNull()).groupBy(*by, strategy).agg(F.count(F.lit(1)).alias("available"))
    group = Window.partitionBy(*by)
    counts = (
        counts.withColumn("_share", F.floor(F.lit(total) / F.count(F.lit(1)).over(group)))
        .withColumn("_taken", F.least("_share", "available"))
        .withColumn("_spare", F.col("available") - F.col("_taken"))
        .withColumn("_open", F.lit(total) - F.sum("_taken").over(group))
    )
    earlier = group.orderBy(F.desc("_spare"), strategy).rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least("_spare", F.col("_open") - F.coalesce(F.sum("_spare").over(earlier), F.lit(0))))
    return counts.select(*by, strategy, "available", (F.col("_taken") + extra).cast("bigint").alias("quota"))


def balanced_subsample(df: DataFrame, total: int = 10_000, strategy: str = "strategy", by: list[str] | None = None, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``total`` rows (per ``by`` group), spread over strategies as evenly as their sizes allow. A null group is one like others."""
    require_columns(df, strategy, id_col)
    rows, groups = with_group_keys(df, list(by or []))
    quotas = strategy_quotas(rows, total, strategy, groups).drop("available")
    return take_by_hash(rows, quotas, [*groups, strategy], id_col, seed).select(df.columns)


def sample_per_group(df: DataFrame, n: int, by: str = "model", id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows of each group, or all of a smaller one."""
    quotas = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.lit(n).cast("bigint").alias("quota"))
    return take_by_hash(df, quotas, [by], id_col, seed)


def shortages(df: DataFrame, n: int, by: str = "model") -> DataFrame:
    """Groups with fewer than n rows, and how many they have."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("available")).filter(F.col("available") < n)


def shuffle_take(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Seeded shuffle, then the first n rows or all of a smaller table."""
    return first_by_hash(df, n, id_col, seed)


def train_validation(df: DataFrame, share: float = 0.95, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly floor(share * rows) rows are train, the others validation."""
    marked = first_by_hash(df, None, id_col, seed, share=share, flag="_train")
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("validation")).drop("_train")


def share_by_hash(df: DataFrame, share: float, id_col: str = "id", seed: int = 42) -> DataFrame:
    """About ``share`` of the rows in one pass, usable on a stream."""
    million = 1_000_000
    return df.filter(F.pmod(hash_number(seeded_hash(seed, id_col)), F.lit(million)) < int(share * million))


def below_share(df: DataFrame, share: float, id_col: str = "id", seed: int = 42) -> DataFrame:
    """The rows whose hash lies in the lowest ``share`` of all hashes; a filter, so it works on a stream.

    The order is that of ``shuffle_take``: the first rows of the whole table are the first of these.
    """
    if share >= 1:
        return df
    return df.filter(F.substring(seeded_hash(seed, id_col), 1, 8) < f"{int(share * (1 << 32)):08x}")
