"""Joins that broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tutorgauge.session import new_folder

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
EXPANSION = 4  # bytes in memory that one byte of a compressed file may stand for


def settled(df: DataFrame) -> DataFrame:
    """Compute an intermediate once, as a table in the shared folder: lineage ends there and its size is known."""
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def _hadoop(table: DataFrame):
    """Where a settled table lies, and the settings to reach it, as Hadoop objects."""
    spark = table.sparkSession
    return spark._jvm.org.apache.hadoop.fs.Path(table._settled_path), spark._jsparkSession.sessionState().newHadoopConf()


def released(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again: what was made of them must be settled itself.

    Only tables as ``settled`` returned them own a folder; others are left alone.
    """
    for table in tables:
        if hasattr(table, "_settled_path"):
            path, conf = _hadoop(table)
            path.getFileSystem(conf).delete(path, True)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Settle an aggregate and mark it for broadcast if the size of its files and its row count allow it.

    Rows are counted while they are written; none comes to the driver. A larger one stays a plain side of the join: shuffled, with hot keys split by AQE.
    """
    seen = Observation()
    table = settled(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    path, conf = _hadoop(table)
    if path.getFileSystem(conf).getContentSummary(path).getLength() * EXPANSION > max_bytes or seen.get["rows"] > max_rows:
        return table
    return F.broadcast(table)


def with_group_keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds a key column per group column that is never null, so that rows of a null group meet in joins."""
    names = [f"_key_{c}" for c in by]
    return df.withColumns({n: F.struct(F.col(c).alias("v")) for n, c in zip(names, by)}) if by else df, names


def left_join_unique(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str]) -> DataFrame:
    """Left join on keys of different names; right keys are dropped.

    A repeated right key is an error, since it would multiply left rows.
    """
    n = "_copies"
    others = [c for c in right.columns if c not in right_on]
    once = right.groupBy(*right_on).agg(F.count(F.lit(1)).alias(n), *[F.first(c).alias(c) for c in others])
    checked = once.select(
        *[F.col(r).alias(f"_r_{r}") for r in right_on],
        *[
            F.when(F.col(n) == 1, F.col(c)).otherwise(F.raise_error(F.lit("right join key repeats")).cast(right.schema[c].dataType)).alias(c)
            for c in others
        ],
    )
    on = [left[l] == checked[f"_r_{r}"] for l, r in zip(left_on, right_on)]
    return left.join(checked, on, "left").drop(*[f"_r_{r}" for r in right_on])


def self_pairs(df: DataFrame, key: str, label: str, value: str, anchor: str) -> DataFrame:
    """Rows of one label next to the rows of every other label with the same key."""
    one = df.filter(F.col(label) == anchor).select(key, F.col(value).alias(f"{value}_anchor"))
    rest = df.filter(F.col(label) != anchor).select(key, label, value)
    return rest.join(one, key, "inner")
