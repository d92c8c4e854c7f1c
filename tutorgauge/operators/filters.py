"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def forbid_name_part(name: str, part: str) -> str:
    """Guard for output names that later steps would mistake for another kind of table."""
    if part in name:
        raise ValueError(f"name must not contain {part!r}: {name}")
    return name


def matching(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows equal to every given value; a wanted None matches null. Unknown keys are an error."""
    require_columns(df, *wanted)
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True)))


def without_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with no null; NaN stays."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns or df.columns]))


def without_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with neither null nor NaN."""
    return df.na.drop("any", subset=columns)


def in_list(column: str, values: list) -> Column:
    return F.col(column).isin(list(values))


def in_table(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(keys, on, "left_semi")


def not_in_table(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def japanese_api_call(language: Column, prompt: Column) -> Column:
    """Japanese prompts that are title-lookup calls and not user requests."""
    low = F.lower(prompt)
    marked = reduce(lambda a, b: a | b, [low.contains(m) for m in fv.JAPANESE_API_MARKERS])
    return F.coalesce((language == "ja") & marked, F.lit(False))


def for_strategy(df: DataFrame, strategy: str, language: str) -> DataFrame:
    """Seeds that allow a strategy; the language must match except when translating."""
    keep = F.array_contains("strategy", strategy)
    return df.filter(keep if strategy == "translate" else keep & (F.col("language") == language))


def mean_without_nan(column: Column) -> Column:
    return F.avg(F.when(~F.isnan(column), column))


def count_nan(column: Column) -> Column:
    return F.count_if(F.coalesce(F.isnan(column), F.lit(False)))


def overwrite_cell(df: DataFrame, key: dict, column: str, value) -> DataFrame:
    """Set one column where all key columns match."""
    hit = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()])
    return df.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
