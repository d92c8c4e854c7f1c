"""Scans and sinks of plain tables."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType



def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A short fixed table inside the plan."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; filters and column choice made later reach the files."""
    return spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """JSON-lines scan with a given schema (files differ in columns; absent ones are null).

    Text codecs gzip and bzip2 are read by file ending; zstd data belongs in parquet.
    """
    return spark.read.schema(ddl).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_labelled(spark: SparkSession, inputs: list[str], ddl: str, label: str = "base_model") -> DataFrame:
    """Union of ``<label>::<path>`` inputs with the label as a column; a missing path is an error."""
    parts = []
    for text in inputs:
        name, _, path = text.partition("::")
        if not path or not exists(spark, path):
            raise ValueError(f"Cannot find file or input: {text}")
        parts.append(read_json_lines(spark, path, ddl).withColumn(label, F.lit(name)))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing in a part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_constants(df: DataFrame, values: dict) -> DataFrame:
    """Attach constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def renamed(df: DataFrame, names: dict[str, str], copies: dict[str, str] | None = None) -> DataFrame:
    """Rename columns, then copy some: ``copies`` maps a new name to an existing one."""
    df = df.withColumnsRenamed(names)
    return df.withColumns({new: F.col(old) for new, old in (copies or {}).items()})


def keep_columns(df: DataFrame, wanted: list[str], overrides: dict[str, Column] | None = None) -> DataFrame:
    """The wanted columns that exist, some of them replaced."""
    return df.select([c for c in wanted if c in df.columns]).withColumns(overrides or {})


def dataset_names(df: DataFrame, part: str, without: str = "quant", column: str = "dataset") -> DataFrame:
    """Rows whose dataset name holds one text and not the other."""
    return df.filter(F.col(column).contains(part) & ~F.col(column).contains(without))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    if partition_by:
        rebalanced(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def rebalanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows brought together by key in even tasks: few files per partition, hot keys split over several tasks."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def append_table(new: DataFrame, path: str, out: str | None = None) -> str:
    """Existing rows plus new ones; returns the path that holds both.

    Equal schemas append in place. Otherwise the column union goes to ``out``, never over its own input.
    """
    spark = new.sparkSession
    if not exists(spark, path):
        write_table(new, path)
        return path
    old = spark.read.parquet(path)
    kinds = lambda d: sorted((f.name, f.dataType.simpleString()) for f in d.schema)
    if kinds(old) == kinds(new):
        new.select(*old.columns).write.mode("append").parquet(path)
        return path
    if out is None or out == path:
        raise ValueError("schemas differ: name another path for the union")
    write_table(old.unionByName(new, allowMissingColumns=True), out)
    return out


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cached_json(spark: SparkSession, path: str, ddl: str, build, use_cache: bool = True) -> DataFrame:
    """The table at ``path`` if it is there and wanted, else built and stored there first."""
    if not (use_cache and exists(spark, path)):
        write_json_lines(build(), path)
    return read_json_lines(spark, path, ddl)


def write_csv(df: DataFrame, path: str, blank: tuple[str, ...] = ()) -> None:
    """CSV with a header and empty columns to fill in by hand."""
    columns = df.withColumns({c: F.lit("") for c in blank}) if blank else df
    columns.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def write_missing_languages(df: DataFrame, path: str, key: str = "language") -> DataFrame:
    """Write one partition per language and leave languages that are already there untouched.

    Returns the whole release table.
    """
    spark = df.sparkSession
    done = partition_values(spark, path, key)
    # a null language is a partition like others, under the name that Spark gives it
    todo = df.filter(F.coalesce(~F.col(key).isin(done), F.lit(NULL_PARTITION not in done))) if done else df
    rebalanced(todo, [key]).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path)


def partition_values(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of a partition column, from the folder names alone."""
    if not exists(spark, path):
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries]
    return [unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{key}=")]
