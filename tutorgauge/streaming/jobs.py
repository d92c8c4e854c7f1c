"""Incremental jobs: file source, checkpointed progress, restartable sinks."""

from __future__ import annotations


from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tutorgauge.operators.mergeable import Mergeable, merged, partial_sums
from tutorgauge.operators.metrics import distinct_ri_of_sums, vector_sums
from tutorgauge.operators.ranking import first_by_hash
from tutorgauge.operators.sampling import below_share
from tutorgauge.session import new_folder
from tutorgauge.sources.tables import exists


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are picked up by the next run."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_stream(df: DataFrame, path: str, progress: str) -> DataFrame:
    """Run a stateless stream over everything that is there, append to ``path`` exactly once, return the table."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path)


def partials(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The tables of all batches; without a batch so far an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def running_sums(df: DataFrame, by: list[str], sums: dict, path: str, progress: str) -> DataFrame:
    """Totals over a stream, kept as one small partial table per batch.

    A batch is summed in Spark and written to its own folder; a batch that is retried overwrites its
    folder, so each row counts once. The result adds the partials up. ``sums`` maps names to aggregates
    that may be added (sums and counts).
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(*[a.alias(n) for n, a in sums.items()]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    schema = df.groupBy(*by).agg(*[a.alias(n) for n, a in sums.items()]).schema
    return partials(df.sparkSession, path, schema).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])


def running_distinct_ri(df: DataFrame, by: list[str], vector: str, path: str, progress: str) -> DataFrame:
    """Distinct-RI over a stream: vector sums per batch in a folder of their own, added up to the metric."""

    def keep(batch: DataFrame, number: int) -> None:
        vector_sums(batch, by, {"x": vector}).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    parts = partials(df.sparkSession, path, vector_sums(df, by, {"x": vector}).schema)
    total = parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("directed_x").alias("directed_x"), Summarizer.sum(array_to_vector("sum_x")).alias("_s")
    )
    return distinct_ri_of_sums(total.select(*by, "n", "directed_x", vector_to_array("_s").alias("sum_x")), by, ["x"]).withColumnRenamed("x_distinct_ri", "distinct_ri")


def running(df: DataFrame, by: list[str], stats: list[Mergeable], path: str, progress: str) -> DataFrame:
    """Statistics over a stream, kept as one small table of partial sums per batch.

    A batch is one aggregate; its partials go to a folder of its own, which a retried batch overwrites, so every row
    counts once across failures and restarts. The result adds all partials up and equals the statistics of all rows in one batch.
    """

    def keep(batch: DataFrame, number: int) -> None:
        partial_sums(batch, by, stats).write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    empty = df.sparkSession.createDataFrame([], df.schema)
    return merged(partials(df.sparkSession, path, partial_sums(empty, by, stats).schema), by, stats)


def streamed_sample(df: DataFrame, n: int, id_col: str, seed: int, share: float, path: str, progress: str) -> DataFrame:
    """The first ``n`` rows of a stream in hash order: what a seeded shuffle-and-take of the finished table gives.

    The stream keeps the ``share`` with the smallest hashes, a filter without state; of that table the exact sample is taken. A share too small for
    ``n`` rows, while rows were left out, is an error; a share of 1 keeps all rows and never fails.
    """
    kept = append_stream(below_share(df, share, id_col, seed), path, progress)
    if share < 1 and kept.count() < n:
        raise ValueError(f"a share of {share} kept fewer than {n} rows: choose a larger one")
    return first_by_hash(kept, n, id_col, seed)


def stream_run(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and progress folders below the shared folder."""
    root = new_folder(spark, name)
    return f"{root}/out", f"{root}/progress"


