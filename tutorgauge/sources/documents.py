"""JSON documents: one per (language, teacher), and benchmark dumps held in string cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge.functions.names import metric_file_name, metric_file_name_short
from tutorgauge.operators.filters import without_missing
from tutorgauge.schemas import ABLATION_DOCUMENT, METRIC_DOCUMENT, TASK_METRICS


def write_documents(df: DataFrame, path: str, stem: str = "stem") -> None:
    """One folder ``stem=<name>`` per document, its row as JSON inside."""
    df.write.mode("overwrite").partitionBy(stem).json(path)


def document_stem() -> Column:
    """Name of the document a row was read from: its ``stem=`` folder, else its file name."""
    folder = F.regexp_extract("_metadata.file_path", r"/stem=([^/]+)/", 1)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return F.when(folder != "", F.url_decode(folder)).otherwise(name)


def read_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Whole-file JSON documents below ``path`` with their ``stem``."""
    # Reading the files and not the partition column keeps plain directories of files readable too.
    reader = spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True)
    return reader.json(path).select(document_stem().alias("stem"), "*")


def _metric_columns() -> list[Column]:
    return [
        F.col("distinct_ri.prompts_distinct_ri"),
        F.col("distinct_ri.responses_distinct_ri"),
        F.col("reward_model.average_rubric_score").alias("rubric_score"),
        F.col("perplexity.average_perplexity").alias("perplexity"),
    ]


def read_intrinsic(spark: SparkSession, path: str, tag: str, lineage: str = "S1") -> DataFrame:
    """Metric documents as one row per (language, model), in that order; a missing block is null."""
    docs = read_documents(spark, path, METRIC_DOCUMENT)
    rows = docs.select(*[c.alias(k) for k, c in metric_file_name(F.col("stem"), tag, lineage).items()], *_metric_columns())
    return rows.orderBy("language", "model")


def read_intrinsic_complete(spark: SparkSession, path: str) -> DataFrame:
    """Metric documents with all six features, names read by position; incomplete rows are left out."""
    docs = read_documents(spark, path, METRIC_DOCUMENT)
    names = {k: c.alias(k) for k, c in metric_file_name_short(F.col("stem")).items()}
    rows = docs.filter(F.size(F.split("stem", "_")) >= 3).select(
        names["teacher_model"],
        names["target_lang"],
        F.col("distinct_ri.prompts_distinct_ri"),
        F.col("distinct_ri.responses_distinct_ri"),
        F.col("perplexity.average_perplexity"),
        F.col("reward_model.average_rubric_score"),
        F.col("length.prompts_average_length"),
        F.col("length.responses_average_length"),
    )
    return without_missing(rows)


def read_ablations(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, filbench_score) per ablation document in name order; a missing score is 0."""
    docs = read_documents(spark, path, ABLATION_DOCUMENT)
    return docs.select(F.col("stem").alias("experiment"), F.coalesce("filbench_score", F.lit(0.0)).alias("filbench_score")).orderBy("experiment")


def per_instance(docs: DataFrame, metric: str, tag: str, lineage: str = "S1") -> DataFrame:
    """The rows inside metric documents: ``perplexity`` or ``rubric_score``."""
    blocks = {"perplexity": "perplexity.per_instance_perplexity", "rubric_score": "reward_model.per_instance_rubric_scores"}
    if metric not in blocks:
        raise ValueError(f"unsupported metric {metric!r}; supported: {sorted(blocks)}")
    names = [c.alias(k) for k, c in metric_file_name(F.col("stem"), tag, lineage).items()]
    return docs.select(*names, F.inline(blocks[metric]))


def exploded_results(df: DataFrame, results: str = "results") -> DataFrame:
    """One row per task of a ``results`` cell, without the pseudo-task ``all``."""
    keep = [c for c in df.columns if c != results]
    return df.select(*keep, F.explode(F.from_json(results, TASK_METRICS)).alias("eval", "metrics")).filter(F.col("eval") != "all")


def run_config(column: str = "config_general") -> dict[str, Column]:
    """Scalar settings of a run's JSON config cell."""
    return {k: F.get_json_object(column, f"$.{k}") for k in ("model_name", "model_dtype", "model_size")}
