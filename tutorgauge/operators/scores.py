"""From metrics and benchmark results to the combined teacher score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.names import lookup, short_model_name
from tutorgauge.operators.joins import left_join_unique

INTRINSIC = ["prompts_distinct_ri", "responses_distinct_ri", "rubric_score", "perplexity"]


def _real(column: Column) -> Column:
    """Null in place of NaN, so that NaN does not enter a fit."""
    return F.when(~F.isnan(column), column)


def standardized(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None, suffix: str = "_z") -> DataFrame:
    """Columns to mean 0 and population deviation 1, over the table or per ``by`` group.

    Missing values stay out of the fit and stay missing; a constant column is only centred.
    """
    work = df.withColumns({f"_v_{k}": c.cast("double") for k, c in columns.items()})
    fits = [f for k in columns for f in (
        F.avg(_real(F.col(f"_v_{k}"))).alias(f"m_{k}"),
        F.stddev_pop(_real(F.col(f"_v_{k}"))).alias(f"s_{k}"),
    )]
    if by:
        work = work.join(work.groupBy(*by).agg(F.struct(*fits).alias("_fit")), by, "left")
    else:
        work = work.withColumn("_fit", work.agg(F.struct(*fits)).scalar())
    spread = lambda k: F.when(F.col(f"_fit.s_{k}") == 0, F.lit(1.0)).otherwise(F.col(f"_fit.s_{k}"))
    scaled = {f"{k}{suffix}": (F.col(f"_v_{k}") - F.col(f"_fit.m_{k}")) / spread(k) for k in columns}
    return work.withColumns(scaled).drop("_fit", *[f"_v_{k}" for k in columns])


def intrinsic_components(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four standardised intrinsic metrics; perplexity enters as -log(1 + p)."""
    columns = {c: F.col(c) for c in INTRINSIC}
    columns["perplexity"] = -F.log1p(F.col("perplexity"))
    return standardized(df, columns, by)


def intrinsic_zscore(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the four components; missing where any of them is."""
    parts = [F.col(f"{c}_z") for c in INTRINSIC]
    return intrinsic_components(df, by).withColumn("z_score", sum(parts[1:], parts[0]) / 4).drop(*[f"{c}_z" for c in INTRINSIC])


def dedupe_runs(df: DataFrame, by: list[str], run: str = "run", keep: str = "first") -> DataFrame:
    """One row per task: of the earliest run by name, or of the latest with ``keep='last'``.

    An aggregate with map-side combine, so repeated runs of one task never gather in one sort.
    """
    rest = [c for c in df.columns if c not in by and c != run]
    pick = F.min_by if keep == "first" else F.max_by
    edge = F.min if keep == "first" else F.max
    best = df.groupBy(*by).agg(edge(run).alias(run), pick(F.struct(*rest), F.col(run)).alias("_row"))
    return best.select(*by, run, "_row.*")


def headline_result(metrics: str = "metrics", task: str = "task") -> dict[str, Column]:
    """The metric a task is judged by, and its standard error; null for unknown tasks."""
    name = lookup(F.col(task), fv.HEADLINE_METRIC)
    return {
        "result": F.try_element_at(F.col(metrics), name),
        "result_stderr": F.try_element_at(F.col(metrics), F.concat(name, F.lit("_stderr"))),
    }


def known_tasks(task: str = "task") -> Column:
    return lookup(F.col(task), fv.HEADLINE_METRIC).isNotNull()


def unknown_task_counts(df: DataFrame, task: str = "task") -> DataFrame:
    """Tasks without a headline metric, which the score leaves out, and their number of rows."""
    return df.filter(~known_tasks(task)).groupBy(task).agg(F.count(F.lit(1)).alias("n"))


def target_language_mean(df: DataFrame, by: list[str] | None = None, measures: tuple[str, ...] = ("result", "result_stderr")) -> DataFrame:
    """Mean over rows evaluated in the target language; over the whole group where it has no such row."""
    by = by or ["teacher_model", "target_lang"]
    match = F.col("target_lang") == F.col("eval_lang")
    some = F.count_if(match) > 0
    return df.groupBy(*by).agg(
        *[F.when(some, F.avg(F.when(match, _real(F.col(m))))).otherwise(F.avg(_real(F.col(m)))).alias(m) for m in measures],
        (~some).alias("used_fallback"),
    )


def language_mean(df: DataFrame, out: str) -> DataFrame:
    return df.groupBy("eval_lang").agg(F.avg("result").alias(out))


def gain_recovered(df: DataFrame, base: DataFrame, reference: DataFrame) -> DataFrame:
    """PGR: the share of the way from base to reference that the student covers.

    Null where base and reference are equal or one of them is missing.
    """
    student = target_language_mean(df)
    for anchor, name in ((base, "base_perf"), (reference, "ref_perf")):
        right = language_mean(anchor, name).withColumnRenamed("eval_lang", "target_lang")
        student = student.join(right, "target_lang", "left")
    return student.withColumn("pgr", F.try_divide(F.col("result") - F.col("base_perf"), F.col("ref_perf") - F.col("base_perf"))).select(
        "teacher_model", "target_lang", "result", "result_stderr", "used_fallback", "pgr"
    )


def combined_score(extrinsic: DataFrame, intrinsic: DataFrame) -> DataFrame:
    """PG-Score: mean of gain recovered and intrinsic z-score; missing where either is."""
    z = intrinsic.select(short_model_name(F.col("model")).alias("model_short"), "language", "z_score")
    joined = left_join_unique(extrinsic, z, ["teacher_model", "target_lang"], ["model_short", "language"])
    return joined.withColumn("pg_score", (F.col("pgr") + F.col("z_score")) / 2)


def weighted_scores(df: DataFrame, alphas: list[float] | None = None, intrinsic: str = "z_score", extrinsic: str = "pgr") -> DataFrame:
    """One row per input row and weight: alpha on the intrinsic, the rest on the extrinsic side."""
    alphas = fv.ALPHAS if alphas is None else alphas
    each = df.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return each.withColumn("weighted", F.col("alpha") * F.col(intrinsic) + (1 - F.col("alpha")) * F.col(extrinsic))


def mean_scores(df: DataFrame, by: list[str], measures: tuple[str, ...] = ("pg_score", "result", "pgr")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures])


def score_report(df: DataFrame, measures: tuple[str, ...] = ("pg_score", "result", "pgr")) -> DataFrame:
    """Means per teacher and language, and per teacher (null language), in one pass."""
    return (
        df.rollup("teacher_model", "target_lang")
        .agg(*[F.avg(m).alias(m) for m in measures], F.grouping_id().alias("_level"))
        .filter("_level < 3")
        .withColumn("level", F.when(F.col("_level") == 0, "language").otherwise("teacher"))
        .drop("_level")
    )
