"""Group reports: histograms, cross-tabs, summaries, rankings and change along a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.operators.ranking import top_per_group
from tutorgauge.operators.stats import row_mean


def histogram(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def teacher_by_base(df: DataFrame, bases: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Scores by teacher and base model in the given column order, with the mean over present cells."""
    bases = bases or fv.BASE_MODEL_ORDER
    wide = df.groupBy("teacher_model").pivot("base_model", bases).agg(F.first("pg_score", ignorenulls=True))
    quoted = [f"`{b}`" for b in bases]
    mean = row_mean(quoted)
    return wide.withColumn("mean", mean).select(
        "teacher_model", *[F.round(F.col(q), digits).alias(b) for q, b in zip(quoted, bases)], F.round("mean", digits).alias("mean")
    )


def teacher_summary(df: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, sample deviation, lowest and highest score of each teacher."""
    return df.groupBy("teacher_model").agg(
        F.round(F.avg("pg_score"), digits).alias("pg_score_mean"),
        F.round(F.stddev_samp("pg_score"), digits).alias("pg_score_std"),
        F.round(F.min("pg_score"), digits).alias("pg_score_min"),
        F.round(F.max("pg_score"), digits).alias("pg_score_max"),
        F.round(F.avg("pgr"), digits).alias("pgr_mean"),
        F.round(F.stddev_samp("pgr"), digits).alias("pgr_std"),
    )


def ranking_frequency(df: DataFrame) -> DataFrame:
    """How often each teacher comes first, and in the top three, over the base models."""
    best = top_per_group(df, ["base_model"], [F.desc("pg_score"), "teacher_model"], 3)
    placed = best.groupBy("teacher_model").agg(
        F.count_if(F.col("rank") == 1).alias("times_ranked_1st"), F.count(F.lit(1)).alias("times_in_top_3")
    )
    everyone = df.groupBy("teacher_model").agg(F.count_distinct("base_model").alias("base_models"))
    return everyone.join(placed, "teacher_model", "left").na.fill(0, ["times_ranked_1st", "times_in_top_3"])


def first_and_mean(df: DataFrame, by: str, constant: str, value: str = "pg_score") -> DataFrame:
    """A property that is constant in a group, next to the group's mean."""
    return df.groupBy(by).agg(F.first(constant, ignorenulls=True).alias(constant), F.avg(value).alias(value))


def mean_by_known_keys(df: DataFrame, keys: list[str], value: str = "pg_score") -> DataFrame:
    """Mean by several keys; rows with an unknown key are left out."""
    return df.na.drop("any", subset=keys).groupBy(*keys).agg(F.avg(value).alias(value))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, exact or sketched."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])


def span(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def method_means(df: DataFrame) -> DataFrame:
    return df.groupBy("translate_method").agg(F.avg("pg_score").alias("pg_score"))


def method_grid(df: DataFrame, languages: list[str]) -> DataFrame:
    """Score by translation method and language."""
    return df.groupBy("translate_method").pivot("target_lang", languages).agg(F.first("pg_score", ignorenulls=True))


def change_along(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Each step's value, the one before it and the difference.

    Steps are stages of one experiment chain: one row a stage.
    """
    w = Window.partitionBy(*(by or [])).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumns({"previous": before, "change": F.col(value) - before})


def ends_per_group(df: DataFrame, by: str, value: str, tie: str, n: int = 3) -> DataFrame:
    """First n and last n rows of each group by descending value; a short group shows rows twice."""
    top = top_per_group(df, [by], [F.desc(value), F.col(tie)], n).withColumn("part", F.lit("top"))
    low = top_per_group(df, [by], [F.asc(value), F.desc(tie)], n).withColumn("part", F.lit("bottom"))
    return top.unionByName(low)


def in_order(column: str, wanted: list[str]) -> Column:
    """Sort key for a given order of values; others come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in wanted]), F.col(column))
    return F.when(position > 0, position).otherwise(len(wanted) + 1)


def best_rows(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def wide_benchmarks(df: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row per model: score and stderr per benchmark and language, language means, overall mean.

    ``df`` has model_name, task, eval_lang and the metric map. A reward benchmark takes the weighted
    accuracy, or the plain one where the weighted is missing or 0.
    """
    languages = languages or fv.BENCHMARKED_LANGUAGES
    name = F.lit(None).cast("string")
    for part, wide in reversed(fv.WIDE_TASK_NAMES.items()):
        name = F.when(F.col("task").contains(part), F.lit(wide)).otherwise(name)
    at = lambda key: F.try_element_at("metrics", F.lit(key))
    nonzero = lambda a, b: F.coalesce(F.nullif(a, F.lit(0.0)), b)
    pick = lambda tail: (
        F.when(F.col("bench") == "mgsm", at(f"extractive_match{tail}"))
        .when(F.col("bench") == "mrewardbench", nonzero(at(f"weighted_acc{tail}"), at(f"acc{tail}")))
        .otherwise(at(f"acc{tail}"))
    )
    named = df.withColumn("bench", name).filter(F.col("bench").isNotNull())
    rows = named.select("model_name", F.concat_ws("_", "bench", "eval_lang").alias("cell"), pick("").alias("score"), pick("_stderr").alias("stderr"))
    cells = [f"{b}_{l}" for b in fv.WIDE_TASK_NAMES.values() for l in languages]
    wide = rows.groupBy("model_name").pivot("cell", cells).agg(
        F.first("score", ignorenulls=True).alias("score"), F.first("stderr", ignorenulls=True).alias("stderr")
    )
    for c in cells:
        wide = wide.withColumnsRenamed({f"{c}_score": c})
    means = {f"avg_{l}": row_mean([f"{b}_{l}" for b in fv.WIDE_TASK_NAMES.values()]) for l in languages}
    wide = wide.withColumns(means)
    return wide.withColumn("avg_all", row_mean([f"avg_{l}" for l in languages]))
