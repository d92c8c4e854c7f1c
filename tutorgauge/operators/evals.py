"""Scoring of benchmark responses that are given as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice_accuracy(df: DataFrame, by: list[str], logp: str = "logp", n_tokens: str = "n_tokens", n_chars: str = "n_chars", logp_uncond: str = "logp_uncond", gold: str = "gold_idx") -> DataFrame:
    """Share of rows whose best choice is the gold one, under three normalisations of log-likelihood."""
    per = lambda a, b: F.zip_with(a, b, F.try_divide)
    scores = {
        "acc_norm_token": per(logp, n_tokens),
        "acc_norm_char": per(logp, n_chars),
        "acc_norm_pmi": F.zip_with(logp, logp_uncond, lambda x, y: x - y),
    }
    best = lambda a: F.array_position(a, F.array_max(a)) - 1
    hits = df.select(*by, *[(best(s) == F.col(gold)).cast("double").alias(k) for k, s in scores.items()])
    return hits.groupBy(*by).agg(*[F.avg(k).alias(k) for k in scores], F.count(F.lit(1)).alias("n"))


def verdict(text: Column) -> Column:
    """Index of the first A or B in an answer (A is 0); -1 where there is none."""
    mark = F.regexp_extract(F.upper(F.trim(text)), "[AB]", 0)
    return F.when(mark == "A", 0).when(mark == "B", 1).otherwise(-1)


def verdict_accuracy(df: DataFrame, by: list[str], text: str, gold: str) -> DataFrame:
    hit = F.coalesce((verdict(F.col(text)) == F.col(gold)).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(hit).alias("acc"), F.count(F.lit(1)).alias("n"))


def first_number(text: Column) -> Column:
    """The first number in a text, thousands separators removed; null where there is none."""
    found = F.regexp_extract(text, r"-?\d+(?:,\d{3})*(?:\.\d+)?", 0)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def number_match(text: Column, gold: Column, precision: int = 2) -> Column:
    """1 where the first number equals the gold number to ``precision`` digits, else 0."""
    equal = F.round(first_number(text), precision) == F.round(gold, precision)
    return F.coalesce(equal.cast("int"), F.lit(0))


def category_accuracy(df: DataFrame, categories: DataFrame, by: list[str], source: str = "source", hit: str = "hit") -> DataFrame:
    """Accuracy per category of sources; ``categories`` has source, category and weight."""
    tagged = df.join(categories.withColumnRenamed("source", source), source)
    return tagged.groupBy(*by, "category").agg(F.avg(hit).alias("acc"), F.avg("weight").alias("weight"))


def weighted_accuracy(df: DataFrame, categories: DataFrame, by: list[str], source: str = "source", hit: str = "hit") -> DataFrame:
    """Category accuracies joined by their weights."""
    per = category_accuracy(df, categories, by, source, hit)
    return per.groupBy(*by).agg(F.try_divide(F.sum(F.col("weight") * F.col("acc")), F.sum("weight")).alias("weighted_acc"))


def mean_and_stderr(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error of a metric."""
    return df.groupBy(*by).agg(
        F.avg(value).alias(value),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias(f"{value}_stderr"),
        F.count(value).alias("n"),
    )


def macro_average(df: DataFrame, task: str = "task", measures: tuple[str, ...] = ("acc", "acc_stderr")) -> DataFrame:
    """Plain mean over the sub-tasks ``name:part`` of a task, named ``name:_average``."""
    parts = df.filter(F.col(task).contains(":") & ~F.col(task).endswith(":_average"))
    name = F.substring_index(task, ":", 1)
    return parts.groupBy(F.concat(name, F.lit(":_average")).alias(task)).agg(*[F.avg(m).alias(m) for m in measures])


def category_rollup(scores: DataFrame, members: DataFrame, by: list[str], task: str = "task", value: str = "acc") -> DataFrame:
    """Averages by task, by category and over all, from one aggregate over grouping sets.

    ``members`` is an input table (task, category, weight): a task may be in several categories, with a weight in each. A category is the weighted mean of its
    members that were scored. The whole is the mean over tasks, in or out of categories, each of them once. ``n_tasks`` counts scored tasks,
    ``n_missing`` members without a score in the group; a category of which no member was scored has no row. Rows of a task are averaged first;
    a null or NaN value is no score. Pairs of ``members`` must be unique, and its categories not null.
    """
    score = F.col(value).cast("double")
    each = scores.groupBy(*by, task).agg(F.avg(F.when(~F.isnan(score), score)).alias("_acc")).filter("_acc IS NOT NULL")
    known = members.select(F.col("task").alias(task), "category", F.col("weight").cast("double").alias("_weight"))
    shares = known.groupBy(task).agg((1 / F.count(F.lit(1))).alias("_share"))
    rows = each.join(known.join(shares, task), task, "left").withColumn("_share", F.coalesce("_share", F.lit(1.0)))
    sets = [[*by, task], [*by, "category"], list(by)]
    weighted = lambda w: F.try_divide(F.sum(F.col(w) * F.col("_acc")), F.sum(w))
    rolled = rows.groupingSets(sets, *by, task, "category").agg(
        F.grouping(task).alias("_no_task"), F.grouping("category").alias("_no_category"),
        F.avg("_acc").alias("_plain"), weighted("_weight").alias("_weighted"), weighted("_share").alias("_shared"),
        F.count(F.lit(1)).alias("_rows"), F.sum("_share").alias("_tasks"), F.sum(F.when(F.col("category").isNotNull(), F.col("_share"))).alias("_members"),
    )
    level = F.when(F.col("_no_task") == 0, "task").when(F.col("_no_category") == 0, "category").otherwise("all")
    rolled = rolled.withColumn("level", level).filter("level <> 'category' OR category IS NOT NULL")
    pick = lambda one, two, three: F.when(F.col("level") == "task", one).when(F.col("level") == "category", two).otherwise(three)
    whole = lambda c: F.round(c).cast("long")
    # how many members a category and the whole have: as many rows as there are categories
    wanted = known.groupBy(F.col("category").alias("_of")).agg(F.count(F.lit(1)).alias("_wanted"))
    wanted = wanted.unionByName(known.agg(F.lit(None).cast("string").alias("_of"), F.count_distinct(task).alias("_wanted")))
    met = rolled.join(wanted, (F.col("level") != "task") & F.col("category").eqNullSafe(F.col("_of")), "left")
    missing = pick(F.lit(0), F.col("_wanted") - F.col("_rows"), F.coalesce("_wanted", F.lit(0)) - F.coalesce(whole(F.col("_members")), F.lit(0)))
    return met.select(
        *by, "level", pick(F.col(task), F.col("category"), F.lit("all")).alias("name"), pick(F.col("_plain"), F.col("_weighted"), F.col("_shared")).alias(value),
        pick(F.lit(1), F.col("_rows"), whole(F.col("_tasks"))).cast("long").alias("n_tasks"), missing.cast("long").alias("n_missing"),
    )
