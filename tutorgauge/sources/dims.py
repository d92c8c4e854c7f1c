"""Built-in model and language tables. Their size is fixed, so they are always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.names import short_model_name
from tutorgauge.schemas import LANGUAGE_DIM, MODEL_DIM
from tutorgauge.sources.tables import literal_table


def models(spark: SparkSession) -> DataFrame:
    """The known teachers; an unknown size is null."""
    rows = [
        (name, family, shown, None, size, context, None, languages, None, None, None, None, None, None)
        for name, family, shown, size, context, languages in fv.MODELS
    ]
    return literal_table(spark, rows, MODEL_DIM)


def languages(spark: SparkSession) -> DataFrame:
    rows = [(name, code, level, None, share, speakers) for name, code, level, share, speakers in fv.LANGUAGES]
    return literal_table(spark, rows, LANGUAGE_DIM)


def with_dimensions(scores: DataFrame) -> DataFrame:
    """Scores with the facts of their teacher and target language; unknown ones stay null."""
    spark = scores.sparkSession
    teacher = models(spark).select(
        short_model_name(F.col("name")).alias("teacher_model"), "model_family", "beautiful_name", "parameter_size"
    )
    language = languages(spark).select(
        F.col("iso_639_1").alias("target_lang"), F.col("name").alias("language_name"),
        "joshi_etal_resource_level", "pct_commoncrawl", "native_speakers_in_m",
    )
    return scores.join(F.broadcast(teacher), "teacher_model", "left").join(F.broadcast(language), "target_lang", "left")


def with_model_size(df: DataFrame) -> DataFrame:
    """Rows of teachers whose size is known, with the size and its logarithm."""
    known = df.filter(F.col("parameter_size").isNotNull())
    return known.withColumns({"model_size": F.col("parameter_size"), "log_model_size": F.log("parameter_size")})


def known_number(column):
    """A number held as text, null where the text is no number (such as ``Unknown``)."""
    return column.try_cast("double")
