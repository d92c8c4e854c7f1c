"""Grouped statistics whose partial results can be added up: one aggregate for several of them, and the same over a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tutorgauge.functions.text import token_count
from tutorgauge.operators.filters import require_columns
from tutorgauge.operators.metrics import _directed, perplexity_of_losses, with_judge_feedback


@dataclass(frozen=True)
class Mergeable:
    """A statistic of a group as sums.

    ``prepare`` adds columns to rows; ``sums`` are numeric aggregates over them that may be added; ``vectors`` name vector columns to be
    added up, each with a flag column that says which rows have one (all vectors of a group that have the flag are of one length);
    ``finish`` makes the results from the added sums and vectors. All names a statistic adds must be its own.
    """

    prepare: Callable[[DataFrame], DataFrame]
    sums: dict[str, Column]
    finish: dict[str, Column]
    vectors: dict[str, str] = field(default_factory=dict)


def _prepared(df: DataFrame, stats: list[Mergeable]) -> DataFrame:
    for s in stats:
        df = s.prepare(df)
    return df


def _parts(stats: list[Mergeable]) -> tuple[dict[str, Column], dict[str, str]]:
    sums, vectors = {}, {}
    for s in stats:
        if sums.keys() & s.sums.keys() or vectors.keys() & s.vectors.keys():
            raise ValueError("two statistics use one name")
        sums |= s.sums
        vectors |= s.vectors
    return sums, vectors


def partial_sums(df: DataFrame, by: list[str], stats: list[Mergeable]) -> DataFrame:
    """One aggregate over one scan: the sums of all statistics per group, and per flag of a vector.

    Rows with and without a vector are groups of their own, so that every group adds vectors of one length.
    """
    sums, vectors = _parts(stats)
    flags = sorted(set(vectors.values()))
    added = {v: vector_to_array(Summarizer.sum(F.col(v))) for v in vectors}
    return _prepared(df, stats).groupBy(*by, *flags).agg(*[a.alias(n) for n, a in {**sums, **added}.items()])


def merged(parts: DataFrame, by: list[str], stats: list[Mergeable]) -> DataFrame:
    """Partial results added up and finished: one row per group. Partials of several batches may stand in one table."""
    sums, vectors = _parts(stats)
    flags = sorted(set(vectors.values()))
    if vectors:
        once = [vector_to_array(Summarizer.sum(array_to_vector(F.col(v)))).alias(v) for v in vectors]
        parts = parts.groupBy(*by, *flags).agg(*[F.sum(n).alias(n) for n in sums], *once)
    one = [F.max(F.when(F.col(flag), F.col(v))).alias(v) for v, flag in vectors.items()]
    total = parts.groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums], *one)
    return total.select(*by, *[c.alias(n) for s in stats for n, c in s.finish.items()])


def evaluated(df: DataFrame, by: list[str], stats: list[Mergeable]) -> DataFrame:
    """All statistics side by side, one row per group, from one scan."""
    return merged(partial_sums(df, by, stats), by, stats)


# --- the built-in metrics -----------------------------------------------------------


def distinct_ri_stat(prompts: str = "prompt_embedding", responses: str = "response_embedding") -> Mergeable:
    """Diversity of prompts and of responses; rows without one of the two embeddings count for neither."""
    embeddings = {"prompts": prompts, "responses": responses}

    def prepare(df: DataFrame) -> DataFrame:
        require_columns(df, *embeddings.values())
        there = F.lit(True)
        for c in embeddings.values():
            there = there & F.col(c).isNotNull()
        df = df.withColumn("_ri_there", there)
        for k, c in embeddings.items():
            plain = F.col(c).cast("array<double>")
            directed = F.col("_ri_there") & _directed(c)
            zeros = F.array_repeat(F.lit(0.0), F.size(plain))
            value = F.when(directed, plain).when(F.col("_ri_there"), zeros).otherwise(F.array(F.lit(0.0)))
            df = df.withColumns({f"_ri_directed_{k}": directed, f"_ri_raw_{k}": array_to_vector(value)})
            df = Normalizer(p=2.0, inputCol=f"_ri_raw_{k}", outputCol=f"_ri_unit_{k}").transform(df).drop(f"_ri_raw_{k}")
        return df

    n = F.col("_ri_n")
    length = lambda k: F.aggregate(f"_ri_unit_{k}", F.lit(0.0), lambda a, x: a + x * x)
    return Mergeable(
        prepare,
        {"_ri_n": F.count_if("_ri_there"), **{f"_ri_n_{k}": F.count_if(f"_ri_directed_{k}") for k in embeddings}},
        {f"{k}_distinct_ri": F.when(n > 1, 1 - (length(k) - F.col(f"_ri_n_{k}")) / (n * (n - 1.0))) for k in embeddings},
        {f"_ri_unit_{k}": "_ri_there" for k in embeddings},
    )


def perplexity_stat(losses: str = "losses", prompt_length: str = "prompt_length") -> Mergeable:
    """Mean perplexity of the rows that have one, and how many have none."""
    p = F.col("_ppl")
    nan = F.coalesce(F.isnan(p), F.lit(False))
    valid = p.isNotNull() & ~nan
    return Mergeable(
        lambda df: df.withColumn("_ppl", perplexity_of_losses(losses, prompt_length)),
        {"_ppl_sum": F.sum(F.when(valid, p)), "_ppl_valid": F.count_if(valid), "_ppl_nan": F.count_if(nan), "_ppl_rows": F.count(F.lit(1))},
        {
            "average_perplexity": F.try_divide("_ppl_sum", "_ppl_valid"), "num_valid_samples": F.col("_ppl_valid"),
            "num_nan_values": F.col("_ppl_nan"), "total_samples": F.col("_ppl_rows"),
        },
    )


def rubric_stat(raw: str = "raw") -> Mergeable:
    """Mean judge score, its distribution and the number of invalid outputs."""

    def prepare(df: DataFrame) -> DataFrame:
        names = {"score": "_judge_score", "feedback": "_judge_feedback", "valid": "_judge_valid"}
        kept = {c: f"_judge_kept_{c}" for c in names if c in df.columns and c != raw}
        parsed = with_judge_feedback(df.withColumnsRenamed(kept), raw).withColumnsRenamed(names).drop("_judge_feedback")
        return parsed.withColumnsRenamed({v: k for k, v in kept.items()})

    score = F.col("_judge_score")
    counts = {f"_judge_{s}": F.count_if(score == s) for s in range(1, 6)}
    return Mergeable(
        prepare,
        {"_judge_sum": F.sum(score.cast("double")), **counts, "_judge_invalid": F.count_if(~F.col("_judge_valid")), "_judge_n": F.count(F.lit(1))},
        {
            "average_rubric_score": F.try_divide("_judge_sum", "_judge_n"), **{f"score_{s}": F.col(f"_judge_{s}") for s in range(1, 6)},
            "n_invalid": F.col("_judge_invalid"), "n_judged": F.col("_judge_n"),
        },
    )


def length_stat(columns: dict[str, str] | None = None, count: Callable[[Column], Column] = token_count) -> Mergeable:
    """Mean token counts; a null text counts for nothing."""
    columns = columns or {"prompts": "prompt", "responses": "response"}

    def prepare(df: DataFrame) -> DataFrame:
        require_columns(df, *columns.values())
        return df.withColumns({f"_len_{k}": count(F.col(c)).cast("long") for k, c in columns.items()})

    sums = {f"_len_sum_{k}": F.sum(f"_len_{k}") for k in columns} | {f"_len_n_{k}": F.count(f"_len_{k}") for k in columns}
    return Mergeable(prepare, sums, {f"{k}_average_length": F.try_divide(f"_len_sum_{k}", f"_len_n_{k}") for k in columns})


#: Statistics by name, each a function of its parameters.
STATISTICS: dict[str, Callable[..., Mergeable]] = {
    "distinct_ri": distinct_ri_stat, "length": length_stat, "perplexity": perplexity_stat, "reward_model": rubric_stat,
}


def register_statistic(name: str, build: Callable[..., Mergeable]) -> None:
    """Add a mergeable statistic ``(**params) -> Mergeable`` for reports and streams."""
    STATISTICS[name] = build


def grouped_pandas(df: DataFrame, by: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, max_rows: int) -> DataFrame:
    """A user statistic that needs a whole group: ``fn`` gets the group as one pandas table.

    ``max_rows`` declares how large a group may be. Groups are counted first; one above the bound is an error before any
    group is gathered. For groups without a bound write the statistic as sums (``Mergeable``).
    """
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest > max_rows:
        raise ValueError(f"a group has {largest} rows, the statistic is declared for {max_rows}")
    return df.groupBy(*by).applyInPandas(fn, schema)
