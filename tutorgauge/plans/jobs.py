"""End-to-end jobs: one function each, from input tables to the table a user wants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.names import eval_name, run_name
from tutorgauge.functions.text import chat_messages, chat_text, p_text
from tutorgauge.operators import filters, metrics, models, reports, sampling, scores, stats, synthesis
from tutorgauge.operators.joins import settled
from tutorgauge.sources import dims, documents, seeds, tables
from tutorgauge.streaming.jobs import append_stream, streamed_sample


def build_seed(raw: dict[str, DataFrame], path: str, n: int, seed: int = 42, include=None, exclude=None) -> DataFrame:
    """Normalise the chosen corpora, check their ids, store the table; returns rows per language."""
    table = settled(seeds.seed_table(raw, n, seed, include, exclude))
    tables.write_table(seeds.check_unique_ids(table), path)
    return reports.histogram(tables.read_table(table.sparkSession, path), "language")


def prepare_synthesis(
    seed: DataFrame, strategy: str, language: str, n: int | None = None, max_length: int | None = None,
    prefilter: bool = True, shuffle: int = 42, count=synthesis.token_count,
) -> DataFrame:
    """Requests for one strategy and language: prefilter, sample, prompt, token budget."""
    if language not in fv.DISPLAY_NAMES:
        raise ValueError(f"Unknown language: {language}")
    name = fv.DISPLAY_NAMES[language]
    rows = filters.for_strategy(seed, strategy, language) if prefilter else seed
    rows = sampling.shuffle_take(rows, n, seed=shuffle) if n else rows
    rows = synthesis.requests(rows, strategy, name)
    if max_length is None:
        return rows
    return synthesis.within_budget(rows, max_length, synthesis.system_prompt(name), count=count)


def collect_synthesis(inputs: DataFrame, answers: DataFrame, strategy: str, model: str, keep_inputs: bool = True) -> DataFrame:
    """Answers joined to their requests, without unanswered ones, in chat format."""
    return synthesis.answered(synthesis.collect_answers(inputs, answers, strategy, model, keep_inputs))


def translation_requests(df: DataFrame, strategy: str, language: str, translations: DataFrame | None = None, max_length: int | None = None) -> DataFrame:
    """Requests of the translating strategies, English text kept in ``*_en`` columns.

    ``translate`` lets the teacher translate the English prompt. ``nllb_translate_then_respond`` takes the
    translated prompt from ``translations`` (id, prompt) and asks for a response.
    """
    english = tables.renamed(df, {"prompt": "prompt_en", "response": "response_en"})
    name = fv.DISPLAY_NAMES[language]
    if strategy == "translate":
        rows = synthesis.requests(english.withColumn("prompt", F.col("prompt_en")), "translate", name)
    elif strategy == "nllb_translate_then_respond":
        rows = synthesis.requests(english.join(translations.select("id", "prompt"), "id"), "respond", name)
    else:
        raise ValueError(f"strategy {strategy!r} asks no teacher")
    if max_length is None:
        return rows
    return synthesis.within_budget(rows, max_length, synthesis.system_prompt(name), buffer=800)


def translated_both(df: DataFrame, translations: DataFrame, model: str) -> DataFrame:
    """Training rows whose prompt and response are both taken from ``translations`` (id, prompt, response)."""
    english = tables.renamed(df, {"prompt": "prompt_en", "response": "response_en"})
    rows = english.join(translations.select("id", "prompt", "response"), "id")
    rows = tables.with_constants(rows, {"synth_prompt": "None", "strategy": "nllb_translate_both", "model": model})
    return rows.withColumn("messages", chat_messages(F.col("prompt"), F.col("response")))


def intrinsic_report(
    df: DataFrame, by: list[str], names: list[str], wanted: dict | None = None, balance: int | None = None,
    limit: int | None = None, params: dict | None = None, id_col: str = "id", seed: int = 42,
) -> DataFrame:
    """Filter, drop incomplete rows, balance by strategy per group, limit, then the requested metrics."""
    rows = filters.without_nulls(filters.matching(df, wanted or {}))
    if balance is not None:
        rows = sampling.balanced_subsample(rows, balance, by=by, id_col=id_col, seed=seed)
    if limit is not None:
        rows = sampling.shuffle_take(rows, limit, id_col, seed)
    if balance is not None or limit is not None:
        rows = settled(rows)  # each metric reads the sample, not the whole input again
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("num_samples"))
    return metrics.metric_table(rows, by, names, params).join(sizes, by)


def streamed_seeds(raw: DataFrame, source: str, path: str, progress: str, n: int | None = None, seed: int = 42, share: float = 1.0) -> DataFrame:
    """Seeds of one corpus that arrives as a stream, equal to the normaliser of the finished corpus.

    Corpora without a sample are filtered and projected inside the stream. Of sampled ones the stream keeps the lowest ``share``
    of hashes of the rows that can be drawn; the sample has its exact size by a cutoff on what was kept.
    """
    if source not in seeds.SAMPLED:
        return append_stream(seeds.SOURCES[source](raw, n, seed), path, progress)
    drawable, key = seeds.SAMPLED[source]
    return seeds.SOURCES[source](streamed_sample(drawable(raw), n, key, seed, share, path, progress), n, seed)


def extrinsic_results(dumps: DataFrame, tag: str, keep: str = "first") -> DataFrame:
    """Benchmark dumps (dataset, run, results) as one row per dataset and task."""
    tasks = documents.exploded_results(dumps)
    once = scores.dedupe_runs(tasks, ["dataset", "eval"], keep=keep)
    named = once.withColumns(eval_name(F.col("eval"))).filter(scores.known_tasks())
    parsed = named.withColumns(run_name(F.col("dataset"), tag)).withColumns(scores.headline_result())
    return parsed.withColumnRenamed("metrics", "raw_result")


def pg_scores(intrinsic: DataFrame, extrinsic: DataFrame, base: DataFrame, reference: DataFrame, metadata: dict | None = None) -> DataFrame:
    """The score table: gain recovered, intrinsic z-score and their mean per teacher and language."""
    table = scores.combined_score(scores.gain_recovered(extrinsic, base, reference), scores.intrinsic_zscore(intrinsic))
    return tables.with_constants(table, metadata) if metadata else table


def export_release(df: DataFrame, path: str, model: str, language: str = "language") -> DataFrame:
    """The release table of one teacher: kept columns, one partition per language, done ones untouched."""
    rows = df.filter(F.col("model") == model)
    return tables.write_missing_languages(tables.keep_columns(rows, fv.RELEASE_COLUMNS, {"language": F.col(language)}), path)


def training_set(
    df: DataFrame, n: int | None = None, wanted: dict | None = None, balance: bool = False, seed: int = 42,
    max_length: int | None = None, encode=synthesis.tokens,
) -> DataFrame:
    """Filter, sample (balanced by strategy or plain), write out as chat text, split 95/5.

    With ``max_length`` the rows also carry padded tokens with their loss mask, and longer ones are left out.
    """
    rows = filters.matching(df, wanted or {})
    if balance:
        if n is None:
            raise ValueError("a balanced sample needs its size")
        rows = sampling.balanced_subsample(rows, n, seed=seed)
    elif n is not None:
        rows = sampling.shuffle_take(rows, n, seed=seed)
    if n is not None:
        rows = settled(rows)  # the split reads the sample three times
    if "messages" not in rows.columns:
        rows = rows.withColumn("messages", chat_messages(F.col("prompt"), F.col("response")))
    rows = sampling.train_validation(rows.withColumn("text", chat_text(F.col("messages"))), seed=seed)
    if max_length is None:
        return rows
    return synthesis.training_rows(synthesis.source_and_target_tokens(rows, encode), max_length, pad_id="")


def annotation_sample(df: DataFrame, path: str, n: int = 50, seed: int = 42) -> DataFrame:
    """n rows per model as a CSV sheet with empty columns for the annotators."""
    rows = sampling.sample_per_group(df, n, seed=seed).select("prompt", "response", "model")
    tables.write_csv(rows, path, ("fluency", "cultural accuracy"))
    return df.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def base_model_scores(df: DataFrame, languages: list[str]) -> DataFrame:
    """Mean scores by teacher and base model over the chosen languages."""
    return df.filter(F.col("target_lang").isin(*languages)).groupBy("teacher_model", "base_model").agg(
        F.avg("pg_score").alias("pg_score"), F.avg("pgr").alias("pgr")
    )


def base_model_effect(df: DataFrame, languages: list[str], bases: list[str], reference: str) -> dict[str, DataFrame]:
    """How far teacher rankings agree between base models."""
    means = base_model_scores(df, languages)
    return {
        "table": reports.teacher_by_base(means, bases),
        "correlations": stats.pair_correlations(means, ["teacher_model"], "base_model", bases, "pg_score"),
        "against_reference": stats.against_reference(means, "teacher_model", "base_model", "pg_score", reference),
        "summary": reports.teacher_summary(means),
        "rankings": reports.ranking_frequency(means),
    }


def language_resource_effect(df: DataFrame, prop: str = "pct_commoncrawl") -> dict[str, DataFrame]:
    """Scores against how well resourced a language is: bins, box statistics, correlation over languages."""
    rows = filters.without_missing(dims.with_dimensions(df), [prop])
    if prop in fv.RESOURCE_BINS:
        edges, labels = fv.RESOURCE_BINS[prop]
        level = stats.binned(F.col(prop), edges, labels)
    else:
        level = F.col(prop).cast("string")
    rows = rows.withColumn("resource_bin", level)
    means = reports.first_and_mean(rows, "target_lang", prop)
    return {
        "boxes": stats.box_stats(rows, "resource_bin", "pg_score"),
        "languages": means,
        "correlation": stats.spearman(means, prop, "pg_score").withColumn("p_text", p_text(F.col("p"))),
    }


def model_scale(df: DataFrame, size_by: str = "pct_commoncrawl") -> dict[str, DataFrame]:
    """Scores against teacher size: mean per teacher, span per teacher, marker class per row."""
    rows = dims.with_model_size(dims.with_dimensions(df))
    return {
        "means": reports.mean_by_known_keys(rows, ["teacher_model", "model_size"]),
        "spans": reports.span(rows, "teacher_model", "pg_score"),
        "classes": stats.quantile_classes(rows, size_by),
    }


def data_scale(df: DataFrame, value: str = "pg_score") -> DataFrame:
    """Score by language and number of training rows, with the change from the step before."""
    named = dims.with_dimensions(df)
    return reports.change_along(named, "scale", value, ["teacher_model", "target_lang"])


def feature_model(intrinsic: DataFrame, benchmark: DataFrame, label: str = "result", k: int | None = None) -> models.Components:
    """Components of the six features over rows that have a benchmark score too."""
    rows = intrinsic.join(benchmark.select("teacher_model", "target_lang", label), ["teacher_model", "target_lang"])
    return models.Components(settled(rows), k=k)


def feature_report(parts: models.Components, label: str = "result", kinds: list[str] | None = None) -> DataFrame:
    """One row with the best regression on the components and all that describes it."""
    rows = settled(parts.scores().select("components", label))
    fits = models.fit_regressions(rows, label, kinds)
    best = max(fits, key=lambda k: fits[k]["r2"])
    model = fits[best]["model"].stages[-1] if best == "quadratic" else fits[best]["model"]
    linear = best != "boosted"
    slopes = model.coefficients if linear else model.featureImportances
    table = (
        best, parts.k, float(fits[best]["r2"]), [float(x) for x in parts.ratios], [float(x) for x in parts.ratios.cumsum()],
        parts.features, [[float(x) for x in c] for c in parts.loadings.T], [float(x) for x in slopes.toArray()],
        float(model.intercept) if linear else None,
    )
    ddl = (
        "best_model string, n_components int, r2_score double, explained_variance_ratio array<double>, cumulative_variance array<double>, "
        "feature_names array<string>, pca_components array<array<double>>, coefficients array<double>, intercept double"
    )
    return tables.literal_table(rows.sparkSession, [table], ddl)


def size_and_benchmark(pg: DataFrame, teacher_perf: DataFrame) -> DataFrame:
    """Scores of teachers whose size and benchmark score are known, with both."""
    perf = teacher_perf.withColumn("teacher_model", F.element_at(F.split("model_name", "/"), -1))
    perf = perf.select("teacher_model", "avg_all", *[f"avg_{l}" for l in fv.BENCHMARKED_LANGUAGES])
    rows = dims.with_model_size(dims.with_dimensions(pg)).join(perf, "teacher_model", "left")
    return filters.without_missing(rows.withColumn("benchmark_performance", F.col("avg_all")), ["benchmark_performance"])


def scale_or_benchmark(pg: DataFrame, teacher_perf: DataFrame) -> DataFrame:
    """Mixed models of the score on teacher size, on benchmark score, on both, and per language."""
    rows = settled(size_and_benchmark(pg, teacher_perf))  # six fits read it
    fits = {
        "scale_only": (rows, ["log_model_size"]),
        "performance_only": (rows, ["benchmark_performance"]),
        "combined": (rows, ["log_model_size", "benchmark_performance"]),
    }
    for lang in fv.BENCHMARKED_LANGUAGES:
        part = rows.filter(F.col("target_lang") == lang).withColumn("lang_benchmark_performance", F.col(f"avg_{lang}"))
        fits[f"lang_specific_{lang}"] = (part, ["lang_benchmark_performance"])
    done = [
        models.random_intercept(part, "pg_score", x, "teacher_model").withColumn("model", F.lit(name))
        for name, (part, x) in fits.items()
    ]
    return tables.union_all(done)


def size_benchmark_summary(rows: DataFrame) -> DataFrame:
    """Mean score per teacher with its size and benchmark score."""
    keys = ["teacher_model", "beautiful_name", "model_size", "benchmark_performance"]
    return reports.mean_by_known_keys(rows, keys)


def teacher_benchmarks(dumps: DataFrame, keep: str = "last") -> DataFrame:
    """Teachers' own benchmark results in wide form; the latest run of a task counts."""
    config = dumps.withColumns(documents.run_config()).select("dataset", "run", "model_name", "results")
    tasks = documents.exploded_results(config).withColumns(eval_name(F.col("eval"))).drop("eval", "n_shots")
    return reports.wide_benchmarks(scores.dedupe_runs(tasks, ["dataset", "task", "eval_lang"], keep=keep))


def quality_against_benchmark(quality: DataFrame, bench: DataFrame, score: str, languages: list[str] | None = None) -> dict[str, DataFrame]:
    """Intrinsic quality against a benchmark score over common (model, language) rows, per language."""
    languages = languages or fv.BENCHMARKED_LANGUAGES
    rows = quality.filter(F.col("language").isin(*languages)).join(bench, ["model", "language"])
    return {
        "rows": rows,
        "pearson": stats.pearson(rows, score, "z_score", ["language"]),
        "spearman": stats.spearman(rows, score, "z_score", ["language"]),
        "line": stats.linear_fit(rows, score, "z_score", ["language"]),
    }


def translation_ablation(df: DataFrame, languages: list[str]) -> dict[str, DataFrame]:
    return {"means": reports.method_means(df), "grid": reports.method_grid(df, languages)}


def staged_ablation(spark: SparkSession, path: str) -> DataFrame:
    """Ablation documents in name order with the change each stage brings."""
    return reports.change_along(documents.read_ablations(spark, path), "experiment", "filbench_score")
