"""Queries of the end-to-end jobs and the streaming forms (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.text import marked_rho, token_count
from tutorgauge.operators import mergeable, models, sampling, scores, stats
from tutorgauge.plans import jobs
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.queries_columns import DRAWN, EXAMPLES, SQL_TOKENS, sql_fill, sql_text, wide_sql
from tutorgauge.plans.queries_groups import HASH, quota_sql, ranked
from tutorgauge.plans.queries_metrics import LOSS_MEAN, M3, PAIRS, PG, SCORED, Z_SCORE, judged_sql, report_rows
from tutorgauge.plans.queries_sources import (
    N1_SQL, N3_SQL, N5_SQL, N6_SQL, N7_SQL, SEED_COUNTS, ablation_documents, dumps, flat, literal_languages, literal_models, metric_documents, raw_aya,
    raw_corpora, raw_euroblocks, raw_magpie, raw_oasst, raw_wildchat_ja,
)
from tutorgauge.plans.queries_stats import CELL, P_SQL, QUARTILES, rank_sql
from tutorgauge.plans.views import LANGS, TAG
from tutorgauge.session import new_folder
from tutorgauge.sources import documents
from tutorgauge.streaming import jobs as streaming

R = lambda expr, name: f"round({expr}, 6) AS {name}"


@query("l1_build_seed", f"SELECT language, sum(count)::BIGINT AS count FROM ({SEED_COUNTS}) GROUP BY language")
def _(t):
    return jobs.build_seed(raw_corpora(t), new_folder(t.spark, "l1"), 100)


GERMAN = fv.SYSTEM_PROMPT.format(lang_name="German")
RESPOND_SQL = sql_fill(fv.RESPOND_PROMPT, lang_name=sql_text("German"), prompt="prompt")


@query(
    "l2_prepare_synthesis",
    f"SELECT id, synth_prompt FROM (SELECT id, {RESPOND_SQL} AS synth_prompt FROM (SELECT * FROM v_sft WHERE strategy IN ('respond', 'generate') AND language = 'de' ORDER BY {HASH.format(id='id')} LIMIT 30)) "
    f"WHERE {SQL_TOKENS.format(c='synth_prompt')} + {len(GERMAN.split())} + 500 <= 640",
)
def _(t):
    return jobs.prepare_synthesis(t.v_seed, "respond", "de", n=30, max_length=640).select("id", "synth_prompt")


@query("l2_generate_requests", f"SELECT w.id, md5({sql_fill(fv.GENERATE_PROMPT, lang_name=sql_text('Japanese'), examples=EXAMPLES)}) AS hash {DRAWN}")
def _(t):
    return jobs.prepare_synthesis(t.v_sft, "generate", "ja", prefilter=False).select("id", F.md5("synth_prompt").alias("hash"))


@query(
    "l3_collect_synthesis",
    "SELECT id, prompt AS prompt_input, 'generate' AS strategy, 'tutor' AS model, concat('U: ', prompt) AS user_turn, concat('A: ', response) AS assistant_turn FROM v_sft WHERE strategy <> 'translate'",
)
def _(t):
    answers = t.v_sft.select("id", F.concat(F.lit("U: "), "prompt").alias("prompt"), F.when(F.col("strategy") != "translate", F.concat(F.lit("A: "), "response")).alias("response"))
    got = jobs.collect_synthesis(t.v_sft.select("id", "prompt", "response"), answers, "generate", "tutor")
    turn = lambda i: F.get("messages", F.lit(i))["content"]
    return got.select("id", "prompt_input", "strategy", "model", turn(0).alias("user_turn"), turn(1).alias("assistant_turn"))


TRANSLATE_SQL = sql_fill(fv.TRANSLATE_PROMPT, lang_name=sql_text("Indonesian"), prompt="prompt")
RESPOND_ID = sql_fill(fv.RESPOND_PROMPT, lang_name=sql_text("Indonesian"), prompt="concat('T: ', prompt)")


@query(
    "l4_translation_dataset",
    f"SELECT id, 'translate' AS way, prompt AS prompt_en, {TRANSLATE_SQL} AS text FROM v_sft UNION ALL SELECT id, 'then_respond', prompt, {RESPOND_ID} FROM v_sft "
    "UNION ALL SELECT id, 'both', prompt, concat('T: ', prompt, '|', 'T: ', response) FROM v_sft",
)
def _(t):
    rows = t.v_sft.select("id", "prompt", "response")
    translations = rows.select("id", *[F.concat(F.lit("T: "), c).alias(c) for c in ("prompt", "response")])
    way = lambda df, name, text: df.select("id", F.lit(name).alias("way"), "prompt_en", text.alias("text"))
    first = way(jobs.translation_requests(rows, "translate", "id"), "translate", F.col("synth_prompt"))
    second = way(jobs.translation_requests(rows, "nllb_translate_then_respond", "id", translations), "then_respond", F.col("synth_prompt"))
    third = way(jobs.translated_both(rows, translations, "translator"), "both", F.concat_ws("|", "prompt", "response"))
    return first.unionByName(second).unionByName(third)


@query(
    "l5_intrinsic_report",
    f"SELECT j.model, j.language, round(avg(score), 6) AS average_rubric_score, count(*) FILTER (WHERE NOT valid) AS n_invalid, round(avg({SQL_TOKENS.format(c='d.text')}), 6) AS responses_average_length, "
    f"round(avg({SQL_TOKENS.format(c='d.lang')}), 6) AS prompts_average_length, count(*) AS num_samples FROM {SCORED} j JOIN documents d ON j.id = d.doc_id GROUP BY 1, 2",
)
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("prompt"), F.col("text").alias("response"))
    rows = t.v_judged.select("id", "model", "language", "raw", F.col("quality").cast("string").alias("strategy")).join(texts, "id")
    got = jobs.intrinsic_report(rows, ["model", "language"], ["reward_model", "length"])
    return got.select("model", "language", r("average_rubric_score"), "n_invalid", r("responses_average_length"), r("prompts_average_length"), "num_samples")


REPORT = (
    "SELECT teacher_model, target_lang, CASE WHEN GROUPING(target_lang) = 0 THEN 'language' ELSE 'teacher' END AS level, "
    f"round(avg(pg_score), 6) AS pg_score, round(avg(result), 6) AS result, round(avg(pgr), 6) AS pgr FROM {PG} GROUP BY GROUPING SETS ((teacher_model, target_lang), (teacher_model))"
)


@query("l6_pg_score_report", REPORT)
def _(t):
    intrinsic = documents.read_intrinsic(t.spark, metric_documents(t, "l6"), TAG)
    table = jobs.pg_scores(intrinsic, t.v_evals, t.v_base, t.v_ref, {"scale": 10000})
    report = scores.score_report(table)
    return report.select("teacher_model", "target_lang", "level", r("pg_score"), r("result"), r("pgr"))


LATEST = "SELECT dataset, eval, teacher_model, target_lang, task, eval_lang, arg_min(result, run) AS result FROM v_runs GROUP BY ALL"


@query(
    "l6_extrinsic_results",
    f"SELECT teacher_model, target_lang, task, eval_lang, round(avg(result), 6) AS result, count(*) AS n FROM ({LATEST}) WHERE task <> 'other_task' GROUP BY ALL",
)
def _(t):
    rows = jobs.extrinsic_results(dumps(t).select("dataset", "run", "results"), TAG)
    return rows.groupBy("teacher_model", "target_lang", "task", "eval_lang").agg(r(F.avg("result"), "result"), F.count(F.lit(1)).alias("n"))


@query("l7_export_release", "SELECT id, language, strategy, model, prompt, response FROM v_sft WHERE model = 'teacher_1'")
def _(t):
    return jobs.export_release(t.v_sft, new_folder(t.spark, "l7"), "teacher_1").select("id", "language", "strategy", "model", "prompt", "response")


@query("l7_streamed_release", "SELECT conv_id, turn, role AS language, text FROM conversations WHERE role = 'assistant'")
def _(t):
    out, progress = streaming.stream_run(t.spark, "l7s")
    stream = streaming.file_stream(t.spark, f"{t.folder}/conversations*.parquet", t.conversations.schema)
    return streaming.append_stream(stream.filter("role = 'assistant'").select("conv_id", "turn", F.col("role").alias("language"), "text"), out, progress)


@query("l7_streamed_counts", f"SELECT lang, source, count(*) AS n, sum({SQL_TOKENS.format(c='text')})::BIGINT AS tokens FROM documents GROUP BY 1, 2")
def _(t):
    out, progress = streaming.stream_run(t.spark, "l7c")
    stream = streaming.file_stream(t.spark, f"{t.folder}/documents*.parquet", t.documents.schema)
    sums = {"n": F.count(F.lit(1)), "tokens": F.sum(token_count(F.col("text")).cast("bigint"))}
    return streaming.running_sums(stream, ["lang", "source"], sums, out, progress)


@query("l7_streamed_distinct_ri", "SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(1 - avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distinct_ri FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
def _(t):
    out, progress = streaming.stream_run(t.spark, "l7v")
    stream = streaming.file_stream(t.spark, f"{t.folder}/embeddings*.parquet", t.embeddings.schema).select("label", "embedding")
    return streaming.running_distinct_ri(stream, ["label"], "embedding", out, progress).select("label", "n", r("distinct_ri"))


def in_batches(t, df, name: str, run):
    """Streams a table in two runs with a restart between them: half of its files are there at first, the rest come later, one file a batch."""
    source, (out, progress) = new_folder(t.spark, f"{name}-in"), streaming.stream_run(t.spark, name)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    for part in (0, 1):
        df.filter(half == part).repartition(2).write.mode("append").parquet(source)
        got = run(streaming.file_stream(t.spark, source, df.schema, 1), out, progress)
    return got


BY = ["model", "language"]


@query("l7_streamed_perplexity", f"SELECT model, language, round(avg({LOSS_MEAN}), 6) AS average_perplexity, count({LOSS_MEAN}) AS num_valid_samples, count(*) - count({LOSS_MEAN}) AS num_nan_values, count(*) AS total_samples FROM v_report GROUP BY 1, 2")
def _(t):
    got = in_batches(t, report_rows(t), "l7p", lambda s, out, progress: streaming.running(s, BY, [mergeable.perplexity_stat()], out, progress))
    return got.withColumn("average_perplexity", r("average_perplexity"))


@query("l7_streamed_rubric", f"SELECT model, language, round(avg(score), 6) AS average_rubric_score, {M3}, count(*) FILTER (WHERE NOT valid) AS n_invalid, count(*) AS n_judged FROM {judged_sql('v_report')} GROUP BY 1, 2")
def _(t):
    got = in_batches(t, report_rows(t), "l7j", lambda s, out, progress: streaming.running(s, BY, [mergeable.rubric_stat()], out, progress))
    return got.withColumn("average_rubric_score", r("average_rubric_score"))


@query("l7_streamed_lengths", f"SELECT model, language, round(avg({SQL_TOKENS.format(c='prompt')}), 6) AS prompts_average_length, round(avg({SQL_TOKENS.format(c='response')}), 6) AS responses_average_length FROM v_report GROUP BY 1, 2")
def _(t):
    got = in_batches(t, report_rows(t), "l7n", lambda s, out, progress: streaming.running(s, BY, [mergeable.length_stat()], out, progress))
    return got.select("model", "language", r("prompts_average_length"), r("responses_average_length"))


def streamed_corpus(t, raw, source: str, n=None, share: float = 1.0):
    """A corpus as a stream of about three batches, through its normaliser."""
    at, (out, progress) = new_folder(t.spark, "corpus"), streaming.stream_run(t.spark, "seeds")
    # as many files as the rows were read in, none of them gathered: the files grow in number, not the work of a task
    raw.write.parquet(at)
    batch = -(-len(t.spark.read.schema(raw.schema).parquet(at).inputFiles()) // 3)
    return flat(jobs.streamed_seeds(streaming.file_stream(t.spark, at, raw.schema, max(1, batch)), source, out, progress, n, 42, share))


@query("n1_streamed_wildchat", N1_SQL)
def _(t):
    return streamed_corpus(t, raw_wildchat_ja(t), fv.WILDCHAT, 150)


@query("n3_streamed_magpie", N3_SQL)
def _(t):
    return streamed_corpus(t, raw_magpie(t), fv.MAGPIE, 120)


@query("n6_streamed_euroblocks", N6_SQL)
def _(t):
    return streamed_corpus(t, raw_euroblocks(t), fv.EUROBLOCKS, 60)


@query("n5_streamed_oasst", N5_SQL)
def _(t):
    return streamed_corpus(t, raw_oasst(t), fv.OASST)


@query("n7_streamed_aya", N7_SQL)
def _(t):
    return streamed_corpus(t, raw_aya(t), fv.AYA)


@query("t5_streamed_share", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5(concat('42|', CAST(doc_id AS VARCHAR))), 1, 15))::BIGINT % 1000000 < 300000")
def _(t):
    out, progress = streaming.stream_run(t.spark, "t5")
    stream = streaming.file_stream(t.spark, f"{t.folder}/documents*.parquet", t.documents.schema)
    return streaming.append_stream(sampling.share_by_hash(stream, 0.3, "doc_id").select("doc_id"), out, progress)


@query("t5_streamed_sample", f"SELECT o_orderkey FROM orders ORDER BY {HASH.format(id='o_orderkey')} LIMIT 250")
def _(t):
    out, progress = streaming.stream_run(t.spark, "t5")
    stream = streaming.file_stream(t.spark, f"{t.folder}/orders*.parquet", t.orders.schema).select("o_orderkey")
    return streaming.streamed_sample(stream, 250, "o_orderkey", 42, 0.5, out, progress)


CHAT_SQL = "concat('<start_of_turn>user', chr(10), trim(prompt), '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10), trim(response), '<end_of_turn>', chr(10))"
DRAWN_SFT = f"(SELECT x.* FROM {ranked('v_sft', 'strategy', 'id')} x JOIN {quota_sql('v_sft', 'strategy', 100)} q ON x.strategy = q.strategy WHERE x.rn <= quota)"


@query(
    "l8_training_set",
    f"SELECT id, {CHAT_SQL} AS text, CASE WHEN row_number() OVER (ORDER BY {HASH.format(id='id')}, id) <= floor(0.95::DOUBLE * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM {DRAWN_SFT}",
)
def _(t):
    return jobs.training_set(t.v_sft, 100, balance=True).select("id", "text", "split")


TURN = "concat('<start_of_turn>user', chr(10), prompt, chr(10), '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10))"
L8_SIZE = f"({SQL_TOKENS.format(c=TURN)} + {SQL_TOKENS.format(c='response')})"


@query("l8_token_training_set", f"SELECT id, {SQL_TOKENS.format(c='response')} AS loss_tokens, 90 AS size FROM v_sft WHERE {L8_SIZE} <= 90")
def _(t):
    rows = jobs.training_set(t.v_sft, max_length=90)
    return rows.select("id", F.aggregate("input_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("loss_tokens"), F.size("input_tokens").alias("size"))


@query("l9_annotation_sample", f"SELECT prompt, response, model FROM {ranked('v_sft', 'model', 'id')} WHERE rn <= 20")
def _(t):
    return jobs.annotation_sample(t.v_sft, new_folder(t.spark, "l9"), 20).select("prompt", "response", "model")


L10_MEANS = "(SELECT teacher_model, base_model, avg(pg_score) AS pg_score, avg(pgr) AS pgr FROM v_orders WHERE target_lang IN ('ar', 'de', 'id') GROUP BY 1, 2)"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
L10_PAIRS = f"(SELECT b.base_model, a.pg_score AS x, b.pg_score AS y FROM {L10_MEANS} a JOIN {L10_MEANS} b ON a.teacher_model = b.teacher_model WHERE a.base_model = '5-LOW' AND b.base_model <> '5-LOW')"


def effect(t):
    return jobs.base_model_effect(t.v_orders, ["ar", "de", "id"], PRIORITIES, "5-LOW")


@query("l10_base_model_effect", f"SELECT base_model, round(corr(rx, ry), 6) + 0e0 AS spearman_rho, count(*) AS n_teachers FROM (SELECT *, {rank_sql('x', 'base_model')} AS rx, {rank_sql('y', 'base_model')} AS ry FROM {L10_PAIRS}) GROUP BY 1")
def _(t):
    return effect(t)["against_reference"].select("base_model", r("rho", "spearman_rho"), "n_teachers")


L10_COLS = ", ".join(f"round(max(pg_score) FILTER (WHERE base_model = '{b}'), 4) AS \"{b}\"" for b in PRIORITIES)


@query("l10_teacher_table", f"SELECT teacher_model, {L10_COLS}, round(avg(pg_score), 4) AS mean FROM {L10_MEANS} GROUP BY 1")
def _(t):
    return effect(t)["table"]


@query(
    "l10_rankings",
    f"SELECT teacher_model, count(DISTINCT base_model) AS base_models, count(*) FILTER (WHERE rk = 1) AS times_ranked_1st, count(*) FILTER (WHERE rk <= 3) AS times_in_top_3 FROM (SELECT *, row_number() OVER (PARTITION BY base_model ORDER BY pg_score DESC, teacher_model) AS rk FROM {L10_MEANS}) GROUP BY 1",
)
def _(t):
    return effect(t)["rankings"]


L11_ALL = f"(SELECT teacher_model, target_lang, alpha, round(alpha * z_score + (1 - alpha) * pgr, 12) AS w FROM v_teacher_scores, (VALUES {', '.join(f'({a}::DOUBLE)' for a in fv.ALPHAS)}) AS v(alpha))"
L11_RANKS = f"(SELECT *, {rank_sql('w', 'alpha')} AS rk FROM {L11_ALL})"
L11 = f"(SELECT a.alpha AS a, b.alpha AS b, CASE WHEN a.alpha = b.alpha THEN 1 ELSE corr(a.rk, b.rk) END AS rho, count(*) AS n FROM {L11_RANKS} a JOIN {L11_RANKS} b USING (teacher_model, target_lang) GROUP BY 1, 2)"


@query("l11_weight_robustness", f"SELECT a AS alpha_a, b AS alpha_b, round(rho, 6) AS rho, {CELL} AS cell FROM (SELECT *, {P_SQL} AS p FROM {L11})")
def _(t):
    got = stats.weight_robustness(t.v_teacher_scores, ["teacher_model", "target_lang"], fv.ALPHAS)
    return got.select("alpha_a", "alpha_b", r("rho"), marked_rho(F.col("rho"), F.col("p"), F.col("alpha_a") == F.col("alpha_b")).alias("cell"))


BIN_SQL = "CASE WHEN l.pct_commoncrawl <= 1 THEN '<1%' WHEN l.pct_commoncrawl <= 2 THEN '1-2%' WHEN l.pct_commoncrawl <= 5 THEN '2-5%' ELSE '>5%' END"
BINNED = f"(SELECT {BIN_SQL} AS base_model, pg_score FROM v_orders o JOIN {literal_languages()} ON o.target_lang = l.code)"


@query("l12_resource_boxes", f"SELECT base_model AS resource_bin, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM {QUARTILES.format(v=BINNED)}")
def _(t):
    got = jobs.language_resource_effect(t.v_orders)["boxes"]
    return got.select("resource_bin", "n", r("q1"), r("median"), r("q3"))


BY_LANG = f"(SELECT target_lang, max(l.native_speakers_in_m::DOUBLE) AS x, avg(pg_score) AS y FROM v_orders o JOIN {literal_languages()} ON o.target_lang = l.code GROUP BY 1)"


@query("l12_resource_correlation", f"SELECT round(corr(rx, ry), 6) + 0e0 AS rho, count(*) AS n FROM (SELECT {rank_sql('x')} AS rx, {rank_sql('y')} AS ry FROM {BY_LANG})")
def _(t):
    return jobs.language_resource_effect(t.v_orders, "native_speakers_in_m")["correlation"].select(r("rho"), "n")


SIZED = f"(SELECT o.*, m.parameter_size::DOUBLE AS model_size, l.pct_commoncrawl::DOUBLE AS share FROM v_orders o JOIN {literal_models()} ON o.teacher_model = m.teacher JOIN {literal_languages()} ON o.target_lang = l.code WHERE m.parameter_size IS NOT NULL)"


@query("l13_model_scale", f"SELECT teacher_model, {R('model_size', 'model_size')}, {R('avg(pg_score)', 'pg_score')} FROM {SIZED} GROUP BY teacher_model, model_size")
def _(t):
    return jobs.model_scale(t.v_orders)["means"].select("teacher_model", r("model_size"), r("pg_score"))


@query(
    "l13_size_classes",
    f"SELECT id, CASE WHEN share <= (SELECT quantile_cont(share, 1 / 3.0e0) FROM {SIZED}) THEN 0 WHEN share <= (SELECT quantile_cont(share, 2 / 3.0e0) FROM {SIZED}) THEN 1 ELSE 2 END AS size_class FROM {SIZED}",
)
def _(t):
    return jobs.model_scale(t.v_orders)["classes"].select("id", "size_class")


STEP = "CASE base_model WHEN '1-URGENT' THEN 1000 WHEN '2-HIGH' THEN 5000 WHEN '3-MEDIUM' THEN 10000 WHEN '4-NOT SPECIFIED' THEN 25000 ELSE 50000 END"


@query(
    "l14_data_scale",
    f"SELECT teacher_model, target_lang, scale, {R('pg_score', 'pg_score')}, round(pg_score - lag(pg_score) OVER (PARTITION BY teacher_model, target_lang ORDER BY scale), 6) + 0e0 AS change FROM "
    f"(SELECT teacher_model, target_lang, {STEP} AS scale, avg(pg_score) AS pg_score FROM v_orders GROUP BY 1, 2, 3)",
)
def _(t):
    rows = t.v_orders.withColumn("scale", F.expr(STEP)).groupBy("teacher_model", "target_lang", "scale").agg(F.avg("pg_score").alias("pg_score"))
    return jobs.data_scale(rows).select("teacher_model", "target_lang", "scale", r("pg_score"), r("change"))


@query("l15_feature_report")
def _(t):
    features = documents.read_intrinsic_complete(t.spark, metric_documents(t, "l15r"))
    parts = jobs.feature_model(features, t.v_teacher_scores, "result")
    got = jobs.feature_report(parts, "result")
    return got.select("best_model", "n_components", r("r2_score"), F.to_json("pca_components").alias("components"), r("intercept"))


@query("l15_feature_model")
def _(t):
    features = documents.read_intrinsic_complete(t.spark, metric_documents(t, "l15"))
    parts = jobs.feature_model(features, t.v_teacher_scores, "result")
    return models.comparison(parts.scores(), "result").select("model", r("r2"), r("rmse"), "best")


@query("l16_scale_or_benchmark")
def _(t):
    perf = jobs.teacher_benchmarks(teacher_dumps(t))
    got = jobs.scale_or_benchmark(t.v_teacher_scores, perf)
    return got.select("model", "predictor", r("beta"), r("se"), r("p", digits=4))


AVG_ALL = f"(SELECT model_name, avg_all FROM ({wide_sql()}))"
L16 = (
    f"(SELECT s.teacher_model, m.parameter_size::DOUBLE AS model_size, w.avg_all AS benchmark_performance, avg(s.pg_score) AS pg_score FROM v_teacher_scores s JOIN {literal_models()} ON s.teacher_model = m.teacher "
    f"JOIN {AVG_ALL} w ON w.model_name = concat('org/', s.teacher_model) WHERE m.parameter_size IS NOT NULL GROUP BY 1, 2, 3)"
)


def summary(t):
    return jobs.size_benchmark_summary(jobs.size_and_benchmark(t.v_teacher_scores, jobs.teacher_benchmarks(teacher_dumps(t))))


@query("l16_size_benchmark_summary", f"SELECT teacher_model, {R('model_size', 'model_size')}, {R('benchmark_performance', 'benchmark_performance')}, {R('pg_score', 'pg_score')} FROM {L16}")
def _(t):
    return summary(t).select("teacher_model", r("model_size"), r("benchmark_performance"), r("pg_score"))


@query("l16_size_benchmark_correlation", f"SELECT {R('corr(model_size, benchmark_performance)', 'r')}, count(*) AS n FROM {L16}")
def _(t):
    return stats.pearson(summary(t), "model_size", "benchmark_performance").select(r("r"), "n")


@query("l17_translation_ablation", "SELECT translate_method, " + ", ".join(f"round(avg(pg_score) FILTER (WHERE target_lang = '{l}'), 6) AS {l}" for l in LANGS) + " FROM (SELECT base_model AS translate_method, target_lang, avg(pg_score) AS pg_score FROM v_orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    rows = t.v_orders.groupBy(F.col("base_model").alias("translate_method"), "target_lang").agg(F.avg("pg_score").alias("pg_score"))
    return jobs.translation_ablation(rows, LANGS)["grid"].select("translate_method", *[r(l) for l in LANGS])


STAGES = "(SELECT concat('stage_', task) AS experiment, CASE WHEN task <> 'error' THEN avg(result) * 1000 ELSE 0 END AS score FROM v_evals GROUP BY task)"


@query("l17_staged_ablation", f"SELECT experiment, {R('score', 'filbench_score')}, round(lag(score) OVER (ORDER BY experiment), 6) AS previous, round(score - lag(score) OVER (ORDER BY experiment), 6) + 0e0 AS change FROM {STAGES}")
def _(t):
    got = jobs.staged_ablation(t.spark, ablation_documents(t, "l17"))
    return got.select("experiment", r("filbench_score"), r("previous"), r("change"))


QUALITY = (
    "(SELECT i.language, i.z_score, b.score FROM (SELECT language, model, z_score FROM " + Z_SCORE + ") i JOIN "
    "(SELECT concat('org/', teacher_model) AS model, target_lang AS language, avg(result) AS score FROM v_evals GROUP BY 1, 2) b USING (model, language) WHERE i.language IN ('de', 'es', 'ja'))"
)


def quality(t):
    bench = t.v_evals.groupBy(F.concat(F.lit("org/"), "teacher_model").alias("model"), F.col("target_lang").alias("language")).agg(F.avg("result").alias("score"))
    return jobs.quality_against_benchmark(scores.intrinsic_zscore(t.v_intrinsic), bench, "score")


@query("l18_quality_correlations", f"SELECT language, round(corr(score, z_score), 6) AS pearson, round(regr_slope(z_score, score), 4) AS slope, round(regr_intercept(z_score, score), 4) AS intercept, count(*) AS n FROM {QUALITY} GROUP BY 1")
def _(t):
    got = quality(t)
    line = got["line"].select("language", r("slope", digits=4), r("intercept", digits=4))
    return got["pearson"].select("language", r("r", "pearson"), "n").join(line, "language")


@query("l18_quality_rank_correlations", f"SELECT language, round(corr(rx, ry), 6) + 0e0 AS rho, count(*) AS n FROM (SELECT language, {rank_sql('score', 'language')} AS rx, {rank_sql('z_score', 'language')} AS ry FROM {QUALITY}) GROUP BY 1")
def _(t):
    return quality(t)["spearman"].select("language", r("rho"), "n")


def teacher_dumps(t):
    """Runs grouped into one dataset per teacher."""
    return dumps(t).select(F.get_json_object("config_general", "$.model_name").alias("dataset"), "run", "results", "config_general")


@query("l18_teacher_benchmarks", wide_sql())
def _(t):
    wide = jobs.teacher_benchmarks(teacher_dumps(t))
    return wide.select("model_name", *[r(c, digits=9) for c in wide.columns[1:]])
