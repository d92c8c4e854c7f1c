"""Queries of the joins, aggregations, rankings, samples and set operators (J, A, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.names import eval_name
from tutorgauge.operators import filters, reports, sampling, scores, stats, synthesis
from tutorgauge.operators.joins import left_join_unique, self_pairs
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.queries_sources import dumps, literal_languages, literal_models
from tutorgauge.plans.views import LANGS
from tutorgauge.sources import dims, documents, tables

BASES = ["click", "error", "purchase", "signup", "view"]
R = lambda expr, name: f"round({expr}, 6) AS {name}"

# --- joins ----------------------------------------------------------------------------------------


@query(
    "j1_answers_to_requests",
    "SELECT id, prompt AS prompt_input, response AS response_input, 'respond' AS strategy, 'tutor' AS model, "
    "CASE WHEN strategy <> 'translate' THEN upper(model) END AS response FROM v_sft",
)
def _(t):
    answers = t.v_sft.filter("strategy <> 'translate'").select("id", "prompt", F.upper("model").alias("response"))
    got = synthesis.collect_answers(t.v_sft.select("id", "prompt", "response"), answers, "respond", "tutor")
    return got.select("id", "prompt_input", "response_input", "strategy", "model", "response")


@query(
    "j2_two_key_join",
    f"SELECT s.teacher_model, s.target_lang, {R('s.pgr', 'pgr')}, {R('i.rubric_score', 'rubric_score')} FROM v_teacher_scores s "
    "LEFT JOIN v_intrinsic i ON s.target_lang = i.language AND concat('org/', s.teacher_model) = i.model AND i.language <> 'cs'",
)
def _(t):
    right = t.v_intrinsic.filter("language <> 'cs'").select(F.element_at(F.split("model", "/"), -1).alias("model_short"), "language", "rubric_score")
    joined = left_join_unique(t.v_teacher_scores.select("teacher_model", "target_lang", "pgr"), right, ["teacher_model", "target_lang"], ["model_short", "language"])
    return joined.select("teacher_model", "target_lang", r("pgr"), r("rubric_score"))


ANCHORED = (
    f"SELECT e.teacher_model, e.target_lang, {R('e.result', 'result')}, {R('b.x', 'base_perf')}, {R('f.x', 'ref_perf')} FROM v_teacher_scores e "
    "LEFT JOIN (SELECT eval_lang, avg(result) AS x FROM v_base GROUP BY 1) b ON e.target_lang = b.eval_lang "
    "LEFT JOIN (SELECT eval_lang, avg(result) AS x FROM v_ref GROUP BY 1) f ON e.target_lang = f.eval_lang"
)


@query("j3_anchor_joins", ANCHORED)
def _(t):
    base = scores.language_mean(t.v_base, "base_perf").withColumnRenamed("eval_lang", "target_lang")
    ref = scores.language_mean(t.v_ref, "ref_perf").withColumnRenamed("eval_lang", "target_lang")
    joined = t.v_teacher_scores.join(base, "target_lang", "left").join(ref, "target_lang", "left")
    return joined.select("teacher_model", "target_lang", *[r(c) for c in ("result", "base_perf", "ref_perf")])


@query("j4_inner_join", f"SELECT s.teacher_model, s.target_lang, {R('s.pg_score', 'pg_score')}, {R('i.perplexity', 'perplexity')} FROM v_teacher_scores s JOIN v_intrinsic i ON i.model = concat('org/', s.teacher_model) AND i.language = s.target_lang")
def _(t):
    features = t.v_intrinsic.select(F.replace("model", F.lit("org/"), F.lit("")).alias("teacher_model"), F.col("language").alias("target_lang"), "perplexity")
    return t.v_teacher_scores.join(features, ["teacher_model", "target_lang"]).select("teacher_model", "target_lang", r("pg_score"), r("perplexity"))


@query(
    "j5_dimension_joins",
    f"SELECT id, o.teacher_model, o.target_lang, {R('m.parameter_size::DOUBLE', 'parameter_size')}, l.language_name, {R('l.pct_commoncrawl::DOUBLE', 'pct_commoncrawl')} FROM v_orders o "
    f"LEFT JOIN {literal_models()} ON o.teacher_model = m.teacher LEFT JOIN {literal_languages()} ON o.target_lang = l.code",
)
def _(t):
    rows = dims.with_dimensions(t.v_orders.select("id", "teacher_model", "target_lang"))
    return rows.select("id", "teacher_model", "target_lang", r("parameter_size"), "language_name", r("pct_commoncrawl"))


MEANS = "(SELECT teacher_model, base_model, avg(pg_score) AS pg_score, avg(pgr) AS pgr FROM v_scores GROUP BY 1, 2)"


def means(t):
    return t.v_scores.groupBy("teacher_model", "base_model").agg(F.avg("pg_score").alias("pg_score"), F.avg("pgr").alias("pgr"))


@query(
    "j6_self_join",
    f"SELECT a.teacher_model, a.base_model, {R('a.pg_score', 'pg_score')}, {R('b.pg_score', 'pg_score_anchor')} FROM {MEANS} a JOIN {MEANS} b ON a.teacher_model = b.teacher_model WHERE b.base_model = 'view' AND a.base_model <> 'view'",
)
def _(t):
    return self_pairs(means(t), "teacher_model", "base_model", "pg_score", "view").select("teacher_model", "base_model", r("pg_score"), r("pg_score_anchor"))


HASH = "md5(concat('42|', CAST({id} AS VARCHAR)))"


def ranked(view: str, by: str, id_col: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY {HASH.format(id=id_col)}, {id_col}) AS rn FROM {view})"


@query("j7_rows_not_sampled", f"SELECT id, strategy FROM {ranked('v_sft', 'strategy', 'id')} WHERE rn > 20")
def _(t):
    taken = sampling.sample_per_group(t.v_sft, 20, by="strategy")
    return filters.not_in_table(t.v_sft, taken.select("id"), "id").select("id", "strategy")


@query("j8_weight_pairs", f"SELECT id, alpha, round(alpha * z_score + (1 - alpha) * pgr, 9) AS weighted FROM v_orders, (VALUES {', '.join(f'({a}::DOUBLE)' for a in fv.ALPHAS)}) AS w(alpha)")
def _(t):
    return scores.weighted_scores(t.v_orders).select("id", "alpha", r("weighted", digits=9))


# --- aggregations ---------------------------------------------------------------------------------


@query(
    "a1_mean_scores",
    f"SELECT teacher_model, target_lang, CASE WHEN GROUPING(target_lang) = 0 THEN 'language' ELSE 'teacher' END AS level, {R('avg(pg_score)', 'pg_score')}, {R('avg(pgr)', 'pgr')} "
    "FROM v_orders GROUP BY GROUPING SETS ((teacher_model, target_lang), (teacher_model))",
)
def _(t):
    report = scores.score_report(t.v_orders, ("pg_score", "pgr"))
    return report.select("teacher_model", "target_lang", "level", r("pg_score"), r("pgr"))


@query("a1_teacher_means", f"SELECT teacher_model, {R('avg(pg_score)', 'pg_score')}, {R('avg(result)', 'result')}, {R('avg(pgr)', 'pgr')} FROM v_scores GROUP BY 1")
def _(t):
    return scores.mean_scores(t.v_scores, ["teacher_model"]).select("teacher_model", *[r(c) for c in ("pg_score", "result", "pgr")])


FALLBACK = (
    "SELECT teacher_model, target_lang, "
    + ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE target_lang = eval_lang) > 0 THEN avg({m}) FILTER (WHERE target_lang = eval_lang) ELSE avg({m}) END AS {m}"
        for m in ("result", "result_stderr")
    )
    + ", count(*) FILTER (WHERE target_lang = eval_lang) = 0 AS used_fallback FROM v_evals GROUP BY 1, 2"
)


@query("a2_target_language_mean", f"SELECT teacher_model, target_lang, {R('result', 'result')}, {R('result_stderr', 'result_stderr')}, used_fallback FROM ({FALLBACK})")
def _(t):
    rows = scores.target_language_mean(t.v_evals)
    return rows.select("teacher_model", "target_lang", r("result"), r("result_stderr"), "used_fallback")


@query("a3_language_mean", f"SELECT eval_lang, {R('avg(result)', 'result')} FROM v_base GROUP BY eval_lang")
def _(t):
    return scores.language_mean(t.v_base, "result").select("eval_lang", r("result"))


@query("a4_histogram", "SELECT lang, source, count(*) AS count FROM documents GROUP BY lang, source")
def _(t):
    return reports.histogram(t.documents, "lang", "source")


STRATS = ["generate", "respond", "translate"]
COUNTS = ", ".join(f"count(*) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATS)


@query("a5_cross_tab", f"SELECT model, {COUNTS} FROM v_sft GROUP BY model")
def _(t):
    return reports.cross_tab(t.v_sft, "model", "strategy", STRATS)


A6 = ", ".join(f"round(max(pg_score) FILTER (WHERE base_model = '{b}'), 4) AS {b}" for b in BASES)


@query("a6_teacher_by_base", f"SELECT teacher_model, {A6}, round(avg(pg_score), 4) AS mean FROM {MEANS} GROUP BY teacher_model")
def _(t):
    return reports.teacher_by_base(means(t), BASES).orderBy(F.desc("mean"))


@query(
    "a7_teacher_summary",
    "SELECT teacher_model, round(avg(pg_score), 4) AS pg_score_mean, round(stddev_samp(pg_score), 4) AS pg_score_std, round(min(pg_score), 4) AS pg_score_min, "
    "round(max(pg_score), 4) AS pg_score_max, round(avg(pgr), 4) AS pgr_mean, round(stddev_samp(pgr), 4) AS pgr_std FROM v_orders GROUP BY teacher_model",
)
def _(t):
    return reports.teacher_summary(t.v_orders).orderBy(F.desc("pg_score_mean"))


@query("a8_first_and_mean", f"SELECT o.target_lang, {R('max(l.pct_commoncrawl::DOUBLE)', 'pct_commoncrawl')}, {R('avg(pg_score)', 'pg_score')} FROM v_orders o JOIN {literal_languages()} ON o.target_lang = l.code GROUP BY 1")
def _(t):
    got = reports.first_and_mean(dims.with_dimensions(t.v_orders), "target_lang", "pct_commoncrawl")
    return got.select("target_lang", r("pct_commoncrawl"), r("pg_score"))


@query(
    "a9_mean_by_known_keys",
    f"SELECT o.teacher_model, m.model_family, {R('m.parameter_size::DOUBLE', 'model_size')}, {R('avg(pg_score)', 'pg_score')} FROM v_orders o JOIN {literal_models()} ON o.teacher_model = m.teacher "
    "WHERE m.parameter_size IS NOT NULL GROUP BY 1, 2, m.parameter_size",
)
def _(t):
    rows = dims.with_dimensions(t.v_orders).withColumnRenamed("parameter_size", "model_size")
    got = reports.mean_by_known_keys(rows, ["teacher_model", "model_family", "model_size"])
    return got.select("teacher_model", "model_family", r("model_size"), r("pg_score"))


@query("a10_distinct_counts", "SELECT count(DISTINCT teacher_model) AS teacher_model, count(DISTINCT target_lang) AS target_lang, count(DISTINCT id) AS id FROM v_orders")
def _(t):
    return reports.distinct_counts(t.v_orders, ["teacher_model", "target_lang", "id"])


@query("a10_approximate_counts")
def _(t):
    return reports.distinct_counts(t.v_orders, ["teacher_model", "target_lang", "id"], approximate=True)


@query("a10_approximate_error", "SELECT true AS teacher_model, true AS target_lang, true AS id")
def _(t):
    """Sketched counts next to exact ones: off by no more than three standard errors of 5 %."""
    columns = ["teacher_model", "target_lang", "id"]
    exact, sketched = reports.distinct_counts(t.v_orders, columns), reports.distinct_counts(t.v_orders, columns, approximate=True)
    both = exact.withColumn("k", F.lit(0)).join(sketched.select(*[F.col(c).alias(f"{c}_s") for c in columns]).withColumn("k", F.lit(0)), "k")
    return both.select(*[(F.abs(F.col(c) - F.col(f"{c}_s")) <= 0.15 * F.col(c)).alias(c) for c in columns])


@query(
    "a11_row_mean",
    "SELECT l_orderkey, l_linenumber, l_partkey, round((q + p + x) / 3, 6) AS three, round(CASE WHEN l_returnflag = 'A' THEN x ELSE (q + x) / 2 END, 6) AS some FROM "
    "(SELECT *, l_quantity AS q, l_extendedprice AS p, l_tax AS x FROM lineitem)",
)
def _(t):
    rows = t.lineitem.withColumn("q", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        r(stats.row_mean(["l_quantity", "l_extendedprice", "l_tax"]), "three"), r(stats.row_mean(["q", "l_tax"]), "some"),
    )


@query("a12_span", f"SELECT teacher_model, {R('min(pg_score)', 'lowest')}, {R('max(pg_score)', 'highest')} FROM v_orders GROUP BY 1")
def _(t):
    return reports.span(t.v_orders, "teacher_model", "pg_score").select("teacher_model", r("lowest"), r("highest"))


A13 = ", ".join(f"round(avg(pg_score) FILTER (WHERE target_lang = '{l}'), 6) AS {l}" for l in LANGS)


@query("a13_method_grid", f"SELECT base_model AS translate_method, {A13}, round(avg(pg_score), 6) AS mean FROM (SELECT base_model, target_lang, avg(pg_score) AS pg_score FROM v_orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    rows = t.v_orders.groupBy(F.col("base_model").alias("translate_method"), "target_lang").agg(F.avg("pg_score").alias("pg_score"))
    grid = reports.method_grid(rows, LANGS).join(reports.method_means(rows).withColumnRenamed("pg_score", "mean"), "translate_method")
    return grid.select("translate_method", *[r(l) for l in LANGS], r("mean"))


SCALES = "CASE o_orderpriority WHEN '1-URGENT' THEN 1000 WHEN '2-HIGH' THEN 5000 WHEN '3-MEDIUM' THEN 10000 WHEN '4-NOT SPECIFIED' THEN 25000 ELSE 50000 END"
SCALED = f"(SELECT target_lang, {SCALES.replace('o_orderpriority', 'base_model')} AS scale, avg(pg_score) AS pg_score FROM v_orders GROUP BY 1, 2)"


@query(
    "a15_scale_series",
    f"SELECT target_lang, scale, {R('pg_score', 'pg_score')}, {R('previous', 'previous')}, round(pg_score - previous, 6) + 0e0 AS change FROM "
    f"(SELECT *, lag(pg_score) OVER (PARTITION BY target_lang ORDER BY scale) AS previous FROM {SCALED})",
)
def _(t):
    rows = t.v_orders.withColumn("scale", F.expr(SCALES.replace("o_orderpriority", "base_model")))
    series = rows.groupBy("target_lang", "scale").agg(F.avg("pg_score").alias("pg_score"))
    got = reports.change_along(series, "scale", "pg_score", ["target_lang"])
    return got.select("target_lang", "scale", *[r(c) for c in ("pg_score", "previous", "change")]).orderBy("target_lang", "scale")


# --- rankings, samples, sorts ---------------------------------------------------------------------


def runs_of_tasks(t):
    """Runs of a task within a teacher's language; each event is one run."""
    return documents.exploded_results(dumps(t).select("dataset", "run", "results"))


def dedupe_sql(pick: str) -> str:
    return f"SELECT dataset, eval, {'min' if pick == 'arg_min' else 'max'}(run) AS run, round({pick}(result, run), 6) AS result FROM v_runs GROUP BY dataset, eval"


def run_value():
    return r(F.coalesce(*[F.try_element_at("metrics", F.lit(m)) for m in ("acc", "extractive_match", "weighted_acc")]), "result")


@query("t1_earliest_run", dedupe_sql("arg_min"))
def _(t):
    return scores.dedupe_runs(runs_of_tasks(t), ["dataset", "eval"]).select("dataset", "eval", "run", run_value())


@query("t1_latest_run", dedupe_sql("arg_max"))
def _(t):
    return scores.dedupe_runs(runs_of_tasks(t), ["dataset", "eval"], keep="last").select("dataset", "eval", "run", run_value())


def quota_sql(source: str, strategy: str, total: int, by: str = "") -> str:
    part, keys, lead = (f"PARTITION BY {by}", f"{by}, {strategy}", f"{by}, ") if by else ("", strategy, "")
    return (
        f"(SELECT {lead}{strategy}, available, taken + greatest(0, least(spare, open - coalesce(sum(spare) OVER ({part} ORDER BY spare DESC, {strategy} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota "
        f"FROM (SELECT *, {total} - sum(taken) OVER ({part}) AS open FROM (SELECT *, least(share, available) AS taken, available - least(share, available) AS spare "
        f"FROM (SELECT *, {total} // count(*) OVER ({part}) AS share FROM (SELECT {keys}, count(*) AS available FROM {source} GROUP BY {keys})))))"
    )


@query("t2_strategy_quotas", f"SELECT strategy, available, quota::BIGINT AS quota FROM {quota_sql('v_sft', 'strategy', 150)}")
def _(t):
    return sampling.strategy_quotas(t.v_sft, 150)


@query("t2_balanced_subsample", f"SELECT id, x.strategy, prompt FROM {ranked('v_sft', 'strategy', 'id')} x JOIN {quota_sql('v_sft', 'strategy', 150)} q ON x.strategy = q.strategy WHERE rn <= quota")
def _(t):
    return sampling.balanced_subsample(t.v_sft, 150).select("id", "strategy", "prompt")


BALANCED_DOCS = f"SELECT id, x.language, x.model FROM {ranked('v_corpus', 'language, model', 'id')} x JOIN {quota_sql('v_corpus', 'model', 100, 'language')} q ON x.language = q.language AND x.model = q.model WHERE rn <= quota"


@query("t2_balanced_by_language", BALANCED_DOCS)
def _(t):
    return sampling.balanced_subsample(t.v_corpus, 100, strategy="model", by=["language"]).select("id", "language", "model")


@query("t3_sample_per_group", f"SELECT event_id, event_type FROM {ranked('events', 'event_type', 'event_id')} WHERE rn <= 300")
def _(t):
    return sampling.sample_per_group(t.events, 300, "event_type", "event_id").select("event_id", "event_type")


@query("t3_shortages", "SELECT lang, count(*) AS available FROM documents GROUP BY lang HAVING count(*) < 140")
def _(t):
    return sampling.shortages(t.documents, 140, "lang")


@query("t4_shuffle_take", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {HASH.format(id='o_orderkey')} LIMIT 2500")
def _(t):
    return sampling.shuffle_take(t.orders, 2500, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("t5_share_by_hash", "SELECT doc_id FROM documents WHERE ('0x' || substr(md5(concat('42|', CAST(doc_id AS VARCHAR))), 1, 15))::BIGINT % 1000000 < 300000")
def _(t):
    return sampling.share_by_hash(t.documents, 0.3, "doc_id").select("doc_id")


@query("t6_train_validation", f"SELECT event_id, CASE WHEN rn <= floor(0.95::DOUBLE * (SELECT count(*) FROM events)) THEN 'train' ELSE 'validation' END AS split FROM {ranked('events', '', 'event_id')}")
def _(t):
    return sampling.train_validation(t.events, 0.95, "event_id").select("event_id", "split")


@query(
    "t7_ranking_frequency",
    "SELECT teacher_model, count(DISTINCT base_model) AS base_models, count(*) FILTER (WHERE rk = 1) AS times_ranked_1st, count(*) FILTER (WHERE rk <= 3) AS times_in_top_3 FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY base_model ORDER BY pg_score DESC, teacher_model) AS rk FROM {MEANS}) GROUP BY 1",
)
def _(t):
    return reports.ranking_frequency(means(t)).orderBy(F.desc("times_ranked_1st"))


@query(
    "t8_ends_per_group",
    "SELECT target_lang, id, part, rank, round(pg_score, 6) AS pg_score FROM (SELECT *, 'top' AS part, row_number() OVER (PARTITION BY target_lang ORDER BY pg_score DESC, id) AS rank FROM v_orders "
    "UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY target_lang ORDER BY pg_score, id DESC) FROM v_orders) WHERE rank <= 3",
)
def _(t):
    return reports.ends_per_group(t.v_orders, "target_lang", "pg_score", "id").select("target_lang", "id", "part", F.col("rank").cast("bigint").alias("rank"), r("pg_score"))


@query("t9_sorted_report", "SELECT base_model, count(*) AS n, coalesce(list_position(['view', 'click', 'error'], base_model), 4)::INT AS place FROM v_scores GROUP BY base_model")
def _(t):
    wanted = ["view", "click", "error"]
    rows = t.v_scores.groupBy("base_model").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("place", reports.in_order("base_model", wanted).cast("int")).orderBy("place", "base_model")


@query("t10_top_listing", "SELECT id, round(pg_score, 6) AS pg_score FROM v_orders ORDER BY v_orders.pg_score DESC LIMIT 10")
def _(t):
    return reports.best_rows(t.v_orders.select("id", "pg_score"), "pg_score").select("id", r("pg_score"))


@query(
    "t11_step_changes",
    "SELECT experiment, round(score, 6) AS score, round(lag(score) OVER (ORDER BY experiment), 6) AS previous, round(score - lag(score) OVER (ORDER BY experiment), 6) + 0e0 AS change FROM "
    "(SELECT base_model AS experiment, avg(pg_score) AS score FROM v_orders GROUP BY 1)",
)
def _(t):
    stages = t.v_orders.groupBy(F.col("base_model").alias("experiment")).agg(F.avg("pg_score").alias("score"))
    return reports.change_along(stages, "experiment", "score").select("experiment", *[r(c) for c in ("score", "previous", "change")])


@query("u1_union_by_name", "SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id * 1000 + turn, text, NULL, role FROM conversations")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return tables.union_all([docs, turns])


@query("u2_set_difference", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1))")
def _(t):
    poor = t.labels.filter("quality = 0 and toxic = 1").join(t.documents, "doc_id").select("source")
    return t.documents.select("source").distinct().join(poor.distinct(), "source", "left_anti")


@query("m11_unknown_tasks", "SELECT task, count(*) AS n FROM v_runs WHERE task = 'other_task' GROUP BY task")
def _(t):
    rows = documents.exploded_results(dumps(t).select("event_id", "results")).withColumns(eval_name(F.col("eval")))
    return scores.unknown_task_counts(rows)


@query("m11_headline_metric", "SELECT event_id, task, round(result, 9) AS result, round(result_stderr, 9) AS result_stderr FROM v_runs WHERE task <> 'other_task'")
def _(t):
    rows = documents.exploded_results(dumps(t).select("event_id", "results")).withColumns(eval_name(F.col("eval")))
    known = rows.filter(scores.known_tasks()).withColumns(scores.headline_result())
    return known.select("event_id", "task", r("result", digits=9), r("result_stderr", digits=9))
