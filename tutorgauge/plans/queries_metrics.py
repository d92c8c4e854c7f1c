"""Queries of the quality metrics and of benchmark scoring (M, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.text import token_count, tokens
from tutorgauge.operators import mergeable, evals, metrics, scores
from tutorgauge.plans import jobs
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.queries_groups import FALLBACK, quota_sql, ranked
from tutorgauge.plans.queries_columns import SQL_TOKENS
from tutorgauge.sources import documents
from tutorgauge.sources.tables import literal_table

HALVES = "(SELECT label, vec_id, embedding[1:len(embedding) // 2] AS p, embedding[len(embedding) // 2 + 1:len(embedding)] AS q FROM embeddings)"


def halves(t):
    """The two halves of each vector, in the roles of prompt and response."""
    half = F.floor(F.size("embedding") / 2).cast("int")
    return t.embeddings.select("vec_id", "label", F.slice("embedding", F.lit(1), half).alias("p"), F.slice("embedding", half + 1, F.size("embedding") - half).alias("q"))


PAIRS = (
    "SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS n, round(1 - avg(list_cosine_similarity(a.p::DOUBLE[], b.p::DOUBLE[])), 6) AS prompts_distinct_ri, "
    f"round(1 - avg(list_cosine_similarity(a.q::DOUBLE[], b.q::DOUBLE[])), 6) AS responses_distinct_ri FROM {HALVES} a JOIN {HALVES} b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label"
)


@query("m1_distinct_ri", PAIRS)
def _(t):
    got = metrics.distinct_ri(halves(t), ["label"], {"prompts": "p", "responses": "q"})
    return got.select("label", "n", r("prompts_distinct_ri"), r("responses_distinct_ri"))


@query("j9_mean_similarity", "SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1")
def _(t):
    # The all-pairs similarity is never built: its mean follows from the sum of the unit vectors.
    return metrics.distinct_ri(t.embeddings, ["label"], {"all": "embedding"}).select("label", r(1 - F.col("all_distinct_ri"), "similarity"))


@query("m1_distinct_ri_overall", "SELECT round(1 - avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS vectors_distinct_ri FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id")
def _(t):
    return metrics.distinct_ri(t.embeddings, [], {"vectors": "embedding"}).select(r("vectors_distinct_ri"))


def loss_rows(t):
    """Token losses of a conversation pair: a number per word, from its length."""
    word = lambda w: F.log(F.length(w) + F.lit(1.0)) + 0.25
    both = F.concat(tokens(F.col("prompt")), tokens(F.col("response")))
    return t.v_sft.select("id", "model", "language", F.transform(both, word).alias("losses"), token_count(F.col("prompt")).alias("prompt_length"))


LOSSES = (
    "(SELECT id, model, language, list_transform(regexp_extract_all(response, '\\S+'), lambda w: ln(length(w) + 1) + 0.25) AS x FROM v_sft)"
)


@query("m2_perplexity_of_losses", f"SELECT id, round(exp(list_avg(x)), 6) AS perplexity FROM {LOSSES}")
def _(t):
    return loss_rows(t).select("id", r(metrics.perplexity_of_losses("losses", "prompt_length"), "perplexity"))


@query("m2_perplexity_summary", f"SELECT model, language, round(avg(exp(list_avg(x))), 6) AS average_perplexity, count(*) AS num_valid_samples, 0::BIGINT AS num_nan_values, count(*) AS total_samples FROM {LOSSES} GROUP BY ALL")
def _(t):
    rows = loss_rows(t).withColumn("perplexity", metrics.perplexity_of_losses("losses", "prompt_length"))
    got = metrics.perplexity_summary(rows, ["model", "language"])
    return got.select("model", "language", r("average_perplexity"), "num_valid_samples", "num_nan_values", "total_samples")


@query(
    "m2_batch_perplexity",
    f"SELECT id, round(exp(sum(list_sum(x)) OVER (PARTITION BY id // 8) / sum(len(x)) OVER (PARTITION BY id // 8)), 6) AS perplexity FROM {LOSSES}",
)
def _(t):
    return metrics.batch_perplexity(loss_rows(t), "id").select("id", r("perplexity"))


UNIGRAM = (
    "WITH words AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '\\S+')) AS word FROM documents), "
    "counts AS (SELECT lang, word, count(*) AS c FROM words GROUP BY ALL), sizes AS (SELECT lang, sum(c) AS n, count(*) AS v FROM counts GROUP BY ALL) "
    "SELECT doc_id, lang, count(*) AS tokens, round(exp(avg(-ln((c + 1) / (n + v)))), 4) AS perplexity FROM words JOIN counts USING (lang, word) JOIN sizes USING (lang) GROUP BY ALL"
)


@query("m2_unigram_large_vocabulary", UNIGRAM)
def _(t):
    got = metrics.unigram_perplexity(t.documents, "text", "doc_id", ["lang"], broadcast_rows=0)
    return got.select("doc_id", "lang", "tokens", r("perplexity", digits=4))


@query("m2_unigram_perplexity", UNIGRAM)
def _(t):
    got = metrics.unigram_perplexity(t.documents, "text", "doc_id", ["lang"])
    return got.select("doc_id", "lang", "tokens", r("perplexity", digits=4))


VALID = (
    "(SELECT *, coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END, '$.score') IN ('UBIGINT', 'BIGINT') AND json_type(CASE WHEN json_valid(raw) THEN raw END, '$.feedback') = 'VARCHAR' "
    "AND (CASE WHEN json_valid(raw) THEN raw END ->> '$.score')::DOUBLE BETWEEN 1 AND 5, false) AS valid FROM v_judged)"
)
def judged_sql(view: str) -> str:
    return f"(SELECT *, CASE WHEN valid THEN (raw ->> '$.score')::INT ELSE 1 END AS score FROM {VALID.replace('v_judged', view)})"


SCORED = f"(SELECT *, CASE WHEN valid THEN (raw ->> '$.score')::INT ELSE 1 END AS score FROM {VALID})"


@query("m3_judge_feedback", f"SELECT id, score, CASE WHEN valid THEN raw ->> '$.feedback' ELSE 'Invalid output' END AS feedback, valid FROM {SCORED}")
def _(t):
    return metrics.with_judge_feedback(t.v_judged.select("id", "raw")).select("id", "score", "feedback", "valid")


M3 = ", ".join(f"count(*) FILTER (WHERE score = {s}) AS score_{s}" for s in range(1, 6))


@query("m3_rubric_score", f"SELECT model, language, round(avg(score), 6) AS average_rubric_score, {M3}, count(*) FILTER (WHERE NOT valid) AS n_invalid, count(*) AS n_judged FROM {SCORED} GROUP BY model, language")
def _(t):
    got = metrics.rubric_score(t.v_judged, ["model", "language"])
    return got.withColumn("average_rubric_score", r("average_rubric_score"))


@query(
    "m4_average_length",
    f"SELECT model, language, strategy, round(avg({SQL_TOKENS.format(c='prompt')}), 6) AS prompts_average_length, round(avg({SQL_TOKENS.format(c='response')}), 6) AS responses_average_length FROM v_sft GROUP BY ALL",
)
def _(t):
    got = metrics.average_length(t.v_sft, ["model", "language", "strategy"])
    return got.select("model", "language", "strategy", r("prompts_average_length"), r("responses_average_length"))


@query(
    "m5_metric_driver",
    "SELECT language, round(avg(" + SQL_TOKENS.format(c="text") + "), 6) AS texts_average_length, count(*) AS num_samples FROM "
    f"(SELECT x.* FROM {ranked('v_corpus', 'language, model', 'id')} x JOIN {quota_sql('v_corpus', 'model', 100, 'language')} q ON x.language = q.language AND x.model = q.model WHERE rn <= quota) GROUP BY language",
)
def _(t):
    rows = t.v_corpus.withColumn("strategy", F.col("model"))
    got = jobs.intrinsic_report(rows, ["language"], ["length"], balance=100, params={"length": {"columns": {"texts": "text"}}})
    return got.select("language", r("texts_average_length"), "num_samples")


COSINES = (
    "(SELECT a.model, a.language, avg(CASE WHEN a.p1 = 0 AND a.p2 = 0 OR b.p1 = 0 AND b.p2 = 0 THEN 0 ELSE (a.p1 * b.p1 + a.p2 * b.p2) / (sqrt(a.p1 ** 2 + a.p2 ** 2) * sqrt(b.p1 ** 2 + b.p2 ** 2)) END) AS pc, "
    "avg(CASE WHEN a.r1 = 0 AND a.r2 = 0 OR b.r1 = 0 AND b.r2 = 0 THEN 0 ELSE (a.r1 * b.r1 + a.r2 * b.r2) / (sqrt(a.r1 ** 2 + a.r2 ** 2) * sqrt(b.r1 ** 2 + b.r2 ** 2)) END) AS rc "
    "FROM v_report a JOIN v_report b ON a.model = b.model AND a.language = b.language AND a.id <> b.id GROUP BY ALL)"
)
LOSS_MEAN = "exp(list_avg(list_transform(regexp_extract_all(response, '\\S+'), lambda w: ln(length(w) + 1) + 0.25)))"


def report_rows(t):
    """Rows that carry the input of every intrinsic metric."""
    word = lambda w: F.log(F.length(w) + F.lit(1.0)) + 0.25
    losses = F.transform(F.concat(tokens(F.col("prompt")), tokens(F.col("response"))), word)
    return t.v_report.select(
        "id", "model", "language", "prompt", "response", "raw", F.array("p1", "p2").alias("prompt_embedding"), F.array("r1", "r2").alias("response_embedding"),
        losses.alias("losses"), token_count(F.col("prompt")).alias("prompt_length"),
    )


@query(
    "m5_full_report",
    f"SELECT j.model, j.language, round(1 - any_value(c.pc), 6) AS prompts_distinct_ri, round(1 - any_value(c.rc), 6) AS responses_distinct_ri, round(avg({SQL_TOKENS.format(c='prompt')}), 6) AS prompts_average_length, "
    f"round(avg({SQL_TOKENS.format(c='response')}), 6) AS responses_average_length, round(avg({LOSS_MEAN}), 6) AS average_perplexity, count(*) FILTER (WHERE {LOSS_MEAN} IS NULL) AS num_nan_values, "
    f"round(avg(score), 6) AS average_rubric_score, {M3}, count(*) FILTER (WHERE NOT valid) AS n_invalid, count(*) AS n_judged, count(*) AS num_samples "
    f"FROM {judged_sql('v_report')} j LEFT JOIN {COSINES} c ON j.model = c.model AND j.language = c.language GROUP BY 1, 2",
)
def _(t):
    got = jobs.intrinsic_report(report_rows(t), ["model", "language"], ["all"])
    rounded = ["prompts_distinct_ri", "responses_distinct_ri", "prompts_average_length", "responses_average_length", "average_perplexity", "average_rubric_score"]
    return got.withColumns({c: r(c) for c in rounded})


def log_length_stat(column: str = "n_chars") -> mergeable.Mergeable:
    """A user's own statistic: geometric mean and log-variance of a length, from three sums."""
    x = F.log(F.col(column) + 1.0)
    mean = F.col("_log_s") / F.col("_log_n")
    return mergeable.Mergeable(
        lambda df: df,
        {"_log_n": F.count(column), "_log_s": F.sum(x), "_log_q": F.sum(x * x)},
        {"geometric_mean": F.exp(mean) - 1, "log_variance": F.greatest(F.col("_log_q") / F.col("_log_n") - mean * mean, F.lit(0.0))},
    )


@query("m5_user_statistic", "SELECT lang, source, round(exp(avg(ln(n_chars + 1e0))) - 1, 4) AS geometric_mean, round(var_pop(ln(n_chars + 1e0)), 6) + 0e0 AS log_variance FROM documents GROUP BY ALL")
def _(t):
    got = mergeable.evaluated(t.documents, ["lang", "source"], [log_length_stat()])
    return got.select("lang", "source", r("geometric_mean", digits=4), r("log_variance"))


@query("m5_group_statistic", "SELECT target_lang, task, median(result) AS middle, round(mad(result), 6) AS spread, count(*) AS n FROM v_evals GROUP BY ALL")
def _(t):
    def middle(group):
        import pandas as pd

        m = group["result"].median()
        return pd.DataFrame({"target_lang": group["target_lang"].head(1), "task": group["task"].head(1), "middle": m, "spread": (group["result"] - m).abs().median(), "n": len(group)})

    rows = t.v_evals.select("target_lang", "task", "result")
    got = mergeable.grouped_pandas(rows, ["target_lang", "task"], middle, "target_lang string, task string, middle double, spread double, n long", max_rows=5_000_000)
    return got.withColumn("spread", r("spread"))


def z(column: str, value: str | None = None) -> str:
    v = value or column
    return f"({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER ()"


Z_PARTS = {c: z(c) for c in scores.INTRINSIC[:3]} | {"perplexity": z("perplexity", "-ln(1 + perplexity)")}
Z_SCORE = "(SELECT language, model, (" + " + ".join(Z_PARTS.values()) + ") / 4 AS z_score FROM v_intrinsic)"


@query("m6_intrinsic_zscore", f"SELECT language, model, round(z_score, 6) + 0e0 AS z_score FROM {Z_SCORE}")
def _(t):
    return scores.intrinsic_zscore(t.v_intrinsic).select("language", "model", r("z_score"))


@query("m6_zscore_per_language", "SELECT language, model, round((" + " + ".join(p.replace("OVER ()", "OVER (PARTITION BY language)") for p in Z_PARTS.values()) + ") / 4, 6) + 0e0 AS z_score FROM v_intrinsic")
def _(t):
    return scores.intrinsic_zscore(t.v_intrinsic, ["language"]).select("language", "model", r("z_score"))


@query("m7_zscore_components", "SELECT language, model, " + ", ".join(f"round({p}, 6) + 0e0 AS {c}_z" for c, p in Z_PARTS.items()) + " FROM v_intrinsic")
def _(t):
    return scores.intrinsic_components(t.v_intrinsic).select("language", "model", *[r(f"{c}_z") for c in scores.INTRINSIC])


PGR = (
    f"(SELECT s.*, (s.result - b.x) / nullif(f.x - b.x, 0) AS pgr FROM ({FALLBACK}) s LEFT JOIN (SELECT eval_lang, avg(result) AS x FROM v_base GROUP BY 1) b ON s.target_lang = b.eval_lang "
    "LEFT JOIN (SELECT eval_lang, avg(result) AS x FROM v_ref GROUP BY 1) f ON s.target_lang = f.eval_lang)"
)


@query("m8_gain_recovered", f"SELECT teacher_model, target_lang, round(result, 6) AS result, round(pgr, 6) AS pgr FROM {PGR}")
def _(t):
    return scores.gain_recovered(t.v_evals, t.v_base, t.v_ref).select("teacher_model", "target_lang", r("result"), r("pgr"))


PG = (
    f"(SELECT p.teacher_model, p.target_lang, p.result, p.result_stderr, p.pgr, i.z_score, (p.pgr + i.z_score) / 2 AS pg_score FROM {PGR} p "
    f"LEFT JOIN {Z_SCORE} i ON concat('org/', p.teacher_model) = i.model AND p.target_lang = i.language)"
)
PG_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("result", "result_stderr", "pgr", "z_score", "pg_score"))


@query("m9_pg_score", f"SELECT teacher_model, target_lang, {PG_ROUNDED} FROM {PG}")
def _(t):
    table = jobs.pg_scores(t.v_intrinsic, t.v_evals, t.v_base, t.v_ref)
    return table.select("teacher_model", "target_lang", *[r(c) for c in ("result", "result_stderr", "pgr", "z_score", "pg_score")])


@query("m10_weighted_scores", f"SELECT teacher_model, target_lang, alpha, round(alpha * z_score + (1 - alpha) * pgr, 6) AS weighted FROM v_teacher_scores, (VALUES {', '.join(f'({a}::DOUBLE)' for a in fv.ALPHAS)}) AS w(alpha)")
def _(t):
    return scores.weighted_scores(t.v_teacher_scores).select("teacher_model", "target_lang", "alpha", r("weighted"))


@query("m12_recomputed_perplexity", "SELECT source, round(avg(n_chars) FILTER (WHERE lang <> 'fr'), 6) AS average_perplexity, count(*) FILTER (WHERE lang = 'fr') AS num_nan_values FROM documents GROUP BY source")
def _(t):
    value = F.when(F.col("lang") == "fr", float("nan")).otherwise(F.col("n_chars").cast("double"))
    row = F.struct(F.col("text").alias("instruction"), F.lit("").alias("response"), value.alias("perplexity"))
    stem = F.concat(F.lit("sft-S1-en_org__"), "source", F.lit("_intrinsic_metrics"))
    docs = t.documents.select(stem.alias("stem"), F.struct(F.array(row).alias("per_instance_perplexity")).alias("perplexity"))
    rows = documents.per_instance(docs, "perplexity", "sft").withColumn("source", F.element_at(F.split("model", "/"), -1))
    return metrics.perplexity_summary(rows, ["source"]).select("source", r("average_perplexity"), "num_nan_values")


# --- benchmark responses ----------------------------------------------------------------------------


def choice_items(t):
    """Four options per order line, with log-likelihoods and lengths out of its numbers."""
    d = lambda c: F.col(c).cast("double")
    return t.lineitem.select(
        "l_returnflag", "l_linestatus", (F.col("l_partkey") % 4).alias("gold_idx"),
        F.array(-d("l_quantity"), -d("l_extendedprice") / 1500, -d("l_discount") * 400, -d("l_tax") * 500).alias("logp"),
        F.array(d("l_linenumber"), F.lit(2.0), d("l_linenumber") + 1, F.lit(3.0)).alias("n_tokens"),
        F.array(F.lit(9.0), d("l_linenumber") * 3, F.lit(8.0), d("l_linenumber") + 2).alias("n_chars"),
        F.array(-d("l_tax") * 300, F.lit(-20.0), -d("l_quantity") / 2, F.lit(-10.0)).alias("logp_uncond"),
    )


def best_sql(options: list[str]) -> str:
    """Index of the first largest option."""
    top = f"greatest({', '.join(options)})"
    return "(CASE " + " ".join(f"WHEN {o} = {top} THEN {i}" for i, o in enumerate(options)) + " END)"


LOGP = ["-l_quantity", "-l_extendedprice / 1500", "-l_discount * 400", "-l_tax * 500"]
NTOK = ["l_linenumber::DOUBLE", "2e0", "(l_linenumber::DOUBLE + 1)", "3e0"]
NCHR = ["9e0", "(l_linenumber::DOUBLE * 3)", "8e0", "(l_linenumber::DOUBLE + 2)"]
UNC = ["-l_tax * 300", "-20e0", "-l_quantity / 2", "-10e0"]
HITS = {
    "acc_norm_token": best_sql([f"(({a}) / {b})" for a, b in zip(LOGP, NTOK)]),
    "acc_norm_char": best_sql([f"(({a}) / {b})" for a, b in zip(LOGP, NCHR)]),
    "acc_norm_pmi": best_sql([f"(({a}) - ({b}))" for a, b in zip(LOGP, UNC)]),
}


@query("e1_choice_accuracy", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg(({e} = l_partkey % 4)::INT), 6) AS {k}" for k, e in HITS.items()) + ", count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    got = evals.choice_accuracy(choice_items(t), ["l_returnflag", "l_linestatus"])
    return got.select("l_returnflag", "l_linestatus", *[r(k) for k in HITS], "n")


VERDICT = "CASE regexp_extract(upper(trim(text)), '[AB]') WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE -1 END"


@query("e2_verdicts", f"SELECT doc_id, {VERDICT} AS verdict FROM documents")
def _(t):
    return t.documents.select("doc_id", evals.verdict(F.col("text")).alias("verdict"))


@query("e2_verdict_accuracy", f"SELECT d.lang, round(avg((({VERDICT}) = l.quality)::INT), 6) AS acc, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def _(t):
    return evals.verdict_accuracy(t.documents.join(t.labels, "doc_id"), ["lang"], "text", "quality").select("lang", r("acc"), "n")


NUMBER = "regexp_extract(html, '-?\\d+(?:,\\d{3})*(?:\\.\\d+)?')"


@query(
    "e3_number_match",
    f"SELECT page_id, nullif(replace({NUMBER}, ',', ''), '')::DOUBLE AS number, coalesce((nullif(replace({NUMBER}, ',', ''), '')::DOUBLE = page_id % 3)::INT, 0) AS hit FROM pages",
)
def _(t):
    text = F.col("html")
    return t.pages.select("page_id", evals.first_number(text).alias("number"), evals.number_match(text, (F.col("page_id") % 3).cast("double")).alias("hit"))


CATEGORIES = [("click", "Chat", 358.0), ("view", "Chat Hard", 456.0), ("purchase", "Safety", 740.0), ("signup", "Reasoning", 1431.0), ("error", "Reasoning", 1431.0)]
CATEGORY_SQL = "(VALUES " + ", ".join(f"('{s}', '{c}', {w}::DOUBLE)" for s, c, w in CATEGORIES) + ") AS c(source, category, weight)"
CATEGORY_MEANS = f"(SELECT user_id % 6 AS lang, category, avg((value > 40)::INT) AS acc, avg(weight) AS weight FROM events e JOIN {CATEGORY_SQL} ON e.event_type = c.source GROUP BY 1, 2)"


def hits(t):
    """Events in the role of judged pairs; weights and categories are example inputs."""
    rows = t.events.select((F.col("user_id") % 6).alias("lang"), F.col("event_type").alias("source"), (F.col("value") > 40).cast("double").alias("hit"))
    return rows, literal_table(t.spark, CATEGORIES, "source string, category string, weight double")


@query("e4_category_accuracy", f"SELECT lang, category, round(acc, 6) AS acc, weight FROM {CATEGORY_MEANS}")
def _(t):
    rows, categories = hits(t)
    return evals.category_accuracy(rows, categories, ["lang"]).select("lang", "category", r("acc"), "weight")


@query("e4_weighted_accuracy", f"SELECT lang, round(sum(weight * acc) / sum(weight), 6) AS weighted_acc FROM {CATEGORY_MEANS} GROUP BY lang")
def _(t):
    rows, categories = hits(t)
    return evals.weighted_accuracy(rows, categories, ["lang"]).select("lang", r("weighted_acc"))


@query("e5_mean_and_stderr", "SELECT task, eval_lang, round(avg(result), 6) AS result, round(stddev_samp(result) / sqrt(count(result)), 6) AS result_stderr, count(result) AS n FROM v_evals GROUP BY 1, 2")
def _(t):
    return evals.mean_and_stderr(t.v_evals, ["task", "eval_lang"], "result").select("task", "eval_lang", r("result"), r("result_stderr"), "n")


@query("e6_macro_average", "SELECT concat(task, ':_average') AS task, round(avg(acc), 6) AS acc, round(avg(acc_stderr), 6) AS acc_stderr FROM (SELECT task, eval_lang, avg(result) AS acc, avg(result_stderr) AS acc_stderr FROM v_evals GROUP BY 1, 2) GROUP BY task")
def _(t):
    parts = t.v_evals.groupBy(F.concat_ws(":", "task", "eval_lang").alias("task")).agg(F.avg("result").alias("acc"), F.avg("result_stderr").alias("acc_stderr"))
    return evals.macro_average(parts).select("task", r("acc"), r("acc_stderr"))


MEMBERS = [("view", "Chat", 1.0), ("click", "Chat", 2.0), ("click", "Safety", 0.5), ("purchase", "Safety", 3.0), ("signup", "Reasoning", 1.0), ("never_run", "Reasoning", 2.0), ("never_run_too", "Coding", 1.0)]
MEMBER_SQL = "(VALUES " + ", ".join(f"('{s}', '{c}', {w}::DOUBLE)" for s, c, w in MEMBERS) + ") AS c(task, category, weight)"


@query(
    "e6_category_rollup",
    f"WITH members AS (SELECT * FROM {MEMBER_SQL}), each AS (SELECT target_lang, task, avg(result) AS acc FROM v_evals GROUP BY 1, 2) "
    "SELECT target_lang, 'task' AS level, task AS name, round(acc, 6) AS acc, 1::BIGINT AS n_tasks, 0::BIGINT AS n_missing FROM each "
    "UNION ALL SELECT target_lang, 'category', category, round(sum(weight * acc) / sum(weight), 6), count(*), (SELECT count(*) FROM members m WHERE m.category = c.category) - count(*) FROM each JOIN members c USING (task) GROUP BY target_lang, category "
    "UNION ALL SELECT target_lang, 'all', 'all', round(avg(acc), 6), count(*), (SELECT count(DISTINCT task) FROM members) - count(*) FILTER (WHERE task IN (SELECT task FROM members)) FROM each GROUP BY target_lang",
)
def _(t):
    """A task in two categories, one in none, members that were never run."""
    members = literal_table(t.spark, MEMBERS, "task string, category string, weight double")
    got = evals.category_rollup(t.v_evals, members, ["target_lang"], value="result")
    return got.select("target_lang", "level", "name", r("result", "acc"), "n_tasks", "n_missing")
