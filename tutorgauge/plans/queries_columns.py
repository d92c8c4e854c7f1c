"""Queries of the column functions, prompt builders and filters (P, B, F)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions import names, text
from tutorgauge.functions.hashing import stable_id
from tutorgauge.operators import filters, reports, synthesis
from tutorgauge.operators.scores import dedupe_runs
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.queries_sources import dumps
from tutorgauge.plans.views import TAG, case
from tutorgauge.sources import documents, tables
from tutorgauge.sources.dims import known_number


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_fill(template: str, **values: str) -> str:
    """SQL that puts expressions into a template's marks."""
    pieces = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(values[p] if i % 2 else sql_text(p) for i, p in enumerate(pieces) if i % 2 or p) + ")"


# --- names and projections --------------------------------------------------------------------


@query("p1_eval_name", "SELECT event_id, task, eval_lang, n_shots::INT AS n_shots FROM v_runs")
def _(t):
    return t.v_runs.select("event_id", *[c.alias(k) for k, c in names.eval_name(F.col("eval")).items()])


@query(
    "p2_run_name",
    "SELECT event_id, concat('allenai/Olmo-3-1025-7B', CASE WHEN contains(dataset, '-8bit') THEN '-8bit' ELSE '' END) AS base_model, teacher_model, contains(dataset, '-lora') AS lora, "
    "contains(dataset, '-lora-4bit') OR contains(dataset, '-8bit') AS qlora, target_lang FROM v_runs",
)
def _(t):
    return t.v_runs.select("event_id", *[c.alias(k) for k, c in names.run_name(F.col("dataset"), TAG).items()])


FILE_STEM = "concat('sft-S1-', language, '_', replace(model, '/', '__'), '_intrinsic_metrics')"


@query("p3_metric_file_name", "SELECT language, model FROM v_intrinsic")
def _(t):
    return t.v_intrinsic.select(*[c.alias(k) for k, c in names.metric_file_name(F.expr(FILE_STEM), TAG).items()])


@query("p4_metric_file_pieces", "SELECT language AS target_lang, split_part(model, '/', 2) AS teacher_model FROM v_intrinsic")
def _(t):
    return t.v_intrinsic.select(*[c.alias(k) for k, c in names.metric_file_name_short(F.expr(FILE_STEM)).items()])


@query("p5_short_model_name", "SELECT page_id, regexp_extract(url, '[^/]*$') AS short FROM pages")
def _(t):
    return t.pages.select("page_id", names.short_model_name(F.col("url")).alias("short"))


BRANCHES = [row[0] for row in fv.BASE_MODELS]


@query(
    "p6_base_model_of_branch",
    f"SELECT o_orderkey, {case('o_custkey % 3', [r_[1] for r_ in fv.BASE_MODELS])} AS base_model, {case('o_custkey % 3', [r_[2] for r_ in fv.BASE_MODELS])} AS license FROM orders",
)
def _(t):
    branch = F.concat(F.lit("exp-"), F.expr(case("o_custkey % 3", BRANCHES)), F.lit("-"), "o_orderstatus")
    return t.orders.select("o_orderkey", *[c.alias(k) for k, c in names.base_model_of_branch(branch).items()])


CODE_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
SQL_NAME = "(CASE lang " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in CODE_NAMES.items()) + " END)"


@query("p7_language_code", "SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN lang END AS code FROM documents")
def _(t):
    lower_name = F.lower(names.display_name(F.col("lang")))
    return t.documents.select("doc_id", names.language_code(F.initcap(lower_name)).alias("code"))


@query("p8_iso1_code", "SELECT doc_id, lang AS code FROM documents")
def _(t):
    iso3 = names.lookup(F.col("lang"), {"de": "deu", "en": "eng", "es": "spa", "fr": "fra"})
    return t.documents.select("doc_id", names.iso1_code(iso3).alias("code"))


@query("p9_script_code", "SELECT doc_id, CASE lang WHEN 'de' THEN 'deu_Latn' WHEN 'en' THEN 'eng_Latn' WHEN 'es' THEN 'spa_Latn' WHEN 'fr' THEN 'fra_Latn' END AS script FROM documents")
def _(t):
    return t.documents.select("doc_id", names.script_code(F.col("lang")).alias("script"))


@query("p10_display_name", f"SELECT doc_id, {SQL_NAME} AS name FROM documents")
def _(t):
    return t.documents.select("doc_id", names.display_name(F.col("lang")).alias("name"))


@query("p11_turn", "SELECT id, prompt AS first, response AS second, CAST(NULL AS VARCHAR) AS third FROM v_sft")
def _(t):
    rows = t.v_sft.select("id", text.chat_messages(F.col("prompt"), F.col("response")).alias("m"))
    return rows.select("id", *[text.turn(F.col("m"), i, "content").alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("p12_chat_messages", "SELECT id, 'user' AS role_0, prompt AS content_0, 'assistant' AS role_1, response AS content_1 FROM v_sft")
def _(t):
    rows = t.v_sft.select("id", text.chat_messages(F.col("prompt"), F.col("response")).alias("m"))
    return rows.select("id", *[text.turn(F.col("m"), i, f).alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content")])


@query("p13_surrogate_id", "SELECT doc_id, md5(concat_ws('|', coalesce(length(source) || ':' || source, '-'), length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR))) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", stable_id("source", F.col("doc_id").cast("string")).alias("id"))


@query("p14_content_hash", "SELECT doc_id, md5(text) AS source_id FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("source_id"))


@query("p15_prefixed_id", "SELECT concat('saillab/alpaca-filipino-cleaned_', CAST(doc_id AS VARCHAR)) AS source_id FROM documents")
def _(t):
    return t.documents.select(F.concat(F.lit(fv.ALPACA_FILIPINO + "_"), F.col("doc_id").cast("string")).alias("source_id"))


@query("p16_rename_and_copy", "SELECT id, prompt AS prompt_en, response AS response_en, prompt FROM v_sft")
def _(t):
    rows = t.v_sft.select("id", "prompt", "response")
    return tables.renamed(rows, {"prompt": "prompt_en", "response": "response_en"}, {"prompt": "prompt_en"})


@query("p17_constants", "SELECT teacher_model, target_lang, round(pg_score, 6) AS pg_score, 10000 AS scale, 'both' AS translate_method FROM v_teacher_scores")
def _(t):
    return tables.with_constants(t.v_teacher_scores.select("teacher_model", "target_lang", r("pg_score")), {"scale": 10000, "translate_method": "both"})


@query("p18_keep_columns", "SELECT id, 'tl' AS language, strategy, model, prompt, response FROM v_sft")
def _(t):
    return tables.keep_columns(t.v_sft, fv.RELEASE_COLUMNS, {"language": F.lit("tl")})


@query("p19_known_number", "SELECT event_id, round(value, 6) AS size FROM events WHERE event_type <> 'error'")
def _(t):
    held = F.when(F.col("event_type") == "error", "Unknown").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", r(known_number(held), "size")).filter(F.col("size").isNotNull())


@query("p20_math", "SELECT event_id, round(ln(value), 6) AS log_value, round(-ln(1 + value), 6) AS neg_log1p, round(exp(value / 1000), 6) AS exp_value, round(value / 7, 4) AS rounded FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", r(F.log(v), "log_value"), r(-F.log1p(v), "neg_log1p"), r(F.exp(v / 1000), "exp_value"), r(v / 7, "rounded", 4))


@query(
    "p21_time_text",
    "SELECT event_id, printf('%02dh%02dm%02ds', (floor(value * 100)::BIGINT // 3600), (floor(value * 100)::BIGINT % 3600) // 60, floor(value * 100)::BIGINT % 60) AS elapsed, "
    "strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM events",
)
def _(t):
    return t.events.select("event_id", text.human_time(F.col("value") * 100).alias("elapsed"), text.run_stamp(F.col("ts")).alias("stamp"))


@query("p22_metric_params", "SELECT event_id, props AS length_params, concat('{\"batch_size\":', CAST(user_id AS VARCHAR), '}') AS perplexity_params, user_id AS batch_size FROM events")
def _(t):
    option = F.concat(F.lit("length::"), "props", F.lit('|perplexity::{"batch_size":'), F.col("user_id").cast("string"), F.lit("}"))
    rows = t.events.select("event_id", text.metric_params(option).alias("m"))
    held = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select(
        "event_id", held("length").alias("length_params"), held("perplexity").alias("perplexity_params"),
        F.get_json_object(held("perplexity"), "$.batch_size").cast("bigint").alias("batch_size"),
    )


def wide_sql() -> str:
    """Latest run of each (teacher, task, language), pivoted; means over the cells that are there."""
    benches = list(fv.WIDE_TASK_NAMES.values())
    tasks = {"global_mmlu_lite": "global_mmlu_lite", "mgsm": "mgsm_custom", "mrewardbench": "mrewardbench_mcf"}
    cell = lambda b, l, c: f"max({c}) FILTER (WHERE task = '{tasks[b]}' AND eval_lang = '{l}')"
    cols = [f"{cell(b, l, 'result')} AS {b}_{l}, {cell(b, l, 'result_stderr')} AS {b}_{l}_stderr" for b in benches for l in fv.BENCHMARKED_LANGUAGES]
    latest = "SELECT teacher_model, task, eval_lang, arg_max(result, run) AS result, arg_max(result_stderr, run) AS result_stderr FROM v_runs GROUP BY ALL"
    wide = f"SELECT concat('org/', teacher_model) AS model_name, {', '.join(cols)} FROM ({latest}) WHERE task <> 'other_task' GROUP BY teacher_model"
    mean = lambda names: f"list_avg(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL))"
    avgs = {l: mean([f"{b}_{l}" for b in benches]) for l in fv.BENCHMARKED_LANGUAGES}
    shown = [f"round({b}_{l}{e}, 9) AS {b}_{l}{e}" for b in benches for l in fv.BENCHMARKED_LANGUAGES for e in ("", "_stderr")]
    shown += [f"round({a}, 9) AS avg_{l}" for l, a in avgs.items()] + [f"round({mean(list(avgs.values()))}, 9) AS avg_all"]
    return f"SELECT model_name, {', '.join(shown)} FROM ({wide})"


@query("p23_wide_benchmarks", wide_sql())
def _(t):
    tasks = documents.exploded_results(dumps(t).withColumns(documents.run_config()).select("model_name", "run", "results"))
    rows = tasks.withColumns(names.eval_name(F.col("eval"))).drop("eval", "n_shots")
    # A teacher has several datasets here, so a cell takes its latest run over all of them.
    wide = reports.wide_benchmarks(dedupe_runs(rows, ["model_name", "task", "eval_lang"], keep="last"))
    return wide.select("model_name", *[r(c, digits=9) for c in wide.columns[1:]])


@query(
    "p24_significance_marks",
    "SELECT event_id, CASE WHEN value / 500 < 0.01 THEN '**' WHEN value / 500 < 0.05 THEN '*' ELSE '' END AS mark, "
    "CASE WHEN value / 500 < 0.001 THEN 'p < 0.001' WHEN value / 500 < 0.01 THEN 'p < 0.01' WHEN value / 500 < 0.05 THEN 'p < 0.05' ELSE 'large' END AS p_text FROM events",
)
def _(t):
    p = F.col("value") / 500
    shown = text.p_text(p)
    return t.events.select("event_id", text.stars(p).alias("mark"), F.when(shown.startswith("p = "), "large").otherwise(shown).alias("p_text"))


# --- prompts and tokens -------------------------------------------------------------------------

HASH_NUMBER = "('0x' || substr(md5(concat('42|', CAST({id} AS VARCHAR), '|{j}')), 1, 15))::BIGINT"
POOL = "(SELECT *, row_number() OVER (ORDER BY md5(concat('42|', CAST(id AS VARCHAR))), id) - 1 AS idx FROM v_sft)"
DRAWS = (
    "(SELECT id, d0, d1, d2 + (CASE WHEN d2 >= least(d0, d1) THEN 1 ELSE 0 END) + (CASE WHEN d2 + (CASE WHEN d2 >= least(d0, d1) THEN 1 ELSE 0 END) >= greatest(d0, d1) THEN 1 ELSE 0 END) AS d2 "
    "FROM (SELECT id, d0, d1 + (CASE WHEN d1 >= d0 THEN 1 ELSE 0 END) AS d1, d2 FROM (SELECT id, "
    + ", ".join(f"{HASH_NUMBER.format(id='id', j=j)} % (n - {j}) AS d{j}" for j in range(3))
    + " FROM v_sft, (SELECT count(*) AS n FROM v_sft))))"
)
EXAMPLE = "concat('Prompt: ', {p}.prompt, chr(10), 'Response: ', {p}.response)"
EXAMPLES = f"concat_ws(chr(10) || chr(10), {', '.join(EXAMPLE.format(p=p) for p in 'abc')})"
DRAWN = f"FROM {DRAWS} w JOIN {POOL} a ON a.idx = w.d0 JOIN {POOL} b ON b.idx = w.d1 JOIN {POOL} c ON c.idx = w.d2"


@query("b1_generate_requests", f"SELECT w.id, {sql_fill(fv.GENERATE_PROMPT, lang_name=sql_text('German'), examples=EXAMPLES)} AS synth_prompt {DRAWN}")
def _(t):
    return synthesis.requests(t.v_sft, "generate", "German").select("id", "synth_prompt")


@query("b2_translate_requests", f"SELECT doc_id AS id, {sql_fill(fv.TRANSLATE_PROMPT, lang_name=sql_text('Czech'), prompt='text')} AS synth_prompt FROM documents")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    return synthesis.requests(rows, "translate", "Czech").select("id", "synth_prompt")


@query("b3_respond_requests", f"SELECT doc_id AS id, {sql_fill(fv.RESPOND_PROMPT, lang_name=sql_text('Arabic'), prompt='text')} AS synth_prompt FROM documents")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"))
    return synthesis.requests(rows, "respond", "Arabic").select("id", "synth_prompt")


@query(
    "b4_strategy_dispatch",
    f"SELECT id, strategy, length({sql_fill(fv.RESPOND_PROMPT, lang_name=sql_text('Spanish'), prompt='prompt')}) AS n FROM v_sft WHERE strategy = 'respond' UNION ALL "
    f"SELECT id, strategy, length({sql_fill(fv.TRANSLATE_PROMPT, lang_name=sql_text('Spanish'), prompt='prompt')}) FROM v_sft WHERE strategy = 'translate'",
)
def _(t):
    parts = [synthesis.requests(t.v_sft.filter(F.col("strategy") == s), s, "Spanish") for s in ("respond", "translate")]
    return tables.union_all(parts).select("id", "strategy", F.length("synth_prompt").cast("bigint").alias("n"))


RUBRIC_SQL = sql_fill(
    fv.RUBRIC_PROMPT, language=SQL_NAME, instruction="source", response="text",
    rubric=sql_fill(fv.RUBRIC_LAYOUT, criteria=sql_fill(fv.RUBRIC_CRITERION, lang_name=SQL_NAME), **{f"score{i}_description": sql_text(x) for i, x in enumerate(fv.RUBRIC_LEVELS, 1)}),
)


@query("b5_rubric_requests", f"SELECT doc_id AS id, {RUBRIC_SQL} AS request, {sql_fill(fv.SYSTEM_PROMPT, lang_name=SQL_NAME)} AS system FROM documents")
def _(t):
    name = names.display_name(F.col("lang"))
    return t.documents.select(
        F.col("doc_id").alias("id"), synthesis.rubric_request(name, F.col("source"), F.col("text")).alias("request"),
        text.fill(fv.SYSTEM_PROMPT, lang_name=name).alias("system"),
    )


@query(
    "b6_chat_text",
    "SELECT id, concat('<start_of_turn>user', chr(10), trim(prompt), '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10), trim(response), '<end_of_turn>', chr(10)) AS text FROM v_sft",
)
def _(t):
    return t.v_sft.select("id", text.chat_text(text.chat_messages(F.col("prompt"), F.col("response"))).alias("text"))


SQL_TOKENS = "len(regexp_extract_all({c}, '\\S+'))"


@query("b7_token_count", f"SELECT doc_id, {SQL_TOKENS.format(c='text')} AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query("b7_custom_token_count", "SELECT doc_id, length(text) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.token_counter(len)(F.col("text")).cast("bigint").alias("tokens"))


SYSTEM_TOKENS = len(fv.SYSTEM_PROMPT.format(lang_name="German").split())


@query("b8_token_budget", f"SELECT {SQL_TOKENS.format(c='text')} + {SYSTEM_TOKENS} + 500 <= 800 AS fits, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    marked = synthesis.within_budget(t.documents, 800, synthesis.system_prompt("German"), prompt="text", flag="fits")
    return marked.groupBy("fits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "b9_truncate",
    f"SELECT doc_id, CASE WHEN {SQL_TOKENS.format(c='text')} > 40 THEN array_to_string(regexp_extract_all(text, '\\S+')[1:40], ' ') ELSE text END AS text FROM documents",
)
def _(t):
    return synthesis.truncated(t.documents.select("doc_id", "text"), "text", 40)


def token_rows(t):
    """Token numbers of a pair: here the length of each word."""
    number = lambda c: F.transform(text.tokens(F.col(c)), lambda w: F.length(w))
    return t.v_sft.select("id", number("prompt").alias("src_tokens"), number("response").alias("dst_tokens"))


@query(
    "b10_training_rows",
    "SELECT id, array_to_string(list_concat(s, d, list_transform(range(greatest(120 - len(s) - len(d), 0)), lambda x: 0)), ' ') AS input_tokens, "
    "len(d) AS loss_tokens, 120 AS size FROM (SELECT id, list_transform(regexp_extract_all(prompt, '\\S+'), lambda w: length(w)) AS s, list_transform(regexp_extract_all(response, '\\S+'), lambda w: length(w)) AS d FROM v_sft) WHERE len(s) + len(d) <= 120",
)
def _(t):
    rows = synthesis.training_rows(token_rows(t), 120)
    return rows.select(
        "id", F.array_join(F.transform("input_tokens", lambda x: x.cast("string")), " ").alias("input_tokens"),
        F.aggregate("input_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("loss_tokens"), F.size("input_mask").alias("size"),
    )


@query(
    "b11_choice_rows",
    "SELECT l_orderkey, l_linenumber, l_returnflag || ',' || l_linestatus || ',' || l_partkey || ',' || l_suppkey AS choices, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 13 ELSE 17 END AS gold_idx FROM lineitem",
)
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("answer"), F.col("l_linestatus").alias("question"), F.col("l_returnflag").alias("option_a"),
        F.col("l_linestatus").alias("option_b"), F.col("l_partkey").cast("string").alias("option_c"), F.col("l_suppkey").cast("string").alias("option_d"),
    )
    return synthesis.choice_rows(rows).select("l_orderkey", "l_linenumber", F.array_join("choices", ",").alias("choices"), "gold_idx")


TOLD = "(CASE lang " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in fv.NUMBER_INSTRUCTIONS.items()) + f" ELSE '{fv.NUMBER_INSTRUCTIONS['en']}' END)"


@query("b12_number_prompts", f"SELECT doc_id, concat(text, chr(10), chr(10), {TOLD}, chr(10), 'Answer:') AS query, CAST(n_chars AS VARCHAR) AS gold FROM documents")
def _(t):
    return t.documents.select("doc_id", *[c.alias(k) for k, c in synthesis.number_prompt(F.col("text"), F.col("lang"), F.col("n_chars")).items()])


FLIP = "('0x' || substr(md5(concat('42|', CAST(id AS VARCHAR))), 1, 15))::BIGINT % 2"


@query(
    "b13_preference_rows",
    f"SELECT id, {sql_fill(fv.JUDGE_PROMPT, language='language', question='prompt')} AS query, ({FLIP})::INT AS gold_idx, "
    f"CASE WHEN {FLIP} = 0 THEN response ELSE model END AS first, CASE WHEN {FLIP} = 0 THEN model ELSE response END AS second, strategy AS source FROM v_sft",
)
def _(t):
    rows = t.v_sft.select("id", "language", "prompt", F.col("response").alias("chosen"), F.col("model").alias("rejected"), F.col("strategy").alias("source"))
    made = synthesis.preference_rows(rows)
    return made.select("id", "query", "gold_idx", F.get("choices", F.lit(0)).alias("first"), F.get("choices", F.lit(1)).alias("second"), "source")


# --- filters ------------------------------------------------------------------------------------


def with_gaps(t):
    """Events with nulls and NaNs: errors have no value, sign-ups have NaN."""
    v = F.when(F.col("event_type") == "signup", F.lit(float("nan"))).when(F.col("event_type") != "error", F.col("value"))
    half = F.when(F.hour("ts") < 12, "early").otherwise("late").alias("half")
    return t.events.select("event_id", "user_id", half, F.nullif("event_type", F.lit("view")).alias("kind"), v.alias("value"))


GAPS = (
    "(SELECT event_id, user_id, CASE WHEN hour(ts) < 12 THEN 'early' ELSE 'late' END AS half, nullif(event_type, 'view') AS kind, CASE WHEN event_type = 'signup' THEN 'NaN'::DOUBLE WHEN event_type <> 'error' THEN value END AS value FROM events)"
)


@query("f1_matching_rows", f"SELECT event_id, kind, round(value, 6) AS value FROM {GAPS} WHERE kind IS NULL AND half = 'late'")
def _(t):
    return filters.matching(with_gaps(t), {"kind": None, "half": "late"}).select("event_id", "kind", r("value"))


@query(
    "f2_missing_rows",
    f"SELECT 'null only' AS rule, kind, count(*) AS n FROM {GAPS} WHERE kind IS NOT NULL AND value IS NOT NULL GROUP BY kind UNION ALL "
    f"SELECT 'null or NaN', kind, count(*) FROM {GAPS} WHERE kind IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY kind",
)
def _(t):
    rows = with_gaps(t)
    count = lambda df, rule: reports.histogram(df, "kind").select(F.lit(rule).alias("rule"), "kind", F.col("count").alias("n"))
    return count(filters.without_nulls(rows), "null only").unionByName(count(filters.without_missing(rows), "null or NaN"))


@query("f3_answered", "SELECT id, response FROM v_sft WHERE strategy <> 'translate'")
def _(t):
    rows = t.v_sft.withColumn("response", F.when(F.col("strategy") != "translate", F.col("response")))
    return synthesis.answered(rows).select("id", "response")


@query("f4_membership", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    listed = t.documents.filter(filters.in_list("lang", ["de", "es"]))
    return filters.in_table(listed, t.labels.filter("quality = 1"), "doc_id").select("doc_id", "lang")


@query("f5_substring_exclusion", "SELECT page_id FROM pages WHERE NOT contains(url, 'blog')")
def _(t):
    return t.pages.filter(~F.col("url").contains("blog")).select("page_id")


@query("f6_conditional_blacklist", "SELECT doc_id, lang FROM documents WHERE NOT (lang = 'de' AND n_chars > 2000) AND NOT contains(lower(text), 'englishtitle')")
def _(t):
    shown = F.concat("text", F.when(F.col("n_chars") > 2000, " EnglishTitle").otherwise(""))
    as_japanese = F.when(F.col("lang") == "de", "ja").otherwise(F.col("lang"))
    return t.documents.filter(~filters.japanese_api_call(as_japanese, shown)).select("doc_id", "lang")


@query("f7_equality", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND turn = 0")
def _(t):
    return t.conversations.filter((F.col("role") == "user") & (F.col("turn") == 0)).select("conv_id", "turn", "text")


@query(
    "f8_strategy_prefilter",
    "SELECT id, language, 'respond' AS wanted FROM v_sft WHERE strategy IN ('respond', 'generate') AND language = 'de' UNION ALL SELECT id, language, 'translate' FROM v_sft WHERE strategy = 'translate'",
)
def _(t):
    parts = [filters.for_strategy(t.v_seed, s, "de").select("id", "language", F.lit(s).alias("wanted")) for s in ("respond", "translate")]
    return tables.union_all(parts)


@query("f9_known_property", f"SELECT kind, count(*) AS n FROM {GAPS} WHERE kind IS NOT NULL GROUP BY kind")
def _(t):
    return with_gaps(t).na.drop(subset=["kind"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f10_excluded_models", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    listed = t.documents.filter(~filters.in_list("source", ["src0", "src1"]))
    return filters.not_in_table(listed, t.labels.filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query(
    "f11_mean_without_nan",
    f"SELECT user_id, round(avg(value) FILTER (WHERE NOT isnan(value)), 6) AS mean, count(*) FILTER (WHERE isnan(value)) AS n_nan FROM {GAPS} GROUP BY user_id",
)
def _(t):
    v = F.col("value")
    return with_gaps(t).groupBy("user_id").agg(r(filters.mean_without_nan(v), "mean"), filters.count_nan(v).alias("n_nan"))


@query("f12_overwrite_cell", "SELECT language, model, CASE WHEN language = 'ja' AND model = 'org/gemma-3-4b-it' THEN 4.518292 ELSE round(perplexity, 6) END AS perplexity FROM v_intrinsic")
def _(t):
    done = filters.overwrite_cell(t.v_intrinsic, {"language": "ja", "model": "org/gemma-3-4b-it"}, "perplexity", 4.518292)
    return done.select("language", "model", r("perplexity"))


@query("f13_checked_columns", "SELECT id, prompt FROM v_sft")
def _(t):
    filters.forbid_name_part("translated-set", f"{TAG}-S1")
    return filters.require_columns(t.v_sft, "prompt", "response").select("id", "prompt")
