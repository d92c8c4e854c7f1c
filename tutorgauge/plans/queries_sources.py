"""Queries of the scans, sinks and seed normalisers (S, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge import schemas
from tutorgauge.operators import metrics, reports
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.views import LANG_NAMES, TAG, case
from tutorgauge.session import new_folder
from tutorgauge.sources.metric_store import store_metrics
from tutorgauge.sources import dims, documents, seeds, tables
from tutorgauge.streaming import jobs as streaming

R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("s1_table_scan", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def _(t):
    rows = tables.read_table(t.spark, f"{t.folder}/documents.parquet")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s2_stream_scan", "SELECT doc_id, lang, source, text FROM documents WHERE lang IN ('de', 'es')")
def _(t):
    out, progress = streaming.stream_run(t.spark, "s2")
    stream = streaming.file_stream(t.spark, f"{t.folder}/documents*.parquet", t.documents.schema)
    return streaming.append_stream(stream.filter(F.col("lang").isin("de", "es")).select("doc_id", "lang", "source", "text"), out, progress)


SCORE_COLUMNS = "teacher_model, target_lang, " + R6("result", "pgr", "z_score", "pg_score")


@query("s3_json_lines", f"SELECT {SCORE_COLUMNS}, CAST(NULL AS DOUBLE) AS result_stderr FROM v_teacher_scores")
def _(t):
    path = new_folder(t.spark, "s3")
    tables.write_json_lines(t.v_teacher_scores.drop("result_stderr"), path)
    back = tables.read_json_lines(t.spark, path, schemas.PG_SCORES)
    return back.select("teacher_model", "target_lang", *[r(c) for c in ("result", "pgr", "z_score", "pg_score")], "result_stderr")


def metric_documents(t, name: str, missing: bool = False) -> str:
    """Writes one metric document per (language, model); with ``missing`` Czech has no rubric block."""
    rubric = F.struct(F.col("rubric_score").alias("average_rubric_score"))
    if missing:
        rubric = F.when(F.col("language") != "cs", rubric)
    stem = F.concat(F.lit(f"{TAG}-S1-"), "language", F.lit("_"), F.replace(F.col("model"), F.lit("/"), F.lit("__")), F.lit("_intrinsic_metrics"))
    docs = t.v_intrinsic.select(
        stem.alias("stem"),
        F.struct("prompts_distinct_ri", "responses_distinct_ri").alias("distinct_ri"),
        F.struct(F.col("perplexity").alias("average_perplexity")).alias("perplexity"),
        rubric.alias("reward_model"),
        F.struct("prompts_average_length", "responses_average_length").alias("length"),
    )
    path = new_folder(t.spark, name)
    documents.write_documents(docs, path)
    return path


@query(
    "s4_intrinsic_documents",
    "SELECT language, model, round(prompts_distinct_ri, 6) AS prompts_distinct_ri, round(responses_distinct_ri, 6) AS responses_distinct_ri, "
    "CASE WHEN language <> 'cs' THEN round(rubric_score, 6) END AS rubric_score, round(perplexity, 6) AS perplexity FROM v_intrinsic",
)
def _(t):
    rows = documents.read_intrinsic(t.spark, metric_documents(t, "s4", missing=True), TAG)
    return rows.select("language", "model", *[r(c) for c in ("prompts_distinct_ri", "responses_distinct_ri", "rubric_score", "perplexity")])


@query(
    "s5_complete_documents",
    "SELECT language AS target_lang, split_part(model, '/', 2) AS teacher_model, round(prompts_distinct_ri, 6) AS prompts_distinct_ri, "
    "round(responses_distinct_ri, 6) AS responses_distinct_ri, round(perplexity, 6) AS average_perplexity, round(rubric_score, 6) AS average_rubric_score, "
    "round(prompts_average_length, 6) AS prompts_average_length, round(responses_average_length, 6) AS responses_average_length "
    "FROM v_intrinsic WHERE language <> 'cs'",
)
def _(t):
    rows = documents.read_intrinsic_complete(t.spark, metric_documents(t, "s5", missing=True))
    return rows.select("target_lang", "teacher_model", *[r(c) for c in rows.columns if c not in ("target_lang", "teacher_model")])


def ablation_documents(t, name: str) -> str:
    means = t.v_evals.groupBy("task").agg(F.avg("result").alias("m"))
    docs = means.select(
        F.concat(F.lit("stage_"), "task").alias("stem"),
        F.struct(F.col("task").alias("model_name")).alias("config"),
        F.when(F.col("task") != "error", F.col("m") * 1000).alias("filbench_score"),
    )
    path = new_folder(t.spark, name)
    documents.write_documents(docs, path)
    return path


@query("s6_ablation_documents", "SELECT concat('stage_', task) AS experiment, round(CASE WHEN task <> 'error' THEN avg(result) * 1000 ELSE 0 END, 6) AS filbench_score FROM v_evals GROUP BY task")
def _(t):
    return documents.read_ablations(t.spark, ablation_documents(t, "s6")).select("experiment", r("filbench_score")).orderBy("experiment")


def dumps(t):
    """Benchmark runs with their results as JSON text, pseudo-task included."""
    name = F.get(F.array(F.lit("acc"), F.lit("extractive_match"), F.lit("weighted_acc")), F.when(F.col("task") == "mgsm_custom", 1).when(F.col("task") == "mrewardbench_mcf", 2).otherwise(0))
    cell = F.create_map(name, F.col("result"), F.concat(name, F.lit("_stderr")), F.col("result_stderr"))
    config = F.to_json(F.struct(F.concat(F.lit("org/"), "teacher_model").alias("model_name"), F.lit("bfloat16").alias("model_dtype")))
    return t.v_runs.select(
        "event_id", "dataset", "run", F.to_json(F.create_map(F.col("eval"), cell, F.lit("all"), cell)).alias("results"), config.alias("config_general")
    )


@query(
    "s7_exploded_results",
    "SELECT event_id, run, eval, round(CASE WHEN task NOT IN ('mgsm_custom', 'mrewardbench_mcf') THEN result END, 6) AS acc, "
    "round(CASE WHEN task = 'mgsm_custom' THEN result END, 6) AS extractive_match, round(CASE WHEN task = 'mrewardbench_mcf' THEN result END, 6) AS weighted_acc FROM v_runs",
)
def _(t):
    rows = documents.exploded_results(dumps(t).drop("config_general"))
    return rows.select("event_id", "run", "eval", *[r(F.try_element_at("metrics", F.lit(m)), m) for m in ("acc", "extractive_match", "weighted_acc")])


@query("s8_run_config", "SELECT run, concat('org/', teacher_model) AS model_name, 'bfloat16' AS model_dtype, CAST(NULL AS VARCHAR) AS model_size FROM v_runs")
def _(t):
    return dumps(t).select("run", *[c.alias(k) for k, c in documents.run_config().items()])


@query("s9_compressed_json", "SELECT doc_id, lang, text FROM documents")
def _(t):
    path = new_folder(t.spark, "s9")
    t.documents.select("doc_id", "lang", "text").write.option("compression", "gzip").json(path)
    return tables.read_json_lines(t.spark, path, "doc_id bigint, lang string, text string")


@query("s10_labelled_inputs", "SELECT base_model, teacher_model, target_lang, round(pg_score, 6) AS pg_score FROM v_scores")
def _(t):
    path = new_folder(t.spark, "s10")
    t.v_scores.withColumn("kind", F.col("base_model")).drop("base_model").write.partitionBy("kind").json(path)
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = tables.read_labelled(t.spark, [f"{k}::{path}/kind={k}" for k in kinds], schemas.PG_SCORES)
    return rows.select("base_model", "teacher_model", "target_lang", r("pg_score"))


@query("s12_dataset_names", "SELECT page_id, url FROM pages WHERE contains(url, 'example.net') AND NOT contains(url, '#top')")
def _(t):
    return tables.dataset_names(t.pages, "example.net", "#top", "url").select("page_id", "url")


def literal_models() -> str:
    rows = ", ".join(
        f"('{n.split('/')[-1]}', '{f}', {s if s is not None else 'NULL'})" for n, f, _, s, _, _ in fv.MODELS
    )
    return f"(VALUES {rows}) AS m(teacher, model_family, parameter_size)"


def literal_languages() -> str:
    rows = ", ".join(f"('{n}', '{c}', {lv}, {p}, {s})" for n, c, lv, p, s in fv.LANGUAGES)
    return f"(VALUES {rows}) AS l(language_name, code, joshi_etal_resource_level, pct_commoncrawl, native_speakers_in_m)"


@query(
    "s13_dimension_tables",
    f"SELECT model_family, round(m.parameter_size::DOUBLE, 6) AS parameter_size, language_name, count(*) AS n FROM v_evals e LEFT JOIN {literal_models()} ON e.teacher_model = m.teacher "
    f"LEFT JOIN {literal_languages()} ON e.target_lang = l.code GROUP BY ALL",
)
def _(t):
    rows = dims.with_dimensions(t.v_evals)
    return rows.groupBy("model_family", r("parameter_size"), "language_name").agg(F.count(F.lit(1)).alias("n"))


@query("s14_parquet_sink", "SELECT id, prompt, response, model, language, strategy FROM v_sft")
def _(t):
    path = new_folder(t.spark, "s14")
    tables.write_table(t.v_sft, path, ["language"])
    return t.spark.read.parquet(path)


@query("s15_append_sink", "SELECT id, language, model, CAST(NULL AS VARCHAR) AS prompt FROM v_sft UNION ALL SELECT id, language, NULL, prompt FROM v_sft")
def _(t):
    first, second = new_folder(t.spark, "s15a"), new_folder(t.spark, "s15b")
    tables.append_table(t.v_sft.select("id", "language", "model"), first)
    return t.spark.read.parquet(tables.append_table(t.v_sft.select("id", "language", "prompt"), first, second))


@query("s16_json_cache", f"SELECT {SCORE_COLUMNS} FROM v_teacher_scores")
def _(t):
    path = new_folder(t.spark, "s16")
    build = lambda: t.v_teacher_scores
    tables.cached_json(t.spark, path, schemas.PG_SCORES, build)
    back = tables.cached_json(t.spark, path, schemas.PG_SCORES, lambda: None)  # second call only reads
    return back.select("teacher_model", "target_lang", *[r(c) for c in ("result", "pgr", "z_score", "pg_score")])


@query("s17_csv_sheet", "SELECT prompt, response, model, CAST(NULL AS VARCHAR) AS fluency, CAST(NULL AS VARCHAR) AS \"cultural accuracy\" FROM v_sft")
def _(t):
    path = new_folder(t.spark, "s17")
    tables.write_csv(t.v_sft.select("prompt", "response", "model"), path, ("fluency", "cultural accuracy"))
    back = t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("prompt", "response", "model", *[F.nullif(c, F.lit("")).alias(c) for c in ("fluency", "cultural accuracy")])


@query(
    "s18_metric_upsert",
    "SELECT language, model, 'rubric_score' AS metric, round(rubric_score, 6) AS value FROM v_intrinsic UNION ALL "
    "SELECT language, model, 'perplexity', round(CASE WHEN language = 'de' THEN -1 ELSE perplexity END, 6) FROM v_intrinsic",
)
def _(t):
    long = metrics.metric_rows(t.v_intrinsic.select("language", "model", "rubric_score", "perplexity"), ["language", "model"])
    old = long.filter("metric = 'perplexity' and language = 'de'").withColumn("value", F.lit(-1.0))
    return metrics.upsert_metrics(old, long, ["language", "model", "metric"]).select("language", "model", "metric", r("value"))


@query(
    "s18_metric_overwrite",
    "SELECT language, model, 'rubric_score' AS metric, round(rubric_score, 6) AS value FROM v_intrinsic UNION ALL "
    "SELECT language, model, 'perplexity', round(perplexity, 6) FROM v_intrinsic UNION ALL SELECT language, model, 'old_metric', -1 FROM v_intrinsic",
)
def _(t):
    long = metrics.metric_rows(t.v_intrinsic.select("language", "model", "rubric_score", "perplexity"), ["language", "model"])
    gone = long.filter("metric = 'perplexity'").withColumn("value", F.lit(-1.0))
    old = gone.unionByName(gone.withColumn("metric", F.lit("old_metric")))
    return metrics.upsert_metrics(old, long, ["language", "model", "metric"], overwrite=True).select("language", "model", "metric", r("value"))


def stored(t, overwrite: bool):
    """Two metrics of every run into a store that already holds one of them for German, and an older one."""
    keys = ["language", "model", "metric"]
    path = new_folder(t.spark, "s18")
    long = metrics.metric_rows(t.v_intrinsic.select("language", "model", "rubric_score", "perplexity"), keys[:2])
    german = long.filter("metric = 'perplexity' and language = 'de'").withColumn("value", F.lit(-1.0))
    store_metrics(german.unionByName(german.withColumn("metric", F.lit("old_metric"))), path, keys, "language")
    return store_metrics(long, path, keys, "language", overwrite).select(*keys, r("value"))


STORED = (
    "SELECT language, model, 'rubric_score' AS metric, round(rubric_score, 6) AS value FROM v_intrinsic UNION ALL SELECT language, model, 'old_metric', -1 FROM v_intrinsic WHERE language = 'de' UNION ALL "
    "SELECT language, model, 'perplexity', round({perplexity}, 6) FROM v_intrinsic"
)


@query("s18_metric_store", STORED.format(perplexity="CASE WHEN language = 'de' THEN -1 ELSE perplexity END"))
def _(t):
    return stored(t, False)


@query("s18_metric_store_overwrite", STORED.format(perplexity="perplexity"))
def _(t):
    return stored(t, True)


@query("s19_missing_languages", "SELECT doc_id, lang AS language, CASE WHEN lang IN ('de', 'fr') THEN 'first' ELSE 'second' END AS written FROM documents")
def _(t):
    path = new_folder(t.spark, "s19")
    rows = t.documents.select("doc_id", F.col("lang").alias("language"))
    tables.write_missing_languages(rows.filter("language in ('de', 'fr')").withColumn("written", F.lit("first")), path)
    return tables.write_missing_languages(rows.withColumn("written", F.lit("second")), path)


@query(
    "s20_per_instance_rows",
    "SELECT lang AS language, concat('org/', source) AS model, text AS instruction, round(n_chars / 10e0, 6) AS perplexity FROM documents",
)
def _(t):
    row = F.struct(F.col("text").alias("instruction"), F.lit("").alias("response"), (F.col("n_chars") / 10).alias("perplexity"))
    stem = F.concat(F.lit(f"{TAG}-S1-"), "lang", F.lit("_org__"), "source", F.lit("_intrinsic_metrics"))
    # A document holds its rows in one array by format; here each row is a document block of its own.
    docs = t.documents.select(stem.alias("stem"), F.struct(F.array(row).alias("per_instance_perplexity")).alias("perplexity"))
    return documents.per_instance(docs, "perplexity", TAG).select("language", "model", "instruction", r("perplexity"))


# --- seed normalisers -----------------------------------------------------------------------

NAMES = LANG_NAMES[:5] + ["English"]
CODES = [fv.LANGUAGE_CODES[n] for n in LANG_NAMES[:5]] + ["en"]


def id_sql(*columns: str) -> str:
    """Surrogate id of columns: lengths tell nulls and separators apart."""
    parts = ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"md5(concat_ws('|', {parts}))"


def seed_sql(source: str, strategy: str, prompt: str, response: str, language: str, source_id: str, rest: str) -> str:
    """Oracle of a normaliser: the seed columns with the id from their content."""
    return (
        f"SELECT {id_sql('source', 'source_id', 'prompt', 'response')} AS id, * FROM (SELECT '{source}' AS source, {prompt} AS prompt, "
        f"{response} AS response, {language} AS language, '{strategy}' AS strategy, {source_id} AS source_id {rest})"
    )


def flat(df):
    return df.withColumn("strategy", F.array_join("strategy", ","))


def raw_wildchat(t):
    talk = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    prompt = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("EnglishTitle: "), "prompt")).otherwise(F.col("prompt"))
    return t.v_pairs.withColumn("prompt", prompt).select(
        F.md5(F.col("id").cast("string")).alias("conversation_hash"), talk.alias("conversation"), F.expr(case("conv_id % 6", NAMES)).alias("language")
    )


def raw_wildchat_ja(t):
    """Same, with Japanese in place of the last known language."""
    names = ["Japanese"] + LANG_NAMES[:4] + ["English"]
    return raw_wildchat(t).drop("language").join(
        t.v_pairs.select(F.md5(F.col("id").cast("string")).alias("conversation_hash"), F.expr(case("conv_id % 6", names)).alias("language")), "conversation_hash"
    )


WILDCHAT_SEED = (
    "(SELECT md5(CAST(id AS VARCHAR)) AS h, CASE WHEN conv_id % 7 = 0 THEN concat('EnglishTitle: ', prompt) ELSE prompt END AS prompt, response, "
    f"{case('conv_id % 6', ['ja'] + [fv.LANGUAGE_CODES[n] for n in LANG_NAMES[:4]] + ['en'])} AS language FROM v_pairs ORDER BY md5(concat('42|', md5(CAST(id AS VARCHAR)))) LIMIT @ROWS) "
    "WHERE language <> 'en' AND NOT (language = 'ja' AND (contains(lower(prompt), 'englishtitle') OR contains(lower(prompt), 'katakanaoftitle')))"
)


N1_SQL = seed_sql(fv.WILDCHAT, "generate,respond", "prompt", "response", "language", "h",
         "FROM " + WILDCHAT_SEED.replace("@ROWS", "150"))


@query("n1_wildchat", N1_SQL)
def _(t):
    return flat(seeds.wildchat(raw_wildchat_ja(t), 150, 42))


@query(
    "n1_short_conversations",
    "SELECT 1::INT AS turns, count(*) AS n FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND a.role IS NULL",
)
def _(t):
    said = t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")
    reply = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    talks = said.join(reply, ["conv_id", "turn"], "left").select(F.array_compact(F.array("text", "reply")).alias("conversation"))
    return seeds.short_conversations(talks, "conversation")


def raw_gsm8k(t):
    return t.documents.select(F.col("text").alias("question"), F.concat(F.lit("#### "), F.col("n_chars").cast("string")).alias("answer"))


@query("n2_gsm8k", seed_sql(fv.GSM8K, "translate", "text", "concat('#### ', CAST(n_chars AS VARCHAR))", "'en'", "md5(text)", "FROM documents"))
def _(t):
    return flat(seeds.gsm8k(raw_gsm8k(t)))


def raw_magpie(t):
    talk = F.array(F.struct(F.lit("human").alias("from"), F.col("prompt").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("response").alias("value")))
    return t.v_pairs.select(F.col("id").cast("string").alias("uuid"), talk.alias("conversations"))


N3_SQL = seed_sql(fv.MAGPIE, "translate", "prompt", "response", "'en'", "CAST(id AS VARCHAR)", "FROM (SELECT * FROM v_pairs ORDER BY md5(concat('42|', CAST(id AS VARCHAR))) LIMIT 120)")


@query("n3_magpie", N3_SQL)
def _(t):
    return flat(seeds.magpie(raw_magpie(t), 120, 42))


def raw_helpsteer(t):
    return t.v_pairs.select(
        F.when(F.col("conv_id") % 4 == 0, "code").otherwise("multilingual").alias("domain"),
        F.lower(F.expr(case("conv_id % 6", NAMES))).alias("language"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("context"),
        F.col("response").alias("response1"), F.reverse("response").alias("response2"),
        (F.col("id") % 5 - 2).alias("overall_preference"),
    )


HELPSTEER_SEED = f"(SELECT *, {case('conv_id % 6', CODES)} AS language, CASE WHEN conv_id % 4 = 0 THEN 'code' ELSE 'multilingual' END AS domain FROM v_pairs) WHERE domain = 'multilingual' AND language <> 'en'"


@query(
    "n4_helpsteer",
    seed_sql(
        fv.HELPSTEER, "generate,respond", "prompt",
        "CASE WHEN id % 5 < 2 THEN response WHEN id % 5 > 2 THEN reverse(response) WHEN ('0x' || substr(md5(concat_ws('|', '42', prompt, response, reverse(response))), 1, 15))::BIGINT % 2 = 0 THEN response ELSE reverse(response) END",
        "language", "md5(prompt)",
        f"FROM {HELPSTEER_SEED}",
    ),
)
def _(t):
    return flat(seeds.helpsteer(raw_helpsteer(t)))


def raw_oasst(t):
    return t.conversations.select(
        F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"), "text",
        F.expr(case("conv_id % 6", CODES)).alias("lang"),
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
    )


N5_SQL = seed_sql(fv.OASST, "respond", "text", "''", "language", "concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR))",
         f"FROM (SELECT *, {case('conv_id % 6', CODES)} AS language FROM conversations) WHERE role = 'user' AND language <> 'en'")


@query("n5_oasst", N5_SQL)
def _(t):
    return flat(seeds.oasst(raw_oasst(t)))


def raw_euroblocks(t):
    return raw_magpie(t).select(
        "conversations", F.expr(case("CAST(uuid AS BIGINT) % 6", NAMES)).alias("language"),
        F.when(F.col("uuid").cast("bigint") % 4 == 0, "Magpie-Ultra").otherwise("EuroSynth").alias("dataset"),
    )


EUROBLOCKS_SEED = (
    f"(SELECT *, {case('id % 6', CODES)} AS language, CASE WHEN id % 4 = 0 THEN 'Magpie-Ultra' ELSE 'EuroSynth' END AS dataset FROM v_pairs) "
    "WHERE language <> 'en' AND dataset <> 'Magpie-Ultra' ORDER BY md5(concat('42|', md5(to_json([{'from': 'human', 'value': prompt}, {'from': 'gpt', 'value': response}])))) LIMIT "
)


N6_SQL = seed_sql(fv.EUROBLOCKS, "generate,respond", "prompt", "response", "language", "md5(prompt)",
         f"FROM {EUROBLOCKS_SEED} 60")


@query("n6_euroblocks", N6_SQL)
def _(t):
    return flat(seeds.euroblocks(raw_euroblocks(t), 60, 42))


ISO3, ISO1 = ["arb", "ces", "deu", "spa", "fra", "tgl"], ["ar", "cs", "de", "es", "fr", "fil"]


def raw_aya(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("inputs"), F.concat(F.lit("re: "), "source").alias("targets"),
        F.expr(case("doc_id % 6", ISO3)).alias("language"),
    )


N7_SQL = seed_sql(fv.AYA, "generate,respond", "text", "concat('re: ', src)", "language", "CAST(doc_id AS VARCHAR)",
         f"FROM (SELECT doc_id, text, source AS src, {case('doc_id % 6', ISO1)} AS language FROM documents) WHERE language NOT IN ('fr', 'fil')")


@query("n7_aya", N7_SQL)
def _(t):
    return flat(seeds.aya(raw_aya(t)))


@query(
    "n8_multilingual_thinking",
    seed_sql(fv.MULTILINGUAL_THINKING, "translate", "prompt", "response", "'en'", "CAST(id AS VARCHAR)",
             f"FROM (SELECT *, {case('conv_id % 6', NAMES)} AS spoken FROM v_pairs) WHERE spoken <> 'English'"),
)
def _(t):
    raw = t.v_pairs.select(
        F.expr(case("conv_id % 6", NAMES)).alias("reasoning_language"), F.col("prompt").alias("user"),
        F.col("response").alias("final"), F.col("id").cast("string").alias("uuid"),
    )
    return flat(seeds.multilingual_thinking(raw))


@query(
    "n9_tagalog",
    f"SELECT {id_sql('source', 'source_id', 'prompt', 'response')} AS id, * FROM ("
    "SELECT 'chats' AS source, prompt, response, 'tl' AS language, 'generate,respond' AS strategy, concat('agentlans/allenai-WildChat_', CAST(id AS VARCHAR)) AS source_id FROM v_pairs "
    "UNION ALL SELECT 'saillab/alpaca-filipino-cleaned', CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN text ELSE concat(text, chr(10), chr(10), lang) END, source, 'tl', 'generate,respond', concat('saillab/alpaca-filipino-cleaned_', CAST(doc_id AS VARCHAR)) FROM documents "
    "UNION ALL SELECT 'CohereLabs/aya_collection', text, concat('re: ', source), 'tl', 'generate,respond', concat('CohereLabs/aya_collection_', CAST(doc_id AS VARCHAR)) "
    f"FROM (SELECT *, {case('doc_id % 6', ISO1)} AS code FROM documents) WHERE code = 'fil')",
)
def _(t):
    chats = raw_magpie(t).select(F.lit("chats").alias("source"), "conversations", F.col("uuid").alias("row_id"))
    alpaca = t.documents.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("instruction"), F.col("source").alias("output"),
        F.when(F.col("doc_id") % 3 == 1, " NaN ").when(F.col("doc_id") % 3 == 2, F.col("lang")).alias("input"),
    )
    return flat(seeds.tagalog(raw_aya(t), chats, alpaca))


@query(
    "n10_instruction_input",
    "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text ELSE concat(text, chr(10), chr(10), lang) END AS prompt FROM documents",
)
def _(t):
    extra = F.when(F.col("doc_id") % 3 == 1, " NaN ").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return t.documents.select("doc_id", seeds.merged_instruction(F.col("text"), extra).alias("prompt"))


def raw_corpora(t) -> dict:
    return {
        fv.WILDCHAT: raw_wildchat_ja(t),
        fv.GSM8K: raw_gsm8k(t),
        fv.MAGPIE: raw_magpie(t),
        fv.HELPSTEER: raw_helpsteer(t),
        fv.OASST: raw_oasst(t),
        fv.EUROBLOCKS: raw_euroblocks(t),
        fv.AYA: raw_aya(t),
    }


SEED_COUNTS = (
    "SELECT 'openai/gsm8k' AS source, 'en' AS language, count(*) AS count FROM documents "
    f"UNION ALL SELECT '{fv.WILDCHAT}', language, count(*) FROM {WILDCHAT_SEED.replace('@ROWS', '100')} GROUP BY ALL "
    f"UNION ALL SELECT '{fv.HELPSTEER}', language, count(*) FROM {HELPSTEER_SEED} GROUP BY ALL "
    f"UNION ALL SELECT '{fv.EUROBLOCKS}', language, count(*) FROM (SELECT * FROM {EUROBLOCKS_SEED} 100) GROUP BY ALL "
    f"UNION ALL SELECT '{fv.AYA}', code, count(*) FROM (SELECT {case('doc_id % 6', ISO1)} AS code FROM documents) WHERE code NOT IN ('fr', 'fil') GROUP BY ALL "
    "UNION ALL SELECT 'Magpie-Align/Magpie-Pro-300K-Filtered', 'en', least(count(*), 100) FROM v_pairs "
    f"UNION ALL SELECT 'OpenAssistant/oasst2', code, count(*) FROM (SELECT *, {case('conv_id % 6', CODES)} AS code FROM conversations) WHERE role = 'user' AND code <> 'en' GROUP BY ALL"
)


@query("n11_seed_union", SEED_COUNTS)
def _(t):
    table = seeds.seed_table(raw_corpora(t), 100, 42)
    return reports.histogram(seeds.check_unique_ids(table), "source", "language")


@query("s11_source_choice", f"SELECT 'CohereLabs/aya_collection' AS source, count(*) AS count FROM (SELECT {case('doc_id % 6', ISO1)} AS code FROM documents) WHERE code NOT IN ('fr', 'fil')")
def _(t):
    # An include list wins over the exclude list.
    return reports.histogram(seeds.seed_table(raw_corpora(t), 100, 42, include=[fv.AYA], exclude=[fv.AYA]), "source")


@query("a14_duplicate_ids", "SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    return seeds.duplicate_ids(t.documents, "text")
