"""Test inputs derived from the driver's tables, by SQL text that Spark and DuckDB both run.

The tables hold no fine-tuning data of the wanted shape, so each view dresses all rows of a table in that
shape: keys come from integer columns, numbers from numeric ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tutorgauge import fixed_values as fv

TAG = "sft"
LANGS = sorted(fv.LANGUAGE_CODES.values())
TEACHERS = [row[0].split("/")[-1] for row in fv.MODELS]


def case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({expr}) {whens} END)"


def lang(expr: str) -> str:
    return case(f"({expr}) % 6", LANGS)


def teacher(expr: str) -> str:
    return case(f"({expr}) % 11", TEACHERS)


LANG_NAMES = [name for code in LANGS for name, c in fv.LANGUAGE_CODES.items() if c == code]
KNOWN_TASKS = ["global_mmlu_lite", "mgsm_custom", "mrewardbench_mcf", "other_task"]
TASK_OF_EVENT = (
    "(CASE event_type WHEN 'view' THEN 'global_mmlu_lite' WHEN 'click' THEN 'mgsm_custom' "
    "WHEN 'purchase' THEN 'mrewardbench_mcf' WHEN 'signup' THEN 'other_task' ELSE 'global_mmlu_lite' END)"
)

VIEWS: dict[str, str] = {
    # A user turn and the assistant turn right after it.
    "v_pairs": (
        "SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn, u.text AS prompt, a.text AS response "
        "FROM {conversations} u JOIN {conversations} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 "
        "WHERE u.role = 'user' AND a.role = 'assistant'"
    ),
    "v_sft": (
        "SELECT id, prompt, response, concat('teacher_', cast(conv_id % 5 AS string)) AS model, "
        f"{lang('conv_id')} AS language, "
        "CASE WHEN conv_id % 10 < 6 THEN 'respond' WHEN conv_id % 10 < 9 THEN 'generate' ELSE 'translate' END AS strategy "
        "FROM {v_pairs}"
    ),
    # Seeds with a list of allowed strategies.
    "v_seed": (
        "SELECT id, prompt, response, language, model AS source, "
        "split(CASE strategy WHEN 'translate' THEN 'translate' WHEN 'respond' THEN 'respond' ELSE 'generate,respond' END, ',') AS strategy "
        "FROM {v_sft}"
    ),
    "v_corpus": "SELECT doc_id AS id, text, lang AS language, source AS model, n_chars FROM {documents}",
    # Benchmark results; the first teacher is never evaluated in its target language.
    "v_evals": (
        f"SELECT event_id, {teacher('user_id')} AS teacher_model, {lang('user_id')} AS target_lang, "
        f"CASE WHEN user_id % 11 = 0 THEN {lang('user_id + 1 + event_id % 5')} ELSE {lang('event_id')} END AS eval_lang, "
        "event_type AS task, value / 1000 AS result, value / 20000 AS result_stderr FROM {events}"
    ),
    "v_base": f"SELECT {lang('event_id')} AS eval_lang, value / 2000 AS result FROM {{events}}",
    "v_ref": f"SELECT {lang('event_id')} AS eval_lang, value / 500 AS result FROM {{events}}",
    "v_intrinsic": (
        "SELECT target_lang AS language, concat('org/', teacher_model) AS model, 1 - avg(result) AS prompts_distinct_ri, "
        "stddev_pop(result) * 5 AS responses_distinct_ri, "
        "avg(CASE task WHEN 'click' THEN 5e0 WHEN 'view' THEN 3e0 WHEN 'error' THEN 1e0 ELSE 2e0 END) AS rubric_score, "
        "1 + max(result) * 100 AS perplexity, avg(event_id % 97) AS prompts_average_length, "
        "avg(event_id % 211) AS responses_average_length FROM {v_evals} GROUP BY target_lang, teacher_model"
    ),
    "v_scores": (
        "SELECT teacher_model, target_lang, task AS base_model, avg(result) AS result, avg(result_stderr) AS result_stderr, "
        "(avg(result) - 0.02e0) * 10 AS pgr, stddev_pop(result) * 20 - 1 AS z_score, "
        "((avg(result) - 0.02e0) * 10 + stddev_pop(result) * 20 - 1) / 2 AS pg_score "
        "FROM {v_evals} GROUP BY teacher_model, target_lang, task"
    ),
    "v_teacher_scores": (
        "SELECT teacher_model, target_lang, avg(result) AS result, avg(result_stderr) AS result_stderr, avg(pgr) AS pgr, "
        "avg(z_score) AS z_score, avg(pg_score) AS pg_score FROM {v_scores} GROUP BY teacher_model, target_lang"
    ),
    # A score table with one row per order, for the operators that must hold on large tables.
    "v_orders": (
        f"SELECT o_orderkey AS id, {teacher('o_custkey')} AS teacher_model, {lang('o_orderkey')} AS target_lang, "
        "o_orderpriority AS base_model, o_totalprice / 99991 AS pg_score, o_custkey / 100e0 AS z_score, "
        "(o_totalprice - o_custkey) / 70001 AS pgr FROM {orders}"
    ),
    "v_judged": (
        "SELECT l.doc_id AS id, d.source AS model, d.lang AS language, l.quality, l.toxic, "
        "CASE WHEN l.toxic = 1 AND l.doc_id % 2 = 0 THEN 'oops' "
        "WHEN l.doc_id % 13 = 5 THEN concat('{{\"score\":\"', cast(1 + l.doc_id % 5 AS string), '\",\"feedback\":\"ok\"}}') "
        "WHEN l.doc_id % 13 = 7 THEN concat('{{\"score\":', cast(1 + l.doc_id % 9 AS string), ',\"feedback\":\"ok\"}}') "
        "WHEN l.doc_id % 13 = 9 THEN concat('{{\"score\":', cast(1 + l.doc_id % 5 AS string), '}}') "
        "ELSE concat('{{\"score\":', cast(1 + 3 * l.quality + l.doc_id % 2 AS string), ',\"feedback\":\"ok\"}}') END AS raw "
        "FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
    ),
    # Conversation pairs with what all four intrinsic metrics read: two numbers stand in for each embedding.
    "v_report": (
        "SELECT id, model, language, prompt, response, cast(length(prompt) % 7 - 3 AS double) AS p1, cast(length(prompt) % 5 - 2 AS double) AS p2, "
        "cast(length(response) % 9 - 4 AS double) AS r1, cast(length(response) % 4 - 1 AS double) AS r2, "
        "CASE WHEN id % 13 = 5 THEN 'oops' WHEN id % 13 = 7 THEN concat('{{\"score\":', cast(1 + id % 9 AS string), ',\"feedback\":\"ok\"}}') "
        "ELSE concat('{{\"score\":', cast(1 + id % 5 AS string), ',\"feedback\":\"ok\"}}') END AS raw FROM {v_sft}"
    ),
    # One benchmark run per event, with the names and numbers its JSON cell is made of.
    "v_runs": (
        "SELECT event_id, concat('acct/details_sft-allenai_Olmo-3-1025-7B', "
        "CASE user_id % 4 WHEN 0 THEN '-lora' WHEN 1 THEN '-lora-4bit' WHEN 2 THEN '-8bit' ELSE '' END, "
        f"'-sft-S1-', {lang('user_id')}, '_', replace({teacher('user_id')}, '.', '_'), "
        "CASE user_id % 5 WHEN 0 THEN '_translate' WHEN 1 THEN '_sz10k' ELSE '' END) AS dataset, "
        f"{teacher('user_id')} AS teacher_model, {lang('user_id')} AS target_lang, "
        "concat('run_', lpad(cast(event_id AS string), 12, '0')) AS run, "
        f"{TASK_OF_EVENT} AS task, {lang('event_id')} AS eval_lang, event_id % 3 AS n_shots, "
        f"concat({TASK_OF_EVENT}, ':', {lang('event_id')}, '|', cast(event_id % 3 AS string)) AS eval, "
        "value / 1000 AS result, value / 20000 AS result_stderr FROM {events}"
    ),
}


def _refs(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def duckdb_sql(sql: str) -> str:
    """A query with the views it uses as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _refs(text):
            if name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    names = {n: n for n in [*VIEWS, *TABLES]}
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**names)})" for n in needed)
    return f"WITH {ctes} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes}, {sql.lstrip()[5:]}"


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """The tables of a folder and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                parts = {n: getattr(self, n) for n in re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name])}
                self._made[name] = self.spark.sql(VIEWS[name], **parts)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]
