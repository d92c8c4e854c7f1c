"""Score arithmetic, published numbers and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorgauge.operators import reports, scores, stats
from tutorgauge.operators.joins import left_join_unique
from tutorgauge.plans import jobs

NAN = float("nan")

# Published scores (teacher: Arabic, German, Indonesian) under two base models.
OLMO = {
    "Llama-3.1-70B-Instruct": (-0.9635390089, 1.1952470743, 0.1823492872), "Llama-3.1-8B-Instruct": (-1.6932289304, 0.8913277947, 0.3218535567),
    "aya-expanse-32b": (-0.0581661935, 1.4680449653, 1.1530138246), "cohere-command-a": (-1.3600687884, 1.6726263091, 1.0629123901),
    "gemma-3-12b-it": (-0.4637085966, 1.7557072151, 0.1513302398), "gemma-3-27b-it": (0.1449610322, 1.6552315701, 0.2142744803),
    "gemma-3-4b-it": (-0.4882560216, 1.643583329, -0.104581641), "gpt-4o-mini-2024-07-18": (-1.1166583237, 1.7663222008, 1.0028097432),
    "granite-4.0-1b": (-0.0717722267, 0.9997347749, -0.0789441766), "granite-4.0-micro": (-0.2824346293, 1.1019540834, -0.3288958145),
}
GEMMA = {
    "Llama-3.1-70B-Instruct": (1.6659469742, 1.0196349234, -0.7730650304), "Llama-3.1-8B-Instruct": (-0.7883685845, 1.4512287286, -0.2630480103),
    "aya-expanse-32b": (0.4051796768, 1.5743619485, 0.305236072), "cohere-command-a": (1.4503667066, 1.6376707862, -0.9126653876),
    "gemma-3-12b-it": (0.9385442521, 1.5691222814, -0.5111422303), "gemma-3-27b-it": (1.783567947, 1.4900414439, -0.8444872214),
    "gemma-3-4b-it": (0.7639137932, 1.52528224, -0.1524125602), "gpt-4o-mini-2024-07-18": (1.7498756567, 1.2389277611, 0.0756763005),
    "granite-4.0-1b": (0.2360916766, 1.5222851931, -0.9234875653), "granite-4.0-micro": (0.5798688181, 1.2063896174, -0.4217649636),
}


def published(spark):
    rows = [(t, l, b, v, v) for b, table in (("OLMo 3 7B", OLMO), ("Gemma 3 4B", GEMMA)) for t, values in table.items() for l, v in zip(("ar", "de", "id"), values)]
    return spark.createDataFrame(rows, "teacher_model string, target_lang string, base_model string, pg_score double, pgr double")


def test_published_base_model_correlation(spark):
    got = jobs.base_model_effect(published(spark), ["ar", "de", "id"], ["OLMo 3 7B", "Gemma 3 4B"], "OLMo 3 7B")
    cells = {(r.model_a, r.model_b): r for r in got["correlations"].collect()}
    rho = cells["Gemma 3 4B", "OLMo 3 7B"]
    a, b = ([np.mean(t[k]) for k in sorted(OLMO)] for t in (OLMO, GEMMA))
    rank = lambda v: np.argsort(np.argsort(v))
    assert rho.rho == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert cells["OLMo 3 7B", "OLMo 3 7B"].rho == 1.0 and cells["OLMo 3 7B", "OLMo 3 7B"].p == 0.0
    other = got["against_reference"].first()
    assert (other.base_model, other.n_teachers) == ("Gemma 3 4B", 10) and other.rho == pytest.approx(rho.rho)
    ranks = {r.teacher_model: (r.times_ranked_1st, r.times_in_top_3, r.base_models) for r in got["rankings"].collect()}
    assert sum(v[0] for v in ranks.values()) == 2 and sum(v[1] for v in ranks.values()) == 6


def test_published_score_is_the_mean_of_its_parts(spark):
    ext = spark.createDataFrame([("Llama-3.1-70B-Instruct", "ar", 3.7312758579)], "teacher_model string, target_lang string, pgr double")
    z = spark.createDataFrame([("meta-llama/Llama-3.1-70B-Instruct", "ar", -0.3993819095)], "model string, language string, z_score double")
    assert scores.combined_score(ext, z).first().pg_score == pytest.approx(1.6659469742)


def test_published_data_scaling(spark):
    german = {1000: 0.4957653741, 5000: 0.5523813765, 10000: 0.639160045, 25000: 0.6419718652, 50000: 0.64235396}
    df = spark.createDataFrame([("gemma-3-27b-it", "de", v, s) for s, v in german.items()], "teacher_model string, target_lang string, result double, scale int")
    got = jobs.data_scale(df, "result").orderBy("scale").collect()
    assert [r.language_name for r in got] == ["German"] * 5 and got[0].change is None
    assert got[2].change == pytest.approx(0.639160045 - 0.5523813765)


def test_published_translation_methods(spark):
    rows = [("both", "ar", 0.1724202416), ("both", "de", 1.2587640012), ("both", "id", 1.1087360372), ("lm", "ar", 0.8402619458), ("lm", "de", 2.0995494439), ("lm", "id", 1.1408677786)]
    df = spark.createDataFrame(rows, "translate_method string, target_lang string, pg_score double")
    got = jobs.translation_ablation(df, ["ar", "id", "de"])
    assert {r.translate_method: round(r.pg_score, 4) for r in got["means"].collect()} == {"both": 0.8466, "lm": 1.3602}
    assert {r.translate_method: (r.ar, r.id, r.de) for r in got["grid"].collect()}["lm"] == (0.8402619458, 1.1408677786, 2.0995494439)


def test_gain_recovered_edges(spark):
    ext = spark.createDataFrame(
        [("t", "de", "de", 0.5, 0.1), ("t", "de", "es", 0.9, 0.3), ("u", "ja", "es", 0.2, None), ("u", "ja", "de", 0.4, 0.2), ("t", "es", "es", 0.3, 0.1), ("t", "id", "id", 0.3, 0.1)],
        "teacher_model string, target_lang string, eval_lang string, result double, result_stderr double",
    )
    base = spark.createDataFrame([("de", 0.4), ("es", 0.6), ("ja", 0.1)], "eval_lang string, result double")
    ref = spark.createDataFrame([("de", 0.8), ("es", 0.6), ("ja", 0.2)], "eval_lang string, result double")
    got = {(r.teacher_model, r.target_lang): r for r in scores.gain_recovered(ext, base, ref).collect()}
    assert got["t", "de"].pgr == pytest.approx(0.25) and not got["t", "de"].used_fallback
    assert got["u", "ja"].result == pytest.approx(0.3) and got["u", "ja"].used_fallback and got["u", "ja"].result_stderr == 0.2
    assert got["u", "ja"].pgr == pytest.approx(2.0)
    assert got["t", "es"].pgr is None  # base and reference are equal
    assert got["t", "id"].pgr is None  # no anchor


def test_zscore_edges(spark):
    rows = [("de", "a", 0.1, 0.5, 3.0, 2.0), ("de", "b", 0.2, 0.5, 4.0, NAN), ("es", "c", 0.6, 0.5, 5.0, 8.0), ("es", "d", None, 0.5, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "language string, model string, prompts_distinct_ri double, responses_distinct_ri double, rubric_score double, perplexity double")
    got = {r.model: r.z_score for r in scores.intrinsic_zscore(df).collect()}
    p = np.array([-math.log1p(x) for x in (2.0, 8.0, 4.0)])
    a, c, r = np.array([0.1, 0.2, 0.6]), p, np.array([3.0, 4.0, 5.0, 1.0])
    z = lambda x, v: (x - v.mean()) / v.std()
    assert got["a"] == pytest.approx((z(0.1, a) + 0 + z(3.0, r) + z(p[0], c)) / 4)
    assert got["c"] == pytest.approx((z(0.6, a) + 0 + z(5.0, r) + z(p[1], c)) / 4)
    assert math.isnan(got["b"]) and got["d"] is None


def test_repeated_right_key_is_an_error(spark):
    left = spark.createDataFrame([(1, "x")], "a int, v string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    with pytest.raises(Exception, match="right join key repeats"):
        left_join_unique(left, right, ["a"], ["k"]).collect()


def test_runs_first_and_last(spark):
    df = spark.createDataFrame([("d", "t", "2024", 1.0), ("d", "t", "2025", 2.0), ("d", "u", "2025", 3.0)], "dataset string, task string, run string, x double")
    pick = lambda keep: {r.task: r.x for r in scores.dedupe_runs(df, ["dataset", "task"], keep=keep).collect()}
    assert pick("first") == {"t": 1.0, "u": 3.0} and pick("last") == {"t": 2.0, "u": 3.0}


def test_unknown_task_has_no_headline(spark):
    df = spark.createDataFrame([("mgsm_custom", {"extractive_match": 0.5, "extractive_match_stderr": 0.1}), ("other", {"acc": 1.0})], "task string, metrics map<string,double>")
    got = df.select("task", scores.known_tasks().alias("known"), *[c.alias(k) for k, c in scores.headline_result().items()]).collect()
    assert tuple(got[0])[1:] == (True, 0.5, 0.1) and tuple(got[1])[1:] == (False, None, None)


def test_wide_benchmarks(spark):
    """One model of the published wide table, a missing cell and a zero weighted accuracy."""
    m = "meta-llama/Llama-3.1-8B-Instruct"
    rows = [
        (m, "global_mmlu_lite", "de", {"acc": 0.42, "acc_stderr": 0.02}), (m, "mgsm_custom", "de", {"extractive_match": 0.16}), (m, "mrewardbench_mcf", "de", {"weighted_acc": 0.4879259246}),
        (m, "mrewardbench_mcf", "es", {"weighted_acc": 0.0, "acc": 0.3}), (m, "other", "de", {"acc": 1.0}),
    ]
    df = spark.createDataFrame(rows, "model_name string, task string, eval_lang string, metrics map<string,double>")
    got = reports.wide_benchmarks(df).first()
    assert got.avg_de == pytest.approx(0.3559753082) and got.global_mmlu_lite_de_stderr == 0.02
    assert got.mrewardbench_es == 0.3 and got.avg_es == 0.3 and got.avg_ja is None
    assert got.avg_all == pytest.approx((0.3559753082 + 0.3) / 2)


def test_binned_edges(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (1.0,), (1.01,), (10.0,), (10.1,), (None,)], "v double")
    got = [r[0] for r in df.select(stats.binned(F.col("v"), [0, 1, 2, 5, 10], ["a", "b", "c", "d"])).collect()]
    assert got == [None, "a", "a", "b", "d", None, None]


def test_min_max_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert [tuple(r)[2:] for r in stats.min_max(df, ["a", "b"]).collect()] == [(0.0, 0.0), (0.0, 1.0)]
