"""Quality metrics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorgauge.operators import evals, filters, metrics

NAN = float("nan")


def brute_distinct_ri(vectors):
    a = np.array(vectors, dtype=float)
    with np.errstate(all="ignore"):
        length = np.linalg.norm(a, axis=1, keepdims=True)
        u = a / np.maximum(length, 1e-12)
        sim = np.nan_to_num(u @ u.T, nan=0.0, posinf=0.0, neginf=0.0)
    n = len(a)
    return 1 - sim[~np.eye(n, dtype=bool)].mean()


@pytest.mark.parametrize("extra", [[], [[0.0] * 4], [[NAN, 1.0, 2.0, 3.0]], [[0.0] * 4, [1.0, NAN, 0.0, 0.0], [5.0, 5.0, 5.0, 5.0]]])
def test_distinct_ri(spark, extra):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 4)).tolist() + extra
    others = [("one", [1.0, 0.0, 0.0, 0.0]), ("flat", [0.0] * 4), ("flat", [NAN] * 4), ("one", None), ("inf", [math.inf, 1.0, 0.0, 0.0]), ("inf", [1.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame([("g", v) for v in vectors] + others, "g string, v array<double>")
    got = {r.g: r.x_distinct_ri for r in metrics.distinct_ri(df, ["g"], {"x": "v"}).collect()}
    assert got["g"] == pytest.approx(brute_distinct_ri(vectors), abs=1e-12)
    assert got["one"] is None and got["flat"] == 1.0 and got["inf"] == 1.0


def test_distinct_ri_of_long_vectors(spark):
    """The work is linear in the length of a vector."""
    df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: F.sin(i * F.col("id"))).cast("array<float>").alias("v"))
    rows = [r.v for r in df.collect()]
    assert metrics.distinct_ri(df, [], {"x": "v"}).first().x_distinct_ri == pytest.approx(brute_distinct_ri(rows), abs=1e-6)


def test_perplexity(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 1), (1, [1.0], 1), (2, [0.5, 0.5], 0)], "i int, losses array<double>, prompt_length int")
    scored = df.withColumn("perplexity", metrics.perplexity_of_losses("losses", "prompt_length"))
    got = [r.perplexity for r in scored.orderBy("i").collect()]
    assert got[0] == pytest.approx(math.exp(2.5)) and math.isnan(got[1]) and got[2] == pytest.approx(math.exp(0.5))
    total = metrics.perplexity_summary(scored, []).first()
    assert (total.num_valid_samples, total.num_nan_values, total.total_samples) == (2, 1, 3)
    assert total.average_perplexity == pytest.approx((math.exp(2.5) + math.exp(0.5)) / 2)
    shared = metrics.batch_perplexity(df, "i", 2).orderBy("i").collect()
    assert shared[0].perplexity == shared[1].perplexity == pytest.approx(math.exp(2.5))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_unigram_perplexity_with_a_hot_word(spark, broadcast_rows):
    texts = [(i, "x", "the the the " + f"w{i} w{i % 7}") for i in range(200)] + [(999, "y", "solo")]
    df = spark.createDataFrame(texts, "id int, lang string, text string")
    got = {r.id: r.perplexity for r in metrics.unigram_perplexity(df, "text", "id", ["lang"], broadcast_rows=broadcast_rows).collect()}
    words = [w for i, l, t in texts if l == "x" for w in t.split()]
    count, n, v = {w: words.count(w) for w in set(words)}, len(words), len(set(words))
    for i, l, t in texts[:200]:
        want = math.exp(np.mean([-math.log((count[w] + 1) / (n + v)) for w in t.split()]))
        assert got[i] == pytest.approx(want)
    assert got[999] == pytest.approx(1.0)


def test_judge_feedback(spark):
    good = ['{"score":3,"feedback":"ok"}', ' {"feedback":"a, b]","score":5,"more":1} ']
    bad = [
        "oops", "", None, "[]", "3", '{"score":9,"feedback":"ok"}', '{"score":0,"feedback":"ok"}', '{"score":"3","feedback":"ok"}', '{"score":3.0,"feedback":"ok"}',
        '{"score":3}', '{"score":3,"feedback":null}', '{"score":3,"feedback":4}', '{"score":true,"feedback":"ok"}', '{"score":3,"feedback":"ok"} and more', '{"score":3,"feedback":"ok"',
    ]
    df = metrics.with_judge_feedback(spark.createDataFrame([(r,) for r in good + bad], "raw string"))
    got = [(r.score, r.feedback, r.valid) for r in df.collect()]
    assert got[:2] == [(3, "ok", True), (5, "a, b]", True)]
    assert set(got[2:]) == {(1, "Invalid output", False)}
    total = metrics.rubric_score(df.select("raw"), []).first()
    assert total.n_invalid == len(bad) and total.average_rubric_score == pytest.approx((8 + len(bad)) / (2 + len(bad)))


def test_metric_registry_and_params(spark):
    metrics.register_metric("rows", lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")))
    try:
        df = spark.createDataFrame([("m", "a b", "c")], "model string, prompt string, response string")
        got = metrics.metric_table(df, ["model"], ["rows", "length"]).first()
        assert (got.rows, got.prompts_average_length, got.responses_average_length) == (1, 2.0, 1.0)
        assert metrics.requested_metrics(["all"]) == sorted(["distinct_ri", "length", "perplexity", "reward_model", "rows"])
    finally:
        metrics.METRICS.pop("rows")
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics.requested_metrics(["beauty"])
    assert metrics.parse_metric_params('length::{"a": 1}|perplexity::{"b": "x::y"}') == {"length": {"a": 1}, "perplexity": {"b": "x::y"}}


def test_null_and_nan_filters(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "a", NAN), (3, "a", 2.0), (4, None, None)], "id int, k string, v double")
    assert [r.id for r in filters.without_nulls(df).collect()] == [2, 3]
    assert [r.id for r in filters.without_missing(df).collect()] == [3]
    assert [r.id for r in filters.matching(df, {"k": None}).collect()] == [1, 4]
    with pytest.raises(ValueError, match="missing columns"):
        filters.matching(df, {"nope": 1})


def test_verdict_and_numbers(spark):
    df = spark.createDataFrame([("THE ANSWER: B",), ("b",), (" no vowel? cdefg",), ("1,234.567 and 5",), ("-3",), (None,)], "t string")
    rows = df.select(evals.verdict(F.col("t")).alias("v"), evals.first_number(F.col("t")).alias("x"), evals.number_match(F.col("t"), F.lit(1234.569)).alias("hit")).collect()
    assert [r.v for r in rows] == [0, 1, -1, 0, -1, -1]
    assert [r.x for r in rows] == [None, None, None, 1234.567, -3.0, None]
    assert [r.hit for r in rows] == [0, 0, 0, 1, 0, 0]


def test_choice_accuracy(spark):
    df = spark.createDataFrame([([-4.0, -3.0], [4.0, 1.0], [1.0, 1.0], [-9.0, -3.0], 0)], "logp array<double>, n_tokens array<double>, n_chars array<double>, logp_uncond array<double>, gold_idx int")
    got = evals.choice_accuracy(df, []).first()
    assert (got.acc_norm_token, got.acc_norm_char, got.acc_norm_pmi, got.n) == (1.0, 0.0, 1.0, 1)


def test_macro_average(spark):
    """Four sub-tasks of one benchmark and their published average."""
    acc = {"culturology": 0.7241379310344828, "driving_license": 0.5733333333333334, "history": 0.6120689655172413, "language": 0.5566037735849056, "_average": 0.0}
    df = spark.createDataFrame([(f"include_tgl_mcf:{k}", v, 0.0) for k, v in acc.items()] + [("sib200", 1.0, 0.0)], "task string, acc double, acc_stderr double")
    got = evals.macro_average(df).collect()
    assert len(got) == 1 and got[0].task == "include_tgl_mcf:_average" and got[0].acc == pytest.approx(0.6165360008674907)
