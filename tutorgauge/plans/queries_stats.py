"""Queries of the statistics and models over score tables (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.names import short_model_name
from tutorgauge.functions.text import marked_rho
from tutorgauge.operators import models, stats
from tutorgauge.plans import jobs
from tutorgauge.plans.catalog import query, r
from tutorgauge.plans.queries_groups import BASES, MEANS, means


def rank_sql(value: str, by: str = "") -> str:
    """Average rank of a column by window functions."""
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({same}) - 1) / 2.0e0)"


def spearman_sql(source: str, x: str, y: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return (
        f"SELECT {keys}round(rho, 6) + 0e0 AS rho, n, round(rho * sqrt((n - 2) / (1 - rho * rho)), 4) + 0e0 AS t FROM (SELECT {keys}corr(rx, ry) AS rho, count(*) AS n FROM "
        f"(SELECT *, {rank_sql(x, by)} AS rx, {rank_sql(y, by)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {group})"
    )


# P(|T| >= t) as the finite series of Student's distribution, for even and odd degrees of freedom n - 2;
# rho is the sine of the angle in those series.
EVEN_TERM = "list_product(list_transform(range(1, k + 1), lambda j: (2 * j - 1) / (2.0e0 * j) * (1 - rho * rho)))"
ODD_TERM = "sqrt(1 - rho * rho) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0e0 * j / (2 * j + 1) * (1 - rho * rho))), 1)"
P_SQL = (
    f"CASE WHEN abs(rho) >= 1 THEN 0 WHEN n % 2 = 0 THEN 1 - abs(rho) * (1 + coalesce(list_sum(list_transform(range(1, (n - 2) // 2), lambda k: {EVEN_TERM})), 0)) "
    f"ELSE 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: {ODD_TERM})), 0)) END"
)
CELL = "CASE WHEN a = b THEN printf('%.2f', rho) WHEN p < 0.01 THEN printf('%.2f**', rho) WHEN p < 0.05 THEN printf('%.2f*', rho) ELSE printf('%.2f', rho) END"


@query("x1_spearman", spearman_sql("v_orders", "pg_score", "z_score"))
def _(t):
    return stats.spearman(t.v_orders, "pg_score", "z_score").select(r("rho"), "n", r("t", digits=4))


@query("x1_spearman_with_ties", spearman_sql("(SELECT *, l_quantity AS q, l_discount AS d FROM lineitem)", "q", "d", "l_returnflag"))
def _(t):
    return stats.spearman(t.lineitem, "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", r("rho"), "n", r("t", digits=4))


@query("x1_spearman_p", f"SELECT round(rho, 6) AS rho, n, round({P_SQL}, 6) AS p FROM (SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT *, {rank_sql('z_score')} AS rx, {rank_sql('pgr')} AS ry FROM v_teacher_scores))")
def _(t):
    return stats.spearman(t.v_teacher_scores, "z_score", "pgr").select(r("rho"), "n", r("p"))


def pairs_sql(marked: bool = False) -> str:
    a, b = (f"{MEANS} {x}" for x in "ab")
    joined = f"(SELECT a.base_model AS model_a, b.base_model AS model_b, a.pg_score AS x, b.pg_score AS y FROM {a} JOIN {b} ON a.teacher_model = b.teacher_model AND a.base_model <> b.base_model)"
    rho = f"SELECT model_a, model_b, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT *, {rank_sql('x', 'model_a, model_b')} AS rx, {rank_sql('y', 'model_a, model_b')} AS ry FROM {joined}) GROUP BY 1, 2"
    if marked:
        both = f"SELECT model_a AS a, model_b AS b, rho, {P_SQL} AS p FROM ({rho}) UNION ALL SELECT DISTINCT base_model, base_model, 1e0, 0e0 FROM v_scores"
        return f"SELECT a AS model_a, b AS model_b, {CELL} AS cell FROM ({both})"
    return f"SELECT model_a, model_b, round(rho, 6) + 0e0 AS rho FROM ({rho}) UNION ALL SELECT DISTINCT base_model, base_model, 1e0 FROM v_scores"


@query("x2_pair_correlations", pairs_sql())
def _(t):
    got = stats.pair_correlations(means(t), ["teacher_model"], "base_model", BASES, "pg_score")
    return got.select("model_a", "model_b", r("rho"))


@query("x2_marked_matrix", pairs_sql(marked=True))
def _(t):
    got = stats.pair_correlations(means(t), ["teacher_model"], "base_model", BASES, "pg_score")
    return got.select("model_a", "model_b", marked_rho(F.col("rho"), F.col("p"), F.col("model_a") == F.col("model_b")).alias("cell"))


X3 = f"(SELECT b.base_model, a.pg_score AS x, b.pg_score AS y FROM {MEANS} a JOIN {MEANS} b ON a.teacher_model = b.teacher_model WHERE a.base_model = 'view' AND b.base_model <> 'view')"


@query("x3_against_reference", f"SELECT base_model, round(corr(rx, ry), 6) + 0e0 AS rho, count(*) AS n_teachers FROM (SELECT *, {rank_sql('x', 'base_model')} AS rx, {rank_sql('y', 'base_model')} AS ry FROM {X3}) GROUP BY base_model")
def _(t):
    got = stats.against_reference(means(t), "teacher_model", "base_model", "pg_score", "view")
    return got.select("base_model", r("rho"), "n_teachers")


WEIGHTED = f"(SELECT id, alpha, round(alpha * z_score + (1 - alpha) * pgr, 12) AS w FROM v_orders, (VALUES {', '.join(f'({a}::DOUBLE)' for a in fv.ALPHAS)}) AS v(alpha))"
X4 = f"(SELECT id, alpha, {rank_sql('w', 'alpha')} AS rk FROM {WEIGHTED})"


@query("x4_weight_robustness", f"SELECT a.alpha AS alpha_a, b.alpha AS alpha_b, round(corr(a.rk, b.rk), 6) AS rho, count(*) AS n FROM {X4} a JOIN {X4} b ON a.id = b.id GROUP BY 1, 2")
def _(t):
    return stats.weight_robustness(t.v_orders, ["id"], fv.ALPHAS).select("alpha_a", "alpha_b", r("rho"), "n")


@query("x5_pearson", "SELECT target_lang, round(corr(pg_score, z_score), 6) + 0e0 AS r, count(*) AS n FROM v_orders GROUP BY 1")
def _(t):
    return stats.pearson(t.v_orders, "pg_score", "z_score", ["target_lang"]).select("target_lang", r("r"), "n")


@query("x5_spearman", spearman_sql("v_orders", "pg_score", "z_score", "target_lang"))
def _(t):
    return stats.spearman(t.v_orders, "pg_score", "z_score", ["target_lang"]).select("target_lang", r("rho"), "n", r("t", digits=4))


@query("x6_summary_correlation", "SELECT round(corr(x, y), 6) AS r, count(*) AS n FROM (SELECT teacher_model, avg(z_score) AS x, avg(pgr) AS y FROM v_orders GROUP BY 1)")
def _(t):
    summary = t.v_orders.groupBy("teacher_model").agg(F.avg("z_score").alias("x"), F.avg("pgr").alias("y"))
    return stats.pearson(summary, "x", "y").select(r("r"), "n")


@query(
    "x7_linear_fit",
    "SELECT target_lang, round(regr_slope(pg_score, z_score), 8) AS slope, round(regr_intercept(pg_score, z_score), 6) AS intercept, round(corr(pg_score, z_score), 6) + 0e0 AS r, "
    "round(sqrt((1 - regr_r2(pg_score, z_score)) * regr_syy(pg_score, z_score) / regr_sxx(pg_score, z_score) / (count(*) - 2)), 8) AS stderr FROM v_orders GROUP BY 1",
)
def _(t):
    got = stats.linear_fit(t.v_orders, "z_score", "pg_score", ["target_lang"])
    return got.select("target_lang", r("slope", digits=8), r("intercept"), r("r"), r("stderr", digits=8))


@query("x8_min_max", "SELECT id, round((pg_score - min(pg_score) OVER ()) / (max(pg_score) OVER () - min(pg_score) OVER ()), 6) AS pg_score_norm, round((z_score - min(z_score) OVER ()) / (max(z_score) OVER () - min(z_score) OVER ()) * 400 + 50, 6) AS z_score_size FROM v_orders")
def _(t):
    rows = stats.min_max(stats.min_max(t.v_orders, ["pg_score"]), ["z_score"], 50, 450, "_size")
    return rows.select("id", r("pg_score_norm"), r("z_score_size"))


FEATURE_VIEW = {
    "prompts_distinct_ri": "l_quantity", "responses_distinct_ri": "l_extendedprice", "average_perplexity": "l_discount",
    "average_rubric_score": "l_tax", "prompts_average_length": "l_linenumber", "responses_average_length": "l_partkey",
}


def features(t):
    """Order lines in the role of feature rows; part of the label is no function of the features."""
    return t.lineitem.select(*[F.col(c).cast("double").alias(f) for f, c in FEATURE_VIEW.items()], (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000 + F.col("l_tax") * 100 + F.col("l_orderkey") % 97).alias("result"))


@query("x9_component_variance")
def _(t):
    rows = features(t)
    return models.Components(rows).variance_table(rows).select("component", r("ratio"), r("cumulative"))


@query("x9_component_loadings")
def _(t):
    rows = features(t)
    return models.Components(rows).loading_table(rows).select("component", "feature", r("loading"))


@query("x10_linear_coefficients")
def _(t):
    return models.coefficients(models.Components(features(t)).scores(), "result", "linear").select("term", r("value"))


@query("x10_boosted_trees")
def _(t):
    return models.comparison(models.Components(features(t)).scores(), "result", ["boosted"]).select("model", r("r2"), r("rmse"))


def intrinsic_features(t):
    return t.v_intrinsic.select(
        short_model_name(F.col("model")).alias("teacher_model"), F.col("language").alias("target_lang"), "prompts_distinct_ri", "responses_distinct_ri",
        F.col("perplexity").alias("average_perplexity"), F.col("rubric_score").alias("average_rubric_score"), "prompts_average_length", "responses_average_length",
    )


@query("x11_model_comparison")
def _(t):
    return models.comparison(models.Components(features(t)).scores(), "result").select("model", r("r2"), r("rmse"), "best")


@query("x11_predictions")
def _(t):
    rows = jobs.feature_model(intrinsic_features(t), t.v_teacher_scores, "pg_score").scores()
    got = models.predictions(rows, "pg_score")
    return got.select("teacher_model", "target_lang", r("pg_score"), r("prediction"))


@query("x12_random_intercept")
def _(t):
    return models.random_intercept(t.v_orders, "pg_score", ["z_score", "pgr"], "teacher_model").select("predictor", r("beta"), r("se"), r("t", digits=3), r("p", digits=4))


@query("x12_random_intercept_ml")
def _(t):
    got = models.random_intercept(t.lineitem, "l_extendedprice", ["l_quantity"], "l_suppkey", reml=False)
    return got.select("predictor", r("beta", digits=4), r("se", digits=4), r("aic", digits=2), r("bic", digits=2))


BALANCED = (
    "WITH rows AS (SELECT event_id // 10 AS g, (event_id % 10) - 4.5e0 AS x, value * (1 + (event_id // 10) % 4) AS y FROM events WHERE event_id < 10 * (SELECT count(*) // 10 FROM events)), "
    "line AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT g) AS k FROM rows), "
    "parts AS (SELECT (SELECT sum((m - a) ** 2) * 10 FROM (SELECT avg(y) AS m FROM rows GROUP BY g), (SELECT avg(y) AS a FROM rows)) AS between_, "
    "(SELECT sum((y - m) ** 2) FROM (SELECT y, avg(y) OVER (PARTITION BY g) AS m FROM rows)) AS within_), "
    "fit AS (SELECT *, (within_ - beta * beta * sxx) / (n - k - 1) AS msw, between_ / (k - 1) AS msb FROM line, parts), "
    "known AS (SELECT beta, sxx, greatest((msb / msw - 1) / 10, 0) AS ratio, CASE WHEN msb > msw THEN msw ELSE (between_ + within_ - beta * beta * sxx) / (n - 2) END AS sigma2 FROM fit) "
    "SELECT 'x' AS predictor, round(beta, 5) + 0e0 AS beta, round(sqrt(sigma2 / sxx), 5) AS se, round(beta / sqrt(sigma2 / sxx), 3) + 0e0 AS t, round(ratio, 4) AS ratio FROM known"
)


@query("x12_equal_groups", BALANCED)
def _(t):
    """Groups of one size with a predictor that is balanced in each: the fit has a closed form (one-way analysis of variance)."""
    tens = F.floor(F.col("event_id") / 10)
    rows = t.events.select(tens.alias("g"), (F.pmod("event_id", F.lit(10)) - 4.5).alias("x"), (F.col("value") * (1 + F.pmod(tens, F.lit(4)))).alias("y"), "event_id")
    whole = t.events.agg((F.floor(F.count(F.lit(1)) / 10) * 10).alias("n")).scalar()
    got = models.random_intercept(rows.filter(F.col("event_id") < whole), "y", ["x"], "g")
    return got.select("predictor", r("beta", digits=5), r("se", digits=5), r("t", digits=3), r("ratio", digits=4))


TWO = ["prompts_distinct_ri", "responses_distinct_ri"]


@query("x9_two_components", "SELECT i AS component, round((1 + (3 - 2 * i) * abs(c)) / 2, 6) AS ratio, round(CASE i WHEN 1 THEN (1 + abs(c)) / 2 ELSE 1 END, 6) AS cumulative FROM (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem), (VALUES (1::INT), (2::INT)) AS v(i)")
def _(t):
    """Two standardised features: the components explain (1 ± |r|) / 2."""
    rows = features(t)
    return models.Components(rows, TWO).variance_table(rows).select("component", r("ratio"), r("cumulative"))


LABEL = "(l_extendedprice * (1 - l_discount) / 1000 + l_tax * 100 + l_orderkey % 97)"
TWO_FIT = (
    f"(SELECT corr(l_quantity, {LABEL}) AS a, corr(l_extendedprice, {LABEL}) AS b, corr(l_quantity, l_extendedprice) AS c, stddev_pop({LABEL}) AS sd FROM lineitem)"
)


@query("x10_two_predictors", f"SELECT 'linear' AS model, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 6) AS r2, round(sd * sqrt(1 - (a * a + b * b - 2 * a * b * c) / (1 - c * c)), 4) AS rmse, true AS best FROM {TWO_FIT}")
def _(t):
    """A linear fit on two components is the least-squares fit on the two features: its R² follows from three correlations."""
    return models.comparison(models.Components(features(t), TWO).scores(), "result", ["linear"]).select("model", r("r2"), r("rmse", digits=4), "best")


@query("x11_order_of_fits", "SELECT true AS ridge_below_linear, true AS lasso_below_linear, true AS quadratic_above_linear, true AS one_best, true AS all_within_0_and_1")
def _(t):
    """What must hold of in-sample fits whatever the data: a penalty costs R², more terms do not, one model is marked as the best."""
    got = models.comparison(models.Components(features(t)).scores(), "result", ["linear", "ridge", "lasso", "quadratic"])
    r2 = lambda kind: F.max(F.when(F.col("model") == kind, F.col("r2")))
    return got.agg(
        (r2("ridge") <= r2("linear") + 1e-9).alias("ridge_below_linear"), (r2("lasso") <= r2("linear") + 1e-9).alias("lasso_below_linear"),
        (r2("quadratic") >= r2("linear") - 1e-9).alias("quadratic_above_linear"), (F.count_if("best") == 1).alias("one_best"), F.every(F.col("r2").between(0, 1)).alias("all_within_0_and_1"),
    )


@query(
    "x13_bins",
    "SELECT event_id, CASE WHEN value <= 1 THEN '<1%' WHEN value <= 2 THEN '1-2%' WHEN value <= 5 THEN '2-5%' WHEN value <= 10 THEN '>5%' END AS bin FROM events",
)
def _(t):
    return t.events.select("event_id", stats.binned(F.col("value"), *fv.RESOURCE_BINS["pct_commoncrawl"]).alias("bin"))


@query(
    "x14_tertiles",
    "SELECT event_id, CASE WHEN value <= (SELECT quantile_cont(value, 1 / 3.0e0) FROM events) THEN 0 WHEN value <= (SELECT quantile_cont(value, 2 / 3.0e0) FROM events) THEN 1 ELSE 2 END AS size_class FROM events",
)
def _(t):
    return stats.quantile_classes(t.events, "value").select("event_id", "size_class")


QUARTILES = "(SELECT base_model, count(*) AS n, quantile_cont(pg_score, 0.25) AS q1, quantile_cont(pg_score, 0.5) AS median, quantile_cont(pg_score, 0.75) AS q3 FROM {v} GROUP BY 1)"
INSIDE = "pg_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
EVENT_BOX = "(SELECT event_type AS base_model, value AS pg_score FROM events)"


@query(
    "x15_box_stats",
    f"SELECT base_model, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(pg_score) FILTER (WHERE {INSIDE}), 6) AS whisker_low, "
    f"round(max(pg_score) FILTER (WHERE {INSIDE}), 6) AS whisker_high, count(*) FILTER (WHERE NOT ({INSIDE})) AS n_outliers FROM {EVENT_BOX} v JOIN {QUARTILES.format(v=EVENT_BOX)} q USING (base_model) GROUP BY 1",
)
def _(t):
    rows = t.events.select(F.col("event_type").alias("base_model"), F.col("value").alias("pg_score"))
    got = stats.box_stats(rows, "base_model", "pg_score")
    return got.select("base_model", "n", *[r(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_outliers")
