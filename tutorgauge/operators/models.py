"""Component analysis and regressions over the feature table, and the random-intercept model.

The fits are Spark ML or sums over the data; the driver sees matrices whose size depends on the
number of features only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge.functions.significance import normal_p
from tutorgauge.operators.boosting import BoostedTreesRegressor
from tutorgauge.operators.joins import released, settled
from tutorgauge.operators.scores import standardized
from tutorgauge.sources.tables import literal_table

FEATURES = [
    "prompts_distinct_ri",
    "responses_distinct_ri",
    "average_perplexity",
    "average_rubric_score",
    "prompts_average_length",
    "responses_average_length",
]
ROWS_PER_PARTITION = 10_000
REGRESSIONS = ["linear", "ridge", "lasso", "quadratic", "boosted"]


class Components:
    """Principal components of standardised features."""

    def __init__(self, df: DataFrame, features: list[str] = FEATURES, k: int | None = None):
        self.features = list(features)
        self.k = k or len(features)
        scaled = standardized(df, {f: F.col(f) for f in features})
        self._vectors = VectorAssembler(inputCols=[f"{f}_z" for f in features], outputCol="_x").transform(scaled)
        model = PCA(k=self.k, inputCol="_x", outputCol="_pc").fit(self._vectors)
        loadings = np.array(model.pc.toArray())
        # A component's sign is free: its largest loading is made positive.
        self.signs = np.array([1.0 if c[np.argmax(np.abs(c))] >= 0 else -1.0 for c in loadings.T])
        self.loadings = loadings * self.signs
        self.ratios = np.array(model.explainedVariance.toArray())
        self._model = model

    def loading_table(self, df: DataFrame) -> DataFrame:
        rows = [
            (f"PC{j + 1}", f, float(self.loadings[i, j])) for j in range(self.k) for i, f in enumerate(self.features)
        ]
        return literal_table(df.sparkSession, rows, "component string, feature string, loading double")

    def variance_table(self, df: DataFrame) -> DataFrame:
        rows = [(j + 1, float(r)) for j, r in enumerate(self.ratios)]
        table = literal_table(df.sparkSession, rows, "component int, ratio double")
        run = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows
        return table.withColumn("cumulative", F.sum("ratio").over(run))

    def scores(self) -> DataFrame:
        """Input rows with their component vector ``components``."""
        signs = F.array(*[F.lit(float(s)) for s in self.signs])
        turned = F.zip_with(vector_to_array("_pc"), signs, lambda x, s: x * s)
        return self._model.transform(self._vectors).withColumn("components", array_to_vector(turned)).drop("_x", "_pc")


def _estimator(kind: str, n: int, label: str, sd: float):
    linear = lambda **kw: LinearRegression(featuresCol="components", labelCol=label, solver="normal", standardization=False, **kw)
    if kind == "linear":
        return linear()
    if kind == "ridge":  # alpha = 1 on the sum of squares
        return linear(regParam=sd / n)
    if kind == "lasso":  # alpha = 0.1 on the mean of squares over two
        return linear(regParam=0.1, elasticNetParam=1.0, tol=1e-12, maxIter=10_000)
    if kind == "quadratic":
        expand = PolynomialExpansion(degree=2, inputCol="components", outputCol="_poly")
        return Pipeline(stages=[expand, LinearRegression(featuresCol="_poly", labelCol=label, solver="normal")])
    if kind == "boosted":
        return BoostedTreesRegressor("components", label, rounds=100, step=0.1, seed=42)
    raise ValueError(f"unknown regression {kind!r}; known: {REGRESSIONS}")


def fit_regressions(df: DataFrame, label: str, kinds: list[str] | None = None) -> dict:
    """In-sample fits of ``label`` on ``components``: model, r2 and rmse by name."""
    kinds = kinds or REGRESSIONS
    spark = df.sparkSession
    rows = df.select("components", F.col(label).cast("double").alias(label))
    base = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("m"), F.stddev_pop(label).alias("sd")).first()
    # The fits pass over these narrow rows many times, so they are spread evenly and kept.
    widest = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(min(widest, base.n // ROWS_PER_PARTITION + 1)).persist()
    try:
        fits = {}
        for kind in kinds:
            model = _estimator(kind, base.n, label, base.sd).fit(rows)
            miss = F.col(label) - F.col("prediction")
            spread = F.col(label) - F.lit(base.m)
            got = model.transform(rows).agg(F.sum(miss * miss).alias("res"), F.sum(spread * spread).alias("tot")).first()
            fits[kind] = {"model": model, "r2": 1 - got.res / got.tot if got.tot else math.nan, "rmse": math.sqrt(got.res / base.n)}
        return fits
    finally:
        rows.unpersist()


def comparison(df: DataFrame, label: str, kinds: list[str] | None = None) -> DataFrame:
    """(model, r2, rmse) of each regression and whether it is the best by r2."""
    fits = fit_regressions(df, label, kinds)
    best = max(fits, key=lambda k: fits[k]["r2"])
    rows = [(k, float(v["r2"]), float(v["rmse"]), k == best) for k, v in fits.items()]
    return literal_table(df.sparkSession, rows, "model string, r2 double, rmse double, best boolean")


def coefficients(df: DataFrame, label: str, kind: str = "linear") -> DataFrame:
    """Intercept and slopes of a linear, ridge or lasso fit."""
    model = fit_regressions(df, label, [kind])[kind]["model"]
    rows = [("intercept", float(model.intercept))] + [(f"PC{i + 1}", float(c)) for i, c in enumerate(model.coefficients)]
    return literal_table(df.sparkSession, rows, "term string, value double")


def importances(df: DataFrame, label: str) -> DataFrame:
    """Importance of each component in the boosted trees."""
    model = fit_regressions(df, label, ["boosted"])["boosted"]["model"]
    rows = [(f"PC{i + 1}", float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return literal_table(df.sparkSession, rows, "component string, importance double")


def predictions(df: DataFrame, label: str, kind: str = "linear") -> DataFrame:
    """Rows with the fitted value of one regression."""
    model = fit_regressions(df, label, [kind])[kind]["model"]
    return model.transform(df.withColumn(label, F.col(label).cast("double")))


def random_intercept(df: DataFrame, y: str, x: list[str], group: str, reml: bool = True) -> DataFrame:
    """Linear mixed model with one random intercept per group: beta, SE, t and p per predictor.

    Under this model a group enters the likelihood only through its size, its sums and its second
    moments, and groups of one size share their weight. So the data is summed per group, the groups per
    size, and that table is settled. The likelihood of a grid of variance ratios is one aggregate over it, refined around the
    best point; the driver sees one row per grid point, however many sizes there are.
    AIC and BIC are given for the maximum-likelihood fit only.
    """
    spark, p = df.sparkSession, len(x) + 1
    names = [*x, y]
    rows = df.select(group, *[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    index = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    col = lambda i: F.lit(1.0) if i == 0 else F.col(names[i - 1])
    sums = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(col(i)).alias(f"s{i}") for i in range(p + 1)],
        *[F.sum(col(i) * col(j)).alias(f"m{i}_{j}") for i, j in index],
    )
    by_size = settled(sums.groupBy("n").agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i, j in index],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"o{i}_{j}") for i, j in index],
    ))

    def square(row, name: str) -> np.ndarray:
        a = np.zeros((p + 1, p + 1))
        for i, j in index:
            a[i, j] = a[j, i] = row[f"{name}{i}_{j}"]
        return a

    whole = by_size.agg(F.sum(F.col("n") * F.col("groups")).alias("rows"), *[F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i, j in index]).first()
    total = whole["rows"] or 0
    if total <= p:
        return literal_table(spark, [], "predictor string, beta double, se double, t double, p double, ratio double, aic double, bic double")
    free = total - p if reml else total
    moments = square(whole, "m")

    def fits(ratios: list[float]) -> list[tuple]:
        """(cost, ratio, beta, sigma2, a) of every ratio, from one aggregate over the sizes."""
        each = by_size.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios])))
        shrink = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
        rows = each.groupBy("ratio").agg(F.sum(F.col("groups") * F.log1p(F.col("n") * F.col("ratio"))).alias("spread"), *[F.sum(shrink * F.col(f"o{i}_{j}")).alias(f"o{i}_{j}") for i, j in index]).collect()
        out = []
        for row in rows:
            full = moments - square(row, "o")
            a, b, c = full[:p, :p], full[:p, p], full[p, p]
            beta = np.linalg.solve(a, b)
            sigma2 = max((c - b @ beta) / free, 1e-300)
            cost = free * math.log(sigma2) + row["spread"] + (np.linalg.slogdet(a)[1] if reml else 0.0)
            out.append((cost, row["ratio"], beta, sigma2, a))
        return sorted(out, key=lambda x: x[:2])

    # The cost is scanned over the log of the ratio, then between the neighbours of the best point, again and again.
    low, high, points, tried = -25.0, 15.0, 161, []
    while high - low > 1e-7:
        step = (high - low) / (points - 1)
        found = fits([math.exp(low + step * i) for i in range(points)] + ([] if tried else [0.0]))
        tried.append(found[0])
        at = math.log(next(x[1] for x in found if x[1] > 0))
        low, high, points = max(at - step, -25.0), min(at + step, 15.0), 129
    released(by_size)
    cost, ratio, beta, sigma2, a = min(tried, key=lambda x: x[:2])
    se = np.sqrt(sigma2 * np.diag(np.linalg.inv(a)))
    log_likelihood = -0.5 * (cost + free * (1 + math.log(2 * math.pi)))
    count = p + 2
    aic = None if reml else float(-2 * log_likelihood + 2 * count)
    bic = None if reml else float(-2 * log_likelihood + math.log(total) * count)
    out = []
    for name, value, error in zip(x, beta[1:], se[1:]):
        t = float(value / error) if error > 0 else math.nan
        out.append((name, float(value), float(error), t, normal_p(t), float(ratio), aic, bic))
    return literal_table(spark, out, "predictor string, beta double, se double, t double, p double, ratio double, aic double, bic double")
