"""Quality rules: word statistics, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge.operators.joins import settled, sized

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
_SYMBOLS = b"#*$%&|<>"
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def word_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier one, and words in repeated three-word windows."""
    words = text.split()
    n = len(words)
    symbols = sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(len(_SYMBOLS)))))
    if not n:
        return 0, 0, symbols, 0, 0
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        keys = ids[: n - WINDOW + 1]
        for k in range(1, WINDOW):
            # pairs of numbers below n * n fit a long; renumber before the next word joins
            keys = np.unique(keys * len(numbers) + ids[k : n - WINDOW + 1 + k], return_inverse=True)[1].astype(np.int64)
        often = np.bincount(keys)[keys] > 1
        inside = np.zeros(n, bool)
        for k in range(WINDOW):
            inside[k : n - WINDOW + 1 + k] |= often
        repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def statistics(text: str | Column) -> Column:
    """The counts of ``word_statistics`` as one struct; a null text has no words."""

    @F.pandas_udf(_COUNTS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([word_statistics(t) if t is not None else (0,) * 5 for t in texts], columns=names, dtype="int64")

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


# --- minimum covariance determinant -------------------------------------------------

FEATURES = ("x0", "x1", "x2", "x3")
SUBSET = 0.5  # share of a group's rows that its estimate rests on; what lies outside may be bad without moving it
STEPS = 30  # at most; steps end when no determinant falls
MIN_ROWS = 100  # a group with fewer rows is judged by the estimate of its language, a language by that of all rows
FLOORS = (0.05, 0.4, 0.5, 0.5)  # least standard deviations: a statistic that is constant in a group must not reject all others
CUTOFF = 6.0  # Mahalanobis distance beyond which a document is rejected


def transformed() -> list[Column]:
    """Log mean word length, and logs of symbol, repeated-line and repeated-word counts per hundred words.

    Counts are cleared of what length alone brings: each is a rate.
    """
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100.0 * F.col(c) / words)
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("x0"), rate("n_symbols").alias("x1"), rate("n_dup_lines").alias("x2"), rate("n_repeat_words").alias("x3")]


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the central ``share`` of normal rows unbiased; ``p`` even."""

    def below(x: float, k: int) -> float:  # chi-squared distribution function, k even
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))

    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid, p) < share else (low, mid)
    return share / below(low, p + 2)


def _model(sums: DataFrame, share: float) -> DataFrame:
    """``(key, start, centre, inverse, det)`` from the sums of a group's rows below and at the limit; one row a group and start.

    Rows at the limit (``_tied``) count only as far as the quota of ``share`` needs them; ``det`` is the log of the determinant.
    """
    p, factor, floors = len(FEATURES), consistency(share, len(FEATURES)), np.array(FLOORS)

    @F.pandas_udf("struct<centre:array<double>,inverse:array<double>,det:double>")
    def fitted(rows: pd.Series, n: pd.Series, firsts: pd.Series, seconds: pd.Series, n_tied: pd.Series, firsts_tied: pd.Series, seconds_tied: pd.Series) -> pd.DataFrame:
        out = []
        for whole, count, a, b, more, c, d in zip(rows, n, firsts, seconds, n_tied, firsts_tied, seconds_tied):
            weight = min(max(math.ceil(share * whole) - count, 0 if count else 1) / more, 1.0) if more else 0.0
            total = count + weight * more
            mean = (np.asarray(a, float) + weight * np.asarray(c, float)) / total
            cov = ((np.asarray(b, float) + weight * np.asarray(d, float)).reshape(p, p) / total - np.outer(mean, mean)) * factor
            cov += np.diag(np.maximum(floors**2 - np.diag(cov), 0))
            out.append((mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        return pd.DataFrame(out, columns=["centre", "inverse", "det"])

    return sums.select("key", "start", fitted("rows", "n", "firsts", "seconds", "n_tied", "firsts_tied", "seconds_tied").alias("m")).select("key", "start", "m.centre", "m.inverse", "m.det")


def _squared_distance() -> Column:
    p = range(len(FEATURES))
    off = [F.col(x) - F.col("centre")[i] for i, x in enumerate(FEATURES)]
    return sum((off[i] * F.col("inverse")[len(FEATURES) * i + j] * off[j] for i in p for j in p), F.lit(0.0))


def _subset_sums(rows: DataFrame) -> DataFrame:
    """Counts, sums and sums of products of the rows below the limit ``most`` and, as ``_tied``, of those at it."""
    out = []
    for name, counts in (("", F.col("d") < F.col("most")), ("_tied", F.col("d") == F.col("most"))):
        total = lambda x: F.coalesce(F.sum(F.when(counts, x)), F.lit(0.0))
        out += [
            F.count(F.when(counts, F.lit(1))).alias(f"n{name}"),
            F.array(*[total(F.col(x)) for x in FEATURES]).alias(f"firsts{name}"),
            F.array(*[total(F.col(x) * F.col(y)) for x in FEATURES for y in FEATURES]).alias(f"seconds{name}"),
        ]
    return rows.groupBy("key", "start").agg(F.max("rows").alias("rows"), *out)


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from, as ``_model`` gives them: the median with variances from the quartiles, the median and the
    lower quartile with variances from the median deviation, which a share of bad rows below one half cannot carry off."""
    p = range(len(FEATURES))
    quartiles = sized(rows.groupBy("key").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{x}") for x in FEATURES]))
    off = rows.join(quartiles, "key").select("key", *[F.abs(F.col(x) - F.col(f"q{x}")[1]).alias(x) for x in FEATURES])
    known = quartiles.join(sized(off.groupBy("key").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{x}") for x in FEATURES])), "key")
    wide = [(F.col(f"q{x}")[2] - F.col(f"q{x}")[0]) / 1.349 for x in FEATURES]
    narrow = [F.col(f"m{x}") * 1.4826 for x in FEATURES]

    def start(number: int, quartile: int, deviations: list[Column]) -> Column:
        spread = [F.pow(F.greatest(v, F.lit(f)), 2) for v, f in zip(deviations, FLOORS)]
        cells = [1 / spread[i] if i == j else F.lit(0.0) for i in p for j in p]
        return F.struct(F.lit(number).alias("start"), F.array(*[F.col(f"q{x}")[quartile] for x in FEATURES]).alias("centre"), F.array(*cells).alias("inverse"), F.lit(math.inf).alias("det"))

    return sized(known.select("key", F.inline(F.array(start(0, 1, wide), start(1, 1, narrow), start(2, 0, narrow)))))


def robust_model(rows: DataFrame, share: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant of every ``key``: ``(key, centre, inverse)``.

    From several starts, a concentration step keeps the ``share`` of a group's rows nearest to the estimate and fits anew,
    which cannot raise the determinant, until none falls any more; the start with the least one counts. Rows are never gathered:
    a step is a quantile and a few sums per group, combined map-side, and models are broadcast where their measured size allows.
    """
    model = _starts(rows)
    for _ in range(steps):
        at = rows.join(model, "key").select("key", "start", *FEATURES, _squared_distance().alias("d"))
        near = sized(at.groupBy("key", "start").agg(F.percentile_approx("d", share, 10000).alias("most"), F.count(F.lit(1)).alias("rows")))
        following = sized(_model(_subset_sums(at.join(near, ["key", "start"]).filter("d <= most")), share))
        falls = following.alias("x").join(model.select("key", "start", F.col("det").alias("before")), ["key", "start"])
        fall = falls.agg(F.max(F.col("before") - F.col("det"))).first()[0]
        model = following
        if fall is None or fall <= 1e-6:
            break
    return model.groupBy("key").agg(F.min_by(F.struct("centre", "inverse"), "det").alias("m")).select("key", "m.centre", "m.inverse")


def quality_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per row ``id, copy``, the five counts, ``base_failed``, ``distance`` and ``kept``; ``copy`` is a hash of the text and the groups.

    Base rules reject a document with fewer than 50 words, or with over half of its words in repeated windows. The estimates rest
    on all rows that pass them, per language and source; copies of a text count once there, so that many copies of a bad one do
    not pass for the rule, and all are judged. A group of fewer than ``min_rows`` such texts takes the estimate of its
    language, a small language that of all rows; if there are fewer in all, no distance is given and the base rules decide.
    Null languages and sources are groups like others; a null text has no words and fails the base rules.
    """
    lang, source = by
    null_safe = [x for c in (lang, source) for x in (F.col(c).isNull(), F.col(c))]
    counted = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text), *null_safe).alias("copy"), F.col(lang).alias("g1"), F.col(source).alias("g2"), statistics(text).alias("s"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    table = settled(counted.select("id", "copy", "g1", "g2", "s.*").withColumn("base_failed", failed).select("*", *transformed()))
    passing = settled(table.filter("NOT base_failed").select("copy", "g1", "g2", *FEATURES).dropDuplicates(["copy"]))
    groups = settled(passing.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")))
    langs = groups.groupBy("g1").agg(F.sum("n").alias("n1"))
    counted = groups.join(langs, groups.g1.eqNullSafe(langs.g1)).drop(langs.g1).withColumn("n0", groups.agg(F.sum("n")).scalar())
    key = lambda level, g1, g2: F.struct(F.lit(level).alias("level"), g1.cast("string").alias("g1"), g2.cast("string").alias("g2"))
    none = F.lit(None)
    own, language, whole = key(2, F.col("g1"), F.col("g2")), key(1, F.col("g1"), none), key(0, none, none)
    chosen = F.when(F.col("n") >= min_rows, own).when(F.col("n1") >= min_rows, language).when(F.col("n0") >= min_rows, whole)
    keys = settled(counted.select("g1", "g2", chosen.alias("key")))
    wanted = keys.filter("key IS NOT NULL").select("key").distinct()
    each = passing.select(*FEATURES, F.explode(F.array(own, language, whole)).alias("key"))
    model = robust_model(settled(each.join(sized(wanted), "key", "left_semi")))
    # groups and models have a row per language and source
    places = sized(keys.join(model, "key").select(F.col("g1").alias("of1"), F.col("g2").alias("of2"), "centre", "inverse"))
    out = table.join(places, table.g1.eqNullSafe(places.of1) & table.g2.eqNullSafe(places.of2), "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(_squared_distance(), F.lit(0.0)))))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select("id", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", verdict.alias("kept"))


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns as they were. Rows that repeat another share its verdict."""
    bad = settled(quality_table(docs, id_col, text, by, cutoff).filter("NOT kept").select("id", "copy").distinct())
    null_safe = [x for c in by for x in (docs[c].isNull(), docs[c])]
    met = docs[id_col].eqNullSafe(bad.id) & (F.xxhash64(docs[text], *null_safe) == bad.copy)
    return docs.join(bad.hint("shuffle_hash"), met, "left_anti")
