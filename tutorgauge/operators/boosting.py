"""Gradient-boosted regression trees on binned features: the rules of Spark's ``GBTRegressor``, two passes over small blocks a tree.

Spark's own trees take three passes a tree over rows as objects. Here a feature value is one byte, its bin, and a task
sums blocks of rows with numpy; the driver sees sums per bin, whose size depends on the number of features only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
SPLIT_ROWS = 10_000  # rows, in expectation, whose values place the borders of the bins
REFRESH = 5  # trees after which the fitted values are kept with the rows
NO_CUT = 255  # above every bin
TASK_ROWS, MOST_TASK_ROWS = 250_000, 4_000_000  # a task should have that many rows at least, so that its start does not outweigh its sums, and at most


def borders(values: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """Borders between at most ``bins`` bins of near equal counts: midpoints of neighbouring values.

    ``values`` are drawn so that ``rows`` are expected; as in Spark, what is missing of them counts as zeros.
    """
    at, counts = np.unique(values[values != 0], return_counts=True)
    if (zeros := rows - counts.sum()) > 0:
        place = np.searchsorted(at, 0.0)
        at, counts = np.insert(at, place, 0.0), np.insert(counts, place, zeros)
    mid = (at[:-1] + at[1:]) / 2
    if len(mid) <= bins - 1:
        return mid
    run, stride = np.cumsum(counts), rows / bins
    out, target = [], stride
    for i in range(1, len(at)):
        if abs(run[i - 1] - target) < abs(run[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out)


def _tasks(n: int, now: int, cores: int) -> int:
    """How many of ``now`` partitions to pass over: two passes a tree start them all, so no more than one a core unless they get too large."""
    return min(now, max(min(cores, n // TASK_ROWS + 1), n // MOST_TASK_ROWS + 1))


def _drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``SPLIT_ROWS`` of ``n`` rows, the very ones Spark's trees draw for their borders; all if there are no more."""
    if n <= SPLIT_ROWS:
        return rows
    spark = rows.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    picked = rows._jdf.toJavaRDD().sample(False, SPLIT_ROWS / n, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(picked, rows._jdf.schema()), spark)


def _leaf(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The leaf, 0 to 7, of every column of ``bins``."""
    feature, cut, _ = tree
    right = lambda node: bins[feature[node]] > cut[node]
    one = right(0)
    two = np.where(one, right(2), right(1))
    three = np.where(one, np.where(two, right(6), right(5)), np.where(two, right(4), right(3)))
    return 4 * one.astype(np.uint8) + 2 * two.astype(np.uint8) + three.astype(np.uint8)


def _fitted(trees: list[tuple], bins: np.ndarray) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for tree in trees:
        out += tree[2][_leaf(tree, bins)]
    return out


def _binned(columns: list, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, columns)]).astype(np.uint8)


def _best(counts: np.ndarray, sums: np.ndarray) -> tuple[int, int, float]:
    """Feature, last bin on the left and gain of the best split; a node that cannot gain sends all rows left."""
    n, s = counts.sum(1, keepdims=True), sums.sum(1, keepdims=True)
    left, left_sum = counts.cumsum(1)[:, :-1], sums.cumsum(1)[:, :-1]
    right, right_sum = n - left, s - left_sum
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left > 0) & (right > 0), left_sum**2 / left + right_sum**2 / right - s**2 / n, -np.inf)
    at = int(np.argmax(gain))
    if not gain.flat[at] > 0:
        return 0, NO_CUT, 0.0
    return at // gain.shape[1], at % gain.shape[1], float(gain.flat[at])


class BoostedTrees:
    """The fitted trees: ``(feature, cut, value)`` each, in heap order, and the borders of the bins."""

    def __init__(self, trees: list[tuple], cuts: list[np.ndarray], gains: np.ndarray, features: str):
        self.trees, self.cuts, self.features = trees, cuts, features
        self.featureImportances = _Importances(gains / gains.sum() if gains.sum() else gains)

    def transform(self, df: DataFrame) -> DataFrame:
        trees, cuts, k = self.trees, self.cuts, len(self.cuts)

        @F.pandas_udf("double")
        def of(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series(_fitted(trees, _binned([c.to_numpy() for c in columns], cuts)))

        x = vector_to_array(self.features)
        return df.withColumn("prediction", of(*[F.get(x, F.lit(i)) for i in range(k)]))


class _Importances:
    def __init__(self, values: np.ndarray):
        self._values = values

    def toArray(self) -> np.ndarray:
        return self._values


class BoostedTreesRegressor:
    """Squared loss; the first tree counts fully, each later one is fitted to twice the rest and counts ``step`` times, as in Spark."""

    def __init__(self, features: str, label: str, rounds: int = 100, step: float = 0.1, seed: int = 42):
        self.features, self.label, self.rounds, self.step, self.seed = features, label, rounds, step, seed

    def fit(self, rows: DataFrame) -> BoostedTrees:
        first, n = rows.select(self.features).first(), rows.count()
        k = len(first[0])
        x = vector_to_array(self.features)
        flat = rows.select(*[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(k)], F.col(self.label).cast("double").alias("y"))
        drawn = _drawn(flat.drop("y"), n, self.seed).toPandas()
        cuts = [borders(drawn[f"x{i}"].to_numpy(), min(n, SPLIT_ROWS), min(BINS, n)) for i in range(k)]
        width = max(len(c) for c in cuts) + 1  # a draw above the expected size can give a bin more

        def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                y = part["y"].to_numpy(dtype=float)
                if not np.isfinite(y).all():
                    raise ValueError("labels must be finite numbers")
                if len(y):
                    bins = _binned([part[f"x{i}"].to_numpy() for i in range(k)], cuts)
                    yield pd.DataFrame({"bins": [bins.tobytes()], "rest": [y.tobytes()]})

        def rests(part: Iterator[tuple[bytes, bytes]], trees: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b, r in part:
                bins = np.frombuffer(b, np.uint8).reshape(k, -1)
                yield bins, np.frombuffer(r) - _fitted(trees, bins)

        pairs = list(combinations(range(k), 2)) or [(0, 0)]

        def of_pairs(trees: list[tuple], counted: bool):
            """Sums (or counts) of a task by the bins of every two features."""

            def sums(part: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
                out = np.zeros((len(pairs), width * width))
                for bins, rest in rests(part, trees):
                    high = bins.astype(np.int64) * width
                    for p, (i, j) in enumerate(pairs):
                        out[p] += np.bincount(high[i] + bins[j], None if counted else rest, width * width)
                yield out.tobytes()

            return sums

        def of_nodes(trees: list[tuple], tree: tuple):
            """Counts and sums of a task by node of the third level, feature and bin."""

            def sums(part: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
                out = np.zeros((2, k, 4 * width))
                for bins, rest in rests(part, trees):
                    node = (_leaf(tree, bins) >> 1).astype(np.int64) * width
                    for i in range(k):
                        at = node + bins[i]
                        out[0, i] += np.bincount(at, minlength=4 * width)
                        out[1, i] += np.bincount(at, rest, 4 * width)
                yield out.tobytes()

            return sums

        def total(table, sums) -> np.ndarray:
            return np.sum([np.frombuffer(r) for r in table.mapPartitions(sums).collect()], axis=0)

        def refreshed(trees: list[tuple]):
            return lambda part: ((bins.tobytes(), rest.tobytes()) for bins, rest in rests(part, trees))

        def table(found: np.ndarray, i: int, j: int) -> np.ndarray:
            """Sums by the bins of two features, those of ``i`` in rows."""
            if i == j:
                p = next(p for p, pair in enumerate(pairs) if i in pair)
                return np.diag(found[p].sum(1 if pairs[p][0] == i else 0))
            return found[pairs.index((i, j))] if i < j else found[pairs.index((j, i))].T

        few = flat.coalesce(_tasks(n, flat.rdd.getNumPartitions(), flat.sparkSession.sparkContext.defaultParallelism))
        state = few.mapInPandas(packed, "bins binary, rest binary").rdd.map(lambda r: (bytes(r[0]), bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            shape = (len(pairs), width, width)
            counts = total(state, of_pairs([], True)).reshape(shape)
            trees, since, gains = [], [], np.zeros(k)
            for number in range(self.rounds):
                if len(since) == REFRESH:
                    old, state = state, state.mapPartitions(refreshed(since)).persist(StorageLevel.MEMORY_AND_DISK)
                    since = []
                    found = total(state, of_pairs(since, False)).reshape(shape)
                    old.unpersist()
                else:
                    found = total(state, of_pairs(since, False)).reshape(shape)
                feature, cut, value = [0] * 7, [NO_CUT] * 7, np.zeros(8)
                weight = 4.0 if number else 1.0
                sides = lambda f, c, right, h: np.stack([(table(h, f, g)[c + 1 :] if right else table(h, f, g)[: c + 1]).sum(0) for g in range(k)])
                whole = lambda h: np.stack([table(h, g, g).sum(0) for g in range(k)])
                nodes = [(0, whole(counts), whole(found))]
                feature[0], cut[0], gain = _best(*nodes[0][1:])
                gains[feature[0]] += weight * gain
                for right in (0, 1):
                    node = 1 + right
                    feature[node], cut[node], gain = _best(sides(feature[0], cut[0], right, counts), sides(feature[0], cut[0], right, found))
                    gains[feature[node]] += weight * gain
                got = total(state, of_nodes(since, (feature, cut, value))).reshape(2, k, 4, width)
                for q in range(4):
                    node = 3 + q
                    n_q, s_q = got[0, :, q], got[1, :, q]
                    feature[node], cut[node], gain = _best(n_q, s_q)
                    gains[feature[node]] += weight * gain
                    f, c = feature[node], cut[node]
                    for leaf, part in ((2 * q, slice(None, c + 1)), (2 * q + 1, slice(c + 1, None))):
                        held = n_q[f, part].sum()
                        value[leaf] = s_q[f, part].sum() / held if held else 0.0
                tree = (feature, cut, value * (2 * self.step if number else 1.0))
                trees.append(tree)
                since.append(tree)
            return BoostedTrees(trees, cuts, gains, self.features)
        finally:
            state.unpersist()
