"""Samples: exact sizes, the rows md5 names, skewed groups and repeated ids."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tutorgauge.operators import ranking, sampling, synthesis


def order(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def table(spark, sizes):
    rows = [(n * 100_000 + i, s) for n, (s, c) in enumerate(sizes.items()) for i in range(c)]
    return spark.createDataFrame(rows, "id bigint, strategy string")


def reference_quotas(sizes, total):
    """The greedy rule, written out."""
    taken = {s: min(total // len(sizes), c) for s, c in sizes.items()}
    left = total - sum(taken.values())
    for s, c in sorted(sizes.items(), key=lambda x: (-(x[1] - taken[x[0]]), x[0])):
        extra = min(left, c - taken[s])
        taken[s] += extra
        left -= extra
    return taken


@pytest.mark.parametrize(
    "sizes, total",
    [({"a": 50, "b": 50, "c": 50}, 100), ({"a": 5, "b": 500, "c": 90}, 300), ({"a": 3, "b": 4}, 100), ({"a": 40}, 10), ({"a": 9, "b": 9, "c": 9, "d": 9}, 3), ({"a": 1000, "b": 1, "c": 1}, 500)],
)
def test_balanced_subsample(spark, sizes, total):
    df = table(spark, sizes)
    want = reference_quotas(sizes, total)
    assert {r.strategy: r.quota for r in sampling.strategy_quotas(df, total).collect()} == want
    got = sampling.balanced_subsample(df, total).collect()
    assert len(got) == min(total, sum(sizes.values()))
    for s in sizes:
        ids = sorted((r.id for r in df.collect() if r.strategy == s), key=order)[: want[s]]
        assert sorted(r.id for r in got if r.strategy == s) == sorted(ids)


def test_shuffle_take(spark):
    df = spark.range(5000)
    for n in (0, 1, 777, 5000, 9000):
        assert sorted(r.id for r in sampling.shuffle_take(df, n).collect()) == sorted(sorted(range(5000), key=order)[:n])
    assert sampling.shuffle_take(df.limit(0), 5).count() == 0


def test_shuffle_take_with_copies(spark):
    """One id holds a third of all rows: the sample still has its size and the split refuses."""
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(900)], "id bigint, v bigint")
    keys = sorted((r.id for r in df.collect()), key=order)
    for n in (10, 200, 299, 301, 500, 899):
        got = [r.id for r in sampling.shuffle_take(df, n).collect()]
        assert Counter(got) == Counter(keys[:n])
    at = keys.index(0) + 5
    with pytest.raises(ValueError, match="ids repeat"):
        sampling.train_validation(df, (at + 0.5) / 900)


def test_group_sample_refuses_repeated_ids_at_the_cut(spark):
    df = spark.createDataFrame([(7, "a")] * 10, "id bigint, model string")
    with pytest.raises(Exception, match="ids repeat"):
        sampling.sample_per_group(df, 4).collect()


def test_hot_group(spark):
    df = spark.range(30_000).withColumn("model", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    got = Counter(r.model for r in sampling.sample_per_group(df, 700).collect())
    sizes = Counter(r.model for r in df.collect())
    assert got == {m: min(700, c) for m, c in sizes.items()}


def test_train_validation_is_exact(spark):
    got = Counter(r.split for r in sampling.train_validation(spark.range(1003)).collect())
    assert got == {"train": int(0.95 * 1003), "validation": 1003 - int(0.95 * 1003)}


def test_shuffled_index_is_a_permutation(spark):
    got = {r.id: r.idx for r in ranking.shuffled_index(spark.range(2000)).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(2000), key=order))}


def test_examples_are_distinct_pool_rows(spark):
    df = spark.range(300).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"), F.lit("r").alias("response"))
    got = synthesis.in_context_examples(df).collect()
    assert len(got) == 300
    seen = Counter()
    for r in got:
        parts = r.examples.split("\n\n")
        assert len(set(parts)) == 3
        seen.update(parts)
    assert len(seen) > 250  # drawn from the whole pool
    assert len(set(r.examples for r in got)) > 290  # another draw for every row


def test_share_by_hash(spark):
    assert abs(sampling.share_by_hash(spark.range(20_000), 0.3).count() - 6000) < 300
