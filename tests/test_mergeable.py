"""Statistics as sums: one scan, equal to the separate metrics, and the same over streams that fail and start again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.operators import mergeable, metrics
from tutorgauge.plans import jobs
from tutorgauge.session import new_folder
from tutorgauge.sources import seeds
from tutorgauge.streaming import jobs as streaming

SCHEMA = "id long, model string, prompt string, response string, raw string, losses array<double>, prompt_length int, prompt_embedding array<float>, response_embedding array<double>, valid string"


def rows(n=240):
    out = []
    for i in range(n):
        vec = None if i % 11 == 0 else [float(i % 5 - 2), float(i % 3 - 1), 0.5 * (i % 2)]
        if i % 13 == 0 and vec:
            vec = [0.0, 0.0, 0.0]
        raw = ["oops", None, '{"score": 4, "feedback": "a"}', '{"score": 9, "feedback": "a"}', '{"score": 2, "feedback": "b"}'][i % 5]
        losses = [0.1 * (i % 7), 0.2, 0.3 * (i % 3)]
        out.append((i, [None, "a", "b", "b"][i % 4], "w " * (i % 6), None if i % 9 == 0 else "v " * (i % 4), raw, losses, 3 if i % 8 == 0 else i % 3, vec, [1.0, float(i % 4), -1.0], "kept"))
    out += [(900 + i, "no vectors", "x", "y", None, [0.5], 0, None, None, "kept") for i in range(5)]
    return out


def all_stats():
    return [mergeable.distinct_ri_stat(), mergeable.length_stat(), mergeable.perplexity_stat(), mergeable.rubric_stat()]


def plain(df, columns):
    return {r["model"]: tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


def expected(df):
    by = ["model"]
    scored = df.withColumn("perplexity", metrics.perplexity_of_losses("losses", "prompt_length"))
    return [
        metrics.distinct_ri(df, by, {"prompts": "prompt_embedding", "responses": "response_embedding"}).drop("n"),
        metrics.average_length(df, by), metrics.perplexity_summary(scored, by), metrics.rubric_score(df, by),
    ]


def check(got, df):
    for part in expected(df):
        columns = [c for c in part.columns if c != "model"]
        want = plain(part, columns)
        have = plain(got, columns)
        assert {k: have[k] for k in want} == want, columns


def test_equal_to_the_separate_metrics(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mergeable.evaluated(df, ["model"], all_stats())
    assert {r.model for r in got.collect()} == {None, "a", "b", "no vectors"}
    check(got, df)
    assert mergeable.evaluated(df.limit(0), ["model"], all_stats()).count() == 0
    one = mergeable.evaluated(df, [], all_stats()).collect()
    assert len(one) == 1 and one[0].total_samples == 245


def test_report_reads_its_input_once(spark):
    path = new_folder(spark, "t")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    table = metrics.metric_table(df, ["model"], ["all"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Join") == 0
    assert {"prompts_distinct_ri", "average_perplexity", "score_5", "responses_average_length"} <= set(table.columns)


def test_own_metrics_beside_shared_ones(spark, monkeypatch):
    monkeypatch.setattr(metrics, "METRICS", dict(metrics.METRICS))
    metrics.register_metric("rows", lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")))
    df = spark.createDataFrame(rows(), SCHEMA)
    table = metrics.metric_table(df, ["model"], ["rows", "length"])
    assert {r.model: r.n_rows for r in table.collect()}[None] == 60 and set(table.columns) == {"model", "n_rows", "prompts_average_length", "responses_average_length"}


def test_two_statistics_need_names_of_their_own(spark):
    df = spark.createDataFrame(rows(4), SCHEMA)
    with pytest.raises(ValueError, match="one name"):
        mergeable.evaluated(df, ["model"], [mergeable.rubric_stat(), mergeable.rubric_stat()])


def test_streams_over_batches_restarts_and_replays(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    source, (out, progress) = new_folder(spark, "t"), streaming.stream_run(spark, "t")
    run = lambda: streaming.running(streaming.file_stream(spark, source, df.schema, 1), ["model"], all_stats(), out, progress)
    df.limit(0).write.parquet(source)
    assert run().count() == 0
    df.filter("id % 2 = 0").repartition(3).write.mode("append").parquet(source)
    check(run(), df.filter("id % 2 = 0"))
    df.filter("id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    check(run(), df)
    check(run(), df)  # nothing new
    # the last batch failed after it wrote its sums: it runs again and takes their place
    last = max(glob.glob(f"{progress}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc")
    check(run(), df)
    assert len(glob.glob(f"{out}/batch=*")) >= 5


def test_pandas_groups_have_a_declared_bound(spark):
    df = spark.createDataFrame(rows(), SCHEMA).select("model", "id")
    top = lambda g: g.nlargest(1, "id")
    got = mergeable.grouped_pandas(df, ["model"], top, "model string, id long", 500)
    assert {r.model: r.id for r in got.collect()} == {None: 236, "a": 237, "b": 239, "no vectors": 904}
    with pytest.raises(ValueError, match="declared for 10"):
        mergeable.grouped_pandas(df, ["model"], top, "model string, id long", 10)
    assert mergeable.grouped_pandas(df.limit(0), ["model"], top, "model string, id long", 10).count() == 0


def test_registered_statistics(monkeypatch):
    monkeypatch.setattr(mergeable, "STATISTICS", dict(mergeable.STATISTICS))
    mergeable.register_statistic("mine", mergeable.length_stat)
    assert mergeable.STATISTICS["mine"] is mergeable.length_stat


def test_streamed_samples_are_exact(spark):
    raw = spark.range(300).selectExpr("cast(id as string) uuid", "array(named_struct('from', 'human', 'value', concat('p', id)), named_struct('from', 'gpt', 'value', 'r')) conversations")
    at = new_folder(spark, "t")
    raw.repartition(4).write.parquet(at)
    want = {r.source_id for r in seeds.magpie(raw, 50, 42).collect()}
    for share in (1.0, 0.4):
        out, progress = streaming.stream_run(spark, "t")
        stream = streaming.file_stream(spark, at, raw.schema, 1)
        got = jobs.streamed_seeds(stream, fv.MAGPIE, out, progress, 50, 42, share)
        assert {r.source_id for r in got.collect()} == want
    out, progress = streaming.stream_run(spark, "t")
    with pytest.raises(ValueError, match="larger"):
        jobs.streamed_seeds(streaming.file_stream(spark, at, raw.schema), fv.MAGPIE, out, progress, 50, 42, 0.05)
