"""Sinks, caches, documents and streams on folders of their own."""

import pytest
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.session import new_folder, shared_folder
from tutorgauge.sources import dims, documents, seeds, tables
from tutorgauge.streaming import jobs as streaming


def test_append(spark):
    path, wide = new_folder(spark, "t"), new_folder(spark, "t")
    a = spark.createDataFrame([(1, "x")], "id int, k string")
    assert tables.append_table(a, path) == path
    assert tables.append_table(a.select("k", "id"), path) == path  # same columns in another order
    assert spark.read.parquet(path).count() == 2
    b = spark.createDataFrame([(2, 0.5)], "id int, v double")
    with pytest.raises(ValueError, match="another path"):
        tables.append_table(b, path, path)
    got = spark.read.parquet(tables.append_table(b, path, wide)).orderBy("id", "k")
    assert [tuple(r) for r in got.select("id", "k", "v").collect()] == [(1, "x", None), (1, "x", None), (2, None, 0.5)]


def test_cache(spark):
    path, calls = new_folder(spark, "t"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, None)], "a int, b double")

    for use in (True, True, False):
        assert tables.cached_json(spark, path, "a int, b double", build, use).collect() == [(1, None)]
    assert len(calls) == 2


def test_labelled_inputs(spark):
    with pytest.raises(ValueError, match="Cannot find"):
        tables.read_labelled(spark, ["x::/nowhere/at/all"], "a int")
    with pytest.raises(ValueError, match="Cannot find"):
        tables.read_labelled(spark, ["no mark"], "a int")


def test_missing_languages(spark):
    path = new_folder(spark, "t")
    rows = lambda mark, *langs: spark.createDataFrame([(l, mark) for l in langs], "language string, mark int")
    tables.write_missing_languages(rows(1, "de", "es"), path)
    got = tables.write_missing_languages(rows(2, "de", "ja"), path)
    assert {(r.language, r.mark) for r in got.collect()} == {("de", 1), ("es", 1), ("ja", 2)}


def test_plain_directory_of_documents(spark, tmp_path):
    (tmp_path / "sft-S1-de_org__m_intrinsic_metrics.json").write_text('{\n"distinct_ri": {"prompts_distinct_ri": 0.5},\n "length": {"prompts_average_length": 3.0}\n}')
    got = documents.read_intrinsic(spark, str(tmp_path), "sft").collect()
    assert [tuple(r) for r in got] == [("de", "org/m", 0.5, None, None, None)]
    assert documents.read_intrinsic_complete(spark, str(tmp_path)).count() == 0


def test_csv_sheet_keeps_text(spark):
    path = new_folder(spark, "t")
    text = 'line "one"\nline, two \\ end'
    tables.write_csv(spark.createDataFrame([(text,)], "prompt string"), path, ("fluency",))
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).first()
    assert got.prompt == text and got.fluency in (None, "")


def test_seed_ids(spark):
    raw = spark.createDataFrame([("q", "a"), ("q", "a")], "question string, answer string")
    with pytest.raises(ValueError, match="not unique"):
        seeds.check_unique_ids(seeds.gsm8k(raw))
    assert seeds.chosen_sources(["a", "b", "c"], include=["b"], exclude=["b"]) == ["b"]
    assert seeds.chosen_sources(["a", "b", "c"], exclude=["b"]) == ["a", "c"]
    assert list(seeds.SOURCES) == [fv.WILDCHAT, fv.GSM8K, fv.MAGPIE, fv.HELPSTEER, fv.OASST, fv.EUROBLOCKS, fv.AYA]


def test_euroblocks_copies(spark):
    """A third of the rows are copies of one conversation; the sample has its exact size."""
    talk = lambda i: [("human", f"p{i}"), ("gpt", "r")]
    raw = spark.createDataFrame([(talk(0 if i % 3 == 0 else i), "German", "x") for i in range(300)], "conversations array<struct<from:string,value:string>>, language string, dataset string")
    for n in (40, 150, 250):
        assert seeds.euroblocks(raw, n, 42).count() == n


def test_dimensions(spark):
    df = spark.createDataFrame([("gpt-4o-mini-2024-07-18", "de"), ("nobody", "xx")], "teacher_model string, target_lang string")
    got = {r.teacher_model: r for r in dims.with_dimensions(df).collect()}
    assert got["gpt-4o-mini-2024-07-18"].parameter_size is None and got["gpt-4o-mini-2024-07-18"].language_name == "German"
    assert got["nobody"].model_family is None
    assert dims.with_model_size(dims.with_dimensions(df)).count() == 0
    assert dims.models(spark).count() == 11 and dims.languages(spark).count() == 6


def test_stream_takes_new_files_once(spark):
    source, (out, progress) = new_folder(spark, "src"), streaming.stream_run(spark, "t")
    spark.range(10).write.parquet(source)
    schema = spark.range(1).schema
    run = lambda: streaming.append_stream(streaming.file_stream(spark, source, schema, 1).filter("id % 2 = 0"), out, progress)
    assert run().count() == 5
    assert run().count() == 5
    spark.range(10, 20).write.mode("append").parquet(source)
    assert sorted(r.id for r in run().collect()) == list(range(0, 20, 2))


def test_running_sums_over_restarts(spark):
    source, (out, progress) = new_folder(spark, "src"), streaming.stream_run(spark, "t")
    schema = "id bigint, g string"
    batch = lambda a, b: spark.range(a, b).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    df_schema = batch(0, 1).schema
    sums = {"n": F.count(F.lit(1)), "s": F.sum("id")}
    for a, b in ((0, 30), (30, 75)):
        batch(a, b).write.mode("append").parquet(source)
        got = streaming.running_sums(streaming.file_stream(spark, source, df_schema), ["g"], sums, out, progress)
    want = {r.g: (r.n, r.s) for r in batch(0, 75).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).collect()}
    assert {r.g: (r.n, r.s) for r in got.collect()} == want and schema


class Session:
    """Stand-in for a session without the setting."""

    def __init__(self, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_shared_folder_without_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named.rstrip("/")
    assert new_folder(spark, "a") != new_folder(spark, "a")
