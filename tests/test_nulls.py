"""Null keys, equal rows, empty streams and wide rows lose nothing."""

from pyspark.sql import functions as F

from tutorgauge.functions.hashing import stable_id
from tutorgauge.operators.joins import sized
from tutorgauge.operators.metrics import unigram_perplexity
from tutorgauge.operators.sampling import balanced_subsample
from tutorgauge.session import new_folder
from tutorgauge.sources import seeds
from tutorgauge.sources.tables import write_missing_languages
from tutorgauge.streaming import jobs as streaming


def test_null_language_is_written(spark):
    path = f"{new_folder(spark, 'nulls')}/release"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, language string")
    write_missing_languages(rows((1, "de")), path)
    write_missing_languages(rows((2, "es"), (3, None), (4, "de")), path)
    again = write_missing_languages(rows((5, None), (6, "fr")), path)
    assert {(r.id, r.language) for r in again.collect()} == {(1, "de"), (2, "es"), (3, None), (6, "fr")}


def test_equal_rows_get_ids_of_their_own(spark):
    raw = spark.createDataFrame([("q", "a")] * 3 + [("r", "b")], "question string, answer string")
    name = next(n for n, f in seeds.SOURCES.items() if f is seeds.gsm8k)
    first = {r.id for r in seeds.check_unique_ids(seeds.seed_table({name: raw}, 10)).collect()}
    assert len(first) == 4 and first == {r.id for r in seeds.seed_table({name: raw.repartition(3)}, 10).collect()}
    assert {r.id for r in seeds.gsm8k(raw).collect()} < first


def test_ids_tell_nulls_and_separators_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("c", None), ("", "c"), ("-", "c")]
    ids = spark.createDataFrame(rows, "x string, y string").select(stable_id("x", "y").alias("id")).collect()
    assert len({r.id for r in ids}) == len(rows)


def test_null_groups_stay(spark):
    rows = [(i, ["de", None][i % 2], ["x", "y", "z"][i % 3], "alpha beta " * (i % 4 + 1)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, language string, strategy string, text string")
    got = balanced_subsample(df, 6, by=["language"])
    assert got.columns == df.columns
    assert {r.language: r.n for r in got.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()} == {"de": 6, None: 6}
    plain = {(r.id, r.language): round(r.perplexity, 9) for r in unigram_perplexity(df, "text", "id", ["language"]).collect()}
    assert len(plain) == 24
    for shuffled in ({"broadcast_rows": 0}, {"broadcast_bytes": 3}):
        assert {(r.id, r.language): round(r.perplexity, 9) for r in unigram_perplexity(df, "text", "id", ["language"], **shuffled).collect()} == plain


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("word"))
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(sized(wide)) and "broadcast" not in plan(sized(wide, max_bytes=5000))
    assert sized(wide, max_bytes=5000).count() == 10


def test_empty_streams(spark):
    folder = new_folder(spark, "empty")
    spark.createDataFrame([], "label string, v array<double>").write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = lambda: streaming.file_stream(spark, f"{folder}/in/none*.parquet", schema)
    assert streaming.running_sums(stream(), ["label"], {"n": F.count(F.lit(1))}, f"{folder}/a", f"{folder}/pa").collect() == []
    assert streaming.running_distinct_ri(stream(), ["label"], "v", f"{folder}/b", f"{folder}/pb").collect() == []
