"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge.operators.joins import settled

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: shares by weight, held at ``most`` times the size.

    Sources in code-point order, null last, take the weights in turn. What a held source cannot take goes to the others by
    weight until none is above its limit: with sources ordered by limit per weight, that is the first level which
    the next source can bear. One row a source, so the windows see the catalogue of sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("rank", F.row_number().over(by_name))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    held = F.coalesce(F.sum("source_size").over(fill), F.lit(0)) * most
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(share_percent) / 100 - held) / weights_left
    levels = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(every)
    even = F.coalesce(fits["level"] * F.col("weight"), F.lit(float("inf")))
    return levels.select(*sizes.columns, F.least(even, (most * F.col("source_size")).cast("double")).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_mix_size, _mix_source_size, _mix_target, _mix_copies``: how often the mix takes each row.

    Systematic sampling: each document of a source expects target / source size copies; documents stand in order of
    size, hash bucket and id, their expected copies are summed up, a random offset of the source is added, and a document is
    emitted once per integer boundary its own share crosses. Ordered by size, the sample has the source's mix
    of lengths, so its words come near the target. The position is the sum of three counts: of smaller sizes,
    of earlier buckets of the size, and within the bucket; so no task orders a whole source or a whole size.
    Null text: size 0. Null source: a source of its own, the last. Null id: an id like others. Rows that repeat an id are
    ordered by a hash of their text; equal rows may swap places, which changes no result.
    """
    bucket = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 3)
    name = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    cell = ["_mix_name", "_mix_size", "_mix_bucket"]
    rows = docs.withColumns({"_mix_name": name, "_mix_size": n_words(F.col(text)), "_mix_bucket": bucket, "_mix_id": F.col(id_col), "_mix_text": F.xxhash64(F.col(text))})
    cells = settled(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))
    steps = settled(cells.groupBy("_mix_name", "_mix_size").agg(F.sum("n").alias("n")))
    sums = steps.groupBy("_mix_name").agg(F.sum(F.col("n") * F.col("_mix_size")).alias("source_size"))
    sums = sums.withColumn("source", F.when(F.col("_mix_name") != "0", F.expr("substring(_mix_name, 2)")))
    targets = source_targets(sums, weights, share_percent, most)
    up_to = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    smaller = steps.select("_mix_name", "_mix_size", up_to(["_mix_name"], "_mix_size").alias("smaller"))
    earlier = cells.select(*cell, up_to(cell[:2], "_mix_bucket").alias("earlier"))
    starts = earlier.join(smaller, cell[:2]).join(targets.drop("source"), "_mix_name")
    starts = settled(starts.select(*cell, (F.col("smaller") + F.col("earlier")).alias("_mix_start"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("_mix_id", "_mix_text"))
    placed = rows.withColumn("_mix_place", place).join(starts, cell)
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|offset|"), F.col("_mix_name"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    position = F.col("_mix_start") + F.col("_mix_place")
    crossed = F.floor(position * rate + offset) - F.floor((position - 1) * rate + offset)
    out = placed.withColumn("_mix_copies", F.least(crossed, F.lit(most)).cast("long"))
    return out.select(*docs.columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, all columns as they were."""
    rows = with_copies(docs, id_col, text, source, **options).filter("_mix_copies > 0")
    each = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return each.select(*docs.columns)
