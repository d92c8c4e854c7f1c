"""Shards that each hold the mixture of the whole: seeded shuffle within source, fractional ranks, even cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge.operators.joins import released, settled
from tutorgauge.operators.ranking import numbered

SHARDS = 24
SEED = 42
BUCKETS = 4096  # three hex digits: cells of a source in shuffled order
GRID = 4096  # cells of the fractional ranks
ROWS_PER_FILE = 100_000
_PRE = "_shard_"
_TO_HERE = Window.unboundedPreceding, Window.currentRow


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _fraction(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def shuffle_hash(id_col: str | Column = "doc_id", text: str | Column = "text", seed: int = SEED) -> Column:
    """Place of a row in the seeded shuffle: a hash of its id and text; only rows equal in both share it. Nulls count as empty."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _text(col(id_col)), F.md5(_text(col(text)))))


def interleaved(rows: DataFrame, source: str, order: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: rows per shard at most one apart, and every shard with the mixture of sources.

    Rows of a source stand by ``order``, a text hash; the r-th of n gets the fractional rank (r - u) / n, with u in [0, 1) fixed per
    source, so that sources of few rows spread over all shards as well. All rows are sorted by fractional rank
    and cut into even runs: row p of N goes to shard floor(p * shards / N). A cut lies within
    S / N of its even fractional rank, S being the number of sources, so a source of n rows has n / shards rows in a shard, give
    or take 2 + 2 S n / N.

    No task orders a source or the table. Ranks come from counts: of earlier buckets of the source, of smaller hashes in the
    bucket (equal hashes counted first, so a group of equal rows is one entry) and of earlier copies (numbered run by run);
    places from counts of earlier grid cells and the order within one. Rows are written once with their hash and read from there.

    A null source is a source of its own. Rows that share ``order`` may swap places; the shards of all other rows do not
    depend on how the input is cut into files. No rows give no rows. Input columns of any name but ``shard`` and ``slot``,
    which are replaced, are passed on.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    name, h, start, copy, n, f, cell = (_PRE + x for x in ("name", "hash", "start", "copy", "n", "rank", "cell"))
    packed = rows.select(F.struct(*kept).alias(_PRE + "row"), F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string"))).alias(name), F.col(order).alias(h))
    packed = settled(packed)
    hashes = settled(packed.groupBy(name, h).agg(F.count(F.lit(1)).alias("copies")))
    bucket = F.substring(h, 1, len(f"{BUCKETS - 1:x}"))
    cells = hashes.groupBy(name, bucket.alias("bucket")).agg(F.sum("copies").alias("n"))
    upto = lambda by, *by_order: F.sum("n").over(Window.partitionBy(*by).orderBy(*by_order).rowsBetween(*_TO_HERE)) - F.col("n")
    sizes = cells.groupBy(name).agg(F.sum("n").alias(n))
    starts = settled(cells.withColumn("before", upto([name], "bucket")).join(sizes, name).select(name, "bucket", "before", n))
    within = hashes.withColumn("bucket", bucket).withColumnRenamed("copies", "n")
    within = within.withColumn("inside", upto([name, "bucket"], h)).join(starts, [name, "bucket"])
    bases = settled(within.select(name, h, (F.col("before") + F.col("inside")).alias(start), F.col(n), (F.col("n") > 1).alias("many")))
    placed = packed.join(bases, [name, h])
    single = placed.filter("NOT many").withColumn(copy, F.lit(1).cast("long"))
    copies = numbered(placed.filter("many"), [name, h], copy)
    offset = _fraction(F.concat(F.lit(f"{seed}|offset|"), F.col(name)))
    r = F.col(start) + F.col(copy)
    ranked = single.unionByName(copies.select(*single.columns)).withColumn(_PRE + "r", r).withColumn(f, (r - offset) / F.col(n))
    ranked = settled(ranked.withColumn(cell, F.floor(F.col(f) * GRID)).select(_PRE + "row", name, _PRE + "r", f, cell))
    grid = ranked.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))  # at most GRID rows, whatever the table
    grid = settled(grid.select(cell, upto([], cell).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")))
    p = F.col("before") + F.row_number().over(Window.partitionBy(cell).orderBy(f, name, _PRE + "r")) - 1
    out = ranked.join(F.broadcast(grid), cell).withColumn("p", p)
    out = out.withColumn("shard", F.expr(f"cast((p * {shards}) div total as int)")).withColumn("slot", F.col("p") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
    out = settled(out.select(_PRE + "row", "shard", "slot"))
    released(packed, hashes, starts, bases, ranked, grid)
    return out.select(f"{_PRE}row.*", "shard", "slot")


def sharded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` by ``interleaved``; rows are shuffled by seed, id and text. See there for nulls, ties and names."""
    keyed = docs.withColumn(_PRE + "order", shuffle_hash(id_col, text, seed))
    return interleaved(keyed, source, _PRE + "order", shards, seed).drop(_PRE + "order")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder ``shard=…`` per shard with its rows in order of ``slot``; a shard larger than a task's share takes several files."""
    rows = sharded(docs, **options)
    runs = F.floor(F.col("slot") / ROWS_PER_FILE)
    rows.withColumn(_PRE + "file", runs).repartition("shard", _PRE + "file").sortWithinPartitions("shard", "slot").drop(_PRE + "file").write.partitionBy("shard").parquet(path)
