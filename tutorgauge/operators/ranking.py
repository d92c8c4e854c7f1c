"""Order-based operators that never sort a whole table, or a whole group, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tutorgauge.functions.hashing import seeded_hash
from tutorgauge.operators.joins import released, settled, sized, with_group_keys

_H, _B = "_hash", "_bucket"
_TO_HERE = Window.unboundedPreceding, Window.currentRow


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds the md5 order key and its first four hex digits: 65,536 even buckets in hash order."""
    h = seeded_hash(seed, id_col)
    return df.withColumn(_H, h).withColumn(_B, F.substring(h, 1, 4))


def hash_cutoffs(df: DataFrame, quotas: DataFrame, by: list[str], id_col: str, seed: int) -> DataFrame:
    """Per group, the hash of the quota-th row in hash order as ``_cut``, with ``quota`` and ``_total``.

    Rows are first counted by bucket (combined map-side, at most 65,536 rows a group). Only the one
    bucket in which the quota runs out is sorted, so a hot group costs no more than a small one.
    ``quotas`` has the group columns and ``quota``. A repeated id at the cut is an error, since the
    sample could then not have its exact size.
    """
    keys = _hashed(df.select(*by, id_col), id_col, seed)
    run = Window.partitionBy(*by).orderBy(_B).rowsBetween(*_TO_HERE)
    sizes = (
        keys.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    )
    edges = (
        sizes.join(quotas, by)
        .groupBy(*by, "quota")
        .agg(
            F.sum("_n").alias("_total"),
            F.max(F.when(F.col("_before") < F.col("quota"), F.struct("_before", _B))).alias("_edge"),
        )
    )
    edges = sized(edges.select(*by, "quota", "_total", F.col("_edge._before").alias("_before"), F.col(f"_edge.{_B}").alias("_edge")))
    in_bucket = Window.partitionBy(*by).orderBy(_H).rowsBetween(*_TO_HERE)
    need = F.col("quota") - F.col("_before")
    repeated = F.raise_error(F.lit("ids repeat within a group: no sample of exact size")).cast("string")
    marks = (
        keys.join(edges.filter("_total > quota and quota > 0"), by)
        .filter(F.col(_B) == F.col("_edge"))
        .groupBy(*by, "quota", "_before", _H).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_up_to", F.sum("_copies").over(in_bucket))
        .filter((F.col("_up_to") >= need) & (F.col("_up_to") - F.col("_copies") < need))
        .select(*by, F.when(F.col("_up_to") == need, F.col(_H)).otherwise(repeated).alias("_cut"))
    )
    return edges.select(*by, "quota", "_total").join(marks, by, "left")


def take_by_hash(df: DataFrame, quotas: DataFrame, by: list[str], id_col: str = "id", seed: int = 42, flag: str | None = None) -> DataFrame:
    """The first ``quota`` rows of each group in hash order: a seeded sample of exact size.

    With ``flag`` all rows stay and a boolean column marks the sampled ones. The payload columns are
    read once and are not shuffled: the last step is a filter against one cutoff per group.
    """
    cuts = sized(hash_cutoffs(df, quotas, by, id_col, seed))
    kept = F.coalesce((F.col("quota") >= F.col("_total")) | (seeded_hash(seed, id_col) <= F.col("_cut")), F.lit(False))
    out = df.join(cuts, by, "left" if flag else "inner")
    out = out.withColumn(flag, kept) if flag else out.filter(kept)
    return out.drop("quota", "_total", "_cut")


def first_by_hash(df: DataFrame, n: int | None = None, id_col: str = "id", seed: int = 42, share: float | None = None, flag: str | None = None) -> DataFrame:
    """Seeded shuffle, then the first n rows (or ``floor(share * rows)``), capped at the table.

    Two narrow aggregates over the id column find the cutoff hash; the result is then a plain filter,
    with no sort and no shuffle of the payload. Rows with the same id hash alike: where such copies
    straddle the cut, as many of them are taken as still fit.
    """
    keys = _hashed(df.select(id_col), id_col, seed)
    sizes = keys.groupBy(_B).agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,536 rows, whatever the table: one task is enough for the running total.
    run = sizes.withColumn("_up_to", F.sum("_n").over(Window.orderBy(_B).rowsBetween(*_TO_HERE)))
    run = run.withColumn("_quota", F.lit(n) if n is not None else F.floor(F.lit(float(share)) * F.sum("_n").over(Window.partitionBy())))
    edge = run.filter("_up_to - _n < _quota").agg(
        F.max(F.struct(F.col(_B).alias("bucket"), (F.col("_up_to") - F.col("_n")).alias("before"), "_up_to", "_quota")).alias("e")
    ).select("e.*").first()
    if edge.bucket is None:
        return df.withColumn(flag, F.lit(False)) if flag else df.limit(0)
    if edge._up_to <= edge._quota:
        # The quota ends with this bucket: "g" sorts after every hex digit.
        kept, straddling = seeded_hash(seed, id_col) < edge.bucket + "g", 0
    else:
        need = edge._quota - edge.before
        spot = Window.orderBy(_H).rowsBetween(*_TO_HERE)
        mark = (
            keys.filter(F.col(_B) == edge.bucket)
            .groupBy(_H).agg(F.count(F.lit(1)).alias("_copies"))
            .withColumn("_up_to", F.sum("_copies").over(spot))
            .filter(F.col("_up_to") - F.col("_copies") < need)
            .agg(F.max(F.struct(F.col(_H).alias("cut"), "_copies", "_up_to")).alias("m"))
            .select("m.*").first()
        )
        cut = mark.cut
        straddling = need - (mark._up_to - mark._copies) if mark._up_to > need else 0
        kept = seeded_hash(seed, id_col) < cut if straddling else seeded_hash(seed, id_col) <= cut
    kept = F.coalesce(kept, F.lit(False))
    if flag:
        if straddling:
            raise ValueError("ids repeat: no split of exact size")
        return df.withColumn(flag, kept)
    taken = df.filter(kept)
    return taken.unionByName(df.filter(seeded_hash(seed, id_col) == cut).limit(straddling)) if straddling else taken


def shuffled_index(df: DataFrame, id_col: str = "id", seed: int = 42, index: str = "idx") -> DataFrame:
    """Dense positions 0..n-1 in hash order, numbered bucket by bucket in parallel."""
    keyed = _hashed(df, id_col, seed)
    sizes = _hashed(df.select(id_col), id_col, seed).groupBy(_B).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.orderBy(_B).rowsBetween(*_TO_HERE)
    starts = sizes.select(_B, (F.sum("_n").over(run) - F.col("_n")).alias("_start"))
    spot = Window.partitionBy(_B).orderBy(_H, id_col)
    return (
        keyed.join(F.broadcast(starts), _B)  # at most 65,536 buckets exist
        .withColumn(index, F.col("_start") + F.row_number().over(spot) - 1)
        .drop(_H, _B, "_start")
    )


PIECE_ROWS = 200_000  # distinct values that are ordered in one task


def cumulative_counts(df: DataFrame, value: str, by: list[str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Distinct (group, value) with ``_c`` rows of that value, ``_end`` rows up to it and ``_n`` rows in the group; null and NaN are left out.

    The input is read once: copies of a value are counted and the counts settled. If a group has more than ``piece_rows`` distinct values, they are dealt to
    ranges of (group, value), so a large group lies in many of them. Each range is ordered apart; its start is the sum of what lies before it in its group.
    """
    by = list(by or [])
    keys = [f"_by_{i}" for i in range(len(by))]
    spot = F.col(value)
    seen = df.filter(spot.isNotNull() & ~F.isnan(spot.cast("double"))).select(*[F.struct(F.col(c).alias("v")).alias(k) for c, k in zip(by, keys)], spot.alias("_value"))
    counts = settled(seen.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_c")))
    largest = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    out = lambda rows: rows.select(*[F.col(k)["v"].alias(c) for c, k in zip(by, keys)], F.col("_value").alias(value), "_c", "_end", "_n")
    if (largest["most"] or 0) <= piece_rows:  # groups are ordered apart as they are
        whole = Window.partitionBy(*keys)
        run = whole.orderBy("_value").rowsBetween(*_TO_HERE)
        return out(counts.withColumns({"_end": F.sum("_c").over(run), "_n": F.sum("_c").over(whole)}))
    placed = settled(counts.repartitionByRange(-(-largest["all"] // piece_rows), *keys, "_value").withColumn("_piece", F.spark_partition_id()))
    released(counts)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy(*keys, "_piece").agg(F.sum("_c").alias("_rows"))
    pieces = pieces.select(*keys, "_piece", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"), F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"))
    within = Window.partitionBy(*keys, "_piece").orderBy("_value").rowsBetween(*_TO_HERE)
    met = placed.withColumn("_here", F.sum("_c").over(within)).join(sized(pieces), [*keys, "_piece"])
    return out(met.withColumn("_end", F.col("_start") + F.col("_here")))


def average_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Distinct (group, value) with its 1-based rank, ties averaged; null and NaN values get none."""
    counted = cumulative_counts(df, value, by, piece_rows)
    return counted.select(*(by or []), value, (F.col("_end") - (F.col("_c") - 1) / 2).alias(out or f"{value}_rank"))


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group with ``n`` and the array ``q``.

    Read off the cumulative counts, so no task holds all values of a group and the input is read once.
    """
    by = list(by or [])
    counted = cumulative_counts(df, value, by, piece_rows).withColumnRenamed("_n", "n")
    at = lambda position: F.min(F.when(F.col("_end") > position, F.col(value)))
    spots = [(F.col("n") - 1) * F.lit(float(p)) for p in probabilities]
    aggs = [a for i, s in enumerate(spots) for a in (at(F.floor(s)).alias(f"_lo{i}"), at(F.ceil(s)).alias(f"_hi{i}"))]
    ends = counted.groupBy(*by, "n").agg(*aggs)
    part = lambda i, s: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (s - F.floor(s))
    return ends.select(*by, "n", F.array(*[part(i, s) for i, s in enumerate(spots)]).alias("q"))


RUN_BITS = 17  # rows numbered together: runs of 131,072 rows as they lie in their partitions


def numbered(df: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """Numbers the rows of each group from 1, whatever the size of a group.

    Rows are written once with their place; a group is numbered run by run (the runs of a hot group lie in many
    tasks), and the rows of a group's earlier runs are added. Null keys form groups like others. The order is the
    one in which the rows lay when written, so only rows that may swap places should share a group.
    """
    place, run, ahead = "_place", "_run", "_ahead"
    rows = settled(df.withColumn(place, F.monotonically_increasing_id())).withColumn(run, F.shiftright(place, RUN_BITS))
    rows, keys = with_group_keys(rows, by)
    earlier = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("_n"))
    runs = settled(runs.select(*keys, run, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(ahead)))
    here = F.row_number().over(Window.partitionBy(*keys, run).orderBy(place))
    return rows.withColumn(number, here).join(runs, [*keys, run]).select(*df.columns, (F.col(ahead) + F.col(number)).alias(number))


def top_per_group(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group. Spark cuts each partition to n rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
