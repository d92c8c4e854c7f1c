"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded difference between two of them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
GAPS = ((1, 2), (2, 5), (3, 9))  # the second and third byte of a triplet, counted from the first
ROWS_PER_RANGE = 500
MOST_RANGES = 20_000
_FACTORS = (2654435761, 2246822519, 3266489917)
_STEP = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets of the text hash to each bucket; read in steps, so memory does not grow with the text."""
    counts = np.zeros(BUCKETS, np.int64)
    reach = max(b for _, b in GAPS)
    for at in range(0, len(data), _STEP):
        part = np.frombuffer(data, np.uint8, min(_STEP + reach, len(data) - at), at).astype(np.uint32)
        for kind, (i, j) in enumerate(GAPS):
            n = min(_STEP, len(part) - j)
            if n > 0:
                mixed = part[:n] * np.uint32(_FACTORS[0]) + part[i : i + n] * np.uint32(_FACTORS[1]) + part[j : j + n] * np.uint32(_FACTORS[2]) + np.uint32(kind)
                mixed ^= mixed >> np.uint32(15)
                counts += np.bincount((mixed * np.uint32(_FACTORS[0])) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """130 hex digits: two for the length on a log scale, then two bits a bucket, its quarter among the bucket counts."""
    counts = bucket_counts(data)
    length = min(255, round(8 * math.log2(1 + len(data)))) if data else 0
    quarters = np.searchsorted(np.quantile(counts, (0.25, 0.5, 0.75), method="lower"), counts, side="left").astype(np.uint8)
    codes = quarters.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{length:02x}" + codes.astype(np.uint8).tobytes().hex()


def _opened(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[0]), (raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).astype(np.int64).ravel()


def difference(a: str, b: str) -> float:
    """From 0 for equal digests to 1: squared steps between bucket quarters, against what unrelated texts show on average, and
    the length difference, at most a tenth of the whole."""
    if a == b:
        return 0.0
    (len_a, qa), (len_b, qb) = _opened(a), _opened(b)
    steps = float(((qa - qb) ** 2).mean()) / 2.5  # two independent draws of 0..3 differ by 2.5 squared steps on average
    return min(1.0, 0.9 * min(1.0, steps) + 0.1 * min(1.0, abs(len_a - len_b) / 16))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b)


def fingerprint(text: str | Column) -> Column:
    """Digest of the UTF-8 bytes of a column; null as empty."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([digest(t or b"") for t in texts], dtype=object)

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def compared(a: Column, b: Column) -> Column:
    """Likeness of two digest columns, from 0 to 1; null if either is."""

    @F.pandas_udf("double")
    def of(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(first, second)], dtype=float)

    return of(a, b)


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def beside_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; ids are integers.

    The next document is that of the next id; after the last comes the first. Ids are cut into ranges of about
    ``rows_per_range`` rows, or of more where there would be over ``MOST_RANGES`` (the driver and every task know the ranges), and the first row of each range is also sent to the end of the range before, so a
    range is a sorted run that knows its follower, and the text is shuffled once. The edited text has its last quarter
    (rounded down, in code points) replaced by the start of the next text. Null texts are empty, rows that repeat an id stand in
    order of a hash of their text, null ids come first; a single row is its own next one.
    """
    least = -(1 << 63)  # stands for a null id: a column with nulls would reach Python as floats
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).withColumn("tie", F.xxhash64("data"))
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, n // rows_per_range))
    shares = [i / ranges for i in range(1, ranges)]
    # cut points and first rows: a few numbers for each of a bounded number of ranges
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx("id", shares, 10 * ranges)).first()[0] or [])) if shares else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids, side="right").astype("int32"))

    placed = rows.withColumn("range", range_of("id"))
    firsts = placed.groupBy("range").agg(F.min(F.struct("id", "tie")).alias("f")).select("range", "f.id", "f.tie").orderBy("range").collect()
    before = {r.range: firsts[i - 1].range for i, r in enumerate(firsts)}
    first = {r.range: (r.id, r.tie) for r in firsts}

    @F.pandas_udf("array<struct<target:int,tail:boolean>>")
    def targets(ranges: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for r, i, t in zip(ranges, ids, ties):
            at = [{"target": r, "tail": False}]
            if first[r] == (i, t):
                at.append({"target": before[r], "tail": True})
            out.append(at)
        return pd.Series(out)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for target, tail, i, data in zip(batch["target"], batch["tail"], batch["id"], batch["data"]):
                content = data.decode("utf-8", "replace")
                mark = digest(data)
                if held and held[0] == target:
                    _, of, own, own_mark = held
                    quarter = len(own) // 4
                    edited = (own[: len(own) - quarter] + content[:quarter]).encode()
                    edited_mark = digest(edited)
                    out.append((of, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                held = None if tail else (target, i, content, mark)
            yield pd.DataFrame(out, columns=["id", *[c.split()[0] for c in _OUT.split(", ")]])

    sent = placed.withColumn("to", F.explode(targets("range", "id", "tie"))).select("to.target", "to.tail", "id", "tie", "data")
    runs = sent.repartition(-(-ranges // 4), "target").sortWithinPartitions("target", "tail", "id", "tie")
    return runs.mapInPandas(follow, f"id long, {_OUT}").withColumn("id", F.nullif("id", F.lit(least)))
