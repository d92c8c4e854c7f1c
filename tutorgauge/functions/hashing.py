"""Seeded, repeatable draws. A retried task draws the same rows, which a random generator would not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int, *columns) -> Column:
    """md5 over ``seed|column|column``: the order key of every shuffle and sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]))


def hash_number(hash_column: Column) -> Column:
    """The first 60 bits of an md5 as a non-negative bigint."""
    return F.conv(F.substring(hash_column, 1, 15), 16, 10).cast("bigint")


def coin(seed: int, *columns) -> Column:
    """0 or 1 with equal chance, fixed by seed and columns."""
    return F.pmod(hash_number(seeded_hash(seed, *columns)), F.lit(2)).cast("int")


def stable_id(*columns) -> Column:
    """Surrogate id from content, so a rebuilt table carries the same ids; lengths tell nulls and separators apart."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.length(of(c)).cast("string"), F.lit(":"), of(c)), F.lit("-")) for c in columns]))
