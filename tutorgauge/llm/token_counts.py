"""Token counts of sections by offset-mapped attribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tutorgauge.llm.tokens import worker_encoder

RULES = ("majority", "first", "proportional")


def line_sections(text: str | Column) -> Column:
    """Sizes in characters of the lines of a text, each with the line break that ends it."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.transform(F.split(t, "\n"), lambda x: (F.length(x) + 1).cast("long"))


def passage_sections(text: str, size: int) -> Column:
    """Sizes of passages of ``size`` characters; the last ends with the text, which has one passage at least."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return F.array_repeat(F.lit(size).cast("long"), F.greatest(F.ceil(n / size), F.lit(1)).cast("int"))


def field_sections(*fields: str) -> Column:
    """Sizes of columns within ``joined_fields`` of the same columns; a null field is empty."""
    return F.array(*[(F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))) + 1).cast("long") for f in fields])


def joined_fields(*fields: str) -> Column:
    """Columns as one text, a line break after each but the last; the break belongs to the field it ends."""
    return F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])


def attribute(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that each section gets, and how many tokens that touch it reach beyond it.

    Tokens and sections are character spans in order of their starts; sections do not overlap. A token touches the
    sections it shares characters with (without a character of its own, the one it stands in). ``majority`` gives it to
    the section that holds most of it, the earlier on a tie; ``first`` to the first it touches; ``proportional`` splits it
    by characters. Characters outside all sections count for none; a token that touches no section goes to none.
    """
    gets, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(tokens) or not len(starts):
        return gets, crossing
    a, b = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    # interval join of two sorted lists: the first and last section each token can touch
    low, high = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    n = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(a)), n)
    section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[token]
    shared = np.minimum(b[token], ends[section]) - np.maximum(a[token], starts[section])
    touching = shared > 0
    token, section, shared = token[touching], section[touching], shared[touching]
    np.add.at(crossing, section[shared < (b - a)[token]], 1)
    if rule == "proportional":
        whole = np.bincount(token, shared, minlength=len(a))
        np.add.at(gets, section, shared / whole[token])
        return gets, crossing
    rank = -shared if rule == "majority" else np.zeros_like(shared)
    order = np.lexsort((section, rank, token))
    chosen = order[np.unique(token[order], return_index=True)[1]]
    np.add.at(gets, section[chosen], 1)
    return gets, crossing


def section_tokens(docs: DataFrame, tokenizer: str, sections: str | Column, id_col: str = "doc_id", text: str = "text", rule: str = "majority") -> DataFrame:
    """Per document and section ``id, section, start, end, n_tokens, n_crossing``; ``n_tokens`` sums up to the tokens in sections.

    The whole text is encoded once and token spans are mapped to the sections: an array of ``struct<start, end>`` in
    characters, in order and without overlap, or an array of sizes of sections that follow one another and end with the text.
    A null text is empty: its sections have no tokens. Null or no sections give no row.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer, spans=True)
        for batch in batches:
            parts = []
            for doc, content, a, b in batch[["id", "text", "starts", "ends"]].itertuples(index=False):
                content = content or ""
                ends = np.asarray(b, np.int64)
                if a is None:
                    ends = np.minimum(np.cumsum(ends), len(content))
                starts = np.concatenate([[0], ends[:-1]]) if a is None else np.asarray(a, np.int64)
                gets, crossing = attribute(encoder.offsets(content), starts, ends, rule)
                parts.append((np.full(len(starts), doc, object), np.arange(len(starts)), starts, ends, gets, crossing))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[]] * 6
            yield pd.DataFrame(dict(zip(("id", "section", "start", "end", "n_tokens", "n_crossing"), columns)))

    kind = docs.schema[id_col].dataType.simpleString()
    at = sections if isinstance(sections, Column) else F.col(sections)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), at.alias("at")).filter("size(at) > 0")
    spans = isinstance(rows.schema["at"].dataType.elementType, StructType)
    starts, ends = (F.col("at.start"), F.col("at.end")) if spans else (F.lit(None).cast("array<long>"), F.col("at"))
    out = rows.select("id", "text", starts.alias("starts"), ends.alias("ends")).mapInPandas(encode, "id string, section int, start long, end long, n_tokens double, n_crossing long")
    return out.withColumn("id", F.col("id").cast(kind))
