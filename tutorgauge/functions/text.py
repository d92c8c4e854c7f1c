"""Text building and token columns."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tutorgauge import fixed_values as fv


def fill(template: str, **values: Column | str) -> Column:
    """Put values into ``{name}`` marks. Marks inside the values stay as they are."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                pieces.append(F.lit(piece))
        else:
            value = values[piece]
            pieces.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("None")))
    return F.concat(*pieces)


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(r"\S+"))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.array_remove(F.split(text, r"\s+"), "")


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Arrow-batched token count with a caller's tokenizer, for use in place of ``token_count``."""

    @F.pandas_udf(IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else int(count(t))).astype("Int32")

    return counted


def first_tokens(text: Column, n: int) -> Column:
    """The first n tokens; a text with no more than n stays untouched."""
    return F.when(token_count(text) > n, F.array_join(F.slice(tokens(text), 1, n), " ")).otherwise(text)


def merged_instruction(instruction: Column, extra: Column) -> Column:
    """Instruction followed by its input, where the input is not empty or the text ``nan``."""
    missing = extra.isNull() | (F.lower(F.trim(extra)) == "nan")
    return F.when(missing, instruction).otherwise(F.concat(instruction, F.lit("\n\n"), extra))


def turn(conversation: Column, i: int, field: str) -> Column:
    """Field of the i-th turn, null where the conversation is shorter."""
    return F.get(conversation, F.lit(i)).getField(field)


def chat_messages(prompt: Column, response: Column) -> Column:
    """The two-turn message list of a training row."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("user", prompt), message("assistant", response))


def chat_text(messages: Column, start: str = "") -> Column:
    """Messages written out with turn markup, after an optional start mark."""
    role = lambda m: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in fv.GEMMA_ROLE_NAMES.items() for x in kv]), m["role"]),
        m["role"],
    )
    piece = lambda m: F.concat(F.lit("<start_of_turn>"), role(m), F.lit("\n"), F.trim(m["content"]), F.lit("<end_of_turn>\n"))
    return F.concat(F.lit(start), F.array_join(F.transform(messages, piece), ""))


def training_source(prompt: Column) -> Column:
    """Prompt between the fixed turn prefix and suffix."""
    return F.concat(F.lit(fv.GEMMA_TURN_PREFIX), prompt, F.lit(fv.GEMMA_TURN_SUFFIX))


def human_time(seconds: Column) -> Column:
    """Seconds as ``HHhMMmSSs``."""
    whole = F.floor(seconds)
    return F.format_string("%02dh%02dm%02ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def run_stamp(ts: Column) -> Column:
    """Timestamp as the text used in run names."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def metric_params(column: Column) -> Column:
    """``metric::{json}|metric::{json}`` as a map from metric to its JSON text."""
    item = lambda x: F.struct(F.get(F.split(x, "::", 2), F.lit(0)).alias("key"), F.get(F.split(x, "::", 2), F.lit(1)).alias("value"))
    return F.map_from_entries(F.transform(F.split(column, r"\|"), item))


def stars(p: Column) -> Column:
    """Significance mark: ** below .01, * below .05."""
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def marked_rho(rho: Column, p: Column, diagonal: Column) -> Column:
    """Correlation to two digits with its mark; none on the diagonal, empty where undefined."""
    text = F.format_string("%.2f", rho)
    return (
        F.when(rho.isNull() | p.isNull(), "")
        .when(diagonal, text)
        .otherwise(F.concat(text, stars(p)))
    )


def p_text(p: Column) -> Column:
    """p-value as the text of a figure."""
    return (
        F.when(p < 0.001, "p < 0.001")
        .when(p < 0.01, "p < 0.01")
        .when(p < 0.05, "p < 0.05")
        .otherwise(F.format_string("p = %.3f", p))
    )
