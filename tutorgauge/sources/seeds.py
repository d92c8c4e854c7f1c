"""Normalisers: public chat corpora to the seed schema, and their union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.hashing import coin, stable_id
from tutorgauge.functions.names import iso1_code, language_code
from tutorgauge.functions.text import merged_instruction, turn
from tutorgauge.operators.filters import japanese_api_call
from tutorgauge.operators.joins import settled
from tutorgauge.operators.ranking import first_by_hash, numbered
from tutorgauge.schemas import SEED_COLUMNS
from tutorgauge.sources.tables import union_all

BOTH, RESPOND, TRANSLATE = ["generate", "respond"], ["respond"], ["translate"]


def _seed(df: DataFrame, source: str, strategy: list[str], prompt: Column, response: Column, language: Column, source_id: Column) -> DataFrame:
    """Project to the seed schema; rows without a prompt or response turn are left out."""
    rows = df.select(
        F.lit(source).alias("source"),
        prompt.cast("string").alias("prompt"),
        response.cast("string").alias("response"),
        language.alias("language"),
        F.array(*[F.lit(s) for s in strategy]).alias("strategy"),
        source_id.cast("string").alias("source_id"),
    ).filter(F.col("prompt").isNotNull() & F.col("response").isNotNull())
    return rows.withColumn("id", stable_id("source", "source_id", "prompt", "response")).select(*SEED_COLUMNS)


def wildchat(raw: DataFrame, n: int, seed: int) -> DataFrame:
    """Sampled first, then cut to the known languages; Japanese title-lookup calls are left out."""
    kept = first_by_hash(raw, n, "conversation_hash", seed).filter(F.col("language").isin(*fv.LANGUAGE_CODES))
    rows = _seed(
        kept, fv.WILDCHAT, BOTH, turn(F.col("conversation"), 0, "content"), turn(F.col("conversation"), 1, "content"),
        language_code(F.col("language")), F.col("conversation_hash"),
    )
    return rows.filter(~japanese_api_call(F.col("language"), F.col("prompt")))


def gsm8k(raw: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    return _seed(raw, fv.GSM8K, TRANSLATE, F.col("question"), F.col("answer"), F.lit("en"), F.md5("question"))


def magpie(raw: DataFrame, n: int, seed: int) -> DataFrame:
    kept = first_by_hash(raw, n, "uuid", seed)
    talk = F.col("conversations")
    return _seed(kept, fv.MAGPIE, TRANSLATE, turn(talk, 0, "value"), turn(talk, 1, "value"), F.lit("en"), F.col("uuid"))


def helpsteer(raw: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """Multilingual rows with the preferred response; a tie is settled by a seeded coin."""
    names = [name.lower() for name in fv.LANGUAGE_CODES]
    kept = raw.filter((F.col("domain") == "multilingual") & F.col("language").isin(*names))
    prompt = turn(F.col("context"), 0, "content")
    tie = F.when(coin(seed, prompt, "response1", "response2") == 0, F.col("response1")).otherwise(F.col("response2"))
    p = F.col("overall_preference")
    liked = F.when(p < 0, F.col("response1")).when(p > 0, F.col("response2")).when(p == 0, tie)
    return _seed(kept, fv.HELPSTEER, BOTH, prompt, liked, language_code(F.initcap("language")), F.md5(prompt))


def oasst(raw: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    kept = raw.filter((F.col("role") == "prompter") & F.col("lang").isin(*fv.LANGUAGE_CODES.values()))
    return _seed(kept, fv.OASST, RESPOND, F.col("text"), F.lit(""), F.col("lang"), F.col("message_id"))


def euroblocks_rows(raw: DataFrame) -> DataFrame:
    """Known languages and no rows taken over from Magpie, with the hash of the conversation as ``_key``."""
    kept = raw.filter(F.col("language").isin(*fv.LANGUAGE_CODES) & ~F.col("dataset").contains("Magpie"))
    return kept.withColumn("_key", F.md5(F.to_json("conversations")))


def euroblocks(raw: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows that can be drawn, sampled, as seeds."""
    talk = F.col("conversations")
    kept = first_by_hash(euroblocks_rows(raw), n, "_key", seed)
    prompt = turn(talk, 0, "value")
    return _seed(kept, fv.EUROBLOCKS, BOTH, prompt, turn(talk, 1, "value"), language_code(F.col("language")), F.md5(prompt))


def aya(raw: DataFrame, n: int | None = None, seed: int = 42, codes: dict[str, str] = fv.LANGUAGE_CODES, prefix: str = "") -> DataFrame:
    kept = raw.withColumn("language", iso1_code(F.col("language"))).filter(F.col("language").isin(*codes.values()))
    return _seed(kept, fv.AYA, BOTH, F.col("inputs"), F.col("targets"), F.col("language"), F.concat(F.lit(prefix), F.col("id").cast("string")))


def multilingual_thinking(raw: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    kept = raw.filter(F.col("reasoning_language").isin(*fv.LANGUAGE_CODES))
    return _seed(kept, fv.MULTILINGUAL_THINKING, TRANSLATE, F.col("user"), F.col("final"), F.lit("en"), F.col("uuid"))


def tagalog(aya_raw: DataFrame, wildchat_raw: DataFrame, alpaca_raw: DataFrame) -> DataFrame:
    """The Tagalog extension: three sources with prefixed source ids, all marked ``tl``.

    ``wildchat_raw`` and ``alpaca_raw`` carry ``row_id``, the position of a row in its file.
    """
    talk = F.col("conversations")
    tl = F.lit("tl")
    chats = wildchat_raw.select(
        F.col("source"), turn(talk, 0, "value").alias("prompt"), turn(talk, 1, "value").alias("response"),
        F.concat(F.lit(fv.WILDCHAT_TAGALOG_PREFIX), F.col("row_id").cast("string")).alias("source_id"),
    ).filter(F.col("prompt").isNotNull() & F.col("response").isNotNull())
    chats = chats.withColumns(
        {"id": stable_id("source", "source_id", "prompt", "response"), "language": tl, "strategy": F.array(*[F.lit(s) for s in BOTH])}
    ).select(*SEED_COLUMNS)
    alpaca = _seed(
        alpaca_raw, fv.ALPACA_FILIPINO, BOTH, merged_instruction(F.col("instruction"), F.col("input")), F.col("output"), tl,
        F.concat(F.lit(fv.ALPACA_FILIPINO + "_"), F.col("row_id").cast("string")),
    )
    native = aya(aya_raw, codes=fv.TAGALOG_CODES, prefix=fv.AYA + "_").withColumn("language", tl)
    return union_all([chats, alpaca, native])


#: Sampled corpora: the rows that can be drawn, and the column whose hash orders them. Both are stateless, so they work on a stream.
SAMPLED: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    fv.WILDCHAT: (lambda raw: raw, "conversation_hash"),
    fv.MAGPIE: (lambda raw: raw, "uuid"),
    fv.EUROBLOCKS: (euroblocks_rows, "_key"),
}


def short_conversations(raw: DataFrame, column: str) -> DataFrame:
    """Conversations by number of turns, of those too short to give a prompt and a response."""
    turns = F.coalesce(F.size(column), F.lit(0))
    return raw.groupBy(turns.alias("turns")).agg(F.count(F.lit(1)).alias("n")).filter("turns < 2")


SOURCES: dict[str, Callable[..., DataFrame]] = {
    fv.WILDCHAT: wildchat,
    fv.GSM8K: gsm8k,
    fv.MAGPIE: magpie,
    fv.HELPSTEER: helpsteer,
    fv.OASST: oasst,
    fv.EUROBLOCKS: euroblocks,
    fv.AYA: aya,
}


def chosen_sources(names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """An include list wins over an exclude list."""
    if include:
        return [n for n in names if n in include]
    return [n for n in names if n not in (exclude or [])]


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur more than once; must be empty for a seed table."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def numbered_copies(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Gives equal rows ids of their own: the first copy keeps its id, the k-th gets one made of the id and k.

    The input is computed once. Only rows whose id repeats are shuffled, and the copies of one id are numbered in many tasks.
    """
    df = settled(df)
    again = settled(duplicate_ids(df, id_col).select(id_col))
    if again.isEmpty():
        return df
    copies = numbered(df.join(again, id_col, "left_semi"), [id_col], "_copy")
    own = F.when(F.col("_copy") == 1, F.col(id_col)).otherwise(F.md5(F.concat_ws("|", id_col, F.col("_copy").cast("string"))))
    return df.join(again, id_col, "left_anti").unionByName(copies.withColumn(id_col, own).drop("_copy"))


def check_unique_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    if not duplicate_ids(df, id_col).isEmpty():
        raise ValueError("ids are not unique")
    return df


def seed_table(raw: dict[str, DataFrame], n: int, seed: int = 42, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The chosen corpora in one table. ``check_unique_ids`` is the caller's next step."""
    return numbered_copies(union_all([SOURCES[name](raw[name], n, seed) for name in chosen_sources(list(raw), include, exclude)]))
