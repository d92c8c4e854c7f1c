"""Requests for a teacher, and its answers joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions.hashing import coin, hash_number, seeded_hash
from tutorgauge.functions.text import chat_messages, fill, first_tokens, token_count, tokens, training_source
from tutorgauge.functions.names import lookup
from tutorgauge.operators.filters import require_columns
from tutorgauge.operators.joins import settled
from tutorgauge.operators.ranking import shuffled_index

EXAMPLES = 3


def in_context_examples(df: DataFrame, pool: DataFrame | None = None, id_col: str = "id", k: int = EXAMPLES, seed: int = 42) -> DataFrame:
    """(id, examples): for every row, k pool rows written as prompt and response.

    The pool gets dense positions in hash order; each row asks for k of them and an equi-join on the
    position answers, so the work is linear in rows. A row may draw itself. The pool is computed once.
    """
    own, pool = pool is None, settled((df if pool is None else pool).select(id_col, "prompt", "response"))
    df = pool if own else df
    indexed = shuffled_index(pool, id_col, seed)
    text = F.concat(F.lit("Prompt: "), F.coalesce("prompt", F.lit("None")), F.lit("\nResponse: "), F.coalesce("response", F.lit("None")))
    indexed = indexed.select("idx", text.alias("_text"))
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = df.select(id_col, size.alias("_n"))
    for j in range(k):
        left = F.greatest(F.col("_n") - j, F.lit(1))
        position = F.pmod(hash_number(seeded_hash(seed, F.col(id_col), F.lit(j))), left)
        asked = asked.withColumn("_p", position)
        if j:
            asked = asked.withColumn("_taken", F.array_sort(F.array(*[f"_d{i}" for i in range(j)])))
            for i in range(j):
                asked = asked.withColumn("_p", F.col("_p") + F.when(F.col("_p") >= F.get("_taken", F.lit(i)), 1).otherwise(0))
        asked = asked.withColumnRenamed("_p", f"_d{j}")
    draws = F.array(*[F.struct(F.lit(j).alias("k"), F.col(f"_d{j}").alias("idx")) for j in range(k)])
    asked = asked.select(id_col, F.inline(draws))
    found = asked.join(indexed, "idx").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("k", "_text"))).alias("_x"))
    return found.select(id_col, F.array_join(F.transform("_x", lambda e: e["_text"]), "\n\n").alias("examples"))


def generate_requests(df: DataFrame, lang_name: str, id_col: str = "id", seed: int = 42) -> DataFrame:
    require_columns(df, "prompt", "response")
    examples = in_context_examples(df, id_col=id_col, seed=seed)
    request = fill(fv.GENERATE_PROMPT, lang_name=lang_name, examples=F.col("examples"))
    return df.join(examples, id_col).withColumn("synth_prompt", request).drop("examples")


def translate_requests(df: DataFrame, lang_name: str, **_) -> DataFrame:
    require_columns(df, "prompt")
    return df.withColumn("synth_prompt", fill(fv.TRANSLATE_PROMPT, lang_name=lang_name, prompt=F.col("prompt")))


def respond_requests(df: DataFrame, lang_name: str, **_) -> DataFrame:
    require_columns(df, "prompt")
    return df.withColumn("synth_prompt", fill(fv.RESPOND_PROMPT, lang_name=lang_name, prompt=F.col("prompt")))


STRATEGIES = {"generate": generate_requests, "translate": translate_requests, "respond": respond_requests}


def requests(df: DataFrame, strategy: str, lang_name: str, **options) -> DataFrame:
    """``synth_prompt`` by strategy name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, lang_name, **options)


def system_prompt(lang_name: str) -> str:
    return fv.SYSTEM_PROMPT.format(lang_name=lang_name)


def rubric_request(lang_name: Column, instruction: Column, response: Column) -> Column:
    """The text a judge gets for one row."""
    levels = {f"score{i}_description": text for i, text in enumerate(fv.RUBRIC_LEVELS, 1)}
    rubric = fill(fv.RUBRIC_LAYOUT, criteria=fill(fv.RUBRIC_CRITERION, lang_name=lang_name), **levels)
    return fill(fv.RUBRIC_PROMPT, language=lang_name, instruction=instruction, response=response, rubric=rubric)


def within_budget(df: DataFrame, max_length: int, system: str, prompt: str = "synth_prompt", buffer: int = 500, count=token_count, flag: str | None = None) -> DataFrame:
    """Rows whose prompt, system prompt and buffer fit the model; ``flag`` marks instead of filtering."""
    fits = count(F.col(prompt)) + count(F.lit(system)) + F.lit(buffer) <= F.lit(max_length)
    return df.withColumn(flag, fits) if flag else df.filter(fits)


def collect_answers(inputs: DataFrame, answers: DataFrame, strategy: str, model: str, keep_inputs: bool = True) -> DataFrame:
    """Requests with their answers; input text moves to ``*_input`` columns or is dropped."""
    if keep_inputs:
        inputs = inputs.withColumnsRenamed({"prompt": "prompt_input", "response": "response_input"})
    else:
        inputs = inputs.drop("prompt", "response")
    inputs = inputs.withColumns({"strategy": F.lit(strategy), "model": F.lit(model)})
    joined = inputs.join(answers, "id", "left")
    return joined.withColumn("messages", chat_messages(F.col("prompt"), F.col("response")))


def answered(df: DataFrame) -> DataFrame:
    return df.filter(F.col("response").isNotNull())


def training_rows(df: DataFrame, max_length: int, pad_id: int | str = 0, source: str = "src_tokens", target: str = "dst_tokens") -> DataFrame:
    """Token row, loss mask (target only) and right padding; longer rows are left out."""
    size = F.size(source) + F.size(target)
    pad = F.greatest(F.lit(max_length) - size, F.lit(0))
    ids = F.concat(F.col(source), F.col(target))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(source)), F.array_repeat(F.lit(1), F.size(target)))
    kind = df.schema[source].dataType.elementType
    return df.filter(size <= max_length).withColumns(
        {
            "input_tokens": F.concat(ids, F.array_repeat(F.lit(pad_id).cast(kind), pad)),
            "input_mask": F.concat(mask, F.array_repeat(F.lit(0), pad)),
        }
    )


def source_and_target_tokens(df: DataFrame, encode=tokens) -> DataFrame:
    """Tokens of the marked-up prompt and of the response, by a pluggable token column."""
    return df.withColumns({"src_tokens": encode(training_source(F.col("prompt"))), "dst_tokens": encode(F.col("response"))})


def choice_rows(df: DataFrame, question: str = "question", answer: str = "answer", options: tuple[str, ...] = ("option_a", "option_b", "option_c", "option_d")) -> DataFrame:
    """Multiple-choice rows: choices in order and the index of the answer letter."""
    return df.withColumns({"choices": F.array(*options), "gold_idx": F.ascii(answer) - 65, "query": F.col(question)})


def number_prompt(question: Column, language: Column, answer: Column) -> dict[str, Column]:
    """Math question with the number-only instruction of its language (English where none exists)."""
    told = F.coalesce(lookup(language, fv.NUMBER_INSTRUCTIONS), F.lit(fv.NUMBER_INSTRUCTIONS["en"]))
    return {"query": F.concat(question, F.lit("\n\n"), told, F.lit("\nAnswer:")), "gold": answer.cast("string")}


def preference_rows(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Judge question with chosen and rejected in random order, and where the chosen one stands."""
    gold = coin(seed, id_col)
    return df.withColumns(
        {
            "query": fill(fv.JUDGE_PROMPT, language=F.col("language"), question=F.col("prompt")),
            "gold_idx": gold,
            "choices": F.when(gold == 0, F.array("chosen", "rejected")).otherwise(F.array("rejected", "chosen")),
            "source": F.coalesce("source", F.lit("Unknown")),
        }
    )


def truncated(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, first_tokens(F.col(column), n))
