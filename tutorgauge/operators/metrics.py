"""Intrinsic quality metrics of a teacher's data, by any key columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorgauge.functions.text import token_count, tokens
from tutorgauge.operators.filters import count_nan, mean_without_nan, require_columns
from tutorgauge.operators.joins import BROADCAST_BYTES, settled, sized, with_group_keys

HOT_SHARE = 1e-4
VOCABULARY_ROWS = 1_000_000


def _directed(embedding: str) -> Column:
    """Whether a vector has a direction: it is not all zeros and holds neither NaN nor infinity."""
    low, high = F.array_min(embedding), F.array_max(embedding)  # NaN counts as the largest value
    usable = (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0))
    return F.coalesce(usable, F.lit(False))


def vector_sums(df: DataFrame, by: list[str], embeddings: dict[str, str]) -> DataFrame:
    """Rows ``n`` per group and, per embedding, how many vectors have a direction and the sum of their unit vectors.

    Each task adds its vectors up and hands on one vector a group; such partial sums may be added again.
    Vectors without a direction add zeros; rows without an embedding are left out.
    """
    require_columns(df, *embeddings.values())
    rows = df.select(*by, *[F.col(c).cast("array<double>").alias(f"_a_{k}") for k, c in embeddings.items()])
    rows = rows.na.drop(subset=[f"_a_{k}" for k in embeddings])
    rows = rows.withColumns({f"_w_{k}": _directed(f"_a_{k}") for k in embeddings})
    plain = lambda k: F.when(F.col(f"_w_{k}"), F.col(f"_a_{k}")).otherwise(F.array_repeat(F.lit(0.0), F.size(f"_a_{k}")))
    rows = rows.select(*by, *[c for k in embeddings for c in (f"_w_{k}", array_to_vector(plain(k)).alias(f"_v_{k}"))])
    for k in embeddings:
        rows = Normalizer(p=2.0, inputCol=f"_v_{k}", outputCol=f"_u_{k}").transform(rows)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(f"_w_{k}").alias(f"directed_{k}") for k in embeddings],
        *[Summarizer.sum(F.col(f"_u_{k}")).alias(f"_s_{k}") for k in embeddings],
    )
    return sums.select(*by, "n", *[c for k in embeddings for c in (f"directed_{k}", vector_to_array(f"_s_{k}").alias(f"sum_{k}"))])


def distinct_ri_of_sums(sums: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``<name>_distinct_ri`` from vector sums; null below two rows."""
    n = F.col("n")
    length = lambda k: F.aggregate(f"sum_{k}", F.lit(0.0), lambda a, x: a + x * x)
    value = lambda k: F.when(n > 1, 1 - (length(k) - F.col(f"directed_{k}")) / (n * (n - 1.0)))
    return sums.select(*by, "n", *[value(k).alias(f"{k}_distinct_ri") for k in names])


def distinct_ri(df: DataFrame, by: list[str], embeddings: dict[str, str]) -> DataFrame:
    """``<name>_distinct_ri``: one minus the mean cosine between different rows of a group.

    The mean over all ordered pairs equals (|sum u|^2 - sum |u|^2) / (n (n - 1)) for unit vectors u,
    so one pass that adds vectors replaces the pair table. Vectors without a direction are similar to
    nothing and still count in n; fewer than two rows give null.
    """
    return distinct_ri_of_sums(vector_sums(df, by, embeddings), by, list(embeddings))


def perplexity_of_losses(losses: str | Column, prompt_length: str | Column, row_length: Column | None = None) -> Column:
    """exp of the mean loss of the response tokens; NaN where the response has none."""
    losses = F.col(losses) if isinstance(losses, str) else losses
    skip = F.col(prompt_length) if isinstance(prompt_length, str) else prompt_length
    size = row_length if row_length is not None else F.size(losses)
    n = F.greatest(size - skip, F.lit(0))
    total = F.aggregate(F.slice(losses, skip + 1, n), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, F.exp(total / n)).otherwise(F.lit(float("nan")))


def batch_perplexity(df: DataFrame, position: str, batch_size: int = 8, losses: str = "losses", prompt_length: str = "prompt_length") -> DataFrame:
    """The shared-loss variant: every row of a batch of neighbours gets the batch's mean token loss."""
    n = F.greatest(F.size(losses) - F.col(prompt_length), F.lit(0))
    total = F.aggregate(F.slice(losses, F.col(prompt_length) + 1, n), F.lit(0.0), lambda a, x: a + x)
    keyed = df.withColumns({"batch": F.floor(F.col(position) / batch_size), "_n": n, "_t": total})
    shared = keyed.groupBy("batch").agg(F.exp(F.try_divide(F.sum("_t"), F.sum("_n"))).alias("perplexity"))
    return keyed.drop("_n", "_t").join(shared, "batch", "left")


def perplexity_summary(df: DataFrame, by: list[str], perplexity: str = "perplexity") -> DataFrame:
    """Mean perplexity without NaN rows, and how many rows were left out."""
    p = F.col(perplexity)
    return df.groupBy(*by).agg(
        mean_without_nan(p).alias("average_perplexity"),
        F.count_if(p.isNotNull() & ~F.isnan(p)).alias("num_valid_samples"),
        count_nan(p).alias("num_nan_values"),
        F.count(F.lit(1)).alias("total_samples"),
    )


def unigram_perplexity(df: DataFrame, text: str, id_col: str, by: list[str], pieces: Callable[[Column], Column] = tokens, broadcast_rows: int = VOCABULARY_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Row perplexity under an add-one word model of the row's own group, for use without a language model.

    A null group is one like others. A vocabulary of no more than ``broadcast_rows`` words of ``broadcast_bytes`` in all goes to every task. Of a larger one only the
    words that hold at least 1/10,000 of all tokens do (there are at most 10,000), and a row's tokens are
    summed where they are read; the other words are shuffled to meet their losses, and none of those is hot.
    """
    named, groups = with_group_keys(df, by)
    got = _unigram_perplexity(named, text, id_col, groups, pieces, broadcast_rows, broadcast_bytes)
    return got.select(id_col, *[F.col(g)["v"].alias(c) for g, c in zip(groups, by)], "tokens", "perplexity")


def _unigram_perplexity(df: DataFrame, text: str, id_col: str, by: list[str], pieces: Callable, broadcast_rows: int, broadcast_bytes: int) -> DataFrame:
    keys = [*by, "word"]
    words = df.select(id_col, *by, F.explode(pieces(F.col(text))).alias("word"))
    counts = settled(words.groupBy(*keys).agg(F.count(F.lit(1)).alias("word_count")))  # the vocabulary, counted once
    sizes = counts.groupBy(*by).agg(F.sum("word_count").alias("_tokens"), F.count(F.lit(1)).alias("_types"))
    total = sizes.agg(F.sum("_tokens")).scalar()
    loss = -F.log((F.col("word_count") + 1) / (F.col("_tokens") + F.col("_types")))
    scored = counts.join(sized(sizes), by).withColumn("_nll", loss)
    part = lambda rows: rows.groupBy(id_col, *by).agg(F.sum("_nll").alias("_loss"), F.count(F.lit(1)).alias("tokens"))
    mean = lambda rows: rows.select(id_col, *by, "tokens", F.exp(F.col("_loss") / F.col("tokens")).alias("perplexity"))
    rows, size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if rows <= broadcast_rows and size <= broadcast_bytes:
        return mean(part(words.join(F.broadcast(scored.select(*keys, "_nll")), keys)))
    frequent = F.col("word_count") >= HOT_SHARE * total
    hot = F.broadcast(scored.filter(frequent).select(*keys, "_nll"))
    cold = scored.filter(~frequent).select(*keys, "_nll").hint("merge")
    near = part(words.join(hot, keys))
    far = part(words.join(hot, keys, "left_anti").join(cold, keys))
    rows = near.unionByName(far).groupBy(id_col, *by).agg(F.sum("_loss").alias("_loss"), F.sum("tokens").alias("tokens"))
    return mean(rows)


def with_judge_feedback(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``score``, ``feedback`` and ``valid`` from a judge's raw output, which is parsed once.

    Valid is one JSON object with an integer ``score`` from 1 to 5 and a text ``feedback``; any other
    output, and none at all, counts as score 1 with feedback ``Invalid output``.
    """
    # In brackets, text after the object becomes a second element or an error.
    parsed = df.withColumn("_json", F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit("]"))))
    at = lambda path, kind="variant": F.try_variant_get("_json", path, kind)
    fields = F.struct(
        F.schema_of_variant(at("$[0].score")).alias("score_kind"),
        F.schema_of_variant(at("$[0].feedback")).alias("feedback_kind"),
        at("$[0].score", "int").alias("score"),
        at("$[0].feedback", "string").alias("feedback"),
        at("$[1]").isNull().alias("alone"),
    )
    parsed = parsed.withColumn("_fields", fields)
    f = lambda name: F.col(f"_fields.{name}")
    valid = f("alone") & (f("score_kind") == "BIGINT") & f("score").between(1, 5) & (f("feedback_kind") == "STRING")
    parsed = parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return parsed.withColumns(
        {
            "score": F.when(F.col("valid"), f("score")).otherwise(F.lit(1)),
            "feedback": F.when(F.col("valid"), f("feedback")).otherwise(F.lit("Invalid output")),
        }
    ).drop("_json", "_fields")


def rubric_score(df: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Mean judge score, its distribution and the number of invalid outputs."""
    parsed = with_judge_feedback(df.select(*by, F.col(raw).alias("raw")))
    return parsed.groupBy(*by).agg(
        F.avg("score").alias("average_rubric_score"),
        *[F.count_if(F.col("score") == s).alias(f"score_{s}") for s in range(1, 6)],
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count(F.lit(1)).alias("n_judged"),
    )


def average_length(df: DataFrame, by: list[str], columns: dict[str, str] | None = None, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """Mean token count of prompts and of responses."""
    columns = columns or {"prompts": "prompt", "responses": "response"}
    require_columns(df, *columns.values())
    return df.groupBy(*by).agg(*[F.avg(count(F.col(c))).alias(f"{k}_average_length") for k, c in columns.items()])


def _distinct_ri_metric(df: DataFrame, by: list[str], prompts: str = "prompt_embedding", responses: str = "response_embedding") -> DataFrame:
    return distinct_ri(df, by, {"prompts": prompts, "responses": responses}).drop("n")


def _perplexity_metric(df: DataFrame, by: list[str], losses: str = "losses", prompt_length: str = "prompt_length") -> DataFrame:
    scored = df.withColumn("perplexity", perplexity_of_losses(losses, prompt_length))
    return perplexity_summary(scored, by).select(*by, "average_perplexity", "num_nan_values")


METRICS: dict[str, Callable[..., DataFrame]] = {
    "distinct_ri": _distinct_ri_metric,
    "length": average_length,
    "perplexity": _perplexity_metric,
    "reward_model": rubric_score,
}


BUILT_IN = dict(METRICS)  # those that are sums and can share a scan
UNREPORTED = ("num_valid_samples", "total_samples")


def register_metric(name: str, metric: Callable[..., DataFrame]) -> None:
    """Add a metric ``(df, by, **params) -> one row per group``."""
    METRICS[name] = metric


def requested_metrics(names: list[str]) -> list[str]:
    """Sorted names without repeats; ``all`` stands for every registered metric."""
    wanted = sorted(METRICS) if "all" in names else sorted(set(names))
    unknown = [n for n in wanted if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return wanted


def parse_metric_params(text: str | None) -> dict[str, dict]:
    """Job option ``metric::{json}|metric::{json}``."""
    if not text:
        return {}
    pairs = (item.split("::", 1) for item in text.split("|"))
    return {name: json.loads(params) for name, params in pairs}


def metric_table(df: DataFrame, by: list[str], names: list[str], params: dict[str, dict] | None = None) -> DataFrame:
    """The requested metrics side by side, one row per group.

    Metrics that are sums (``mergeable.STATISTICS``) share one scan and one aggregate; others run on their own and are joined.
    """
    from tutorgauge.operators import mergeable  # which builds on this module

    params, wanted = params or {}, requested_metrics(names)
    own = [n for n in wanted if METRICS[n] is not BUILT_IN.get(n)]
    shared = [mergeable.STATISTICS[n](**params.get(n, {})) for n in wanted if n not in own]
    parts = [METRICS[n](df, by, **params.get(n, {})) for n in own]
    if shared:
        parts.insert(0, mergeable.evaluated(df, by, shared).drop(*UNREPORTED))
    if len(parts) == 1:
        return parts[0]
    keyed = [with_group_keys(p, by)[0].drop(*by).withColumn("_key_all", F.lit(0)) for p in parts]
    keys = [*[f"_key_{c}" for c in by], "_key_all"]
    whole = reduce(lambda a, b: a.join(b, keys, "outer"), keyed)
    return whole.select(*[F.col(k)["v"].alias(c) for k, c in zip(keys, by)], *[c for c in whole.columns if c not in keys])


def metric_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    """A metric table in long form (keys, metric, value), the shape the metric store keeps."""
    metrics = [c for c in table.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return table.select(*keys, F.inline(pairs))


def upsert_metrics(old: DataFrame, new: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Add metrics to a store; a metric that is there stays unless ``overwrite``."""
    if overwrite:
        return old.join(new, keys, "left_anti").unionByName(new)
    return old.unionByName(new.join(old, keys, "left_anti"))
