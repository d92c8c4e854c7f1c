"""Name parsers and text columns on odd input."""

import pytest
from pyspark.sql import functions as F

from tutorgauge import fixed_values as fv
from tutorgauge.functions import names, text
from tutorgauge.operators import synthesis


def rows(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    made = build(F.col("x"))
    return [tuple(r) for r in df.select(*[c.alias(k) for k, c in made.items()]).collect()]


def test_eval_name(spark):
    got = rows(spark, ["mgsm_custom:de|5", "custom|mgsm_custom:de|5", "all", "a:b:c|1", None], names.eval_name)
    assert got == [("mgsm_custom", "de", 5), ("mgsm_custom", "de", 5), (None,) * 3, (None,) * 3, (None,) * 3]


@pytest.mark.parametrize(
    "name, want",
    [
        ("me/details_sft-allenai_Olmo-3-1025-7B-lora-4bit-sft-S1-es_Llama-3_1-8B-Instruct", ("allenai/Olmo-3-1025-7B", "Llama-3.1-8B-Instruct", True, True, "es")),
        # Suffixes go in list order, each once: ".translate" goes before ".translate.ablation" is looked for.
        ("me/details_sft-a_b_c-sft-S1-ar_gemma-3-4b-it_translate_sz10k", ("a/b_c", "gemma-3-4b-it.translate", False, False, "ar")),
        ("me/details_sft-a_b-sft-S1-ar_gemma_translate_ablation", ("a/b", "gemma", False, False, "ar")),
        ("me/details_sft-a_b-sft-S1-ar_gemma_sz50k_generate", ("a/b", "gemma", False, False, "ar")),
        ("me/details_sft-plain-8bit-sft-S1-ar", ("plain-8bit", "", False, True, "ar")),
        ("me/details_sft-a_b-LoRA-x-sft-S1-de_t", ("a/b", "t", True, False, "de")),
        ("no such name", (None,) * 5),
    ],
)
def test_run_name(spark, name, want):
    assert rows(spark, [name], lambda c: names.run_name(c, "sft")) == [want]


def test_metric_file_names(spark):
    stem = "sft-S1-ar_mistralai__Mistral-Small-24B-Instruct-2501_intrinsic_metrics"
    assert rows(spark, [stem], lambda c: names.metric_file_name(c, "sft")) == [("ar", "mistralai/Mistral-Small-24B-Instruct-2501")]
    got = rows(spark, [stem, "sft-S1-de_cohere-command-a_intrinsic_metrics", "too_short", "a_b_c"], names.metric_file_name_short)
    assert got == [("ar", "Mistral-Small-24B-Instruct-2501"), ("de", "cohere-command-a"), (None, None), ("a", "")]


def test_base_model_of_branch(spark):
    got = rows(spark, ["x-Olmo-3-1025-7B-de"], names.base_model_of_branch)
    assert got == [("allenai/OLMo-3-1025-7B", "apache-2.0")]
    with pytest.raises(Exception, match="no base model"):
        rows(spark, ["mystery"], names.base_model_of_branch)


def test_display_name_of_unknown_code(spark):
    with pytest.raises(Exception, match="Unknown language"):
        rows(spark, ["xx"], lambda c: {"n": names.display_name(c)})


def test_fill_keeps_marks_inside_values(spark):
    got = rows(spark, ["100% {prompt} {lang_name} $1 \\1 |", None], lambda c: {"t": text.fill("<{lang_name}> {prompt}!", lang_name="Czech", prompt=c)})
    assert got == [("<Czech> 100% {prompt} {lang_name} $1 \\1 |!",), ("<Czech> None!",)]


def test_templates_match_python_formatting(spark):
    prompt = "Was ist 1+1? {x}"
    df = spark.createDataFrame([(1, prompt, "2")], "id int, prompt string, response string")
    for name, template in (("translate", fv.TRANSLATE_PROMPT), ("respond", fv.RESPOND_PROMPT)):
        got = synthesis.requests(df, name, "German").first().synth_prompt
        assert got == template.format(lang_name="German", prompt=prompt)
    example = f"Prompt: {prompt}\nResponse: 2"
    got = synthesis.requests(df, "generate", "German").first().synth_prompt
    assert got == fv.GENERATE_PROMPT.format(lang_name="German", examples=example)  # a pool of one gives one example
    with pytest.raises(ValueError, match="unknown strategy"):
        synthesis.requests(df, "sing", "German")
    with pytest.raises(ValueError, match="missing columns"):
        synthesis.requests(df.drop("response"), "generate", "German")


def test_short_conversation_gives_null(spark):
    df = spark.createDataFrame([([("user", "a")],)], "m array<struct<role:string,content:string>>")
    assert df.select(text.turn(F.col("m"), 0, "content"), text.turn(F.col("m"), 1, "content")).first() == ("a", None)


def test_merged_instruction(spark):
    df = spark.createDataFrame([("i", None), ("i", " NaN "), ("i", "x"), ("i", "")], "a string, b string")
    got = [r[0] for r in df.select(text.merged_instruction(F.col("a"), F.col("b"))).collect()]
    assert got == ["i", "i", "i\n\nx", "i\n\n"]


def test_human_time(spark):
    df = spark.createDataFrame([(0.4,), (3725.9,), (360000.0,)], "s double")
    assert [r[0] for r in df.select(text.human_time(F.col("s"))).collect()] == ["00h00m00s", "01h02m05s", "100h00m00s"]


def test_training_rows(spark):
    df = spark.createDataFrame([(1, [1, 2], [3]), (2, [1, 2, 3], [4, 5]), (3, [1], [2, 3, 4])], "id int, src_tokens array<int>, dst_tokens array<int>")
    got = {r.id: (r.input_tokens, r.input_mask) for r in synthesis.training_rows(df, 4).collect()}
    assert got == {1: ([1, 2, 3, 0], [0, 0, 1, 0]), 3: ([1, 2, 3, 4], [0, 1, 1, 1])}
