"""Schemas of the tables the engine exchanges (DDL strings)."""

SEED = (
    "id string, source string, prompt string, response string, language string, "
    "strategy array<string>, source_id string"
)
SEED_COLUMNS = ["id", "source", "prompt", "response", "language", "strategy", "source_id"]

PG_SCORES = (
    "teacher_model string, target_lang string, result double, result_stderr double, "
    "pgr double, z_score double, pg_score double"
)
DATA_SCALING = PG_SCORES + ", scale int"
TRANSLATION_SCORES = PG_SCORES + ", translate_method string"

METRIC_DOCUMENT = (
    "metadata struct<input_dataset:string,num_samples:bigint>, "
    "distinct_ri struct<prompts_distinct_ri:double,responses_distinct_ri:double>, "
    "perplexity struct<average_perplexity:double,"
    "per_instance_perplexity:array<struct<instruction:string,response:string,perplexity:double>>>, "
    "reward_model struct<average_rubric_score:double,"
    "per_instance_rubric_scores:array<struct<instruction:string,response:string,feedback:string,score:int>>>, "
    "length struct<prompts_average_length:double,responses_average_length:double>"
)
ABLATION_DOCUMENT = (
    "config struct<model_name:string,model_dtype:string,model_size:string>, "
    "results map<string,struct<acc:double,acc_stderr:double>>, "
    "category_scores map<string,double>, filbench_score double"
)
MODEL_DIM = (
    "name string, model_family string, beautiful_name string, url string, parameter_size double, "
    "context_length int, pct_multi_pretraining double, num_languages_supported int, "
    "instruction_tuned boolean, training_approach array<string>, cost_in_mtok double, "
    "cost_out_mtok double, release_date string, license string"
)
LANGUAGE_DIM = (
    "name string, iso_639_1 string, joshi_etal_resource_level int, "
    "ethnologue_num_speakers int, pct_commoncrawl double, native_speakers_in_m double"
)
JUDGE_OUTPUT = "score int, feedback string"
TASK_METRICS = "map<string,map<string,double>>"
