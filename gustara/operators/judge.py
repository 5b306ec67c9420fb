"""Judging recommendations item by item and list against list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.functions.scalars import parse_answer
from gustara.functions.text import pair_prompt, prompt_parts
from gustara.operators.generate import generate
from gustara.providers.base import GenerationParams, TextProvider
from gustara.schemas import PAIRWISE_JUDGEMENT, POINTWISE_JUDGEMENT

# Names of the two models, as in the column ``model``: a parameter of everything that compares them.
MODELS = ("first", "second")
POINTWISE_PARAMS = GenerationParams(temperature=0.0, thinking_budget=None, max_output_tokens=4096)
PAIRWISE_PARAMS = GenerationParams(temperature=0.0, thinking_budget=2048, max_output_tokens=4096)


def recommendations_to_judge(
    recommendations: DataFrame, users: DataFrame, profiles: DataFrame, items: DataFrame
) -> DataFrame:
    """Recommendations of the chosen users with both profile texts and the title.

    ``recommendations``: (model, user_id, item_id, rank). ``profiles``: (user_id,
    user_profile_text). ``items``: (item_id, title, item_profile_text).
    """
    chosen = recommendations.join(users, "user_id", "left_semi")
    return (
        chosen.join(profiles.select("user_id", "user_profile_text"), "user_id", "left")
        .join(items.select("item_id", "title", "item_profile_text"), "item_id", "left")
        .select("model", "user_id", "rank", "item_id", "title", "user_profile_text", "item_profile_text")
    )


def judge_pointwise(
    rows: DataFrame,
    provider: TextProvider,
    instruction: str,
    params: GenerationParams = POINTWISE_PARAMS,
    **options,
) -> DataFrame:
    """Rows with ``verdict``, ``confidence``, ``justification`` and ``error``.

    All models' lists go through in one pass. An unreadable answer gives a NULL verdict.
    """
    parts = prompt_parts(instruction, "user_profile_text", "item_profile_text")
    judged = generate(rows, parts, provider, params, **options)
    parsed = judged.withColumn("_answer", parse_answer("answer_text", POINTWISE_JUDGEMENT))
    return parsed.select(
        *rows.columns,
        F.col("answer_text").alias("judgement_text"),
        F.col("_answer.would_like").alias("verdict"),
        F.col("_answer.confidence").alias("confidence"),
        F.col("_answer.justification").alias("justification"),
        "error",
    )


def negative_verdicts(judged: DataFrame) -> DataFrame:
    """Rows judged false, with the reason."""
    return judged.where(~F.col("verdict")).select("model", "user_id", "item_id", "justification")


def pointwise_metrics(judged: DataFrame, models: tuple[str, str] = MODELS) -> DataFrame:
    """Quality score per user of both models side by side (users with both only), in one pass."""
    measures = []
    for m in models:
        mine = F.col("model") == m
        measures += [
            F.count_if(mine & F.col("verdict")).alias(f"n_liked_{m}"),
            F.count(F.when(mine, F.col("item_id"))).alias(f"n_judged_{m}"),
        ]
    both = judged.groupBy("user_id").agg(*measures)
    both = both.where(F.least(*[f"n_judged_{m}" for m in models]) > 0)
    return both.withColumns(
        {f"quality_score_{m}": F.try_divide(F.col(f"n_liked_{m}"), F.col(f"n_judged_{m}")) for m in models}
    )


def paired_lists(rows: DataFrame, k: int = 20, models: tuple[str, str] = MODELS) -> DataFrame:
    """One row per user with both models' ranked lists of at most ``k`` items, in one pass.

    Users without a list from one of the models are left out.
    """
    columns = ("item_id", "title", "item_profile_text")
    record = F.struct("rank", *columns)
    lists = rows.where(F.col("rank") <= k).groupBy("user_id").agg(
        F.max(F.when(F.col("model").isin(*models), F.col("user_profile_text"))).alias("user_profile_text"),
        *[F.array_sort(F.collect_list(F.when(F.col("model") == m, record))).alias(f"_{m}") for m in models],
    )
    paired = lists.where(F.least(*[F.size(f"_{m}") for m in models]) > 0)
    return paired.select(
        "user_id", "user_profile_text", *[F.col(f"_{m}.{c}").alias(f"{c}_{m}") for m in models for c in columns]
    )


def judge_pairwise(
    rows: DataFrame,
    provider: TextProvider,
    instruction: str,
    seed: int = 0,
    k: int = 20,
    params: GenerationParams = PAIRWISE_PARAMS,
    models: tuple[str, str] = MODELS,
    **options,
) -> DataFrame:
    """Per user the model whose list was preferred.

    Lists are shown in a seeded order. Only A and B are answers; anything else selects nobody.
    """
    prompts = pair_prompt(paired_lists(rows, k, models), seed, models).select("user_id", "model_a", "model_b", "comparison_prompt")
    judged = generate(prompts, prompt_parts(instruction, "comparison_prompt"), provider, params, **options)
    answer = parse_answer("answer_text", PAIRWISE_JUDGEMENT)
    picked = judged.withColumn("_answer", answer)
    preferred = F.col("_answer.preferred_model")
    return picked.select(
        "user_id",
        "model_a",
        "model_b",
        preferred.alias("preferred_model"),
        F.when(preferred == "A", F.col("model_a")).when(preferred == "B", F.col("model_b")).alias("model_selected"),
        F.col("_answer.confidence").alias("confidence"),
        F.col("_answer.justification").alias("justification"),
        "error",
    )


def approved_recommendations(judged: DataFrame) -> DataFrame:
    """Recommendations marked approved or experimental, with the judge's explanation."""
    status = F.when(F.col("verdict"), F.lit("approved")).otherwise(F.lit("experimental"))
    return judged.select(
        "model", "user_id", "rank", "item_id", "title", status.alias("status"), "confidence", "justification"
    )
