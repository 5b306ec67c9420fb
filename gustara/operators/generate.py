"""Row-wise generation and embedding through batch providers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.functions.scalars import envelope_text, parse_answer
from gustara.functions.text import prompt_parts
from gustara.providers.base import EmbeddingProvider, GenerationParams, Retry, TextProvider, envelope
from gustara.session import spread

_RESULT = T.StructType([T.StructField("full_response", T.StringType()), T.StructField("error", T.StringType())])


def generate(
    df: DataFrame,
    parts: Column,
    provider: TextProvider,
    params: GenerationParams = GenerationParams(),
    retry: Retry = Retry(),
    concurrency: int | None = None,
    raise_errors: bool = False,
) -> DataFrame:
    """Add ``full_response``, ``answer_text`` and ``error``.

    Only the prompt parts cross to Python. A batch that keeps failing is halved until the failing
    rows stand alone, so one bad row costs its own ``error`` and a few more calls; an outage ends the
    task after ``retry.give_up`` failed calls in a row. ``concurrency`` sets the number of
    tasks that call the provider at once. The call is marked non-deterministic so the planner
    never evaluates it twice; write the result once before reading it several times.
    """
    settings = params.as_dict()

    @F.pandas_udf(_RESULT)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            requests = [list(p) for p in batch]
            yield pd.DataFrame(
                _answers(requests, provider, settings, retry, raise_errors), columns=["full_response", "error"]
            )

    rows = spread(df, concurrency)
    answered = rows.withColumn("_ai", call.asNondeterministic()(parts))
    return answered.select(
        *df.columns,
        F.col("_ai.full_response").alias("full_response"),
        envelope_text("_ai.full_response").alias("answer_text"),
        F.col("_ai.error").alias("error"),
    )


def _answers(requests, provider, settings, retry, raise_errors) -> list[tuple[str | None, str | None]]:
    def answer(part):
        return [(envelope(t), None) for t in _checked(provider, part, settings)]

    def failed(failure):
        if raise_errors:
            raise failure
        return None, f"{type(failure).__name__}: {failure}"

    return retry.isolate(requests, answer, failed)


def _checked(provider: TextProvider, requests: list[list[str]], settings: dict) -> list[str]:
    texts = provider.generate(requests, settings)
    if len(texts) != len(requests):
        raise ValueError(f"provider returned {len(texts)} answers for {len(requests)} requests")
    return texts


def generate_profiles(
    df: DataFrame,
    instruction: str,
    columns: Sequence[str],
    provider: TextProvider,
    schema: T.StructType,
    params: GenerationParams = GenerationParams(),
    text_name: str = "profile_text",
    **options,
) -> DataFrame:
    """Generation plus typed parsing: the answer text, a ``profile`` struct and ``error``."""
    answered = generate(df, prompt_parts(instruction, *columns), provider, params, **options)
    return answered.withColumn("profile", parse_answer("answer_text", schema)).withColumnRenamed(
        "answer_text", text_name
    )


def generation_failures(answered: DataFrame) -> DataFrame:
    """One row: rows, provider errors, unreadable answers."""
    return answered.agg(
        F.count("*").alias("n_rows"),
        F.count("error").alias("n_errors"),
        F.count("profile._bad").alias("n_unreadable"),
    )


def embed_text(
    df: DataFrame,
    content: str,
    provider: EmbeddingProvider,
    task_type: str = "RETRIEVAL_DOCUMENT",
    name: str = "embedding",
    retry: Retry = Retry(),
    concurrency: int | None = None,
) -> DataFrame:
    """Add the embedding of a text column; NULL texts and failures give an empty array.

    One pass without a shuffle: the whole text goes to the provider in Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if t is not None else "" for t in batch]
            yield pd.Series(_vectors(texts, provider, task_type, retry), dtype=object)

    rows = spread(df, concurrency)
    return rows.withColumn(name, call.asNondeterministic()(F.col(content)))


def _vectors(texts: list[str], provider: EmbeddingProvider, task_type: str, retry: Retry) -> list[np.ndarray]:
    return retry.isolate(texts, lambda part: list(provider.embed(part, task_type)), lambda failure: np.empty(0))
