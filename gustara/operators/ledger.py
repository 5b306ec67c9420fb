"""Generation whose answers outlive the job: equal prompts are asked once, and never again.

A ledger is a Parquet folder of answers under a hash of everything that decides them: the prompt
parts, the parameters and the model's name. A run asks only prompts the ledger has no answer for, in
waves whose answers are appended before the next wave begins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.functions.scalars import envelope_text
from gustara.operators.generate import _answers
from gustara.operators.skew import attach
from gustara.providers.base import GenerationParams, Retry, TextProvider
from gustara.session import materialize, spread

LEDGER = "key string, full_response string, error string, run string"
NOT_ASKED = "NotAsked"


def prompt_key(parts: Column, params: GenerationParams, model: str) -> Column:
    """SHA-256 of the prompt parts, NULL ones told from empty ones, the parameters and the model's name."""
    decided = F.lit(json.dumps([model, params.as_dict()], sort_keys=True))
    given = F.to_json(F.struct(parts.alias("parts")), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", decided, given), 256)


def generate_once(
    df: DataFrame,
    parts: Column,
    provider: TextProvider,
    ledger: str,
    model: str,
    params: GenerationParams = GenerationParams(),
    retry: Retry = Retry(),
    concurrency: int | None = None,
    wave_rows: int = 100_000,
    batch_rows: int = 100,
) -> DataFrame:
    """Add ``full_response``, ``answer_text`` and ``error``, as ``generate`` does, with answers from the ledger first.

    All rows of ``df`` stay. Rows of one prompt share one answer and one call. Failures are written
    down, but a later run asks them again. A provider outage (see ``Retry.give_up``) ends the
    calls of its task: what earlier batches answered is appended, prompts left over get the error ``NotAsked``, and
    no further wave is begun; run again to go on. ``batch_rows`` prompts go to one call; below half of
    ``retry.give_up`` an outage is never noticed. A job that is killed loses at most the answers of
    the wave under way, about ``wave_rows`` prompts. Two runs at once may both ask a prompt; the
    readers take one of the answers, the same one for every row.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    # Numbers instead of names, so that no given column can meet those of the ledger.
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = materialize(df.select(*columns, parts.alias("parts"), prompt_key(parts, params, model).alias("key")), "prompts")
    answered = _read(spark, ledger).where("error is null").select("key").distinct()
    asked = rows.groupBy("key").agg(F.any_value("parts").alias("parts")).join(answered, "key", "left_anti")
    asked = materialize(asked, "asked")
    waves = -(-asked.count() // wave_rows)
    number = F.pmod(F.xxhash64("key"), F.lit(waves))
    call = _caller(provider, params.as_dict(), retry, batch_rows)
    for wave in range(waves):
        part = spread(asked.where(number == wave) if waves > 1 else asked, concurrency)
        part.mapInPandas(call, "key string, full_response string, error string").withColumn("run", F.lit(run)).write.mode(
            "append"
        ).parquet(ledger)
        if not _read(spark, ledger).where((F.col("run") == run) & F.col("error").startswith(NOT_ASKED)).isEmpty():
            break
    # An answer before this run's failures; of several answers the first by text.
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "full_response", "error")).alias("best")
    usable = _read(spark, ledger).where(F.col("error").isNull() | (F.col("run") == run))
    answers = usable.groupBy("key").agg(best).select("key", "best.full_response", "best.error", F.lit(True).alias("seen"))
    joined = attach(rows, answers, "key", "left")
    error = F.when(F.col("seen").isNull(), F.lit(f"{NOT_ASKED}: the provider failed before")).otherwise(F.col("error"))
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)],
        "full_response",
        envelope_text("full_response").alias("answer_text"),
        error.alias("error"),
    )


def _read(spark, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger)


def _caller(provider: TextProvider, settings: dict, retry: Retry, batch_rows: int):
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outage = None
        for frame in frames:
            requests = [[] if p is None else list(p) for p in frame["parts"]]
            out: list[tuple[str | None, str | None]] = []
            for at in range(0, len(requests), batch_rows):
                part = requests[at : at + batch_rows]
                if outage is None:
                    try:
                        out += _answers(part, provider, settings, retry, False)
                        continue
                    except RuntimeError as failure:
                        outage = f"{NOT_ASKED}: {failure}"
                out += [(None, outage)] * len(part)
            answered = pd.DataFrame(out, columns=["full_response", "error"])
            answered.insert(0, "key", frame["key"].to_numpy())
            yield answered

    return call
