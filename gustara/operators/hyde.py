"""Search with hypothetical profiles, and free-text search over a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.functions.text import prompt_parts
from gustara.operators.generate import embed_text, generate
from gustara.operators.text_index import text_match
from gustara.operators.vector_search import search_repeated, vector_search
from gustara.providers.base import EmbeddingProvider, GenerationParams, TextProvider
from gustara.session import materialize

HYDE_PARAMS = GenerationParams(
    temperature=1.2, thinking_budget=None, max_output_tokens=4096, extra={"topP": 0.95, "topK": 20}
)


def hypothetical_profiles(
    users: DataFrame,
    instruction: str,
    provider: TextProvider,
    embedder: EmbeddingProvider,
    params: GenerationParams = HYDE_PARAMS,
) -> DataFrame:
    """(user_id, user_profile_text) plus ``hyde_profile_text`` and its ``embedding``, written once."""
    rows = generate(users, prompt_parts(instruction, "user_profile_text"), provider, params)
    rows = rows.drop("full_response").withColumnRenamed("answer_text", "hyde_profile_text")
    return materialize(embed_text(rows, "hyde_profile_text", embedder, "RETRIEVAL_QUERY"), "hyde")


def hyde_search(
    users: DataFrame,
    base: DataFrame,
    instruction: str,
    provider: TextProvider,
    embedder: EmbeddingProvider,
    k: int = 20,
) -> DataFrame:
    """Nearest items of every user's hypothetical profile; equal profiles and equal items are compared once."""
    profiles = hypothetical_profiles(users, instruction, provider, embedder)
    return search_repeated(base, profiles, k)


def semantic_search(
    queries: DataFrame,
    base: DataFrame,
    embedder: EmbeddingProvider,
    k: int = 20,
    max_distance: float = 2.0,
    category: str | None = None,
) -> DataFrame:
    """Text queries against embedded rows, with a text match where vectors find nothing.

    ``queries``: (query_id, text). ``base``: (item_id, content, embedding[, category]). Vector
    hits farther than ``max_distance`` do not count. A query without any falls back to rows
    that contain its text; ``source`` says which way a row came. A category, if given, restricts the
    rows before either search, so it takes nothing from the ``k`` hits.
    """
    if category is not None:
        base = base.where(F.col("category") == category)
    embedded = materialize(embed_text(queries, "text", embedder, "RETRIEVAL_QUERY"), "queries")
    near = vector_search(base, embedded, k, query_id="query_id").where(F.col("distance") <= max_distance)
    near = materialize(near, "near")
    unanswered = embedded.join(near.select("query_id"), "query_id", "left_anti")
    fallback = text_match(unanswered, base, k)
    return near.select("query_id", "item_id", "rank", F.lit("vector").alias("source")).unionByName(
        fallback.select("query_id", "item_id", "rank", F.lit("text").alias("source"))
    )
