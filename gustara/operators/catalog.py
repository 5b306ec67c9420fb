"""Catalogue views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def community_ratings(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("item_id").agg(
        F.count("*").alias("n_ratings"), F.avg("rating").alias("community_rating")
    )


def browse(items: DataFrame, interactions: DataFrame, category: str | None = None) -> DataFrame:
    """Items with their community rating, all or of one category."""
    shown = items if category is None else items.where(F.col("category") == category)
    return shown.join(community_ratings(interactions), "item_id", "left").select(
        "item_id",
        "title",
        "category",
        F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"),
        "community_rating",
    )
