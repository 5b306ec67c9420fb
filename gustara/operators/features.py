"""Features and training matrix of the ranking model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.skew import attach

# Feature names and their order.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
STARS = (1, 2, 3, 4, 5)
ITEM_NUTRIENTS = (
    "sugars",
    "sodium",
    "carbohydrates",
    "calories",
    "fat",
    "caloriesFromFat",
    "calcium",
    "fiber",
    "cholesterol",
    "protein",
    "vitaminA",
    "potassium",
    "saturatedFat",
)
EVENING_HOURS = (18, 23)


def user_features(interactions: DataFrame, ts: str = "ts") -> DataFrame:
    """Fifteen features per user in one aggregation.

    Distinct items come from (user, item) partial groups, so the shuffle carries one row per
    pair and no task sees all rows of a hot user.
    """
    pair = interactions.groupBy("user_id", "item_id").agg(
        F.count("*").alias("n"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rating_n"),
        *[F.count_if(F.col("rating") == s).alias(f"s{s}") for s in STARS],
        *[F.count_if(F.weekday(ts) == i).alias(f"d{i}") for i in range(7)],
        F.count_if(F.hour(ts).between(*EVENING_HOURS)).alias("evening"),
    )
    return pair.groupBy("user_id").agg(
        F.try_divide(F.sum("rating_sum"), F.sum("rating_n")).alias("mean_aver_rate"),
        F.count("item_id").alias("count_recipes"),
        *[F.sum(f"s{s}").alias(f"{s}_stars_rating_received") for s in STARS],
        *[F.sum(f"d{i}").alias(f"{day}_review_count") for i, day in enumerate(WEEKDAYS)],
        F.sum("evening").alias("evening_review_count"),
    )


def item_features(items: DataFrame, nutrition: DataFrame) -> DataFrame:
    """Community rating, review count and thirteen nutrients per item."""
    return items.select("item_id", "aver_rate", "review_nums").join(
        nutrition.select("item_id", *ITEM_NUTRIENTS), "item_id", "left"
    )


def ranking_matrix(users: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings with the features of their user and item; both joins drop rows without features.

    ``ratings``: (user_id, item_id, rating, rating_date). Missing feature values become 0.
    The feature frames are arguments: pass those of the training split to avoid leaking.
    """
    rows = ratings.select("user_id", "item_id", "rating", "rating_date")
    return attach(attach(rows, users, "user_id"), items, "item_id").na.fill(0)


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("user_id", "item_id", "rating", "rating_date")]


def require_same_users(left: DataFrame, right: DataFrame) -> None:
    """The two splits must cover equally many users."""
    counts = [df.agg(F.countDistinct("user_id")).first()[0] for df in (left, right)]
    if counts[0] != counts[1]:
        raise ValueError(f"different number of users in the two splits: {counts[0]} and {counts[1]}")
