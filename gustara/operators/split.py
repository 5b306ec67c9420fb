"""From raw interactions to the windowed train and validation sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.functions.scalars import parse_timestamp
from gustara.session import materialize


def clean_interactions(
    raw: DataFrame, ts: str = "date_last_modified", sort: bool = False
) -> DataFrame:
    """Typed interactions: ids as text, parsed timestamp, month, quarter; rows with a NULL dropped.

    NULL ids are dropped too (text casting must not turn them into an id). ``sort`` orders by
    date for a sink; consumers in a plan do not need it.
    """
    typed = raw.withColumns(
        {
            "user_id": F.col("user_id").cast("string"),
            "item_id": F.col("item_id").cast("string"),
            ts: parse_timestamp(ts),
            "rating": F.col("rating").try_cast("double"),
        }
    ).withColumns({"month": F.month(ts), "quarter": F.quarter(ts)})
    cleaned = typed.na.drop("any")
    return cleaned.orderBy(ts) if sort else cleaned


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def train_window(train: DataFrame, prev_days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``prev_days`` before the newest row, bound included.

    The bound is one subquery value, so it reaches the file reader as a plain comparison.
    """
    bound = train.agg((F.max(ts) - days(prev_days)).alias("bound")).scalar()
    return train.where(F.col(ts) >= bound)


def valid_window(valid: DataFrame, post_days: int, min_rating: float = 3.0, ts: str = "ts") -> DataFrame:
    """Well-rated rows of the first ``post_days``; the oldest row is found before that filter."""
    bound = valid.agg((F.min(ts) + days(post_days)).alias("bound")).scalar()
    return valid.where((F.col(ts) <= bound) & (F.col("rating") >= min_rating))


def common_ids(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def filter_common_ids(train: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose user and item both occur in both splits, decided once for both splits."""
    users = materialize(common_ids(train, valid, "user_id"), "common-users")
    items = materialize(common_ids(train, valid, "item_id"), "common-items")

    def keep(df: DataFrame) -> DataFrame:
        return df.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")

    return keep(train), keep(valid)


def users_with_min_rows(train: DataFrame, valid: DataFrame, min_train: int, min_valid: int) -> DataFrame:
    """Users with enough rows in both splits."""

    def enough(df: DataFrame, minimum: int) -> DataFrame:
        return df.groupBy("user_id").count().where(F.col("count") >= minimum).select("user_id")

    return enough(train, min_train).intersect(enough(valid, min_valid))


@dataclass(frozen=True)
class WindowedSplit:
    train: DataFrame
    valid: DataFrame
    users: DataFrame
    items: DataFrame


def windowed_split(
    train: DataFrame,
    valid: DataFrame,
    prev_days: int = 24 * 7,
    post_days: int = 4 * 7,
    min_rating: float = 3.0,
    min_train: int = 5,
    min_valid: int = 5,
    ts: str = "ts",
    store: bool = True,
) -> WindowedSplit:
    """Windows, then common ids, then minimum counts, in that order.

    Everything before the last step works on one table of (user, item) counts for both splits:
    it is partially aggregated where the rows are read, so a hot user or item does not travel.
    ``store`` writes that table and the chosen ids, which all later steps read, once.
    """
    keep = materialize if store else (lambda df, label: df)
    recent = train_window(train, prev_days, ts)
    upcoming = valid_window(valid, post_days, min_rating, ts)
    sides = _side(recent, 1, 0).union(_side(upcoming, 0, 1))
    pairs = keep(
        sides.groupBy("user_id", "item_id").agg(F.sum("t").alias("n_train"), F.sum("v").alias("n_valid")), "pairs"
    )
    in_both = (F.col("n_train") > 0) & (F.col("n_valid") > 0)
    per_item = pairs.groupBy("item_id").agg(F.max("n_train").alias("n_train"), F.max("n_valid").alias("n_valid"))
    items = keep(per_item.where(in_both).select("item_id"), "common-items")

    # A user with enough rows on both sides is a common user, so that test needs no own step.
    # A minimum below one would let users in that have no row at all.
    kept = pairs.join(items, "item_id", "left_semi")
    per_user = kept.groupBy("user_id").agg(F.sum("n_train").alias("n_train"), F.sum("n_valid").alias("n_valid"))
    enough = (F.col("n_train") >= max(1, min_train)) & (F.col("n_valid") >= max(1, min_valid))
    users = keep(per_user.where(enough).select("user_id"), "final-users")

    def final(df: DataFrame) -> DataFrame:
        return df.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")

    final_items = kept.join(users, "user_id", "left_semi").select("item_id").distinct()
    return WindowedSplit(final(recent), final(upcoming), users, final_items)


def _side(df: DataFrame, t: int, v: int) -> DataFrame:
    return df.select("user_id", "item_id", F.lit(t).alias("t"), F.lit(v).alias("v"))


def catalogue_of(items: DataFrame, final_items: DataFrame) -> DataFrame:
    return items.join(final_items, "item_id", "left_semi")


def split_stats(split: WindowedSplit) -> DataFrame:
    """One row: users, items, rows and the smallest per-user count of both splits."""
    per_user_t = split.train.groupBy("user_id").count()
    per_user_v = split.valid.groupBy("user_id").count()
    return (
        per_user_t.agg(
            F.count("*").alias("n_users"),
            F.sum("count").alias("n_train"),
            F.min("count").alias("min_train_per_user"),
        )
        .withColumns(
            {
                "n_valid": per_user_v.agg(F.sum("count").alias("n")).scalar(),
                "min_valid_per_user": per_user_v.agg(F.min("count").alias("n")).scalar(),
                "n_items": split.items.agg(F.count("*").alias("n")).scalar(),
            }
        )
    )
