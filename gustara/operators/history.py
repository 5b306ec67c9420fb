"""User histories: recent rows, point-in-time reviews, listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gustara.functions.scalars import date_text
from gustara.operators.ordering import top_k
from gustara.operators.relational import before_cutoff, join_one_to_one, natural_join
from gustara.session import materialize


@dataclass(frozen=True)
class RecentHistory:
    rows: DataFrame  # user_id, rank, item_id, rating, date, user_comment
    rejects: DataFrame  # user_id, n_rows: users below the minimum


def recent_history(
    interactions: DataFrame,
    n: int = 25,
    k_min: int = 5,
    ts: str = "ts",
    reviews: DataFrame | None = None,
) -> RecentHistory:
    """The ``n`` newest rows per user, newest first, ties by item.

    Users with fewer than ``k_min`` rows go to ``rejects`` instead of failing the run. The row
    limit is applied before the shuffle; the count test then only needs the limited rows, which
    are already together. With ``reviews`` the comments are joined afterwards, so that texts are
    only looked up and checked for repeated keys where a kept row needs them.
    """
    order = [F.col(ts).desc(), F.col("item_id").asc()]
    rows = top_k(interactions, ["user_id"], order, max(n, k_min))
    counted = rows.withColumn("n_rows", F.count("*").over(W.partitionBy("user_id")))
    kept = counted.where(F.col("n_rows") >= k_min)
    rejects = counted.where((F.col("n_rows") < k_min) & (F.col("rank") == 1)).select("user_id", "n_rows")
    kept = kept.where(F.col("rank") <= n)
    if reviews is not None:
        kept = materialize(kept, "recent")
        keys = ["user_id", "item_id", ts]
        kept = attach_comments(kept, materialize(reviews.join(kept.select(*keys), keys, "left_semi"), "comments"), ts)
    comment = F.col("user_comment") if "user_comment" in kept.columns else F.lit(None).cast("string")
    records = kept.select(
        "user_id",
        "rank",
        "item_id",
        "rating",
        date_text(ts).alias("date"),
        comment.alias("user_comment"),
    )
    return RecentHistory(records, rejects)


def nested_history(records: DataFrame, n: int = 25) -> DataFrame:
    """One row per user with the ``n`` newest records as an array of structs."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "item_id", "rating", "date", "user_comment")))
    lists = records.where(F.col("rank") <= n).groupBy("user_id").agg(packed.alias("_rows"))
    record = F.transform(
        "_rows",
        lambda r: F.struct(*[r[c].alias(c) for c in ("item_id", "rating", "date", "user_comment")]),
    )
    return lists.select("user_id", record.alias("user_history")).withColumns(
        {
            "n_history": F.size("user_history"),
            "items_to_exclude": F.col("user_history.item_id"),
        }
    )


def latest_per_user(interactions: DataFrame, ts: str = "ts") -> DataFrame:
    return interactions.groupBy("user_id").agg(F.max(ts).alias("latest"))


def attach_comments(interactions: DataFrame, reviews: DataFrame, ts: str = "ts") -> DataFrame:
    """Each interaction with the comment of the same user, item and time; keys must be unique."""
    comments = reviews.select("user_id", "item_id", ts, F.col("text").alias("user_comment"))
    return join_one_to_one(interactions, comments, ["user_id", "item_id", ts])


def reviews_before_cutoff(reviews: DataFrame, interactions: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Reviews older than the user's newest interaction, with the item columns they share."""
    older = before_cutoff(reviews, latest_per_user(interactions, ts), "user_id", ts, "latest")
    return natural_join(older, items)


def rating_totals(history: DataFrame) -> DataFrame:
    """Rows rated and mean rating over the whole history."""
    return history.groupBy("user_id").agg(
        F.count("*").alias("n_rated"), F.avg("rating").alias("avg_rating")
    )


def newest_rows(history: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    return top_k(history, ["user_id"], [F.col(ts).desc(), F.col("item_id").asc()], n)


def history_listing(interactions: DataFrame, reviews: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Chronological history of every user with ratings, comments and titles."""
    rows = attach_comments(interactions, reviews, ts).join(items.select("item_id", "title"), "item_id", "left")
    return rows.select("user_id", ts, "item_id", "title", "rating", "user_comment").orderBy("user_id", ts, "item_id")
