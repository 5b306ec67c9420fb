"""Ranking metrics per user and over all users."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gustara.operators.ordering import top_k
from gustara.operators.relational import remove_excluded


def recall_at_k(
    recommendations: DataFrame,
    truth: DataFrame,
    k: int = 20,
    excluded_items: DataFrame | None = None,
    distinct_truth: bool = True,
) -> DataFrame:
    """Per recommended user: n_truth, hit_count, hit, hit_proportion.

    ``recommendations``: (user_id, item_id, rank). ``truth``: (user_id, item_id). Items that
    could not be recommended are taken out of the truth. Without truth the proportion is NULL.
    """
    wanted = truth.select("user_id", "item_id")
    if excluded_items is not None:
        wanted = remove_excluded(wanted, excluded_items)
    weight = F.lit(1).cast("long") if distinct_truth else F.count("*")
    counted = wanted.groupBy("user_id", "item_id").agg(weight.alias("_n"))
    sizes = counted.groupBy("user_id").agg(F.sum("_n").alias("n_truth"))
    # The lists are read once: a search behind them must not run twice.
    listed = recommendations.where(F.col("rank") <= k).select("user_id", "item_id").distinct()
    hits = (
        listed.join(counted, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("hit_count"))
    )
    return hits.join(sizes, "user_id", "left").select(
        "user_id",
        F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
        "hit_count",
        (F.col("hit_count") > 0).alias("hit"),
        F.try_divide(F.col("hit_count"), F.col("n_truth")).alias("hit_proportion"),
    )


def recall_summary(per_user: DataFrame) -> DataFrame:
    """One row: users, hits, mean and sample deviation of the proportion."""
    return per_user.agg(
        F.count("*").alias("n_users"),
        F.sum("hit_count").alias("n_hits"),
        F.avg("hit_proportion").alias("avg_hit_proportion"),
        F.stddev_samp("hit_proportion").alias("std_hit_proportion"),
    )


def ranking_metrics(recommendations: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """One row: pooled precision, mean average precision and NDCG at ``k``.

    Users without truth are skipped; users without recommendations count with zero hits.
    """
    wanted = truth.select("user_id", "item_id").distinct()
    sizes = wanted.groupBy("user_id").agg(F.count("*").alias("n_truth"))
    listed = recommendations.where(F.col("rank") <= k).select("user_id", "item_id", "rank")
    hits = listed.join(wanted, ["user_id", "item_id"], "left_semi")
    # At most k rows per user reach this window.
    so_far = F.row_number().over(W.partitionBy("user_id").orderBy("rank"))
    per_user = (
        hits.withColumn("_so_far", so_far)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("hits"),
            F.sum(F.col("_so_far") / F.col("rank")).alias("ap"),
            F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        )
    )
    possible = F.least(F.lit(k), F.col("n_truth"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), possible.cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0)
    )
    scored = sizes.join(per_user, "user_id", "left").select(
        possible.alias("possible"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        (F.coalesce("ap", F.lit(0.0)) / possible).alias("ap"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )
    return scored.agg(
        F.count("*").alias("n_users"),
        F.try_divide(F.sum("hits"), F.sum("possible")).alias("precision_at_k"),
        F.avg("ap").alias("map_at_k"),
        F.avg("ndcg").alias("ndcg_at_k"),
    )


def hit_rate_at_k(scored: DataFrame, truth: str = "rating_date", score: str = "score", k: int = 5) -> DataFrame:
    """Per user: overlap of the top-k by score and the top-k by truth, over k (also if fewer rows).

    Ties in either order go to the smaller item id. ``scored`` has one row per (user, item).
    """
    tie = F.col("item_id").asc()
    by_score = top_k(scored.select("user_id", "item_id", score), ["user_id"], [F.col(score).desc(), tie], k)
    by_truth = top_k(scored.select("user_id", "item_id", truth), ["user_id"], [F.col(truth).desc(), tie], k)
    both = by_score.select("user_id", "item_id").withColumn("_hit", F.lit(1)).join(
        by_truth.select("user_id", "item_id"), ["user_id", "item_id"], "right"
    )
    return both.groupBy("user_id").agg((F.count("_hit") / F.lit(k)).alias("hit_rate"))


def graded_ndcg_at_k(
    scored: DataFrame, truth: str = "rating", score: str = "score", k: int = 5, average_ties: bool = False
) -> DataFrame:
    """Per user NDCG with linear gains.

    Score ties go to the smaller item id, or with ``average_ties`` every row of a tie gets the mean gain
    of the tie, as if all its orders were averaged; item ids do not count then. NULL scores come last
    and tie with each other; a NULL gain is 0.
    """
    tie = F.col("item_id").asc()
    gain = F.coalesce(F.col(truth), F.lit(0)).alias("gain")
    rows = scored.select("user_id", "item_id", gain, F.col(score).alias("_score"))
    gained = F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0))
    if average_ties:
        actual = _tied_gain(rows, k)
    else:
        actual = top_k(rows, ["user_id"], [F.col("_score").desc(), tie], k).groupBy("user_id").agg(gained.alias("dcg"))
    ideal = top_k(rows, ["user_id"], [F.col("gain").desc(), tie], k).groupBy("user_id").agg(gained.alias("idcg"))
    return actual.join(ideal, "user_id").select(
        "user_id",
        F.when(F.col("idcg") == 0, F.lit(0.0)).otherwise(F.try_divide("dcg", "idcg")).alias("ndcg"),
    )


def _tied_gain(rows: DataFrame, k: int) -> DataFrame:
    """(user_id, dcg): mean gain of each tie times the discounts of the places it takes among the first ``k``.

    A tie is one row before any window, and a user's first ``k`` ties reach place ``k``.
    """
    ties = rows.groupBy("user_id", "_score").agg(F.count("*").alias("n"), F.avg("gain").alias("mean"))
    first = top_k(ties, ["user_id"], [F.col("_score").desc()], k)
    end = F.sum("n").over(W.partitionBy("user_id").orderBy("rank"))
    discounts = [0.0]
    for place in range(1, k + 1):
        discounts.append(discounts[-1] + 1 / math.log2(place + 1))
    upto = F.array(*[F.lit(d) for d in discounts])
    placed = first.withColumn("end", end).select(
        "user_id", "mean", F.least("end", F.lit(k)).cast("int").alias("last"), F.least(F.col("end") - F.col("n"), F.lit(k)).cast("int").alias("before")
    )
    taken = F.get(upto, F.col("last")) - F.get(upto, F.col("before"))
    return placed.groupBy("user_id").agg(F.sum(F.col("mean") * taken).alias("dcg"))


def results_table(valid: DataFrame, train: DataFrame) -> DataFrame:
    """Per user hit rates of both splits with their difference."""
    joined = valid.select("user_id", F.col("hit_rate").alias("val_hit_rate")).join(
        train.select("user_id", F.col("hit_rate").alias("train_hit_rate")), "user_id"
    )
    diff = F.col("val_hit_rate") - F.col("train_hit_rate")
    return joined.withColumns({"diff": diff, "abs_diff": F.abs(diff)})


def extreme_users(results: DataFrame, level: float) -> DataFrame:
    """Users with the same extreme hit rate (0 or 1) in both splits."""
    return results.where((F.col("val_hit_rate") == level) & (F.col("train_hit_rate") == level))


def users_at_least(per_user: DataFrame, threshold: float, column: str = "hit_proportion") -> DataFrame:
    return per_user.where(F.col(column) >= threshold)


def users_at_most(per_user: DataFrame, threshold: float, column: str = "val_hit_rate") -> DataFrame:
    return per_user.where(F.col(column) <= threshold)
