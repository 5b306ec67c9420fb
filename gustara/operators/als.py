"""Implicit-feedback matrix factorisation and its recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.vector_search import vector_search
from gustara.operators.weights import index_ids, interaction_triples
from gustara.session import materialize, work_dir


@dataclass(frozen=True)
class Factorisation:
    model: ALSModel
    users: DataFrame  # user_id, user_idx
    items: DataFrame  # item_id, item_idx

    def user_vectors(self) -> DataFrame:
        rows = self.model.userFactors.select(F.col("id").alias("user_idx"), F.col("features").alias("embedding"))
        return rows.join(self.users, "user_idx").select("user_id", "embedding")

    def item_vectors(self) -> DataFrame:
        rows = self.model.itemFactors.select(F.col("id").alias("item_idx"), F.col("features").alias("embedding"))
        return rows.join(self.items, "item_idx").select("item_id", "embedding")


def als_fit(
    interactions: DataFrame,
    value: str = "rating",
    rank: int = 32,
    reg: float = 0.05,
    alpha: float = 2.0,
    max_iter: int = 15,
    seed: int = 0,
    blocks: int | None = None,
) -> Factorisation:
    """Fit on (user_id, item_id, value) rows; repeated pairs are summed.

    Users are the rows of the factorisation and items its columns. Spark reads confidence as
    1 + alpha * |value| and scales the penalty with the number of ratings, so factors differ
    from other implicit ALS implementations; quality is what can be compared. Each iteration is
    two shuffles: 10 to 20 iterations are the sensible range, checkpointed as they go. Both sides
    are cut into ``blocks`` blocks, by default as many as the session has shuffle partitions; the
    start factors, and so the fitted ones, depend on that number only.
    """
    spark = interactions.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    rows = materialize(interactions.select("user_id", "item_id", F.col(value).cast("double").alias("value")), "als")
    if blocks is None:
        blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    users = materialize(index_ids(rows, "user_id", "user_idx"), "users")
    items = materialize(index_ids(rows, "item_id", "item_idx"), "items")
    triples = interaction_triples(rows.join(users, "user_id").join(items, "item_id"), "value")
    als = ALS(
        rank=rank,
        regParam=reg,
        alpha=alpha,
        maxIter=max_iter,
        seed=seed,
        implicitPrefs=True,
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="value",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=5,
        coldStartStrategy="drop",
    )
    return Factorisation(als.fit(triples), users, items)


def als_recommend(fitted: Factorisation, seen: DataFrame, n: int = 20, users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, distance, rank): the ``n`` best unseen items per user.

    A factor product is an inner product, so this is the block search with the seen pairs left
    out. Asking the model for ``n`` plus the longest history instead would make every user pay
    for the heaviest one.
    """
    queries = fitted.user_vectors()
    if users is not None:
        queries = queries.join(users, "user_id", "left_semi")
    return vector_search(
        materialize(fitted.item_vectors(), "item-factors"),
        materialize(queries, "user-factors"),
        n,
        "DOT_PRODUCT",
        exclude=seen.select("user_id", "item_id"),
    )


def unknown_users(fitted: Factorisation, users: DataFrame) -> DataFrame:
    """Users asked for that the training data does not know."""
    return users.join(fitted.users, "user_id", "left_anti")
