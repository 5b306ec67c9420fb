"""Tree model over ranking features, scored per user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.features import feature_columns
from gustara.operators.listwise import ListwiseRanker
from gustara.operators.ordering import competition_rank, running_position
from gustara.operators.skew import attach
from gustara.session import materialize, work_dir


@dataclass(frozen=True)
class Ranker:
    model: GBTRegressionModel
    features: list[str]

    def importances(self) -> list[float]:
        return self.model.featureImportances.toArray().tolist()


def rank_model(
    matrix: DataFrame,
    label: str = "rating",
    max_iter: int = 20,
    max_depth: int = 5,
    step: float = 0.1,
    seed: int = 0,
    centre: bool = True,
) -> Ranker:
    """Boosted regression trees on the label, centred per user so only the order within a user counts.

    Spark has no pairwise tree ranker; a pointwise regression on centred labels is judged with
    the same ranking metrics.
    """
    spark = matrix.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    features = feature_columns(matrix)
    target = F.col(label).cast("double")
    rows = matrix
    if centre:
        means = matrix.groupBy("user_id").agg(F.avg(label).alias("_mean"))
        rows = attach(matrix, means, "user_id")
        target = target - F.col("_mean")
    rows = materialize(rows.select(*features, target.alias("label")), "ranker")
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    gbt = GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, checkpointInterval=10)
    return Ranker(gbt.fit(assembled.select("features", "label")), features)


def score(ranker: Ranker, matrix: DataFrame) -> DataFrame:
    """Matrix rows with their ``score``."""
    assembled = VectorAssembler(inputCols=ranker.features, outputCol="features").transform(matrix)
    scored = ranker.model.transform(assembled).withColumnRenamed("prediction", "score")
    return scored.select("user_id", "item_id", "rating", "rating_date", "score")


def rank_items(scored: DataFrame, items: DataFrame) -> DataFrame:
    """Scored rows with their rank per user (ties share the lowest) and the item's title."""
    ranked = competition_rank(materialize(scored, "scored"), ["user_id"], "score", "score_rank")
    return ranked.join(items.select("item_id", "title"), "item_id", "left")


def review_rows(
    scored: DataFrame, history: DataFrame, items: DataFrame, item_profiles: DataFrame, user_profiles: DataFrame
) -> DataFrame:
    """What users rated last and what the model puts first, with the profiles of both sides.

    ``scored``: one row per (user_id, item_id) with rating, rating_date and score; ``history``: ranked
    rows (user_id, rank, item_id, rating). Predictions are placed by score, then by ``rating_date``,
    largest first, then by item id. Profiles are (item_id, item_profile_text) and (user_id,
    user_profile_text), one row per id; missing ones and missing titles are NULL.
    """
    order = [("score", False), ("rating_date", False), ("item_id", True)]
    placed = running_position(scored, ["user_id"], order, "position")
    predicted = placed.select("user_id", F.lit("prediction").alias("part"), "position", "item_id", "rating", "score")
    seen = history.select(
        "user_id", F.lit("history").alias("part"), F.col("rank").cast("long").alias("position"), "item_id", "rating", F.lit(None).cast("double").alias("score")
    )
    rows = materialize(seen.unionByName(predicted), "review")
    shown = attach(attach(rows, items.select("item_id", "title"), "item_id", "left"), item_profiles, "item_id", "left")
    return attach(shown, user_profiles, "user_id", "left")


def importance_order(ranker: Ranker | ListwiseRanker, spark) -> DataFrame:
    """Feature importances, largest first; one row per feature."""
    rows = sorted(zip(ranker.features, ranker.importances()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(i, name, value) for i, (name, value) in enumerate(rows)],
        "position int, feature_name string, feature_importance double",
    )
