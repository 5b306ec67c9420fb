"""Interaction weights: age bonus, confidence, TF-IDF and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.operators.ordering import running_position
from gustara.operators.relational import with_group_count
from gustara.operators.skew import attach

# Fixed values of the weighting formulas.
BM25_K1 = 100.0
BM25_B = 0.8
AGE_BONUS = 0.2
CONFIDENCE_ALPHA = 20.0


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def age_norm(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``age_norm``: 1 for the oldest row of the table, 0 for the newest; 1 if all are equal."""
    at = _seconds(F.col(ts))
    edges = df.agg(F.struct(F.min(at).alias("oldest"), F.max(at).alias("newest")).alias("x")).scalar()
    oldest, newest = edges["oldest"], edges["newest"]
    span = newest - oldest
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    return df.withColumn("age_norm", 1.0 - (_seconds(F.col(ts)) - oldest) / span)


def rating_with_age(df: DataFrame, bonus: float = AGE_BONUS, clip: bool = False, ts: str = "ts") -> DataFrame:
    """Add ``rating_date``: the rating plus up to ``bonus`` for old rows.

    Not clipped to the rating scale unless asked (the top value is then 5 + bonus).
    """
    value = F.col("rating") + bonus * F.col("age_norm")
    if clip:
        value = F.greatest(F.lit(1.0), F.least(F.lit(5.0), value))
    return age_norm(df, ts).withColumn("rating_date", value).drop("age_norm")


def confidence(df: DataFrame, rating: str = "rating_date", alpha: float = CONFIDENCE_ALPHA) -> DataFrame:
    """Add ``confidence`` = ln(1 + (1 + alpha * rating) / sqrt(rows of the user))."""
    counted = with_group_count(df, "user_id", "_n_user")
    raw = (1.0 + alpha * F.col(rating)) / F.sqrt(F.col("_n_user").cast("double"))
    return counted.withColumn("confidence", F.log1p(raw)).drop("_n_user")


def index_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct ids in sorted order with codes from 0.

    The position is computed over range partitions; ``dense_rank`` over the whole table would
    put every id through one task.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct()
    indexed = running_position(ids, [], [(column, True)], "_position")
    return indexed.select(column, (F.col("_position") - 1).cast("int").alias(name))


def encode(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose user and item are known to the index, with their codes."""
    return attach(attach(df, users, "user_id"), items, "item_id")


def interaction_triples(encoded: DataFrame, value: str) -> DataFrame:
    """(user_idx, item_idx, value) with repeated pairs summed."""
    return encoded.groupBy("user_idx", "item_idx").agg(F.sum(value).alias("value"))


def _with_idf(entries: DataFrame) -> DataFrame:
    """Add ``_idf`` of the entry's user: ln(items) - ln(1 + entries of the user)."""
    n_items = entries.agg(F.countDistinct("item_id").alias("n")).scalar()
    per_user = entries.groupBy("user_id").agg(F.count("*").alias("_nnz"))
    idf = F.log(n_items.cast("double")) - F.log1p(F.col("_nnz").cast("double"))
    return attach(entries, per_user.select("user_id", idf.alias("_idf")), "user_id")


def tfidf_weight(entries: DataFrame, value: str = "confidence", name: str = "tfidf", keep_idf: bool = False) -> DataFrame:
    """sqrt(value) * idf with items as documents and users as terms; repeats are own entries.

    ``keep_idf`` leaves the column ``_idf`` for a BM25 weight of the same rows.
    """
    weighed = _with_idf(entries).withColumn(name, F.sqrt(value) * F.col("_idf"))
    return weighed if keep_idf else weighed.drop("_idf")


def bm25_weight(
    entries: DataFrame,
    value: str = "tfidf",
    name: str = "bm25",
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """value * (k1 + 1) / (k1 * length + value) * idf, length = item sum over the mean item sum.

    Weights can be negative for a user with nearly every item; ALS then reads them as no
    preference. A column ``_idf`` that the entries bring along is not computed again.
    """
    entries = entries if "_idf" in entries.columns else _with_idf(entries)
    sums = entries.groupBy("item_id").agg(F.sum(value).alias("_sum"))
    mean = sums.agg(F.avg("_sum").alias("m")).scalar()
    lengths = sums.select("item_id", ((1.0 - b) + b * F.col("_sum") / mean).alias("_length"))
    v = F.col(value)
    weight = v * (k1 + 1.0) / (k1 * F.col("_length") + v) * F.col("_idf")
    return attach(entries, lengths, "item_id").withColumn(name, weight).drop("_idf", "_length")
