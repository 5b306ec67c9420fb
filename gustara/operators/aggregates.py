"""Counts, summaries and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.selection import select_quantiles


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    counted = df.groupBy(column).agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.col("n_rows").desc(), F.col(column).asc())


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """Mean and sample deviation; NULL and NaN are left out."""
    clean = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    return df.agg(
        F.count(clean).alias("n_values"), F.avg(clean).alias("mean"), F.stddev_samp(clean).alias("std")
    )


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with the exact linear-interpolated quantiles ``q0``, ``q1``, ... of a column.

    NULLs are left out, NaN is the largest value; without a value all quantiles are NULL.
    """
    found = select_quantiles(df, [column], shares)[column]
    return df.sparkSession.range(1).select(*[F.lit(q).cast("double").alias(f"q{i}") for i, q in enumerate(found)])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, one row per numeric column; a name may repeat."""
    quartiles = select_quantiles(df, list(dict.fromkeys(columns)), (0.25, 0.5, 0.75))
    rows = []
    for name in columns:
        value = F.col(name).cast("double")
        q25, q50, q75 = (F.lit(q).cast("double") for q in quartiles[name])
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(name).alias("n_values"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                q25.alias("q25"),
                q50.alias("q50"),
                q75.alias("q75"),
                F.max(value).alias("max"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins numbered from 1, the right edge in the last bin; empty bins have no row."""
    value = F.col(column).cast("double")
    known = df.where(F.col(column).isNotNull() & ~F.isnan(value))
    lo = F.lit(low) if low is not None else known.agg(F.min(value).alias("x")).scalar()
    hi = F.lit(high) if high is not None else known.agg(F.max(value).alias("x")).scalar()
    raw = F.floor((value - lo) * bins / F.nullif(hi - lo, F.lit(0.0))) + 1
    number = F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)).cast("int")
    return known.select(number.alias("bin")).groupBy("bin").agg(F.count("*").alias("n_rows"))


def embedding_lengths(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows per vector length; NULL vectors count as length 0."""
    length = F.coalesce(F.array_size(F.col(column)), F.lit(0))
    return df.groupBy(length.alias("length")).agg(F.count("*").alias("n_rows"))


def matrix_density(interactions: DataFrame) -> DataFrame:
    """Users, items, stored entries (repeats count) and filled share of the matrix."""
    return interactions.agg(
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.count("*").alias("nnz"),
    ).withColumn(
        "density",
        F.try_divide(F.col("nnz").cast("double"), F.col("n_users").cast("double") * F.col("n_items")),
    )


def group_sizes(df: DataFrame, key: str = "user_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("group_size")).orderBy(key)


def quality_score(verdicts: DataFrame, verdict: str = "verdict", key: str = "user_id") -> DataFrame:
    """Per user: positive verdicts, judged items and their ratio (NULL verdicts count as judged)."""
    return verdicts.groupBy(key).agg(
        F.count_if(F.col(verdict)).alias("n_liked"), F.count("item_id").alias("n_judged")
    ).withColumn("quality_score", F.try_divide(F.col("n_liked"), F.col("n_judged")))


def verdict_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(column)


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def table_profile(df: DataFrame, numeric: list[str]) -> DataFrame:
    """``describe`` plus the table's row count on every line."""
    return describe(df, numeric).withColumn("table_rows", df.agg(F.count("*").alias("n")).scalar())


