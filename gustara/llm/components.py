"""Connected components of links between integer ids, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.skew import attach
from gustara.session import materialize


def signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in ``links`` (a, b).

    Every round joins each id's neighbours to their minimum and is written; links never reach the
    driver, only their count and hash sum, to see that a round changed nothing. A hub's neighbours
    are split over tasks, and become direct neighbours of the minimum.
    """
    one = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    star = materialize(one.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = signature(star)
    while known[0]:
        both = materialize(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = attach(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = attach(large, least, "a")
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b")
        star = materialize(small.distinct(), "small-star")
        if signature(star) == known:
            break
        known = signature(star)
    roots = star.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
