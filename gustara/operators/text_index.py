"""Texts that contain a given text, by an inverted index of tokens.

Tokens are runs without white space. A text that contains a query holds the query's inner tokens as
whole tokens; the outer two may be parts of longer ones. A query with inner tokens is looked up by its
rarest ones: postings of only the asked tokens are kept, and a text has to be in all of them. A query
without inner tokens is first looked up in the vocabulary, by the rarest gram of its longer outer
token, and takes the texts of all tokens around it. ``contains`` decides on what is left. All of it is
joins and aggregates of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.operators.ordering import top_k
from gustara.operators.skew import attach
from gustara.session import materialize

RAREST = 3  # postings intersected per query
GRAM = 3


def text_match(queries: DataFrame, base: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, item_id, rank): the first ``k`` rows by id whose ``content`` contains the query ``text``.

    Case is ignored, spaces around the query too; ids are compared as text. A query that is NULL,
    empty or white space matches nothing, and a NULL content is in no result. Repeated rows of one id
    count once.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.lower(F.trim("text")).alias("txt")).distinct()
    parts = F.split("txt", r"\s+", -1)
    edges = F.array(F.element_at("parts", 1), F.element_at("parts", -1))
    whole = F.array_distinct(F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0))), lambda p: p != ""))
    longest = F.array_max(F.transform(edges, lambda e: F.struct(F.length(e).alias("n"), e.alias("e"))))["e"]
    asked = asked.where(F.length("txt") > 0).withColumn("parts", parts)
    asked = asked.select("query_id", "txt", whole.alias("whole"), longest.alias("edge"))
    asked = materialize(asked.where((F.size("whole") > 0) | (F.col("edge") != "")), "asked")
    texts = base.select(F.col("item_id").cast("string").alias("item_id"), F.lower("content").alias("body")).where(F.col("body").isNotNull())
    tokens = texts.select("item_id", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("token"))

    inner = asked.where(F.size("whole") > 0).select("query_id", F.explode("whole").alias("token"))
    outer = asked.where(F.size("whole") == 0).select("query_id", "edge")
    around = inner.limit(0) if outer.isEmpty() else materialize(_tokens_around(outer, tokens), "around")
    wanted = materialize(inner.select("token").unionByName(around.select("token")).distinct(), "wanted")
    postings = materialize(tokens.join(wanted, "token", "left_semi"), "postings")
    frequency = materialize(postings.groupBy("token").agg(F.count("*").alias("df")), "frequency")
    # A token that no text holds has no frequency, is the rarest, and leaves the query without a result.
    weighed = inner.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = materialize(top_k(weighed, ["query_id"], [F.col("df").asc(), F.col("token").asc()], RAREST), "rarest")
    needed = rarest.groupBy("query_id").agg(F.count("*").alias("needed"))
    met = postings.join(rarest.select("query_id", "token"), "token").groupBy("query_id", "item_id").agg(F.countDistinct("token").alias("n"))
    whole_hits = attach(met, needed, "query_id").where(F.col("n") == F.col("needed")).select("query_id", "item_id")
    part_hits = postings.join(around, "token").select("query_id", "item_id").distinct()
    candidates = materialize(whole_hits.unionByName(part_hits), "candidates")
    held = attach(texts, candidates.select("item_id").distinct(), "item_id", "left_semi")
    shown = attach(held.join(candidates, "item_id"), asked.select("query_id", "txt"), "query_id")
    found = shown.where(F.contains("body", "txt")).select("query_id", "item_id").distinct()
    return top_k(found, ["query_id"], [F.col("item_id").asc()], k)


def _grams(column: str, size: Column) -> Column:
    """All substrings of ``size`` characters."""
    last = F.length(column) - size
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    return F.when(last >= 0, F.array_distinct(F.transform(starts, lambda s: F.substring(F.col(column), s + 1, size)))).otherwise(F.array().cast("array<string>"))


def _tokens_around(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, token): the tokens of the vocabulary that contain a query's outer token."""
    sized = edges.withColumn("size", F.least(F.length("edge"), F.lit(GRAM)))
    grams = materialize(sized.select("query_id", "edge", "size", F.explode(_grams("edge", F.col("size"))).alias("gram")), "edge-grams")
    vocabulary = tokens.select("token").distinct()
    every = F.concat(*[_grams("token", F.lit(n)) for n in range(1, GRAM + 1)])
    listed = vocabulary.select("token", F.explode(every).alias("gram"))
    listed = materialize(listed.join(grams.select("gram").distinct(), "gram", "left_semi"), "gram-postings")
    weighed = grams.join(listed.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = materialize(top_k(weighed, ["query_id"], [F.col("n").asc(), F.col("gram").asc()], 1), "rarest-grams")
    met = listed.join(rarest.select("query_id", "edge", "gram"), "gram")
    return met.where(F.contains("token", "edge")).select("query_id", "token")
