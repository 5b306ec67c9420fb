"""Registered queries: aggregates, windows and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustara.operators import aggregates as A
from gustara.operators import history as H
from gustara.operators import relational as R
from gustara.operators.features import user_features
from gustara.operators.metrics import recall_at_k
from gustara.operators.ordering import competition_rank
from gustara.operators.split import split_stats as stats
from gustara.operators.vector_search import vector_search
from gustara.operators.weights import age_norm
from gustara.plans.fixtures import (
    K,
    comments,
    final_split,
    flawed_vectors,
    interactions,
    item_vectors,
    items,
    sql,
    stored_split,
    table,
    user_vectors,
)
from gustara.plans.q_relational import RECALL, STAMP, r6
from gustara.plans.registry import query


def unseen_search(spark, sf, split):
    return vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)


@query(
    "global_min_max",
    "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_ts FROM events",
)
def global_min_max(spark, sf):
    found = A.min_max(interactions(spark, sf), "ts")
    return found.select(F.date_format("min_ts", STAMP).alias("min_ts"), F.date_format("max_ts", STAMP).alias("max_ts"))


@query("value_counts", "SELECT l_partkey, count(*) AS n_rows FROM lineitem GROUP BY l_partkey")
def value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "lineitem"), "l_partkey")


@query("group_count_broadcast", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders")
def group_count_broadcast(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return R.with_group_count(orders, "o_custkey", "n_orders")


DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
USER_FEATURES = (
    "SELECT user_id, round(avg(rating), 6) AS mean_aver_rate, count(DISTINCT item_id) AS count_recipes, "
    + ", ".join(f'count(*) FILTER (WHERE rating = {s}) AS "{s}_stars_rating_received"' for s in range(1, 6))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE isodow(ts) = {i + 1}) AS {d}_review_count" for i, d in enumerate(DAYS))
    + ", count(*) FILTER (WHERE hour(ts) BETWEEN 18 AND 23) AS evening_review_count FROM interactions GROUP BY user_id"
)


@query("user_features", sql("interactions", USER_FEATURES))
def features_of_users(spark, sf):
    return user_features(interactions(spark, sf)).withColumn("mean_aver_rate", r6("mean_aver_rate"))


@query("group_unique", sql("truth", "SELECT user_id, item_id FROM truth"))
def group_unique(spark, sf):
    return R.group_unique(final_split(spark, sf).valid, "user_id", "item_id")


@query(
    "group_list",
    sql(
        "near_unseen items",
        """SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS item_ids, string_agg(coalesce(title, ''), ',' ORDER BY rank) AS titles
        FROM near_unseen LEFT JOIN items USING (item_id) GROUP BY user_id""",
    ),
)
def group_list(spark, sf):
    split = stored_split(spark, sf)
    titled = R.lookup(unseen_search(spark, sf, split), items(spark, sf).select("item_id", F.col("title")), "item_id")
    titled = titled.withColumn("title", F.coalesce("title", F.lit("")))
    lists = R.group_list(titled, "user_id", ["item_id", "title"], K)
    return lists.select("user_id", F.array_join("item_id", ",").alias("item_ids"), F.array_join("title", ",").alias("titles"))


@query(
    "group_first",
    sql("interactions", "SELECT user_id, arg_min(item_id, event_id) AS item_id, arg_min(rating, event_id) AS rating FROM interactions GROUP BY user_id"),
)
def group_first(spark, sf):
    return R.group_first(interactions(spark, sf), "user_id", ["item_id", "rating"], ["event_id"])


@query(
    "quality_score",
    sql(
        "interactions",
        "SELECT user_id, count(*) FILTER (WHERE rating >= 4) AS n_liked, count(item_id) AS n_judged, round(count(*) FILTER (WHERE rating >= 4) / CAST(count(item_id) AS DOUBLE), 6) AS quality_score FROM interactions GROUP BY user_id",
    ),
)
def quality_score(spark, sf):
    verdicts = interactions(spark, sf).withColumn("verdict", F.col("rating") >= 4)
    return A.quality_score(verdicts).withColumn("quality_score", r6("quality_score"))


@query(
    "mean_std",
    sql("near_unseen truth", "SELECT count(hit_proportion) AS n_values, round(avg(hit_proportion), 6) AS mean, round(stddev_samp(hit_proportion), 6) AS std FROM recall", recall=RECALL),
)
def mean_std(spark, sf):
    split = stored_split(spark, sf)
    per_user = recall_at_k(unseen_search(spark, sf, split), split.valid, K)
    return A.mean_std(per_user, "hit_proportion").withColumns({"mean": r6("mean"), "std": r6("std")})


@query("user_rating_summary", sql("train", "SELECT user_id, count(*) AS n_rated, round(avg(rating), 6) AS avg_rating FROM train GROUP BY user_id"))
def user_rating_summary(spark, sf):
    return H.rating_totals(final_split(spark, sf).train).withColumn("avg_rating", r6("avg_rating"))


def _describe_sql(columns, source):
    line = (
        "SELECT '{c}' AS column_name, count({c}) AS n_values, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        "round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM " + source
    )
    return " UNION ALL ".join(line.format(c=c) for c in columns)


@query("describe", _describe_sql(["o_totalprice", "o_custkey"], "orders"))
def describe(spark, sf):
    described = A.describe(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return described.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "histogram",
    """SELECT CAST(least(floor((o_totalprice - lo) * 30 / (hi - lo)) + 1, 30) AS INTEGER) AS bin, count(*) AS n_rows
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""",
)
def histogram(spark, sf):
    return A.histogram(table(spark, sf, "orders"), "o_totalprice", 30)


@query("verdict_counts", sql("near_unseen truth", "SELECT hit_count, count(*) AS n_rows FROM recall GROUP BY hit_count", recall=RECALL))
def verdict_counts(spark, sf):
    split = stored_split(spark, sf)
    per_user = recall_at_k(unseen_search(spark, sf, split), split.valid, K)
    return A.verdict_counts(per_user, "hit_count")


@query(
    "embedding_length_counts",
    "SELECT CASE WHEN vec_id % 50 IN (7, 8) THEN 0 ELSE 64 END AS length, count(*) AS n_rows FROM embeddings GROUP BY 1",
)
def embedding_length_counts(spark, sf):
    return A.embedding_lengths(flawed_vectors(spark, sf))


@query(
    "matrix_density",
    """SELECT count(DISTINCT o_custkey) AS n_users, count(DISTINCT l_partkey) AS n_items, count(*) AS nnz,
       round(count(*) / (CAST(count(DISTINCT o_custkey) AS DOUBLE) * count(DISTINCT l_partkey)), 6) AS density
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def matrix_density(spark, sf):
    """Customers by parts, at the scale of the order lines."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    return A.matrix_density(lines.join(orders, "l_orderkey")).withColumn("density", r6("density"))


@query("group_sizes", sql("train", "SELECT user_id, count(*) AS group_size FROM train GROUP BY user_id"))
def group_sizes(spark, sf):
    return A.group_sizes(final_split(spark, sf).train)


@query(
    "split_stats",
    sql(
        "train valid final_items",
        """SELECT (SELECT count(DISTINCT user_id) FROM train) AS n_users, (SELECT count(*) FROM final_items) AS n_items,
        (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM valid) AS n_valid,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM train GROUP BY user_id)) AS min_train_per_user,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM valid GROUP BY user_id)) AS min_valid_per_user""",
    ),
)
def split_stats(spark, sf):
    return stats(stored_split(spark, sf))


# ---- Windows and ranks ---------------------------------------------------------------------


@query(
    "recent_history",
    sql(
        "interactions comments",
        """SELECT user_id, CAST(rn AS BIGINT) AS rank, item_id, rating, strftime(ts, '%Y-%m-%d') AS date, md5(text) AS comment_md5 FROM (
        SELECT i.*, c.text, row_number() OVER (PARTITION BY i.user_id ORDER BY i.ts DESC, i.item_id) AS rn, count(*) OVER (PARTITION BY i.user_id) AS n
        FROM interactions i LEFT JOIN comments c ON c.user_id = i.user_id AND c.item_id = i.item_id AND c.ts = i.ts) WHERE rn <= 25 AND n >= 5""",
    ),
)
def recent_history(spark, sf):
    recent = H.recent_history(interactions(spark, sf), 25, 5, reviews=comments(spark, sf)).rows
    return recent.select("user_id", F.col("rank").cast("long").alias("rank"), "item_id", "rating", "date", F.md5("user_comment").alias("comment_md5"))


@query("latest_per_user", sql("train", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM train GROUP BY user_id"))
def latest_per_user(spark, sf):
    found = H.latest_per_user(final_split(spark, sf).train)
    return found.select("user_id", F.date_format("latest", STAMP).alias("latest"))


@query(
    "rank_desc_min",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS score_rank FROM lineitem",
)
def rank_desc_min(spark, sf):
    """Lines ranked by quantity within their supplier: large groups with many ties."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return competition_rank(lines, ["l_suppkey"], "l_quantity", "score_rank")


@query(
    "topk_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def topk_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = R.best_of(orders, "o_custkey", "o_totalprice", "o_orderkey", 3)
    return best.withColumn("rank", F.col("rank").cast("long"))


@query("list_position", sql("near_unseen", "SELECT user_id, item_id, CAST(rank - 1 AS BIGINT) AS position FROM near_unseen"))
def list_position(spark, sf):
    ranked = R.list_positions(unseen_search(spark, sf, stored_split(spark, sf)))
    return ranked.select("user_id", "item_id", F.col("position").cast("long").alias("position"))


@query(
    "min_max_age",
    "SELECT event_id, round(1 - (epoch_us(ts) - lo) / CAST(hi - lo AS DOUBLE), 6) AS age_norm FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)",
)
def min_max_age(spark, sf):
    return age_norm(interactions(spark, sf)).select("event_id", r6("age_norm").alias("age_norm"))


@query(
    "head_per_user",
    sql("interactions", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rank FROM interactions) WHERE rank <= 10"),
)
def head_per_user(spark, sf):
    rows = H.newest_rows(interactions(spark, sf), 10)
    return rows.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query(
    "history_listing",
    sql(
        "train comments items",
        """SELECT t.user_id, strftime(t.ts, '%Y-%m-%d %H:%M:%S') AS ts_text, t.item_id, i.title, t.rating, md5(c.text) AS comment_md5
        FROM train t LEFT JOIN comments c ON c.user_id = t.user_id AND c.item_id = t.item_id AND c.ts = t.ts LEFT JOIN items i ON i.item_id = t.item_id""",
    ),
)
def history_listing(spark, sf):
    rows = H.history_listing(stored_split(spark, sf).train, comments(spark, sf), items(spark, sf))
    return rows.select("user_id", F.date_format("ts", STAMP).alias("ts_text"), "item_id", "title", "rating", F.md5("user_comment").alias("comment_md5"))
