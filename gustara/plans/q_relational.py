"""Registered queries: projections, filters, joins, set operations, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustara.functions.literals import explode_reviews
from gustara.functions.scalars import lower_names, parse_timestamp
from gustara.operators import relational as R
from gustara.operators.features import item_features, ranking_matrix, user_features
from gustara.operators.history import attach_comments, latest_per_user
from gustara.operators.metrics import recall_at_k, users_at_least
from gustara.operators.ordering import head, sort_rows
from gustara.operators.split import (
    catalogue_of,
    clean_interactions,
    filter_common_ids,
    train_window,
    users_with_min_rows,
    valid_window,
)
from gustara.functions.text import nutrition_numeric
from gustara.operators.vector_search import search_matches, valid_vectors, vector_search
from gustara.operators.weights import rating_with_age
from gustara.plans.fixtures import (
    K,
    MIN_ROWS,
    POST_DAYS,
    PREV_DAYS,
    SECOND_VECTOR_OFFSET,
    USER_VECTOR_OFFSET,
    comments,
    final_split,
    flawed_vectors,
    poisoned_vectors,
    interactions,
    item_vectors,
    items,
    raw_interactions,
    review_literals,
    sources,
    sql,
    stored_split,
    table,
    user_vectors,
)
from gustara.plans.registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def r6(c):
    return F.round(c, 6)


# ---- Projections and filters ---------------------------------------------------------------


@query(
    "clean_interactions",
    sql(
        "raw_interactions",
        """SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
        CAST(month(ts) AS BIGINT) AS month, CAST(quarter(ts) AS BIGINT) AS quarter
        FROM raw_interactions WHERE user_id IS NOT NULL AND rating IS NOT NULL AND ts IS NOT NULL""",
    ),
)
def clean(spark, sf):
    rows = clean_interactions(raw_interactions(spark, sf))
    return rows.select(
        "user_id", "item_id", "rating",
        F.date_format("date_last_modified", STAMP).alias("ts_text"),
        F.col("month").cast("long").alias("month"),
        F.col("quarter").cast("long").alias("quarter"),
    )


@query("train_window", sql("train_w", "SELECT user_id, item_id, rating, event_id FROM train_w"))
def window_train(spark, sf):
    train, _ = sources(spark, sf)
    return train_window(train, PREV_DAYS).select("user_id", "item_id", "rating", "event_id")


@query("valid_window", sql("valid_w", "SELECT user_id, item_id, rating, event_id FROM valid_w"))
def window_valid(spark, sf):
    _, valid = sources(spark, sf)
    return valid_window(valid, POST_DAYS).select("user_id", "item_id", "rating", "event_id")


def _windows(spark, sf):
    train, valid = sources(spark, sf)
    return train_window(train, PREV_DAYS), valid_window(valid, POST_DAYS)


@query(
    "filter_common_ids",
    sql("train_c valid_c", "SELECT 'train' AS split, event_id FROM train_c UNION ALL SELECT 'valid', event_id FROM valid_c"),
)
def common(spark, sf):
    train, valid = filter_common_ids(*_windows(spark, sf))
    return train.select(F.lit("train").alias("split"), "event_id").union(valid.select(F.lit("valid"), "event_id"))


@query("min_interactions", sql("final_users", "SELECT user_id FROM final_users"))
def min_rows(spark, sf):
    return users_with_min_rows(*filter_common_ids(*_windows(spark, sf)), MIN_ROWS, MIN_ROWS)


@query(
    "final_items",
    sql("final_items items", "SELECT item_id, title, category FROM items WHERE item_id IN (SELECT item_id FROM final_items)"),
)
def final_catalogue(spark, sf):
    return catalogue_of(items(spark, sf), final_split(spark, sf).items).select("item_id", "title", "category")


@query(
    "valid_vector_filter",
    "SELECT vec_id, CAST(64 AS BIGINT) AS length FROM embeddings WHERE vec_id % 50 NOT IN (7, 8, 9, 10, 11, 12)",
)
def usable_vectors(spark, sf):
    return valid_vectors(poisoned_vectors(spark, sf)).select("vec_id", F.size("embedding").cast("long").alias("length"))


RECALL = """SELECT n.user_id, count(t.item_id) AS hit_count, count(t.item_id) / CAST(nullif(max(c.n), 0) AS DOUBLE) AS hit_proportion
  FROM near_unseen n LEFT JOIN truth t ON t.user_id = n.user_id AND t.item_id = n.item_id
  LEFT JOIN (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id) c ON c.user_id = n.user_id GROUP BY n.user_id"""


@query(
    "threshold_users",
    sql("near_unseen truth", "SELECT user_id, round(hit_proportion, 6) AS hit_proportion FROM recall WHERE hit_proportion >= 0.1", recall=RECALL),
)
def users_to_judge(spark, sf):
    split = stored_split(spark, sf)
    found = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    per_user = recall_at_k(found, split.valid, K)
    return users_at_least(per_user, 0.1).select("user_id", r6("hit_proportion").alias("hit_proportion"))


@query(
    "filter_by_id_list",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def by_id_list(spark, sf):
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return R.keep_ids(table(spark, sf, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "rename_project",
    "SELECT s_suppkey AS supplierid, s_name AS suppliername, round(s_acctbal / 100, 6) AS balance FROM supplier",
)
def rename_project(spark, sf):
    rows = table(spark, sf, "supplier").withColumnsRenamed({"s_suppkey": "SupplierId", "s_name": "SupplierName"})
    rows = rows.withColumn("Balance", r6(F.col("s_acctbal") / 100)).drop("s_nationkey", "s_acctbal")
    return lower_names(rows)


# ---- Joins ---------------------------------------------------------------------------------


@query(
    "left_join_using",
    sql("interactions items", "SELECT k.item_id, i.title, i.category FROM (SELECT DISTINCT item_id FROM interactions) k LEFT JOIN items i USING (item_id)"),
)
def left_join_using(spark, sf):
    ids = interactions(spark, sf).select("item_id").distinct()
    return R.lookup(ids, items(spark, sf), "item_id").select("item_id", "title", "category")


@query(
    "left_join_features",
    sql(
        "items",
        """SELECT item_id, title, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN -2.0 WHEN 2 THEN -1.0 ELSE -2.0 END AS calories,
        CASE p_partkey % 6 WHEN 5 THEN CAST(p_size AS DOUBLE) ELSE -2.0 END AS iron FROM items""",
    ),
)
def left_join_features(spark, sf):
    rows = items(spark, sf)
    nutrition = nutrition_numeric(rows.select("item_id", "nutritions"), "nutritions")
    return rows.select("item_id", "title").join(nutrition.select("item_id", "calories", "iron"), "item_id", "left")


@query(
    "training_matrix_join",
    sql(
        "train items",
        """SELECT r.user_id, r.item_id, r.rating, round(u.m, 6) AS mean_aver_rate, i.aver_rate, i.review_nums
        FROM train r JOIN (SELECT user_id, avg(rating) AS m FROM train GROUP BY user_id) u USING (user_id) JOIN items i USING (item_id)""",
    ),
)
def training_matrix(spark, sf):
    split = stored_split(spark, sf)
    rows = items(spark, sf)
    nutrition = nutrition_numeric(rows.select("item_id", "nutritions"), "nutritions")
    matrix = ranking_matrix(user_features(split.train), item_features(rows, nutrition), rating_with_age(split.train))
    return matrix.select("user_id", "item_id", "rating", r6("mean_aver_rate").alias("mean_aver_rate"), "aver_rate", "review_nums")


@query(
    "semi_join",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def semi_join(spark, sf):
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.keep_ids(table(spark, sf, "lineitem"), urgent, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("in_subquery", sql("train_all final_users", "SELECT user_id, event_id FROM train_all WHERE user_id IN (SELECT user_id FROM final_users)"))
def in_subquery(spark, sf):
    train, _ = sources(spark, sf)
    users = final_split(spark, sf).users
    return R.where_in_subquery(train, users, "user_id").select("user_id", "event_id")


@query(
    "left_join_validated",
    sql("interactions comments", "SELECT i.event_id, i.user_id, i.item_id, md5(c.text) AS comment_md5 FROM interactions i LEFT JOIN comments c ON c.user_id = i.user_id AND c.item_id = i.item_id AND c.ts = i.ts"),
)
def validated(spark, sf):
    joined = attach_comments(interactions(spark, sf), comments(spark, sf))
    return joined.select("event_id", "user_id", "item_id", F.md5("user_comment").alias("comment_md5"))


@query(
    "temporal_cutoff_join",
    sql("interactions train_all", "SELECT i.event_id FROM interactions i JOIN (SELECT user_id, max(ts) AS latest FROM train_all GROUP BY user_id) l ON i.user_id = l.user_id AND i.ts < l.latest"),
)
def cutoff(spark, sf):
    train, _ = sources(spark, sf)
    rows = interactions(spark, sf)
    return R.before_cutoff(rows, latest_per_user(train), "user_id", "ts", "latest").select("event_id")


@query(
    "natural_join",
    "SELECT c.nationkey, c.c_custkey, n.n_name FROM (SELECT c_custkey, c_nationkey AS nationkey FROM customer) c NATURAL JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation) n",
)
def natural(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return R.natural_join(customers, nations)


@query("lookup_join", sql("interactions items", "SELECT i.event_id, i.item_id, m.title, m.aver_rate FROM interactions i LEFT JOIN items m USING (item_id)"))
def lookup_join(spark, sf):
    metadata = items(spark, sf).select("item_id", "title", "aver_rate")
    return R.lookup(interactions(spark, sf), metadata, "item_id").select("event_id", "item_id", "title", "aver_rate")


@query(
    "explode_and_enrich",
    sql(
        "near_unseen items",
        """SELECT n.user_id, n.item_id, CAST(n.rank - 1 AS BIGINT) AS position, i.title, 'profile of ' || n.user_id AS user_profile_text
        FROM near_unseen n LEFT JOIN items i USING (item_id)""",
    ),
)
def explode_and_enrich(spark, sf):
    split = stored_split(spark, sf)
    found = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    lists = R.group_list(found, "user_id", ["item_id"], K)
    profiles = split.train.select("user_id", F.concat(F.lit("profile of "), "user_id").alias("user_profile_text"))
    rows = R.enrich_recommendations(lists, "item_id", profiles, items(spark, sf).select("item_id", "title"))
    return rows.select("user_id", "item_id", F.col("position").cast("long").alias("position"), "title", "user_profile_text")


@query(
    "join_suffixes",
    sql(
        "train valid",
        """SELECT user_id, t.n AS n_rows_train, round(t.m, 6) AS mean_rating_train, v.n AS n_rows_valid, round(v.m, 6) AS mean_rating_valid
        FROM (SELECT user_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1) t JOIN (SELECT user_id, count(*) AS n, avg(rating) AS m FROM valid GROUP BY 1) v USING (user_id)""",
    ),
)
def join_suffixes(spark, sf):
    split = stored_split(spark, sf)

    def summary(df):
        return df.groupBy("user_id").agg(F.count("*").alias("n_rows"), r6(F.avg("rating")).alias("mean_rating"))

    return R.join_with_suffixes(summary(split.train), summary(split.valid), ["user_id"], ("_train", "_valid"))


@query(
    "pair_lists_join",
    sql(
        "near_unseen near_second",
        """SELECT user_id, a.l AS items_first, b.l AS items_second FROM
        (SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS l FROM near_unseen GROUP BY 1) a JOIN
        (SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS l FROM near_second GROUP BY 1) b USING (user_id)""",
    ),
)
def pair_lists(spark, sf):
    split = stored_split(spark, sf)
    base = item_vectors(spark, sf)
    lists = []
    for offset in (USER_VECTOR_OFFSET, SECOND_VECTOR_OFFSET):
        found = vector_search(base, user_vectors(spark, sf, split.users, offset), K, exclude=split.train)
        lists.append(R.group_list(found, "user_id", ["item_id"], K))
    joined = R.join_with_suffixes(*lists, ["user_id"], ("_first", "_second"))
    return joined.select("user_id", F.array_join("item_id_first", ",").alias("items_first"), F.array_join("item_id_second", ",").alias("items_second"))


@query(
    "anti_join_seen",
    sql("truth seen", "SELECT user_id, item_id FROM truth EXCEPT SELECT user_id, item_id FROM seen"),
)
def anti_join_seen(spark, sf):
    split = stored_split(spark, sf)
    wanted = split.valid.select("user_id", "item_id").distinct()
    return R.drop_ids(wanted, split.train.select("user_id", "item_id"), ["user_id", "item_id"])


@query(
    "row_lookup_to_join",
    "SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 10)",
)
def row_lookup(spark, sf):
    """Data-quality count of line items whose part is missing from the listed catalogue."""
    listed = table(spark, sf, "part").where(F.col("p_size") >= 10).select(F.col("p_partkey").alias("l_partkey"))
    return R.missing_lookups(table(spark, sf, "lineitem"), listed, "l_partkey")


@query(
    "flatten_concat",
    sql("near item_vec", "SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance, CAST(label AS BIGINT) AS label, CAST(64 AS BIGINT) AS user_dim FROM near JOIN item_vec USING (item_id)"),
)
def flatten_concat(spark, sf):
    split = stored_split(spark, sf)
    base, queries_ = item_vectors(spark, sf), user_vectors(spark, sf, split.users)
    matches = search_matches(vector_search(base, queries_, K), queries_, base)
    flat = R.flatten_matches(matches)
    return flat.select(
        "user_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("distance").alias("distance"),
        F.col("label").cast("long").alias("label"), F.size("user_embedding").cast("long").alias("user_dim"),
    )


# ---- Set operations, sorting ---------------------------------------------------------------


@query("set_intersect", sql("common_items", "SELECT item_id FROM common_items"))
def set_intersect(spark, sf):
    train, valid = _windows(spark, sf)
    return train.select("item_id").intersect(valid.select("item_id"))


@query("set_union", sql("final_items", "SELECT item_id FROM final_items"))
def set_union(spark, sf):
    return final_split(spark, sf).items


@query(
    "concat_dedup",
    """SELECT item_id, title, source FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY source) AS rn FROM (
         SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, 1 AS source FROM part UNION ALL
         SELECT CAST(s_suppkey AS VARCHAR), s_name, 2 FROM supplier)) WHERE rn = 1""",
)
def concat_dedup(spark, sf):
    first = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.lit(1).alias("source"))
    second = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("item_id"), F.col("s_name").alias("title"), F.lit(2).alias("source"))
    return R.concat_first("item_id", first, second)


@query("distinct_rows", sql("interactions", "SELECT DISTINCT user_id, item_id FROM interactions"))
def distinct_rows(spark, sf):
    return interactions(spark, sf).select("user_id", "item_id").dropDuplicates(["user_id", "item_id"])


@query(
    "subset_check",
    "SELECT count(*) = 0 AS is_subset, count(*) AS n_missing FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))",
)
def subset_check(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return R.is_subset(customers, table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


@query(
    "set_minus_list",
    sql("truth", "SELECT user_id, item_id FROM truth WHERE item_id NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 50 IN (7, 8, 9))"),
)
def set_minus(spark, sf):
    """Ground truth without the items whose vector is unusable."""
    vectors = flawed_vectors(spark, sf)
    unusable = vectors.join(valid_vectors(vectors).select("vec_id"), "vec_id", "left_anti")
    truth = R.group_unique(final_split(spark, sf).valid, "user_id", "item_id")
    return R.remove_excluded(truth, unusable.select(F.col("vec_id").cast("string").alias("item_id")))


@query("sort_multi", sql("train", "SELECT user_id, item_id, event_id, rating FROM train ORDER BY user_id, rating DESC, event_id"))
def sort_multi(spark, sf):
    rows = final_split(spark, sf).train.select("user_id", "item_id", "event_id", "rating")
    return sort_rows(rows, F.col("user_id").asc(), F.col("rating").desc(), F.col("event_id").asc())


@query("limit_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def limit_head(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return head(rows, 5, F.col("o_totalprice").desc(), F.col("o_orderkey").asc())


# ---- Review rows ---------------------------------------------------------------------------


@query(
    "explode_map_entries",
    sql("interactions", """SELECT i.item_id, i.user_id, i.rating, strftime(i.ts, '%Y-%m-%d %H:%M:%S') AS ts_text, md5(coalesce(d.text, 'no comment')) AS text_md5
        FROM interactions i LEFT JOIN documents d ON d.doc_id = i.event_id"""),
)
def explode_map_entries(spark, sf):
    reviews = explode_reviews(review_literals(spark, sf))
    return reviews.select(
        "item_id", "user_id", "rating",
        F.date_format(parse_timestamp("datelastmodified"), STAMP).alias("ts_text"),
        F.md5("text").alias("text_md5"),
    )
