"""Registered queries: weights, factorisation, ranking metrics, features and the ranking model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gustara.functions.text import nutrition_numeric
from gustara.operators.als import als_fit, als_recommend
from gustara.operators.features import (
    ITEM_NUTRIENTS,
    item_features,
    ranking_matrix,
    require_same_users,
    user_features,
)
from gustara.operators.listwise import fit_listwise, score_listwise
from gustara.operators.metrics import (
    graded_ndcg_at_k,
    hit_rate_at_k,
    ranking_metrics,
    recall_at_k,
    results_table,
)
from gustara.operators.ranker import importance_order, rank_items
from gustara.operators.skew import attach
from gustara.operators.vector_search import vector_search
from gustara.operators.weighted_als import fold_in, weighted_als_fit
from gustara.operators.weights import (
    bm25_weight,
    confidence,
    encode,
    index_ids,
    interaction_triples,
    rating_with_age,
    tfidf_weight,
)
from gustara.plans.fixtures import (
    K,
    interactions,
    item_vectors,
    items,
    sql,
    stored_split,
    table,
    user_vectors,
)
from gustara.plans.q_aggregates import USER_FEATURES
from gustara.plans.q_functions import AGED, NUTRITION_SQL
from gustara.plans.q_relational import r6
from gustara.plans.registry import query
from gustara.session import materialize


def order_lines(spark, sf):
    """Customer and part of every order line, with a rating from its quantity."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("user_id"))
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_partkey").cast("string").alias("item_id"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating")
    )
    return lines.join(orders, "l_orderkey").select("user_id", "item_id", "rating")


LINES = "SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
CODES = "SELECT {c}, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {n} FROM (SELECT DISTINCT {c} FROM lines)"
CODE_CTES = {"lines": LINES, "u": CODES.format(c="user_id", n="user_idx"), "i": CODES.format(c="item_id", n="item_idx")}


@query("index_ids", sql("", "SELECT user_id, user_idx FROM u", lines=LINES, u=CODE_CTES["u"]))
def indexed(spark, sf):
    return index_ids(order_lines(spark, sf), "user_id", "user_idx")


@query("interaction_triples", sql("", "SELECT user_idx, item_idx, round(sum(rating), 6) AS value FROM lines JOIN u USING (user_id) JOIN i USING (item_id) GROUP BY 1, 2", **CODE_CTES))
def triples(spark, sf):
    rows = materialize(order_lines(spark, sf), "order-lines")
    coded = encode(rows, index_ids(rows, "user_id", "user_idx"), index_ids(rows, "item_id", "item_idx"))
    return interaction_triples(coded, "rating").withColumn("value", r6("value"))


WEIGHTS = {
    "aged": AGED,
    "conf": "SELECT event_id, user_id, item_id, ln(1 + (1 + 20 * rating_date) / sqrt(count(*) OVER (PARTITION BY user_id))) AS c FROM aged",
    "idf": "SELECT user_id, ln((SELECT count(DISTINCT item_id) FROM conf)) - ln(1 + count(*)) AS idf FROM conf GROUP BY user_id",
    "tf": "SELECT event_id, user_id, item_id, idf, sqrt(c) * idf AS t FROM conf JOIN idf USING (user_id)",
    "len": "SELECT item_id, 0.2 + 0.8 * s / (SELECT avg(s) FROM (SELECT sum(t) AS s FROM tf GROUP BY item_id)) AS l FROM (SELECT item_id, sum(t) AS s FROM tf GROUP BY item_id)",
}


def weighted(spark, sf):
    return confidence(rating_with_age(stored_split(spark, sf).train)).select("event_id", "user_id", "item_id", "confidence")


@query("tfidf_weight", sql("train", "SELECT event_id, round(t, 6) AS tfidf FROM tf", **WEIGHTS))
def tfidf(spark, sf):
    return tfidf_weight(weighted(spark, sf)).select("event_id", r6("tfidf").alias("tfidf"))


@query("bm25_weight", sql("train", "SELECT event_id, round(t * 101 / (100 * l + t) * idf, 6) AS bm25 FROM tf JOIN len USING (item_id)", **WEIGHTS))
def bm25(spark, sf):
    rows = materialize(tfidf_weight(weighted(spark, sf), keep_idf=True), "tfidf")
    return bm25_weight(rows).select("event_id", r6("bm25").alias("bm25"))


def weighted_als_lists(spark, sf, split):
    """Unseen items per user by the factorisation of the confidence, TF-IDF and BM25 weights of the training split."""
    entries = confidence(rating_with_age(split.train)).select("user_id", "item_id", "confidence")
    rows = materialize(tfidf_weight(entries, keep_idf=True), "tfidf")
    return als_recommend(weighted_als_fit(bm25_weight(rows), "bm25", iterations=10), split.train, K)


@query("als_fit")
def fit(spark, sf):
    """Norm of every user's factors."""
    fitted = als_fit(interactions(spark, sf), max_iter=10)
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return fitted.user_vectors().select("user_id", F.size("embedding").alias("n_factors"), F.sqrt(squares).alias("length"))


@query("als_recommend")
def recommend(spark, sf):
    split = stored_split(spark, sf)
    return als_recommend(als_fit(split.train, max_iter=10), split.train, K)


@query(
    "ranking_metrics",
    sql(
        "near_unseen truth",
        """SELECT count(*) AS n_users, round(sum(hits) / CAST(sum(p) AS DOUBLE), 6) AS precision_at_k, round(avg(ap / p), 6) AS map_at_k, round(avg(dcg / ideal), 6) AS ndcg_at_k FROM (
          SELECT c.user_id, least(5, c.n) AS p, (SELECT sum(1 / log2(x + 1)) FROM range(1, 6) r(x) WHERE x <= c.n) AS ideal, coalesce(h.hits, 0) AS hits, coalesce(h.ap, 0) AS ap, coalesce(h.dcg, 0) AS dcg
          FROM (SELECT user_id, count(*) AS n FROM truth GROUP BY 1) c LEFT JOIN (
            SELECT user_id, count(*) AS hits, sum(so_far / CAST(rank AS DOUBLE)) AS ap, sum(1 / log2(rank + 1)) AS dcg FROM (
              SELECT n.user_id, n.rank, row_number() OVER (PARTITION BY n.user_id ORDER BY n.rank) AS so_far FROM near_unseen n JOIN truth t USING (user_id, item_id) WHERE n.rank <= 5) GROUP BY 1) h USING (user_id))""",
    ),
)
def metrics_of_ranking(spark, sf):
    split = stored_split(spark, sf)
    found = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    row = ranking_metrics(found, split.valid, 5)
    return row.withColumns({c: r6(c) for c in ("precision_at_k", "map_at_k", "ndcg_at_k")})


@query("als_weighted_recommend")
def recommend_weighted(spark, sf):
    return weighted_als_lists(spark, sf, stored_split(spark, sf))


@query("als_fold_in")
def recommend_folded(spark, sf):
    """Lists of validation users by factors solved from their validation rows alone, on the training items.

    The items a user has met there are left out, as for a user of the fit.
    """
    split = stored_split(spark, sf)
    fitted = weighted_als_fit(split.train, iterations=5)
    folded = replace(fitted, users=fold_in(fitted, split.valid))
    return als_recommend(folded, split.valid, K)


@query("als_recall_at_k")
def als_recall(spark, sf):
    """Share of future positives in the lists of the weighted factorisation, per user."""
    split = stored_split(spark, sf)
    return recall_at_k(weighted_als_lists(spark, sf, split), split.valid, K)


@query("als_ranking_metrics")
def als_metrics(spark, sf):
    split = stored_split(spark, sf)
    return ranking_metrics(weighted_als_lists(spark, sf, split), split.valid, 5)


def scored_pairs(spark, sf, rows):
    """One row per (user, item): best rating, and the item's community rating as the score."""
    pairs = rating_with_age(rows).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"), F.max("rating_date").alias("rating_date"))
    return pairs.join(items(spark, sf).select("item_id", F.col("aver_rate").alias("score")), "item_id")


SCORED = """SELECT user_id, item_id, max(a.rating) AS rating, max(a.rating_date) AS rating_date, max(i.aver_rate) AS score FROM {aged} a JOIN items i USING (item_id) GROUP BY 1, 2"""
AGED_VALID = AGED.replace("FROM train", "FROM valid")
HIT_RATE = """SELECT user_id, count(*) FILTER (WHERE p <= 5 AND t <= 5) / 5.0 AS hit_rate FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY rating_date DESC, item_id) AS t FROM {scored}) GROUP BY user_id"""


@query("hit_rate_at_k", sql("train items", "SELECT user_id, round(hit_rate, 6) AS hit_rate FROM h", aged=AGED, scored=SCORED.format(aged="aged"), h=HIT_RATE.format(scored="scored")))
def hit_rate(spark, sf):
    scored = materialize(scored_pairs(spark, sf, stored_split(spark, sf).train), "scored")
    return hit_rate_at_k(scored).withColumn("hit_rate", r6("hit_rate"))


@query(
    "ndcg_at_k_graded",
    sql(
        "train items",
        """SELECT a.user_id, round(a.d / b.d, 6) AS ndcg FROM
        (SELECT user_id, sum(rating / log2(r + 1)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM scored) WHERE r <= 10 GROUP BY 1) a JOIN
        (SELECT user_id, sum(rating / log2(r + 1)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM scored) WHERE r <= 10 GROUP BY 1) b USING (user_id)""",
        aged=AGED,
        scored=SCORED.format(aged="aged"),
    ),
)
def graded_ndcg(spark, sf):
    scored = materialize(scored_pairs(spark, sf, stored_split(spark, sf).train), "scored")
    return graded_ndcg_at_k(scored, k=10).withColumn("ndcg", r6("ndcg"))


@query(
    "ndcg_tie_averaged",
    sql(
        "train items",
        """SELECT a.user_id, round(a.d / b.d, 6) AS ndcg FROM
        (SELECT user_id, sum(mean * CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) AS d FROM (SELECT user_id, avg(rating) OVER (PARTITION BY user_id, floor(score)) AS mean, row_number() OVER (PARTITION BY user_id ORDER BY floor(score) DESC) AS r FROM scored) GROUP BY 1) a JOIN
        (SELECT user_id, sum(rating / log2(r + 1)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM scored) WHERE r <= 10 GROUP BY 1) b USING (user_id)""",
        aged=AGED,
        scored=SCORED.format(aged="aged"),
    ),
)
def tie_averaged_ndcg(spark, sf):
    """The community rating in whole stars as the score, so most rows of a user are tied."""
    scored = scored_pairs(spark, sf, stored_split(spark, sf).train).withColumn("score", F.floor("score"))
    return graded_ndcg_at_k(materialize(scored, "scored"), k=10, average_ties=True).withColumn("ndcg", r6("ndcg"))


PRODUCT = "SELECT i.item_id, i.aver_rate, i.review_nums, " + ", ".join(f'n."{k}"' for k in ITEM_NUTRIENTS) + " FROM items i JOIN nutrition n USING (item_id)"


def product_rows(spark, sf):
    rows = items(spark, sf)
    tasks = spark.sparkContext.defaultParallelism  # the catalogue may be one file
    return item_features(rows, nutrition_numeric(rows.select("item_id", "nutritions"), "nutritions", partitions=tasks))


@query("product_features", sql("items", PRODUCT, nutrition=NUTRITION_SQL))
def product_features(spark, sf):
    return product_rows(spark, sf)


@query(
    "ltr_matrix",
    sql(
        "train items",
        """SELECT p.*, u.* EXCLUDE (user_id), a.user_id, a.rating, round(a.rating_date, 6) AS rating_date, count(*) OVER (PARTITION BY a.user_id) AS group_size
        FROM aged a JOIN uf u ON u.user_id = a.user_id JOIN p ON p.item_id = a.item_id""",
        aged=AGED,
        uf=USER_FEATURES.replace("FROM interactions", "FROM train"),
        nutrition=NUTRITION_SQL,
        p=PRODUCT,
    ),
)
def ltr_matrix(spark, sf):
    """Training matrix with the size of each ranking group; both splits cover the same users."""
    split = stored_split(spark, sf)
    require_same_users(split.train, split.valid)
    users = user_features(split.train).withColumn("mean_aver_rate", r6("mean_aver_rate"))
    matrix = ranking_matrix(users, product_rows(spark, sf), rating_with_age(split.train))
    sizes = split.train.groupBy("user_id").agg(F.count("*").alias("group_size"))
    return attach(matrix, sizes, "user_id").withColumn("rating_date", r6("rating_date"))


@query(
    "results_table",
    sql(
        "train valid items",
        """SELECT user_id, round(v.hit_rate, 6) AS val_hit_rate, round(t.hit_rate, 6) AS train_hit_rate, round(v.hit_rate - t.hit_rate, 6) AS diff, round(abs(v.hit_rate - t.hit_rate), 6) AS abs_diff FROM hv v JOIN ht t USING (user_id)""",
        aged=AGED,
        aged_v=AGED_VALID,
        st=SCORED.format(aged="aged"),
        sv=SCORED.format(aged="aged_v"),
        ht=HIT_RATE.format(scored="st"),
        hv=HIT_RATE.format(scored="sv"),
    ),
)
def results(spark, sf):
    split = stored_split(spark, sf)
    rates = [hit_rate_at_k(materialize(scored_pairs(spark, sf, rows), "scored")) for rows in (split.valid, split.train)]
    joined = results_table(*rates)
    return joined.withColumns({c: r6(c) for c in ("val_hit_rate", "train_hit_rate", "diff", "abs_diff")})


# ---- Ranking model -------------------------------------------------------------------------


RANKER = {"rounds": 500, "max_depth": 8, "step": 0.05}  # the surveyed model's trees (SURVEY M13)


def fitted_ranker(spark, sf):
    """Split, ranking matrices of both splits (features of the training split) and the model."""
    split = stored_split(spark, sf)
    users, products = user_features(split.train), product_rows(spark, sf)
    train, valid = (materialize(ranking_matrix(users, products, rating_with_age(rows)), "matrix") for rows in (split.train, split.valid))
    return split, train, valid, fit_listwise(train, **RANKER)


def one_per_pair(scored):
    """Scored rows to one per (user, item): the best rating and score of repeats."""
    return scored.groupBy("user_id", "item_id").agg(*[F.max(c).alias(c) for c in ("rating", "rating_date", "score")])


@query("rank_model")
def ranker_hit_rates(spark, sf):
    """Hit rate of the ranking model per user in both splits."""
    _, train, valid, ranker = fitted_ranker(spark, sf)
    return results_table(*[hit_rate_at_k(materialize(one_per_pair(score_listwise(ranker, m)), "scored")) for m in (valid, train)])


@query("score_and_rank_items")
def score_and_rank(spark, sf):
    _, _, valid, ranker = fitted_ranker(spark, sf)
    return rank_items(one_per_pair(score_listwise(ranker, valid)), items(spark, sf))


@query(
    "rank_stored_scores",
    sql(
        "valid items",
        """SELECT s.*, CAST(rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS BIGINT) AS score_rank, title
        FROM (SELECT user_id, item_id, rating, round(rating_date, 6) AS rating_date, score FROM scored) s LEFT JOIN (SELECT item_id, title FROM items) USING (item_id)""",
        aged=AGED_VALID,
        scored=SCORED.format(aged="aged"),
    ),
)
def rank_stored(spark, sf):
    """The table of ``score_and_rank_items`` with a stored score, where SQL can give the same rows."""
    scored = scored_pairs(spark, sf, stored_split(spark, sf).valid).withColumn("rating_date", r6("rating_date"))
    ranked = rank_items(scored, items(spark, sf))
    return ranked.withColumn("score_rank", F.col("score_rank").cast("long"))


@query("importance_order")
def importances(spark, sf):
    _, _, _, ranker = fitted_ranker(spark, sf)
    return importance_order(ranker, spark)
