"""Registered queries: generation, embeddings, vector search, judging, catalogue views."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F

from gustara.functions.text import prompt_parts
from gustara.operators import catalog, judge
from gustara.operators.filtered_search import filtered_search
from gustara.operators.generate import embed_text, generate, generate_profiles
from gustara.operators.history import newest_rows
from gustara.operators.hyde import hyde_search, semantic_search
from gustara.operators.ledger import generate_once
from gustara.operators.metrics import hit_rate_at_k, recall_at_k, recall_summary, users_at_least, users_at_most
from gustara.operators.listwise import score_listwise
from gustara.operators.ranker import review_rows
from gustara.operators.vector_index import build_index, search_index
from gustara.operators.vector_search import vector_search
from gustara.plans import rules
from gustara.plans.fixtures import (
    DIM,
    K,
    SECOND_VECTOR_OFFSET,
    SEED,
    USER_VECTOR_OFFSET,
    interactions,
    item_vectors,
    items,
    sql,
    stored_split,
    table,
    user_vectors,
)
from gustara.plans.q_functions import HISTORY_SQL, parsed_items, user_histories
from gustara.plans.q_models import fitted_ranker, one_per_pair, weighted_als_lists
from gustara.plans.q_relational import RECALL, r6
from gustara.plans.registry import query
from gustara.providers.base import Retry
from gustara.providers.offline import HashingProvider, ListMatchProvider, ProfileMatchProvider
from gustara.schemas import ITEM_PROFILE, USER_PROFILE
from gustara.session import materialize, work_dir

AT_ONCE = Retry(attempts=2, wait_seconds=0.0, give_up=None)
ITEM_COLUMNS = ("parsed_ingredients", "parsed_recipe", "percent_daily_values")


def item_profiles(spark, sf):
    parsed = parsed_items(spark, sf).select("item_id", "title", "category", *ITEM_COLUMNS)
    rows = generate_profiles(
        parsed, rules.ITEM_INSTRUCTION, ITEM_COLUMNS, rules.ITEM_PROVIDER, ITEM_PROFILE, text_name="item_profile_text"
    )
    return materialize(rows, "item-profiles")


def user_profiles(spark, sf, split):
    rows = generate_profiles(
        user_histories(spark, sf, split), rules.USER_INSTRUCTION, ("history_string",), rules.USER_PROVIDER, USER_PROFILE, text_name="user_profile_text"
    )
    return materialize(rows, "user-profiles")


ITEM_TEXT = "lower(parsed_ingredients || chr(10) || parsed_recipe || chr(10) || percent_daily_values)"
ITEM_PROFILE_SQL = f"SELECT item_id, title, category, {rules.profile_json_sql('x', rules.ITEM_PROVIDER)} AS item_profile_text, {rules.most_frequent_sql('x', rules.KINDS)} AS food_type, {rules.most_frequent_sql('x', rules.CUISINES)} AS cuisine_type, {rules.present_sql('x', rules.FLAVORS)} AS flavors FROM (SELECT item_id, title, category, {ITEM_TEXT} AS x FROM parsed)"
USER_PROFILE_SQL = f"SELECT user_id, {rules.profile_json_sql('x', rules.USER_PROVIDER)} AS user_profile_text, {rules.most_frequent_sql('x', rules.CUISINES)} AS cuisine_preference, {rules.present_sql('x', rules.USER_PROVIDER.rules['food_preferences'])} AS food_preferences FROM (SELECT user_id, lower(history_string) AS x FROM histories)"


@query("ai_generate", sql("parsed", "SELECT item_id, item_profile_text AS answer_text FROM ip", ip=ITEM_PROFILE_SQL))
def ai_generate(spark, sf):
    parsed = parsed_items(spark, sf).select("item_id", *ITEM_COLUMNS)
    rows = generate(parsed, prompt_parts(rules.ITEM_INSTRUCTION, *ITEM_COLUMNS), rules.ITEM_PROVIDER)
    return rows.where(F.col("error").isNull()).select("item_id", "answer_text")


@dataclass(frozen=True)
class RefusingProvider:
    """Answers with the length of whole texts and refuses a batch that holds a text with ``mark``."""

    mark: str

    def generate(self, requests, params):
        if any(self.mark in parts[1] for parts in requests):
            raise ValueError("text refused")
        return [f'{{"notes": "{len(parts[1])}"}}' for parts in requests]


@query("generate_retry", "SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN 'ValueError: text refused' END AS error, CASE WHEN NOT contains(text, 'token = ') THEN '{\"notes\": \"' || length(text) || '\"}' END AS answer_text FROM documents")
def generate_retry(spark, sf):
    """Refused documents (here: with a credential) get an error of their own, their batch mates an answer."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = generate(docs, prompt_parts("Summarise", "text"), RefusingProvider("token = "), retry=AT_ONCE)
    return rows.select("doc_id", "error", "answer_text")


@dataclass(frozen=True)
class SilentProvider:
    """Refuses every call."""

    def generate(self, requests, params):
        raise ValueError("asked again")


@query("generate_ledger", "SELECT doc_id, CASE WHEN contains(text, 'token = ') THEN 'ValueError: asked again' END AS error, CASE WHEN NOT contains(text, 'token = ') THEN '{\"notes\": \"' || length(text) || '\"}' END AS answer_text FROM documents")
def generate_from_ledger(spark, sf):
    """A second run asks only what the first one got no answer for: here its provider refuses, and the answers stand."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger = f"{work_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    parts = prompt_parts("Summarise", "text")
    generate_once(docs, parts, RefusingProvider("token = "), ledger, "notes", retry=AT_ONCE)
    rows = generate_once(docs, parts, SilentProvider(), ledger, "notes", retry=AT_ONCE)
    return rows.select("doc_id", "error", "answer_text")


@query("item_profiles", sql("parsed", "SELECT item_id, food_type, cuisine_type, flavors FROM ip", ip=ITEM_PROFILE_SQL))
def typed_item_profiles(spark, sf):
    return item_profiles(spark, sf).select(
        "item_id", "profile.food_type", "profile.cuisine_type", F.array_join("profile.flavor_profile", ",").alias("flavors")
    )


@query(
    "user_profiles",
    sql("train comments parsed", "SELECT user_id, user_profile_text, cuisine_preference, food_preferences FROM up", histories=HISTORY_SQL, up=USER_PROFILE_SQL),
)
def typed_user_profiles(spark, sf):
    return user_profiles(spark, sf, stored_split(spark, sf)).select(
        "user_id", "user_profile_text", "profile.cuisine_preference", F.array_join("profile.food_preferences", ",").alias("food_preferences")
    )


@query(
    "embed_text",
    sql("", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, round(v[i], 6) AS value FROM e, range(1, 65) t(i)", e=rules.embed_sql("documents", "doc_id", "text", DIM)),
)
def embed_documents(spark, sf):
    tasks = spark.sparkContext.defaultParallelism
    rows = embed_text(table(spark, sf, "documents").select("doc_id", "text"), "text", HashingProvider(DIM), concurrency=tasks)
    exploded = rows.select("doc_id", F.posexplode("embedding").alias("position", "value"))
    return exploded.select("doc_id", F.col("position").cast("long").alias("position"), r6("value").alias("value"))


NEAR_OUT = "SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM "


def _out(found):
    return found.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), r6("distance").alias("distance"))


@query(
    "vector_search",
    sql(
        "item_vec",
        f"""{NEAR_OUT}(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(distance, 9), item_id) AS rank FROM
        (SELECT u.item_id AS user_id, i.item_id, list_cosine_distance(u.v, i.v) AS distance FROM item_vec u, item_vec i)) WHERE rank <= {K}""",
    ),
)
def search(spark, sf):
    """Every stored vector as a query, by the pruning index; flawed vectors are checked by ``valid_vector_filter``."""
    base = item_vectors(spark, sf)
    return _out(search_index(build_index(base), base.withColumnRenamed("item_id", "user_id"), K))


@query("vector_search_exclude", sql("near_unseen", NEAR_OUT + "near_unseen"))
def search_unseen(spark, sf):
    split = stored_split(spark, sf)
    return _out(vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train))


@query(
    "vector_search_filtered",
    sql(
        "user_vec item_vec items",
        f"""{NEAR_OUT}(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(distance, 9), item_id) AS rank FROM
        (SELECT user_id, item_id, list_distance(u.v, i.v) AS distance FROM user_vec u, item_vec i WHERE item_id IN (SELECT item_id FROM items WHERE category = 'PROMO'))) WHERE rank <= {K}""",
    ),
)
def search_filtered(spark, sf):
    """Only items of one category, by euclidean distance."""
    split = stored_split(spark, sf)
    chosen = items(spark, sf).where(F.col("category") == "PROMO")
    base = item_vectors(spark, sf).join(chosen, "item_id", "left_semi")
    return _out(vector_search(base, user_vectors(spark, sf, split.users), K, "EUCLIDEAN"))


@query(
    "vector_search_mixed_filters",
    sql(
        "item_vec items",
        f"""{NEAR_OUT}(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(distance, 9), item_id) AS rank FROM
        (SELECT u.item_id AS user_id, i.item_id, list_cosine_distance(u.v, i.v) AS distance FROM known u JOIN known i
        ON coalesce(u.label % 3 = 0, true) OR (u.label % 3 = 1 AND i.label = u.label) OR (u.label % 3 = 2 AND i.label IN (u.label, u.label + 1) AND i.category = u.category))) WHERE rank <= {K}""",
        known="SELECT v.*, i.category FROM item_vec v LEFT JOIN items i USING (item_id)",
    ),
)
def search_mixed(spark, sf):
    """Every stored vector as a query: any item, items of its label, or items of its category and two labels."""
    base = item_vectors(spark, sf).join(items(spark, sf).select("item_id", "category"), "item_id", "left")
    base = materialize(base, "known-vectors")
    label, text = F.col("label"), F.col("label").cast("string")
    both = F.create_map(F.lit("category"), F.array("category"), F.lit("label"), F.array(text, (label + 1).cast("string")))
    wanted = F.when(label % 3 == 1, F.create_map(F.lit("label"), F.array(text))).when(label % 3 == 2, both)
    queries = base.select(F.col("item_id").alias("user_id"), "embedding", wanted.alias("filters"))
    return _out(filtered_search(base, queries, ["category", "label"], k=K))


HYDE_SQL = f"""SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(distance, 9), item_id) AS rank FROM (
    SELECT user_id, item_id, list_cosine_distance(h.v, b.v) AS distance FROM he h, ie b)) WHERE rank <= {K}"""
HYDE_CTES = {
    "histories": HISTORY_SQL,
    "ip": ITEM_PROFILE_SQL,
    "up": USER_PROFILE_SQL,
    "hp": f"SELECT user_id, {rules.profile_json_sql('x', rules.HYDE_PROVIDER)} AS hyde_text FROM (SELECT user_id, lower(user_profile_text) AS x FROM up)",
    "he": rules.embed_sql("hp", "user_id", "hyde_text", DIM),
    "ie": rules.embed_sql("ip", "item_id", "item_profile_text", DIM),
}


def hyde_lists(spark, sf, split):
    embedder = HashingProvider(DIM)
    tasks = spark.sparkContext.defaultParallelism
    profiles = item_profiles(spark, sf).select("item_id", "item_profile_text")
    base = materialize(embed_text(profiles, "item_profile_text", embedder, concurrency=tasks), "item-embeddings")
    users = user_profiles(spark, sf, split).select("user_id", "user_profile_text")
    return hyde_search(users, base, rules.HYDE_INSTRUCTION, rules.HYDE_PROVIDER, embedder, K)


@query("hyde_search", sql("train comments parsed", HYDE_SQL, **HYDE_CTES))
def hyde(spark, sf):
    return _out(hyde_lists(spark, sf, stored_split(spark, sf)))


HYDE_FOUND = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(distance, 9), item_id) AS rank FROM (
  SELECT user_id, item_id, list_cosine_distance(h.v, b.v) AS distance FROM he h, ie b)) WHERE rank <= {K}"""
RECALL_OUT = """SELECT user_id, n_truth, hit_count, hit_count > 0 AS hit, round(hit_count / CAST(n_truth AS DOUBLE), 6) AS hit_proportion FROM (
  SELECT n.user_id, count(t.item_id) AS hit_count, max(c.n) AS n_truth FROM {found} n LEFT JOIN truth t ON t.user_id = n.user_id AND t.item_id = n.item_id
  JOIN (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id) c ON c.user_id = n.user_id GROUP BY n.user_id)"""


@query("recall_at_k", sql("near_unseen truth", RECALL_OUT.format(found="near_unseen")))
def recall(spark, sf):
    """Flagship: window split, nearest unseen items per user, share of future positives found."""
    split = stored_split(spark, sf)
    found = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    return recall_at_k(found, split.valid, K).withColumn("hit_proportion", r6("hit_proportion"))


@query("hyde_recall", sql("train truth comments parsed", RECALL_OUT.format(found="found"), **HYDE_CTES, found=HYDE_FOUND))
def hyde_recall(spark, sf):
    """Share of future positives in the lists found by generated item descriptions, per user."""
    split = stored_split(spark, sf)
    return recall_at_k(hyde_lists(spark, sf, split), split.valid, K).withColumn("hit_proportion", r6("hit_proportion"))


# ---- Judging -------------------------------------------------------------------------------


def two_models(spark, sf, split):
    """Two vector searches with different user vectors as two models, so that SQL can give the same rows.

    ``judge_als_*`` compare the search with the factorisation.
    """
    base = item_vectors(spark, sf)
    lists = [
        vector_search(base, user_vectors(spark, sf, split.users, offset), K, exclude=split.train)
        for offset in (USER_VECTOR_OFFSET, SECOND_VECTOR_OFFSET)
    ]
    marked = [found.select(F.lit(m).alias("model"), "user_id", "item_id", "rank") for m, found in zip(("first", "second"), lists)]
    return materialize(marked[0].unionByName(marked[1]), "two-models")


def to_judge(spark, sf, threshold=0.05):
    split = stored_split(spark, sf)
    both = two_models(spark, sf, split)
    per_user = recall_at_k(both.where(F.col("model") == "first"), split.valid, K)
    chosen = users_at_least(per_user, threshold).select("user_id")
    rows = judge.recommendations_to_judge(both, chosen, user_profiles(spark, sf, split), item_profiles(spark, sf))
    return materialize(rows, "to-judge")


JUDGE_VIEWS = "near_unseen near_second truth train comments parsed"
JUDGE_CTES = {
    "histories": HISTORY_SQL,
    "ip": ITEM_PROFILE_SQL,
    "up": USER_PROFILE_SQL,
    "recall": RECALL,
    "rows_": """SELECT m.*, ip.title, up.user_profile_text, ip.item_profile_text, coalesce(contains(',' || up.food_preferences || ',', ',' || ip.food_type || ','), false) AS verdict,
      CASE WHEN ip.cuisine_type = up.cuisine_preference THEN 'high' ELSE 'low' END AS confidence
      FROM (SELECT 'first' AS model, user_id, item_id, rank FROM near_unseen UNION ALL SELECT 'second', user_id, item_id, rank FROM near_second) m
      LEFT JOIN up USING (user_id) LEFT JOIN ip USING (item_id) WHERE user_id IN (SELECT user_id FROM recall WHERE hit_proportion >= 0.05)""",
}


@query("recs_to_evaluate", sql(JUDGE_VIEWS, "SELECT model, user_id, item_id, CAST(rank AS BIGINT) AS rank, title, user_profile_text, item_profile_text FROM rows_", **JUDGE_CTES))
def recs_to_evaluate(spark, sf):
    return to_judge(spark, sf).withColumn("rank", F.col("rank").cast("long"))


def judged_rows(spark, sf):
    rows = judge.judge_pointwise(to_judge(spark, sf), ProfileMatchProvider(), rules.POINTWISE_INSTRUCTION)
    return materialize(rows, "judged")


@query("judge_pointwise", sql(JUDGE_VIEWS, "SELECT model, user_id, item_id, verdict, confidence FROM rows_", **JUDGE_CTES))
def judge_pointwise(spark, sf):
    return judged_rows(spark, sf).select("model", "user_id", "item_id", "verdict", "confidence")


@query("negative_verdicts", sql(JUDGE_VIEWS, "SELECT model, user_id, item_id, 'kind of item not among preferences' AS justification FROM rows_ WHERE NOT verdict", **JUDGE_CTES))
def negative_verdicts(spark, sf):
    return judge.negative_verdicts(judged_rows(spark, sf))


@query(
    "judge_pointwise_metrics",
    sql(
        JUDGE_VIEWS,
        """SELECT user_id, v.l AS n_liked_first, v.n AS n_judged_first, round(v.l / CAST(v.n AS DOUBLE), 6) AS quality_score_first, a.l AS n_liked_second, a.n AS n_judged_second, round(a.l / CAST(a.n AS DOUBLE), 6) AS quality_score_second
        FROM (SELECT user_id, count(*) FILTER (WHERE verdict) AS l, count(*) AS n FROM rows_ WHERE model = 'first' GROUP BY 1) v
        JOIN (SELECT user_id, count(*) FILTER (WHERE verdict) AS l, count(*) AS n FROM rows_ WHERE model = 'second' GROUP BY 1) a USING (user_id)""",
        **JUDGE_CTES,
    ),
)
def judge_metrics(spark, sf):
    metrics = judge.pointwise_metrics(judged_rows(spark, sf))
    return metrics.withColumns({c: r6(c) for c in ("quality_score_first", "quality_score_second")})


REAL_MODELS = ("vs", "als")


def als_to_judge(spark, sf):
    """Lists of the vector search beside those of the weighted factorisation, with the profiles of both sides."""
    split = stored_split(spark, sf)
    near = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    lists = zip(REAL_MODELS, (near, weighted_als_lists(spark, sf, split)))
    marked = [found.select(F.lit(name).alias("model"), "user_id", "item_id", "rank") for name, found in lists]
    rows = judge.recommendations_to_judge(
        marked[0].unionByName(marked[1]), split.users, user_profiles(spark, sf, split), item_profiles(spark, sf)
    )
    return materialize(rows, "to-judge")


@query("judge_als_metrics")
def judge_als(spark, sf):
    """Quality of both models per user with lists of both."""
    judged = judge.judge_pointwise(als_to_judge(spark, sf), ProfileMatchProvider(), rules.POINTWISE_INSTRUCTION)
    return judge.pointwise_metrics(materialize(judged, "judged"), REAL_MODELS)


@query("judge_als_pairwise")
def judge_als_pairwise(spark, sf):
    """Per user the model whose list was preferred, the second one being the weighted factorisation."""
    rows = judge.judge_pairwise(als_to_judge(spark, sf), ListMatchProvider(), rules.PAIRWISE_INSTRUCTION, SEED, K, models=REAL_MODELS)
    return rows.drop("error")


@query(
    "judge_pairwise",
    sql(
        JUDGE_VIEWS,
        """SELECT user_id, model_a, model_b, CASE WHEN b > a THEN 'B' ELSE 'A' END AS preferred_model, CASE WHEN b > a THEN model_b ELSE model_a END AS model_selected,
          CASE WHEN abs(a - b) >= 3 THEN 'high' ELSE 'low' END AS confidence, a || ' against ' || b || ' matching items' AS justification
        FROM (SELECT user_id, CASE WHEN f THEN 'first' ELSE 'second' END AS model_a, CASE WHEN f THEN 'second' ELSE 'first' END AS model_b, CASE WHEN f THEN v ELSE s END AS a, CASE WHEN f THEN s ELSE v END AS b
          FROM (SELECT user_id, count(*) FILTER (WHERE verdict AND model = 'first') AS v, count(*) FILTER (WHERE verdict AND model = 'second') AS s,
                instr('02468ace', substr(md5(user_id || ':""" + str(SEED) + """'), 1, 1)) > 0 AS f FROM rows_ GROUP BY user_id))""",
        **JUDGE_CTES,
    ),
)
def judge_pairwise(spark, sf):
    rows = judge.judge_pairwise(to_judge(spark, sf), ListMatchProvider(), rules.PAIRWISE_INSTRUCTION, SEED, K)
    return rows.drop("error")


@query(
    "approved_recommendations",
    sql(JUDGE_VIEWS, "SELECT model, user_id, CAST(rank AS BIGINT) AS rank, item_id, title, CASE WHEN verdict THEN 'approved' ELSE 'experimental' END AS status, confidence, CASE WHEN verdict THEN 'kind of item preferred by user' ELSE 'kind of item not among preferences' END AS justification FROM rows_", **JUDGE_CTES),
)
def approved(spark, sf):
    return judge.approved_recommendations(judged_rows(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


# ---- Catalogue -----------------------------------------------------------------------------

MAX_DISTANCE = 0.35
SEMANTIC_SQL = f"""SELECT CAST(query_id AS VARCHAR) AS query_id, item_id, CAST(rank AS BIGINT) AS rank, source FROM (
  SELECT query_id, item_id, rank, 'vector' AS source FROM hits UNION ALL
  SELECT query_id, item_id, rank, 'text' FROM (SELECT b.item_id AS query_id, CAST(d.doc_id AS VARCHAR) AS item_id, row_number() OVER (PARTITION BY b.item_id ORDER BY CAST(d.doc_id AS VARCHAR)) AS rank
    FROM benchmark b, documents d WHERE contains(lower(d.text), lower(trim(b.text))) AND b.item_id NOT IN (SELECT query_id FROM hits) AND d.lang = 'en') WHERE rank <= {K})"""


@query(
    "semantic_search",
    sql(
        "",
        SEMANTIC_SQL,
        de=rules.embed_sql("documents", "doc_id", "text", DIM),
        be=rules.embed_sql("benchmark", "item_id", "text", DIM),
        hits=f"""SELECT * FROM (SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item_id) AS rank FROM (
          SELECT be.item_id AS query_id, CAST(de.doc_id AS VARCHAR) AS item_id, list_cosine_distance(be.v, de.v) AS distance FROM be, de WHERE de.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))) WHERE rank <= {K} AND distance <= {MAX_DISTANCE}""",
    ),
)
def semantic(spark, sf):
    """Benchmark passages looked up in all English documents."""
    embedder = HashingProvider(DIM)
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"), F.col("lang").alias("category"))
    base = materialize(embed_text(docs, "content", embedder, concurrency=spark.sparkContext.defaultParallelism), "documents")
    queries_ = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    found = semantic_search(queries_, base, embedder, K, MAX_DISTANCE, "en")
    return found.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "source")


@query(
    "catalog_browse",
    sql("items interactions", "SELECT i.item_id, i.title, i.category, coalesce(r.n, 0) AS n_ratings, round(r.m, 6) AS community_rating FROM items i LEFT JOIN (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY 1) r USING (item_id)"),
)
def catalog_browse(spark, sf):
    shown = catalog.browse(items(spark, sf), interactions(spark, sf))
    return shown.withColumn("community_rating", r6("community_rating"))


@query(
    "recall_summary",
    sql("near_unseen truth", "SELECT count(*) AS n_users, CAST(sum(hit_count) AS BIGINT) AS n_hits, round(avg(hit_proportion), 6) AS avg_hit_proportion, round(stddev_samp(hit_proportion), 6) AS std_hit_proportion FROM recall", recall=RECALL),
)
def summary(spark, sf):
    split = stored_split(spark, sf)
    found = vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users), K, exclude=split.train)
    row = recall_summary(recall_at_k(found, split.valid, K))
    return row.withColumns({c: r6(c) for c in ("avg_hit_proportion", "std_hit_proportion")})


@query("poor_user_review")
def poor_user_review(spark, sf):
    """Users the model serves badly: their newest history beside ranked predictions and truth, with all profiles."""
    split, _, valid, ranker = fitted_ranker(spark, sf)
    scored = materialize(one_per_pair(score_listwise(ranker, valid)), "scored")
    poor = materialize(users_at_most(hit_rate_at_k(scored), 0.2, "hit_rate").select("user_id"), "poor")
    history = newest_rows(split.train.join(poor, "user_id", "left_semi"), 5)
    return review_rows(
        scored.join(poor, "user_id", "left_semi"),
        history,
        items(spark, sf),
        item_profiles(spark, sf).select("item_id", "item_profile_text"),
        user_profiles(spark, sf, split).select("user_id", "user_profile_text"),
    )
