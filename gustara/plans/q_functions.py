"""Registered queries: scalar functions and text assembly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.functions import scalars as S
from gustara.functions import text as X
from gustara.functions.literals import python_literal_to_json
from gustara.operators import history as H
from gustara.operators import relational as R
from gustara.operators.metrics import recall_at_k
from gustara.operators.split import days
from gustara.operators.vector_search import vector_search
from gustara.operators.weights import confidence, rating_with_age
from gustara.plans.fixtures import (
    K,
    SECOND_VECTOR_OFFSET,
    SEED,
    USER_VECTOR_OFFSET,
    comments,
    final_split,
    interactions,
    item_vectors,
    items,
    sql,
    stored_split,
    table,
    user_vectors,
)
from gustara.plans.q_relational import STAMP, r6
from gustara.plans.registry import query
from gustara.schemas import POINTWISE_JUDGEMENT


@query(
    "cast_ids",
    "SELECT CAST(o_orderkey AS VARCHAR) AS item_id, CAST(o_custkey AS VARCHAR) AS user_id, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rating, CAST(TRY_CAST(o_orderstatus AS BIGINT) AS VARCHAR) AS not_an_id FROM orders",
)
def cast_ids(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("rating"),
        F.col("o_orderstatus").try_cast("long").cast("string").alias("not_an_id"),
    )


@query("strip_newlines", "SELECT doc_id, md5(replace(text, chr(10), '')) AS text_md5 FROM documents")
def strip_newlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.strip_newlines("text")).alias("text_md5"))


@query(
    "parse_timestamps",
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN event_id % 5 = 3 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text FROM events",
)
def parse_timestamps(spark, sf):
    """Five spellings, one of them not a date."""
    kind = F.col("event_id") % 5
    spelled = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 2, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.lit("soon"))
    )
    rows = interactions(spark, sf).select("event_id", spelled.alias("raw"))
    return rows.select("event_id", F.date_format(S.parse_timestamp("raw"), STAMP).alias("ts_text"))


@query(
    "date_parts",
    "SELECT event_id, CAST(month(ts) AS BIGINT) AS month, CAST(quarter(ts) AS BIGINT) AS quarter, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(hour(ts) AS BIGINT) AS hour FROM events",
)
def date_parts(spark, sf):
    parts = {"month": F.month, "quarter": F.quarter, "weekday": F.weekday, "hour": F.hour}
    return interactions(spark, sf).select("event_id", *[fn("ts").cast("long").alias(n) for n, fn in parts.items()])


@query("date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def date_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.date_text("o_orderdate").alias("date"))


@query(
    "interval_arith",
    "SELECT event_id, strftime(ts - INTERVAL 168 DAY, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ts + INTERVAL 28 DAY, '%Y-%m-%d %H:%M:%S') AS window_end FROM events",
)
def interval_arith(spark, sf):
    return interactions(spark, sf).select(
        "event_id",
        F.date_format(F.col("ts") - days(24 * 7), STAMP).alias("window_start"),
        F.date_format(F.col("ts") + days(4 * 7), STAMP).alias("window_end"),
    )


@query("split_bullets", sql("parsed", "SELECT item_id, parsed_ingredients FROM parsed"))
def split_bullets(spark, sf):
    return items(spark, sf).select("item_id", S.split_bullets("ingredients").alias("parsed_ingredients"))


@query("normalize_directions", sql("parsed", "SELECT item_id, parsed_recipe FROM parsed"))
def normalize_directions(spark, sf):
    return items(spark, sf).select("item_id", X.normalize_directions("cooking_directions").alias("parsed_recipe"))


@query(
    "python_literal_to_json",
    sql(
        "items",
        """SELECT item_id, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) END AS calories, CASE p_partkey % 6 WHEN 0 THEN '< 1' WHEN 1 THEN '-' END AS fat,
        CASE p_partkey % 6 WHEN 5 THEN CAST(p_size AS VARCHAR) END AS iron FROM items""",
    ),
)
def literal_to_json(spark, sf):
    parsed = items(spark, sf).select("item_id", python_literal_to_json("nutritions").alias("json"))
    paths = {k: F.get_json_object("json", f"$.{k}.percentDailyValue") for k in ("calories", "fat", "iron")}
    return parsed.select("item_id", *[c.alias(k) for k, c in paths.items()])


NUTRITION_SQL = "SELECT item_id, " + ", ".join(
    {
        "calories": "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN -1.0 ELSE -2.0 END",
        "fat": "CASE p_partkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 ELSE -2.0 END",
        "iron": "CASE p_partkey % 6 WHEN 5 THEN CAST(p_size AS DOUBLE) ELSE -2.0 END",
    }.get(k, "CAST(-2 AS DOUBLE)").replace("-1.0", "CAST(-1 AS DOUBLE)").replace("-2.0", "CAST(-2 AS DOUBLE)").replace("THEN 0.0", "THEN CAST(0 AS DOUBLE)")
    + f' AS "{k}"'
    for k in X.NUTRIENTS
) + " FROM items"


@query("nutrition_numeric", sql("items", NUTRITION_SQL))
def nutrition_numeric(spark, sf):
    return X.nutrition_numeric(items(spark, sf).select("item_id", "nutritions"), "nutritions").drop("nutritions")


@query("nutrition_text", sql("parsed", "SELECT item_id, percent_daily_values FROM parsed"))
def nutrition_text(spark, sf):
    return X.nutrition_text(items(spark, sf).select("item_id", "nutritions"), "nutritions").drop("nutritions")


@query(
    "map_get_default",
    "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events",
)
def map_get_default(spark, sf):
    """A present NULL stays NULL, an absent key takes the default."""
    props = F.from_json("props", T.MapType(T.StringType(), T.StringType()))
    held = (
        F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit(None).cast("string")))
        .when(F.col("event_type") == "signup", F.create_map(F.lit("other"), F.lit("x")))
        .otherwise(props)
    )
    return table(spark, sf, "events").select("event_id", "event_type", S.map_get(held, "k", F.lit("none")).alias("k"))


@query("lower_case", "SELECT page_id, md5(lower(url)) AS url_md5, lower(url) AS url FROM pages")
def lower_case(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.lower("url")).alias("url_md5"), F.lower("url").alias("url"))


@query(
    "concat_null",
    sql("items", "SELECT item_id, title || ': ' || ingredients AS line FROM items"),
)
def concat_null(spark, sf):
    return items(spark, sf).select("item_id", S.concat_or_null("title", F.lit(": "), "ingredients").alias("line"))


@query("json_extract", "SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN text END AS answer FROM documents")
def json_extract(spark, sf):
    """Document texts inside response envelopes, every seventh without a candidate."""
    answer = F.to_json(
        F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    )
    shown = F.when(F.col("doc_id") % 7 != 3, answer).otherwise(F.lit('{"candidates": []}'))
    return table(spark, sf, "documents").select("doc_id", S.envelope_text(shown).alias("answer"))


@query(
    "json_typed_parse",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN quality = 1 THEN 'true' ELSE 'false' END AS would_like, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'label ' || toxic END AS justification,
       doc_id % 3 = 2 AS is_bad FROM labels""",
)
def json_typed_parse(spark, sf):
    """Judgements written from the label table, every third of them cut short."""
    good = F.to_json(
        F.struct((F.col("quality") == 1).alias("would_like"), F.concat(F.lit("label "), F.col("toxic").cast("string")).alias("justification"))
    )
    text = F.when(F.col("doc_id") % 3 == 2, F.substring(good, 1, 12)).otherwise(good)
    parsed = table(spark, sf, "labels").select("doc_id", S.parse_answer(text, POINTWISE_JUDGEMENT).alias("a"))
    return parsed.select("doc_id", F.col("a.would_like").cast("string").alias("would_like"), "a.justification", F.col("a._bad").isNotNull().alias("is_bad"))


@query("array_length", sql("near_unseen", "SELECT user_id, count(*) AS n_items FROM near_unseen GROUP BY user_id"))
def array_length(spark, sf):
    lists = R.group_list(_unseen(spark, sf), "user_id", ["item_id"], K)
    return lists.select("user_id", F.size("item_id").cast("long").alias("n_items"))


def _unseen(spark, sf, split=None, offset=USER_VECTOR_OFFSET):
    split = split or stored_split(spark, sf)
    return vector_search(item_vectors(spark, sf), user_vectors(spark, sf, split.users, offset), K, exclude=split.train)


@query(
    "array_pluck",
    sql(
        "train",
        """SELECT user_id, string_agg(item_id, ',' ORDER BY rn) AS items_to_exclude, count(*) AS n_history FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rn FROM train) WHERE rn <= 25 GROUP BY user_id""",
    ),
)
def array_pluck(spark, sf):
    nested = H.nested_history(H.recent_history(final_split(spark, sf).train).rows)
    return nested.select("user_id", F.array_join("items_to_exclude", ",").alias("items_to_exclude"), F.col("n_history").cast("long").alias("n_history"))


@query(
    "hits_in_list",
    sql(
        "valid near_unseen",
        """SELECT v.user_id, count(*) AS list_size, count(n.item_id) AS hit_count FROM valid v LEFT JOIN near_unseen n ON n.user_id = v.user_id AND n.item_id = v.item_id GROUP BY v.user_id""",
    ),
)
def hits_in_list(spark, sf):
    """Raw validation rows as the left list, so repeats count."""
    split = stored_split(spark, sf)
    return R.hits_in_list(split.valid, _unseen(spark, sf, split), "user_id", "item_id")


@query("struct_flatten", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status FROM orders")
def struct_flatten(spark, sf):
    nested = table(spark, sf, "orders").select(
        F.struct("o_orderkey").alias("query"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("base")
    )
    return R.flatten_matches(nested)


AGED = "SELECT *, rating + 0.2 * (1 - (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM train)) / CAST((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM train) AS DOUBLE)) AS rating_date FROM train"


@query(
    "confidence",
    sql("train", "SELECT event_id, round(ln(1 + (1 + 20 * rating_date) / sqrt(count(*) OVER (PARTITION BY user_id))), 6) AS confidence FROM aged", aged=AGED),
)
def confidence_weights(spark, sf):
    rows = confidence(rating_with_age(stored_split(spark, sf).train))
    return rows.select("event_id", r6("confidence").alias("confidence"))


@query("antiquity_rating", sql("train", "SELECT event_id, round(rating_date, 6) AS rating_date FROM aged", aged=AGED))
def antiquity_rating(spark, sf):
    rows = rating_with_age(stored_split(spark, sf).train)
    return rows.select("event_id", r6("rating_date").alias("rating_date"))


@query(
    "diff_abs",
    sql(
        "near_unseen near_second truth",
        """SELECT user_id, round(abs(a.p - b.p), 6) AS abs_diff FROM
        (SELECT user_id, count(t.item_id) / 20.0 AS p FROM near_unseen n LEFT JOIN truth t USING (user_id, item_id) GROUP BY user_id) a JOIN
        (SELECT user_id, count(t.item_id) / 20.0 AS p FROM near_second n LEFT JOIN truth t USING (user_id, item_id) GROUP BY user_id) b USING (user_id)""",
    ),
)
def diff_abs(spark, sf):
    split = stored_split(spark, sf)
    rates = []
    for offset, name in ((USER_VECTOR_OFFSET, "a"), (SECOND_VECTOR_OFFSET, "b")):
        per_user = recall_at_k(_unseen(spark, sf, split, offset), split.valid, K)
        rates.append(per_user.select("user_id", (F.col("hit_count") / F.lit(float(K))).alias(name)))
    return rates[0].join(rates[1], "user_id").select("user_id", r6(F.abs(F.col("a") - F.col("b"))).alias("abs_diff"))


@query(
    "fill_sentinels",
    "SELECT c.c_custkey, coalesce(o.total, CAST(-2 AS DOUBLE)) AS total, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey",
)
def fill_sentinels(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    joined = table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey", "left")
    return joined.na.fill({"total": -2.0, "n": 0})


HISTORY_SQL = """SELECT user_id, n_history, '###########################################' || ' USER HISTORY START ' || '###########################################' || chr(10)
  || 'The user has rated ' || n_history || ' recipes, with an average rating of ' || printf('%.2f', avg_rating) || '.' || chr(10) || body
  || '###########################################' || ' USER HISTORY END ' || '###########################################' || chr(10) AS history_string
FROM (SELECT r.user_id, count(*) AS n_history, avg(r.rating) AS avg_rating, string_agg(
  chr(10) || '>>> Recipe Title: ' || coalesce(p.title, '') || chr(10) || '>>> User Rating: ' || CAST(r.rating AS VARCHAR) || chr(10)
  || '>>> Date of Interaction: ' || strftime(r.ts, '%Y-%m-%d') || chr(10) || chr(10) || '>>> User Comment: ' || coalesce(r.text, '') || chr(10) || chr(10)
  || '>>> Ingredients:' || chr(10) || coalesce(p.parsed_ingredients, '') || chr(10) || chr(10) || '>>> Cooking Directions:' || chr(10) || coalesce(p.parsed_recipe, '') || chr(10)
  || repeat('-', 44) || chr(10), '' ORDER BY r.rn) AS body
  FROM (SELECT t.*, c.text, row_number() OVER (PARTITION BY t.user_id ORDER BY t.ts DESC, t.item_id) AS rn FROM train t
        LEFT JOIN comments c ON c.user_id = t.user_id AND c.item_id = t.item_id AND c.ts = t.ts) r
  LEFT JOIN parsed p USING (item_id) WHERE r.rn <= 25 GROUP BY r.user_id)"""


def parsed_items(spark, sf):
    """The parsed catalogue; it may be one file, so its rows are spread before Python reads their literals."""
    return X.parse_items(items(spark, sf), spark.sparkContext.defaultParallelism)


def user_histories(spark, sf, split):
    """(user_id, n_history, history_string) of the split's users."""
    recent = H.recent_history(split.train, reviews=comments(spark, sf))
    return X.history_text(recent.rows, parsed_items(spark, sf))


@query("history_text", sql("train comments parsed", HISTORY_SQL))
def history_text(spark, sf):
    return user_histories(spark, sf, stored_split(spark, sf))


@query(
    "profile_prompt_text",
    sql(
        "train comments parsed",
        """SELECT 'item' AS kind, item_id AS id, 'A dish to profile:' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || chr(10) || 'Ingredients:' || chr(10)
          || parsed_ingredients || chr(10) || chr(10) || 'Cooking Directions:' || chr(10) || parsed_recipe || chr(10) || chr(10)
          || 'Describe this dish as a structured profile.' AS prompt FROM parsed
        UNION ALL SELECT 'user', user_id, 'Ratings given: ' || max(n) || ', mean rating ' || printf('%.2f', max(m)) || '.' || chr(10) || string_agg(
          chr(10) || 'Recipe Title: ' || p.title || chr(10) || 'User Rating: ' || CAST(rating AS VARCHAR) || chr(10) || 'User Comment: ' || coalesce(text, '') || chr(10)
          || 'Recipe Average Rating: ' || CAST(CAST(p.aver_rate AS DOUBLE) AS VARCHAR) || chr(10) || 'Ingredients:' || chr(10) || p.parsed_ingredients || chr(10) || 'Cooking Directions:' || chr(10) || p.parsed_recipe || chr(10)
          || '----' || chr(10), '' ORDER BY rn) || chr(10) || 'Describe this person as a structured profile.'
        FROM (SELECT t.*, c.text, count(*) OVER (PARTITION BY t.user_id) AS n, avg(t.rating) OVER (PARTITION BY t.user_id) AS m,
              row_number() OVER (PARTITION BY t.user_id ORDER BY t.ts DESC, t.item_id) AS rn
              FROM train t LEFT JOIN comments c ON c.user_id = t.user_id AND c.item_id = t.item_id AND c.ts = t.ts) JOIN parsed p USING (item_id)
        WHERE rn <= 10 GROUP BY user_id""",
    ),
)
def profile_prompts(spark, sf):
    """Short item prompts of the whole catalogue and short user prompts of the split's users."""
    parsed = parsed_items(spark, sf)
    split = stored_split(spark, sf)
    rows = H.attach_comments(split.train, comments(spark, sf)).withColumnRenamed("user_comment", "text")
    history = H.newest_rows(rows, 10).join(parsed, "item_id")
    users = X.user_prompt_text(history, H.rating_totals(split.train))
    of_items = parsed.select(
        F.lit("item").alias("kind"), F.col("item_id").alias("id"), X.item_prompt_text("title", "parsed_ingredients", "parsed_recipe").alias("prompt")
    )
    return of_items.union(users.select(F.lit("user"), "user_id", "prompt"))


@query(
    "ab_permutation",
    f"SELECT c_custkey, instr('02468ace', substr(md5(CAST(c_custkey AS VARCHAR) || ':{SEED}'), 1, 1)) > 0 AS first_is_a FROM customer",
)
def ab_permutation(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("user_id"))
    return users.select("c_custkey", X.first_is_a("user_id", SEED).alias("first_is_a"))


def _prompt_list(cte: str) -> str:
    return (
        f"SELECT n.user_id, string_agg('>>> Rank ' || (n.rank - 1) || chr(10) || '>>> Recipe Title: ' || coalesce(p.title, '') || chr(10) || '>>> Recipe Profile: ' "
        f"|| coalesce(p.parsed_ingredients, '') || chr(10) || repeat('-', 44) || chr(10), '' ORDER BY n.rank) AS body FROM {cte} n LEFT JOIN parsed p USING (item_id) GROUP BY n.user_id"
    )


_MARK = "=" * 23
PAIR_SQL = f"""SELECT user_id, CASE WHEN first THEN 'first' ELSE 'second' END AS model_a, CASE WHEN first THEN 'second' ELSE 'first' END AS model_b,
  'USER PROFILE:' || chr(10) || 'likes ' || user_id || 'Compare the two lists of recommended recipes below and determine which list better aligns with the user''s profile and preferences.' || chr(10) || chr(10)
  || chr(10) || '{_MARK} BEGIN LIST of MODEL A {_MARK}' || chr(10) || CASE WHEN first THEN v ELSE a END || chr(10) || '{_MARK} END LIST {_MARK}' || chr(10)
  || chr(10) || '{_MARK} BEGIN LIST of MODEL B {_MARK}' || chr(10) || CASE WHEN first THEN a ELSE v END || chr(10) || '{_MARK} END LIST {_MARK}' || chr(10) AS comparison_prompt
FROM (SELECT x.user_id, x.body AS v, y.body AS a, instr('02468ace', substr(md5(x.user_id || ':{SEED}'), 1, 1)) > 0 AS first FROM x JOIN y USING (user_id))"""


@query(
    "pair_prompt",
    sql(
        "near_unseen near_second parsed",
        PAIR_SQL,
        x=_prompt_list("near_unseen"),
        y=_prompt_list("near_second"),
    ),
)
def pair_prompt(spark, sf):
    split = stored_split(spark, sf)
    parsed = parsed_items(spark, sf).select("item_id", "title", F.col("parsed_ingredients").alias("item_profile_text"))
    lists = []
    for offset in (USER_VECTOR_OFFSET, SECOND_VECTOR_OFFSET):
        found = _unseen(spark, sf, split, offset).join(parsed, "item_id", "left")
        lists.append(R.group_list(found, "user_id", ["title", "item_profile_text"], K))
    lists[0] = lists[0].withColumn("user_profile_text", F.concat(F.lit("likes "), "user_id"))
    pairs = R.join_with_suffixes(*lists, ["user_id"], ("_first", "_second"))
    return X.pair_prompt(pairs, SEED).select("user_id", "model_a", "model_b", "comparison_prompt")


@query(
    "schema_prompt",
    sql(
        "parsed",
        "SELECT item_id, 'Answer as [  would_like (true only if the user would like the item)  confidence (high, medium or low)  justification (matches or mismatches between both profiles)  ]: ' || parsed_ingredients AS prompt, 'would_like BOOL, confidence STRING, justification STRING' AS output_schema FROM parsed",
    ),
)
def schema_prompts(spark, sf):
    """Every item's prompt with the answer schema spelled out."""
    instruction = f"Answer as {X.schema_prompt(POINTWISE_JUDGEMENT)}: "
    parsed = parsed_items(spark, sf)
    return parsed.select("item_id", X.prompt_text(instruction, "parsed_ingredients").alias("prompt"), F.lit(X.output_ddl(POINTWISE_JUDGEMENT)).alias("output_schema"))


@query(
    "file_stem",
    r"""SELECT page_id, regexp_extract(url, '([^/]+)\.[^./]+$', 1) AS stem,
         CASE WHEN instr(url, 'example.com/') > 0 THEN substring(url, instr(url, 'example.com/') + 12) ELSE url END AS relative FROM pages""",
)
def file_stem(spark, sf):
    """Stem of every page's address, and its path below one host where it lies there."""
    pages = table(spark, sf, "pages")
    return pages.select("page_id", S.file_stem("url").alias("stem"), S.relative_path("url", "example.com").alias("relative"))


@query("prompt_from_columns", sql("parsed", "SELECT item_id, 'Profile this: ' || parsed_ingredients || parsed_recipe || percent_daily_values AS prompt FROM parsed"))
def prompt_from_columns(spark, sf):
    parsed = parsed_items(spark, sf)
    return parsed.select("item_id", X.prompt_text("Profile this: ", "parsed_ingredients", "parsed_recipe", "percent_daily_values").alias("prompt"))
