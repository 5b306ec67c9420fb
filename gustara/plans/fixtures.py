"""The recommender's input tables, derived from the given tables, in Spark and in SQL.

Every view covers its whole source table. Interactions are events (user, item key, a rating per
event type); items are parts, with text columns spelled the way raw catalogues spell them;
vectors are the embedding rows, users' vectors being those at a fixed offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustara.operators.split import WindowedSplit, windowed_split
from gustara.session import materialize

BOUNDARY = "2024-01-21 00:00:00"
PREV_DAYS = 20
POST_DAYS = 10
MIN_ROWS = 5
USER_VECTOR_OFFSET = 100
SECOND_VECTOR_OFFSET = 200
K = 20
DIM = 64
SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- Spark views ---------------------------------------------------------------------------


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = {"error": 1.0, "signup": 2.0, "view": 3.0, "click": 4.0}
    rating = F.lit(5.0)
    for kind, value in stars.items():
        rating = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(rating)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        rating.alias("rating"),
        "ts",
        "event_id",
    )


def raw_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions as they arrive: dates broken by a line feed, some ids and ratings missing."""
    rows = interactions(spark, sf_dir)
    date = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T\n"), F.date_format("ts", "HH:mm:ss"), F.lit("\n"))
    return rows.select(
        F.when(F.col("event_id") % 97 != 5, F.col("user_id")).alias("user_id"),
        "item_id",
        F.when(F.col("event_id") % 89 != 3, F.col("rating").cast("string")).alias("rating"),
        F.when(F.col("event_id") % 83 == 1, F.lit("not a date")).otherwise(date).alias("date_last_modified"),
    )


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation interactions before any window.

    Event times stay zone-less as stored, so the time filters reach the file reader.
    """
    rows = interactions(spark, sf_dir)
    cut = F.lit(BOUNDARY).cast("timestamp_ntz")
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def final_split(spark: SparkSession, sf_dir: str) -> WindowedSplit:
    train, valid = sources(spark, sf_dir)
    return windowed_split(train, valid, PREV_DAYS, POST_DAYS, 3.0, MIN_ROWS, MIN_ROWS)


def stored_split(spark: SparkSession, sf_dir: str) -> WindowedSplit:
    """The split written once, for plans that read it several times."""
    split = final_split(spark, sf_dir)
    both = split.train.withColumn("split", F.lit("train")).unionByName(split.valid.withColumn("split", F.lit("valid")))
    stored = materialize(both, "split", partition_by="split")
    train, valid = (stored.where(F.col("split") == name).drop("split") for name in ("train", "valid"))
    return WindowedSplit(train, valid, split.users, split.items)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item catalogue: all parts, with every spelling the text columns are known to have."""
    p = table(spark, sf_dir, "part")
    kind, shape = F.col("p_partkey") % 6, F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    nutritions = (
        F.when(kind == 0, F.concat(F.lit("{'calories': {'percentDailyValue': '"), size, F.lit("'}, 'fat': {'percentDailyValue': '< 1'}}")))
        .when(kind == 1, F.lit("{'calories': {'percentDailyValue': None}, 'fat': {'percentDailyValue': '-'}}"))
        .when(kind == 2, F.lit("{'calories': {'amount': 3}}"))
        .when(kind == 3, F.lit("{'sodium': {'percentDailyValue': 'abc'}}"))
        .when(kind == 4, F.lit("{}"))
        .otherwise(F.concat(F.lit("{'iron': {'percentDailyValue': "), size, F.lit("}}")))
    )
    directions = (
        F.when(shape == 1, F.concat(F.lit("Heat The "), F.col("p_name")))
        .when(shape == 2, F.concat(F.lit("{'directions': 'Mix the "), F.col("p_name"), F.lit(r".\nBake it.\n\nthen serve "), size, F.lit(" times.'}")))
        .when(shape == 3, F.concat(F.lit("{Broken "), F.col("p_name")))
        .when(shape == 4, F.lit("{'other': 1}"))
    )
    return p.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        (F.col("p_size") / 10.0).alias("aver_rate"),
        F.col("p_size").cast("long").alias("review_nums"),
        F.when(F.col("p_size") % 10 != 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("^")), F.lit("^"), F.col("p_brand"))).alias("ingredients"),
        directions.alias("cooking_directions"),
        nutritions.alias("nutritions"),
    )


def review_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, reviews): one dict literal per event, the comment being the document of its id."""
    rows = interactions(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    text = F.coalesce("text", F.lit("no comment"))
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    literal = F.concat(
        F.lit("{'"), F.col("user_id"), F.lit("': {'rating': "), F.col("rating").cast("string"),
        F.lit(", 'dateLastModified': '"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("', 'text': '"), text, F.lit("'}}"),
    )
    return rows.join(docs, "event_id", "left").select("item_id", literal.alias("reviews"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, ts, text) of the events that have a document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return interactions(spark, sf_dir).join(docs, "event_id").select("user_id", "item_id", "ts", "text")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), "embedding", "label")


def user_vectors(spark: SparkSession, sf_dir: str, users: DataFrame, offset: int = USER_VECTOR_OFFSET) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - offset).cast("string").alias("user_id"), "embedding"
    )
    return rows.join(users, "user_id", "left_semi")


def flawed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, some replaced by the three shapes of a failed embedding."""
    flaw = F.col("vec_id") % 50
    vector = (
        F.when(flaw == 7, F.array().cast("array<float>"))
        .when(flaw == 8, F.lit(None).cast("array<float>"))
        .when(flaw == 9, F.transform("embedding", lambda x: F.lit(0).cast("float")))
        .otherwise(F.col("embedding"))
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", vector.alias("embedding"))


def poisoned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flawed vectors, and some whose first element is NaN, infinite or NULL."""
    flaw = F.col("vec_id") % 50
    bad = F.when(flaw == 10, F.lit(float("nan"))).when(flaw == 11, F.lit(float("inf"))).cast("float")
    spoilt = F.transform("embedding", lambda x, i: F.when(i == 0, bad).otherwise(x))
    vector = F.when(flaw.isin(10, 11, 12), spoilt).otherwise(F.col("embedding"))
    return flawed_vectors(spark, sf_dir).select("vec_id", vector.alias("embedding"))


# ---- The same views in SQL -----------------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "interactions": (
        (),
        """SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id,
          CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3
               WHEN 'click' THEN 4 ELSE 5 END AS DOUBLE) AS rating, ts, event_id FROM events""",
    ),
    "raw_interactions": (
        ("interactions",),
        """SELECT CASE WHEN event_id % 97 <> 5 THEN user_id END AS user_id, item_id,
          CASE WHEN event_id % 89 <> 3 THEN rating END AS rating,
          CASE WHEN event_id % 83 <> 1 THEN date_trunc('second', ts) END AS ts FROM interactions""",
    ),
    "train_all": (("interactions",), f"SELECT * FROM interactions WHERE ts < TIMESTAMP '{BOUNDARY}'"),
    "valid_all": (("interactions",), f"SELECT * FROM interactions WHERE ts >= TIMESTAMP '{BOUNDARY}'"),
    "train_w": (
        ("train_all",),
        f"SELECT * FROM train_all WHERE ts >= (SELECT max(ts) FROM train_all) - INTERVAL {PREV_DAYS} DAY",
    ),
    "valid_w": (
        ("valid_all",),
        f"""SELECT * FROM valid_all
          WHERE ts <= (SELECT min(ts) FROM valid_all) + INTERVAL {POST_DAYS} DAY AND rating >= 3""",
    ),
    "common_users": (
        ("train_w", "valid_w"),
        "SELECT user_id FROM train_w INTERSECT SELECT user_id FROM valid_w",
    ),
    "common_items": (
        ("train_w", "valid_w"),
        "SELECT item_id FROM train_w INTERSECT SELECT item_id FROM valid_w",
    ),
    "train_c": (
        ("common_users", "common_items"),
        """SELECT * FROM train_w WHERE user_id IN (SELECT user_id FROM common_users)
          AND item_id IN (SELECT item_id FROM common_items)""",
    ),
    "valid_c": (
        ("common_users", "common_items"),
        """SELECT * FROM valid_w WHERE user_id IN (SELECT user_id FROM common_users)
          AND item_id IN (SELECT item_id FROM common_items)""",
    ),
    "final_users": (
        ("train_c", "valid_c"),
        f"""SELECT user_id FROM train_c GROUP BY user_id HAVING count(*) >= {MIN_ROWS}
          INTERSECT SELECT user_id FROM valid_c GROUP BY user_id HAVING count(*) >= {MIN_ROWS}""",
    ),
    "train": (("final_users",), "SELECT * FROM train_c WHERE user_id IN (SELECT user_id FROM final_users)"),
    "valid": (("final_users",), "SELECT * FROM valid_c WHERE user_id IN (SELECT user_id FROM final_users)"),
    "final_items": (("train", "valid"), "SELECT item_id FROM train UNION SELECT item_id FROM valid"),
    "items": (
        (),
        """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_type AS category,
          p_size / 10.0 AS aver_rate, CAST(p_size AS BIGINT) AS review_nums, p_partkey, p_size, p_brand, p_name,
          CASE WHEN p_size % 10 <> 0 THEN replace(p_name, ' ', '^') || '^' || p_brand END AS ingredients FROM part""",
    ),
    "parsed": (
        ("items",),
        """SELECT item_id, title, category, aver_rate, review_nums, p_partkey,
          CASE WHEN ingredients IS NULL THEN '' ELSE '- ' || replace(ingredients, '^', chr(10) || '- ') END AS parsed_ingredients,
          CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN lower('Heat The ' || p_name)
            WHEN 2 THEN 'Mix the ' || p_name || '. Bake it. then serve ' || p_size || ' times'
            WHEN 3 THEN lower('{Broken ' || p_name) ELSE '' END AS parsed_recipe,
          CASE p_partkey % 6 WHEN 0 THEN 'calories: ' || p_size || ' percent' || chr(10) || 'fat: 0.0 percent'
            WHEN 1 THEN 'calories: None' || chr(10) || 'fat: - percent' WHEN 2 THEN 'calories: -1 percent'
            WHEN 3 THEN 'sodium: abc percent' WHEN 4 THEN '' ELSE 'iron: ' || p_size || ' percent' END AS percent_daily_values
          FROM items""",
    ),
    "truth": (("valid",), "SELECT DISTINCT user_id, item_id FROM valid"),
    "seen": (("train",), "SELECT DISTINCT user_id, item_id FROM train"),
    "item_vec": (
        (),
        "SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    ),
    "user_vec": (
        ("final_users",),
        f"""SELECT CAST(vec_id - {USER_VECTOR_OFFSET} AS VARCHAR) AS user_id, CAST(embedding AS DOUBLE[]) AS v
          FROM embeddings WHERE CAST(vec_id - {USER_VECTOR_OFFSET} AS VARCHAR) IN (SELECT user_id FROM final_users)""",
    ),
    "user_vec2": (
        ("final_users",),
        f"""SELECT CAST(vec_id - {SECOND_VECTOR_OFFSET} AS VARCHAR) AS user_id, CAST(embedding AS DOUBLE[]) AS v
          FROM embeddings WHERE CAST(vec_id - {SECOND_VECTOR_OFFSET} AS VARCHAR) IN (SELECT user_id FROM final_users)""",
    ),
    "near": (
        ("user_vec", "item_vec"),
        f"""SELECT * FROM (SELECT user_id, item_id, d AS distance, row_number() OVER (PARTITION BY user_id ORDER BY round(d, 9), item_id) AS rank
          FROM (SELECT u.user_id, i.item_id, list_cosine_distance(u.v, i.v) AS d FROM user_vec u, item_vec i)) WHERE rank <= {K}""",
    ),
    "near_unseen": (
        ("user_vec", "item_vec", "seen"),
        f"""SELECT * FROM (SELECT user_id, item_id, d AS distance, row_number() OVER (PARTITION BY user_id ORDER BY round(d, 9), item_id) AS rank
          FROM (SELECT u.user_id, i.item_id, list_cosine_distance(u.v, i.v) AS d FROM user_vec u, item_vec i
                WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = i.item_id))) WHERE rank <= {K}""",
    ),
    "near_second": (
        ("user_vec2", "item_vec", "seen"),
        f"""SELECT * FROM (SELECT user_id, item_id, d AS distance, row_number() OVER (PARTITION BY user_id ORDER BY round(d, 9), item_id) AS rank
          FROM (SELECT u.user_id, i.item_id, list_cosine_distance(u.v, i.v) AS d FROM user_vec2 u, item_vec i
                WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = i.item_id))) WHERE rank <= {K}""",
    ),
    "comments": (
        ("interactions",),
        "SELECT i.user_id, i.item_id, i.ts, d.text FROM interactions i JOIN documents d ON d.doc_id = i.event_id",
    ),
}


def sql(names: str, body: str, **extra: str) -> str:
    """``body`` after a WITH clause holding the named views, what they need, and ``extra`` ones."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in ordered:
            needs, text = CTES[name]
            for need in needs:
                add(need)
            ordered[name] = text

    for name in names.split():
        add(name)
    ordered.update(extra)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ordered.items()) + "\n" + body
