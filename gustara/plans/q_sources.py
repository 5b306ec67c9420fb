"""Registered queries: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gustara.operators.aggregates import table_profile
from gustara.plans.fixtures import flawed_vectors, interactions, items, raw_interactions, sql, table
from gustara.plans.registry import query
from gustara.schemas import RAW_INTERACTIONS
from gustara.session import work_dir
from gustara.sources.files import binary_manifest, write_files
from gustara.sources.sql import register_functions, register_views
from gustara.sources.keyed import read_keyed, update_keyed, write_keyed
from gustara.sources.tables import (
    create_namespace,
    enrich_table,
    publish_table,
    read_csv,
    read_table,
    replace_table,
    save_table,
    update_column,
    write_csv,
)


def _scratch(spark, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(
    "scan_csv",
    sql(
        "raw_interactions",
        """SELECT user_id, item_id, CAST(rating AS DOUBLE) AS rating, strftime(ts, '%Y-%m-%dT|%H:%M:%S|') AS date_text
        FROM (SELECT r.user_id, r.item_id, r.rating, r.ts FROM raw_interactions r) WHERE ts IS NOT NULL
        UNION ALL SELECT user_id, item_id, CAST(rating AS DOUBLE), 'not a date' FROM raw_interactions WHERE ts IS NULL""",
    ),
)
def scan_csv(spark, sf):
    """Dates hold line feeds, so records span lines."""
    path = _scratch(spark, "csv")
    write_csv(raw_interactions(spark, sf), path)
    back = read_csv(spark, path, RAW_INTERACTIONS)
    return back.select(
        "user_id",
        "item_id",
        F.col("rating").cast("double").alias("rating"),
        F.replace("date_last_modified", F.lit("\n"), F.lit("|")).alias("date_text"),
    )


@query("scan_table", "SELECT * FROM customer")
def scan_table(spark, sf):
    return read_table(spark, f"{sf}/customer.parquet")


@query("scan_projected", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_projected(spark, sf):
    return read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "sink_replace",
    sql("interactions", "SELECT user_id, item_id, rating, CAST(CASE WHEN rating >= 3 THEN 1 ELSE 0 END AS BIGINT) AS positive, event_id FROM interactions"),
)
def sink_replace(spark, sf):
    """The second write replaces the table it reads, under a name that always shows a whole version."""
    create_namespace(spark, "gustara_store")
    name, folder = f"gustara_store.replaced_{uuid.uuid4().hex}", _scratch(spark, "replace")
    publish_table(interactions(spark, sf).select("user_id", "item_id", "rating", "event_id"), name, folder)
    marked = read_table(spark, name).withColumn("positive", F.when(F.col("rating") >= 3, 1).otherwise(0).cast("long"))
    publish_table(marked, name, folder)
    return read_table(spark, name)


@query(
    "ctas_enrich",
    """SELECT c.c_custkey, c.c_name, c.c_mktsegment, CAST(o.n_orders AS DOUBLE) AS n_orders FROM customer c
       LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""",
)
def ctas_enrich(spark, sf):
    path = _scratch(spark, "enrich")
    replace_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n_orders"))
    enrich_table(spark, path, counts, "c_custkey")
    return read_table(spark, path)


@query("create_namespace", sql("interactions", "SELECT user_id, item_id, rating FROM interactions"))
def create_database(spark, sf):
    """Interactions saved under a namespace that is created twice, read back by name."""
    create_namespace(spark, "gustara_store")
    create_namespace(spark, "gustara_store")
    name = f"gustara_store.interactions_{uuid.uuid4().hex}"
    save_table(interactions(spark, sf), name, _scratch(spark, "table"))
    return read_table(spark, name, ["user_id", "item_id", "rating"])


@query(
    "add_column_update",
    """SELECT vec_id, CAST(CASE WHEN vec_id % 6 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS VARCHAR) AS label, CASE WHEN vec_id % 50 = 7 THEN '' WHEN vec_id % 50 <> 8 THEN array_to_string(
         [CAST(CASE WHEN vec_id % 50 = 9 THEN 0 ELSE CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) END AS VARCHAR) FOR x IN embedding], ' ') END AS micro
       FROM embeddings""",
)
def add_column_update(spark, sf):
    """Vectors arrive keyed for some rows; the others keep NULL. Then labels are set anew, half of them to NULL."""
    target = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    updates = flawed_vectors(spark, sf).where(F.col("embedding").isNotNull())
    anew = F.when(F.col("vec_id") % 6 != 0, F.col("label") + 100).alias("label")
    relabelled = target.where(F.col("vec_id") % 3 == 0).select("vec_id", anew)
    updated = update_column(update_column(target, updates, "vec_id", "embedding"), relabelled, "vec_id", "label")
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return updated.select("vec_id", F.col("label").cast("string").alias("label"), F.array_join(scaled, " ").alias("micro"))


@query(
    "keyed_update",
    """SELECT vec_id, CAST(CASE WHEN vec_id % 6 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN CAST(label AS BIGINT) + 100 ELSE CAST(label AS BIGINT) END AS VARCHAR) AS label,
         CASE WHEN label = 3 THEN 'third' END AS note FROM embeddings""",
)
def keyed_update(spark, sf):
    """The same in a table of hash buckets, of which an update rewrites those that hold a key; a note is a new column."""
    target = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    folder = _scratch(spark, "keyed")
    write_keyed(target, folder, "vec_id", buckets=16)
    notes = target.where(F.col("label") == 3).select("vec_id", F.lit("third").alias("note"))
    anew = F.when(F.col("vec_id") % 6 != 0, F.col("label") + 100).alias("label")
    update_keyed(spark, folder, notes, "vec_id", "note")
    update_keyed(spark, folder, target.where(F.col("vec_id") % 3 == 0).select("vec_id", anew), "vec_id", "label")
    return read_keyed(spark, folder, ["vec_id", "label", "note"]).withColumn("label", F.col("label").cast("string"))


@query(
    "binary_file_manifest",
    """SELECT CAST(page_id AS VARCHAR) AS id, 'store/pages/' || page_id || '.html' AS dst, CAST(strlen(coalesce(html, '')) AS BIGINT) AS length
       FROM pages WHERE page_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def binary_file_manifest(spark, sf):
    """Every page written as a file named by its id; then the files whose id another table lists."""
    folder = _scratch(spark, "pages")
    content = F.coalesce("html", F.lit("")).cast("binary")
    write_files(table(spark, sf, "pages").select(F.col("page_id").cast("string"), content), folder, "html")
    allowed = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return binary_manifest(spark, folder, allowed, "store/pages").select("id", "dst", "length")


@query(
    "table_profile",
    """SELECT 'l_quantity' AS column_name, count(l_quantity) AS n_values, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
         min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50,
         round(quantile_cont(l_quantity, 0.75), 6) AS q75, max(l_quantity) AS max, count(*) AS table_rows FROM lineitem
       UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount),
         round(quantile_cont(l_discount, 0.25), 6), round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.75), 6), max(l_discount), count(*) FROM lineitem""",
)
def profile_table(spark, sf):
    profile = table_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    rounded = {c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")}
    return profile.withColumns(rounded)


@query(
    "sql_surface",
    sql(
        "interactions items",
        """SELECT d.item_id, d.title, d.category || ' / ' || d.title AS label, CAST(d.length AS BIGINT) AS length, d.k FROM (
          SELECT k.item_id, i.title, i.category, CASE WHEN v.vec_id % 50 IN (7) THEN 0 ELSE 64 END AS length, k.k
          FROM (SELECT DISTINCT item_id, item_id AS k FROM interactions) k LEFT JOIN items i USING (item_id) LEFT JOIN embeddings v ON CAST(v.vec_id AS VARCHAR) = k.item_id
          WHERE v.vec_id % 50 NOT IN (7, 8)) d
        WHERE d.item_id IN (SELECT item_id FROM interactions WHERE rating = 5) AND d.category IN ('PROMO', 'SMALL', 'LARGE')""",
    ),
)
def sql_surface(spark, sf):
    """CTE, derived table, USING, IN with a subquery and with a list, ||, warehouse function names."""
    register_functions(spark)
    register_views(
        spark,
        {
            "g_interactions": interactions(spark, sf).join(
                table(spark, sf, "events").select("event_id", "props"), "event_id"
            ),
            "g_items": items(spark, sf),
            "g_vectors": flawed_vectors(spark, sf).select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").cast("array<double>").alias("text_embedding")),
        },
    )
    return spark.sql(
        """
        WITH known AS (SELECT DISTINCT item_id, JSON_EXTRACT_SCALAR(props, '$.k') AS k FROM g_interactions)
        SELECT d.item_id, d.title, d.category || ' / ' || d.title AS label, CAST(d.length AS BIGINT) AS length, d.k
        FROM (
          SELECT item_id, i.title, i.category, ARRAY_LENGTH(v.text_embedding) AS length, known.k
          FROM known LEFT JOIN g_items i USING (item_id) LEFT JOIN g_vectors v USING (item_id)
          WHERE v.text_embedding IS NOT NULL AND ARRAY_LENGTH(v.text_embedding) > 0
        ) d
        WHERE d.item_id IN (SELECT item_id FROM g_interactions WHERE rating = 5)
          AND d.category IN ('PROMO', 'SMALL', 'LARGE')
        """
    )
