"""One registered query per operator of this package, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustara.llm import (
    ball_kmeans,
    byte_bpe,
    decontaminate,
    embedding_dedup,
    language_id,
    lexical_search,
    line_dedup,
    order_minhash,
    piecewise_hash,
    secret_scan,
    token_counts,
    toxicity,
    warc,
)
from gustara.llm.common import prepare, table
from gustara.operators.skew import attach

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


@query(
    "op1_embedding_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
    ), reach AS (
      SELECT vec_id AS id, vec_id AS seen FROM embeddings
      UNION
      SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
    ), n AS (
      SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
    ), c AS (
      SELECT id AS vec_id, min(seen) AS component_id FROM reach GROUP BY id
    )
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM c LEFT JOIN n USING (vec_id)
    """,
)
def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_order_minhash")
def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))


@query("op3_byte_bpe")
def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return both.select(
        "doc_id",
        (F.octet_length("tokens") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify_language(docs, language_id.fit_language(docs), keep=["doc_id"])
    return named.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op6_token_counts")
def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query(
    "op7_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i - 1 AS line, trim(regexp_replace(l[i], '\s+', ' ', 'g'), ' ') AS said, l[i] AS raw
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
           unnest(generate_series(1, len(l))) AS g(i)
    ), spoken AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place, len(string_split(said, ' ')) AS words
      FROM lines WHERE said <> ''
    ), summed AS (
      SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS total FROM spoken
    ), runs AS (
      SELECT a.doc_id, a.place, min(b.place) AS last FROM summed a JOIN summed b
      ON a.doc_id = b.doc_id AND b.place >= a.place AND b.place < a.place + 50 AND b.total - a.total + a.words >= 50
      GROUP BY ALL
    ), said AS (
      SELECT r.doc_id, r.place, r.last, string_agg(s.said, chr(10) ORDER BY s.place) AS run
      FROM runs r JOIN spoken s ON s.doc_id = r.doc_id AND s.place BETWEEN r.place AND r.last GROUP BY ALL
    ), later AS (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS n FROM said
    ), gone AS (
      SELECT DISTINCT s.doc_id, s.line FROM later l JOIN spoken s
      ON s.doc_id = l.doc_id AND s.place BETWEEN l.place AND l.last WHERE l.n > 1
    ), left_over AS (
      SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) AS text FROM lines ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id
    ), counted AS (
      SELECT doc_id, CAST(count(*) AS BIGINT) AS n_removed FROM gone GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, coalesce(c.n_removed, 0) AS n_removed
    FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN counted c USING (doc_id)
    """,
)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_decontamination")
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_secret_scan")
def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


@query(
    "op10_warc",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS payload FROM pages
    ), d AS (
      SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p
    ), k AS (
      SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
    FROM k
    """,
)
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _ball_oracle(rounds: int = 4) -> str:
    """Plain k-means on the same integers: every part against every entry, ties to the lower index."""
    steps = [
        """
        WITH kept AS (
          SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
          SELECT r, p, list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4) AS v FROM kept, range(4) AS g(p)
        ), chosen AS (
          SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS entry FROM kept ORDER BY entry LIMIT 256
        ), book0 AS (
          SELECT p, entry, v FROM parts JOIN chosen USING (r)
        )"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""
        near{n} AS (
          SELECT a.r, a.p, min(CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(a.v AS DOUBLE[])) + list_inner_product(CAST(b.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))
                                    - 2 * list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) * 256 + b.entry) AS found
          FROM parts a JOIN book{n} b USING (p) GROUP BY a.r, a.p
        )""")
        if n < rounds:
            steps.append(f"""
        cells{n} AS (
          SELECT p, found % 256 AS entry, i, sum(v[i]) AS s, count(*) AS n
          FROM near{n} JOIN parts USING (r, p), unnest(generate_series(1, len(v))) AS g(i) GROUP BY ALL
        ), moved{n} AS (
          SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM cells{n} GROUP BY ALL
        ), book{n + 1} AS (
          SELECT p, entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN moved{n} m USING (p, entry)
        )""")
    return (
        ",".join(steps)
        + f"""
        , coded AS (
          SELECT r, string_agg(printf('%02x', found % 256), '' ORDER BY p) AS code, CAST(sum(found // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY r
        ), digest AS (
          SELECT sha256(string_agg(CAST(v[i] AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256
          FROM book{rounds}, unnest(generate_series(1, len(v))) AS g(i)
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (r), digest"""
    )


@query("op11_ball_kmeans", _ball_oracle())
def ball_kmeans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_kmeans.compress_vectors(table(spark, sf_dir, "embeddings"))
    label = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("label")]
    rows = coded.select("id", "codes", "error", *label)
    errors = rows.groupBy("no_label", "label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.numbers())).encode()).hexdigest()
    return attach(rows, errors, ["no_label", "label"]).select(
        F.col("id").alias("vec_id"),
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


@query("op12_piecewise_hash")
def piecewise_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query(
    "op13_lexical_search",
    r"""
    WITH said AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), tf AS (
      SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM said GROUP BY ALL
    ), lengths AS (
      SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL
    ), corpus AS (
      SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
    ), asked AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tf, corpus GROUP BY term
    ), scores AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
      FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 10
    """,
)
def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
