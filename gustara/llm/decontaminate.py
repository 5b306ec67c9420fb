"""Benchmark passages in training texts by spaced seeds, in DataFrame functions.

A mask says which tokens of a window count; the hash of those is a seed. Seeds of all windows of
the benchmark are joined with those of the training texts, so a substituted token under a 0 of the
mask does no harm. A hit fixes how item and text are aligned; around it the longest stretch is
found in which matches outweigh substitutions, and its matching tokens decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import KEY, beside_texts, document_key, quoted, without
from gustara.operators.skew import attach
from gustara.session import materialize

# The first mask is contiguous; the others skip tokens. A substitution costs as much as this many matches.
MASKS = ("11111111", "11101101011", "1101010011011")
MIN_MATCHED, MISMATCH = 13, 3
# A seed table of at most this many rows (about 40 bytes each) is sent to every executor.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: Column) -> Column:
    """One 64-bit hash per token: runs of letters and digits, lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, carried: list[str], masks: Sequence[str] = MASKS) -> DataFrame:
    """(carried, at, before, seed, span) for every mask and window of the array ``tokens``.

    ``before`` is the token in front of the window, ``span`` the hash of all tokens below a spaced
    mask, NULL for the contiguous one.
    """
    least = min(map(len, masks))
    starts = F.when(F.size("tokens") >= least, F.sequence(F.lit(0), F.size("tokens") - least))
    placed = rows.select(*carried, "tokens", F.explode_outer(starts).alias("at"))

    def window(mask: str) -> Column:
        number = MASKS.index(mask) if mask in MASKS else -len(mask)
        here = [F.get("tokens", F.col("at") + i) for i in range(len(mask))]
        seen = F.xxhash64(F.lit(number), *[h for h, m in zip(here, mask, strict=True) if m == "1"])
        seed = F.when(F.col("at") + len(mask) <= F.size("tokens"), seen)
        span = F.xxhash64(*here) if "0" in mask else F.lit(None).cast("bigint")
        return F.struct(seed.alias("seed"), span.alias("span"))

    before = F.get("tokens", F.col("at") - 1).alias("before")
    windows = F.array(*[window(m) for m in masks])
    found = placed.where(F.col("at").isNotNull()).select(*carried, "at", before, F.explode(windows).alias("w"))
    return found.select(*carried, "at", "before", "w.seed", "w.span").where(F.col("seed").isNotNull())


def benchmark_items(benchmark: DataFrame, item_id: str, text: str, min_tokens: int) -> DataFrame:
    """(item, tokens) of the items with at least ``min_tokens`` tokens; equal ones once, by their smallest id."""
    items = benchmark.select(F.col(quoted(item_id)).alias("item"), token_hashes(F.col(quoted(text))).alias("tokens"))
    items = items.where(F.size("tokens") >= max(1, min_tokens)).groupBy("tokens").agg(F.min("item").alias("item"))
    return items.withColumn("item_key", F.xxhash64("tokens"))


def matched_tokens(item: Column, there: Column) -> Column:
    """Most matches in a stretch of two aligned token arrays where matches outweigh substitutions."""
    pairs = F.zip_with(item, there, lambda a, b: F.coalesce(a == b, F.lit(False)))
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, same: Column) -> Column:
        score = state["score"] + F.when(same, 1).otherwise(-MISMATCH)
        run = F.when(score > 0, state["run"] + same.cast("int")).otherwise(0)
        return F.struct(F.greatest(score, F.lit(0)).alias("score"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(pairs, zero, step, lambda s: s["best"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_matched: int = MIN_MATCHED, min_tokens: int = 1,
) -> DataFrame:
    """(document key, item, matched, at): every benchmark item found in every document.

    An item is found where an aligned stretch has at least ``min_matched`` matching tokens, or all of
    the item's if it has fewer; ``matched`` is the best stretch and ``at`` the token in the document
    where the item's first token lies (negative: before its start). An item shorter than the first mask
    is one contiguous seed of its own length. Items of fewer than ``min_tokens`` tokens, items
    without a token, NULL texts and NULL items are never found.
    """
    items = materialize(benchmark_items(benchmark, item_id, item_text, min_tokens), "items")
    least = min(map(len, MASKS))
    short = items.where(F.size("tokens") < least).select(F.size("tokens").alias("n")).distinct().collect()  # fewer than the mask's length
    own = ["1" * r["n"] for r in sorted(short, key=lambda r: r["n"])]
    asked = seeds(items.where(F.size("tokens") >= least), ["item_key"])
    for mask in own:
        asked = asked.unionByName(seeds(items.where(F.size("tokens") == len(mask)), ["item_key"], [mask]))
    asked = materialize(asked, "seeds").withColumnsRenamed(
        {"at": "item_at", "before": "item_before", "span": "item_span"}
    )
    if asked.count() <= BROADCAST_SEEDS:
        asked = F.broadcast(asked)
    tokens = docs.select(*document_key(docs, doc_id, text), token_hashes(F.col(quoted(text))).alias("tokens"))
    joined = seeds(tokens, KEY, [*MASKS, *own]).join(asked, "seed")
    # A contiguous hit that goes on to the left is known from its first window; a spaced hit without
    # a substitution is known from a contiguous one.
    first = F.col("item_span").isNull() & ((F.col("item_at") == 0) | ~F.col("before").eqNullSafe(F.col("item_before")))
    spaced = F.col("span") != F.col("item_span")
    hits = joined.where(first | spaced).select(*KEY, "item_key", (F.col("at") - F.col("item_at")).alias("at"))
    hits = materialize(hits.distinct(), "hits")
    # The texts of documents with a hit, then the items, beside each alignment.
    held = beside_texts(tokens, hits.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)
    both = hits.join(materialize(held, "held"), KEY).withColumnRenamed("tokens", "doc_tokens").join(items, "item_key")
    there = F.slice("doc_tokens", F.greatest(F.col("at"), F.lit(0)) + 1, F.size("tokens") + F.least(F.col("at"), F.lit(0)))
    here = F.slice("tokens", 1 - F.least(F.col("at"), F.lit(0)), F.size("tokens"))
    scored = both.select(*KEY, "item", "at", F.size("tokens").alias("n"), matched_tokens(here, there).alias("matched"))
    found = scored.where(F.col("matched") >= F.least(F.lit(min_matched), F.col("n")))
    best = F.max(F.struct("matched", (-F.col("at")).alias("place"))).alias("best")
    return found.groupBy(*KEY, "item").agg(best).select(*KEY, "item", "best.matched", (-F.col("best.place")).alias("at"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """Per row of ``docs``: its id, ``contaminated``, ``n_items``, ``first_item`` (the smallest id found,
    else NULL) and ``matched`` (its best stretch, 0 without). Rows equal in id and text agree."""
    found = contaminated(docs, benchmark, doc_id, text, **names)
    by_doc = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("item").alias("first_item"), F.max("matched").alias("best"))
    rows = docs.select(F.col(quoted(doc_id)).alias("__id"), *document_key(docs, doc_id, text))
    return attach(rows, by_doc, KEY, "left").select(
        F.col("__id").alias(doc_id),
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).alias("n_items"),
        "first_item",
        F.coalesce("best", F.lit(0)).alias("matched"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their own columns."""
    found = contaminated(docs, benchmark, doc_id, text, **names).select(*KEY).distinct()
    columns = without(docs, [])
    rows = docs.select(*[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(columns)], *document_key(docs, doc_id, text))
    clean = beside_texts(rows, found, KEY, "left_anti")
    return clean.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
