"""Toxicity scores: a linear model over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams. Each n-gram carries the logarithm of how much
more often labelled toxic texts hold it than clean ones; a logistic model is fitted on top of the
scaled features. The fit uses a bounded sample of labelled rows, scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import named, numbered, quoted, text_stage
from gustara.llm.linear import BITS, ORDERS, Grams, fit_logistic, log_count_ratio
from gustara.session import materialize

MOST_ROWS_PER_LABEL = 2000
# An n-gram is a feature if this many sampled texts hold it and its share of toxic ones differs
# from the sample's by this many standard deviations: the rest would only fit noise in the labels.
LEAST_TEXTS, LEAST_DEVIATION = 5, 5.0


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def scores(self, texts: list[str | None], grams: Grams) -> list[float]:
        margins = [self.bias + float(self.weights[grams.of(t or "")].sum()) for t in texts]
        return (1 / (1 + np.exp(-np.clip(margins, -30, 30)))).tolist()


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = MOST_ROWS_PER_LABEL,
    smoothing: float = 0.1,
    penalty: float = 1e-4,
    rounds: int = 150,
    rate: float = 0.05,
) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled texts of each label, the first ones by a hash of the id.

    The sample's classes are weighted back to their shares among all usable labelled rows. Rows
    with a NULL or held-out id, a label other than 0 and 1, or no text row are not learned from; an
    id labelled twice with both values is learned as toxic, and of rows that share an id the first text
    in order is learned from. Without both labels the model scores
    every text with the share of toxic rows.

    N-grams are counted and chosen by Spark; the driver receives the chosen ones of the sample.
    """
    usable = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).where(
        F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id"))
    )
    usable = usable.groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))
    known = usable.join(docs.select(F.col(doc_id).alias("__id")).distinct(), "__id", "left_semi")
    share = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        toxic = share.get(1, 0)
        margin = np.log((toxic + 0.5) / (total - toxic + 0.5))
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(margin))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = [known.where(F.col("__label") == side).orderBy(*order).limit(most_rows) for side in (0, 1)]
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(chosen[0].union(chosen[1])), "__id"
    )
    sample = sample.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))

    def make():
        grams = Grams()
        return lambda texts: [[grams.of(t or "").astype(np.int32) for t in texts]]

    rows = materialize(text_stage(sample, "__text", make, {"__grams": "array<int>"}, ["__id", "__label"]), "grams")
    held = rows.select("__id", "__label", F.explode("__grams").alias("gram"))
    mean = rows.agg(F.avg("__label")).first()[0]
    counts = held.groupBy("gram").agg(F.count("*").alias("n"), F.sum("__label").alias("toxic"))
    deviation = F.abs(F.col("toxic") - F.col("n") * mean) / F.sqrt(F.col("n") * mean * (1 - mean))
    features = materialize(counts.where((F.col("n") >= LEAST_TEXTS) & (deviation >= LEAST_DEVIATION)).select("gram"), "features")
    # At most one row per bucket number.
    pairs = held.join(F.broadcast(features), "gram").select("__id", "gram").toArrow()
    texts = rows.select("__id", "__label").toArrow()
    ids, label_of = texts["__id"].to_numpy(), texts["__label"].to_numpy().astype(np.int64)
    by_id = np.argsort(ids, kind="stable")
    ids, label_of = ids[by_id], label_of[by_id]
    line = np.searchsorted(ids, pairs["__id"].to_numpy())
    order = np.lexsort((pairs["gram"].to_numpy(), line))
    line = line[order]
    used, columns = np.unique(pairs["gram"].to_numpy()[order], return_inverse=True)
    ratio = log_count_ratio(columns, line, label_of, used.size, smoothing)
    weight = np.array([share[0] / max(1, (label_of == 0).sum()), share[1] / max(1, (label_of == 1).sum())])[label_of]
    fitted, bias = fit_logistic(columns, line, ratio, label_of, weight, penalty, rounds, rate)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = fitted
    return ToxicityModel(weights, bias)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Add ``out``: the probability that the whole text is toxic; NULL counts as empty.

    All rows and columns stay; a column already named ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        grams = Grams(sent.value.bits, sent.value.orders)
        return lambda texts: [sent.value.scores(texts, grams)]

    return text_stage(docs, text, make, {out: "double"}, keep)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """Rows whose score stays below ``at_least``, with their own columns."""
    rows = docs.select(*numbered(docs), F.col(quoted(text)).alias("said"))
    scored = score_toxicity(rows, model, "said", "toxicity", keep=[c for c in rows.columns if c != "said"])
    return scored.where(F.col("toxicity") < at_least).select(*named(docs))
