"""Repeated line runs by a suffix array over line-ID sequences, in DataFrame functions.

Every document is a sequence of line IDs. Suffixes are ranked by prefix doubling: the rank by 2^k
lines and the rank of the suffix 2^k lines on give the rank by 2^(k+1) lines. Two suffixes have a
longest common prefix of at least L lines, 2^k <= L < 2^(k+1), exactly if their ranks by 2^k lines
agree at their starts and again at their last 2^k of L lines; the suffixes that agree form one
interval of the suffix array. L is the least number of lines that hold ``min_words`` words, so
the intervals' runs, overlapping, cover every maximal repeated run of that many words. In each
interval the first suffix in document order stays and the lines of the other runs are deleted.

Lines that occur once are in no run: they never enter the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gustara.llm.common import KEY, beside_texts, document_key, quoted, without
from gustara.operators.ordering import running_position
from gustara.operators.skew import attach
from gustara.session import materialize

MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: how many distinct key tuples are not above the row's, over the whole table.

    Equal tuples are one row before the sort; the sort is a range partitioning with slice offsets.
    """
    distinct = df.groupBy(*keys).agg(F.count("*").alias("held"))
    order = running_position(distinct, [], [(k, True) for k in keys], name)
    return attach(df, order.select(*keys, name, "held"), keys)


def repeated_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(document key, place, line, words, rank) of the non-blank lines that occur more than once.

    ``place`` counts the document's non-blank lines, ``line`` all its lines, both from 0. A line is
    known by two 64-bit hashes of its trimmed text.
    """
    trimmed = F.transform(lines_of(F.col(quoted(text))), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    numbered = F.transform(trimmed, lambda s, i: F.struct(i.alias("line"), s.alias("said")))
    spoken = F.filter(numbered, lambda s: s["said"] != "")
    rows = docs.select(*document_key(docs, doc_id, text), F.posexplode(spoken).alias("place", "at"))
    words = F.length("at.said") - F.length(F.replace(F.col("at.said"), F.lit(" "), F.lit(""))) + 1
    rows = rows.select(
        *KEY, "place", F.col("at.line").alias("line"), words.alias("words"),
        F.xxhash64("at.said").alias("h1"), F.xxhash64(F.lit(1), "at.said").alias("h2"),
    )
    rows = materialize(rows, "lines")
    twice = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    # Rows equal in id and text come here once.
    return attach(rows, twice, ["h1", "h2"]).dropDuplicates([*KEY, "place"])


def later_copies(docs: DataFrame, doc_id: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(document key, line): lines of a repeated run of at least ``min_words`` words, save its first copy."""
    rows = materialize(ranked(materialize(repeated_lines(docs, doc_id, text), "repeated"), ["h1", "h2"], "rank"), "ranks")
    rows = rows.select(*KEY, "place", "line", "words", "rank")
    # The least number of lines from here on with enough words: all neighbours are repeated lines.
    by_doc = W.partitionBy(*KEY).orderBy("place")
    block = rows.withColumn("block", F.col("place") - F.row_number().over(by_doc))
    ahead = W.partitionBy(*KEY, "block").orderBy("place")
    upto = block.withColumn("total", F.sum("words").over(ahead.rowsBetween(W.unboundedPreceding, 0)))
    reach = F.collect_list(F.struct("total", "place")).over(ahead.rowsBetween(0, max(0, min_words - 1)))
    need = F.col("total") - F.col("words") + min_words
    last = F.get(F.filter(reach, lambda s: s["total"] >= need), F.lit(0))["place"]
    starts = upto.withColumn("length", last - F.col("place") + 1)
    levels = materialize(starts.select(*KEY, "place", "line", "length", "rank"), "levels")
    found, width = None, 1
    while True:
        # Runs of this doubling's lengths, told apart by two overlapping ranks.
        runs = levels.where((F.col("length") >= width) & (F.col("length") < 2 * width))
        tails = levels.select(*KEY, F.col("place").alias("tail"), F.col("rank").alias("tail_rank"))
        runs = runs.withColumn("tail", F.col("place") + F.col("length") - width).join(tails, [*KEY, "tail"])
        copies = runs.select(*KEY, "place", "line", "length", "rank", "tail_rank")
        found = copies if found is None else found.unionByName(copies)
        if 2 * width > min_words:
            break
        # Ranks by twice as many lines; suffixes too short for them are in no longer run.
        ahead_ranks = levels.select(*KEY, (F.col("place") - width).alias("place"), F.col("rank").alias("next"))
        both = levels.join(ahead_ranks, [*KEY, "place"])
        doubled = ranked(both, ["rank", "next"], "wider").where("held > 1")
        levels = materialize(doubled.select(*KEY, "place", "line", "length", F.col("wider").alias("rank")), "levels")
        width *= 2
    found = materialize(found, "runs")
    interval = ["length", "rank", "tail_rank"]
    at = F.struct(*KEY, "place")
    first = found.groupBy(*interval).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = attach(found, first, interval).where(F.struct(*KEY, "place") > F.col("first"))
    covered = later.select(*KEY, F.explode(F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)).alias("place")).distinct()
    lines = rows.select(*KEY, "place", "line")
    return covered.join(lines, [*KEY, "place"]).select(*KEY, "line")


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, out: str = "n_removed"
) -> DataFrame:
    """Delete the later copies of repeated line runs and add ``out``, the number of lines deleted.

    A run counts from ``min_words`` words on, over any number of whole lines. Lines are compared with
    white space collapsed; blank lines neither join nor break a run and stay in place. The first
    copy in order of id (NULL last), text hash and place stays, also within one document. NULL and
    empty texts stay as they are; rows equal in id and text get the same result, as one document.
    A column already named ``out`` is replaced.
    """
    kept = without(docs, [out])
    gone = later_copies(docs.where(F.col(quoted(text)).isNotNull()), doc_id, text, min_words)
    gone = gone.groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("__gone"))
    rows = docs.select(*[F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(kept)], *document_key(docs, doc_id, text))
    joined = beside_texts(rows, gone, KEY, "left")
    # One flag per line, as text: gaps of 0 before each deleted line's 1.
    flags = F.transform(
        "__gone",
        lambda line, i: F.concat(F.repeat(F.lit("0"), line - F.coalesce(F.get("__gone", i - 1), F.lit(-1)) - 1), F.lit("1")),
    )
    marks = joined.withColumn("__flags", F.split(F.array_join(flags, ""), ""))
    at = kept.index(text)
    stay = F.filter(lines_of(F.col(f"__c{at}")), lambda s, i: F.coalesce(F.get("__flags", i), F.lit("0")) != "1")
    left = F.when(F.col("__gone").isNull(), F.col(f"__c{at}")).otherwise(F.array_join(stay, "\n"))
    columns = [(left if i == at else F.col(f"__c{i}")).alias(c) for i, c in enumerate(kept)]
    return marks.select(*columns, F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias(out))
