"""Checked joins, list building, set operations, flattening."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.operators.ordering import first_per_group, top_k
from gustara.operators.skew import attach
from gustara.session import materialize


class DuplicateKeyError(ValueError):
    """A join that promised one row per key met several."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(keys: Sequence[str], **sides: DataFrame) -> None:
    """Raise when a side repeats a key, naming up to five; only those reach the driver."""
    found = [duplicate_keys(df, keys).select(F.lit(side).alias("_side"), *keys) for side, df in sides.items()]
    rows = reduce(lambda a, b: a.union(b), found).orderBy("_side", *keys).limit(5).collect()
    if rows:
        shown = "; ".join(f"{row['_side']}: " + ", ".join(f"{k}={row[k]}" for k in keys) for row in rows)
        raise DuplicateKeyError(f"repeated keys ({shown})")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that refuses repeated keys on either side."""
    require_unique(keys, left=left, right=right)
    return left.join(right, list(keys), how)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every common column, in sorted order."""
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("the two sides have no column in common")
    return left.join(right, shared, "inner")


def keep_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(ids, on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(ids, on, "left_anti")


def where_in_subquery(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """SQL ``WHERE column IN (SELECT column FROM ids)`` on the two frames."""
    text = "SELECT * FROM {rows} WHERE " + f"{column} IN (SELECT {column} FROM " + "{ids})"
    return df.sparkSession.sql(text, rows=df, ids=ids)


def before_cutoff(rows: DataFrame, cutoffs: DataFrame, key: str, ts: str, cutoff: str) -> DataFrame:
    """Rows strictly older than their key's cutoff (point-in-time history)."""
    limits = materialize(cutoffs.select(F.col(key).alias("_key"), F.col(cutoff).alias("_cutoff")), "cutoffs")
    condition = (F.col(key) == F.col("_key")) & (F.col(ts) < F.col("_cutoff"))
    return rows.join(limits, condition, "inner").drop("_key", "_cutoff")


def join_with_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; only names on both sides get a suffix."""
    overlap = (set(left.columns) & set(right.columns)) - set(on)

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in overlap})

    return renamed(left, suffixes[0]).join(renamed(right, suffixes[1]), list(on), "inner")


def lookup(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Rows with their metadata; rows without any keep NULLs (see ``missing_lookups``)."""
    return rows.join(metadata, key, "left")


def missing_lookups(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """One row: how many rows and keys have no metadata."""
    lost = rows.join(metadata.select(key), key, "left_anti")
    return lost.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def concat_first(id_column: str, *tables: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Concatenate tables and keep, per id, the row of the earliest table."""
    tagged = [t.withColumn("_source", F.lit(i)) for i, t in enumerate(tables)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    return first_per_group(stacked, [id_column], ["_source", *order]).drop("_source")


def is_subset(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: whether every id on the left occurs on the right, and how many do not."""
    lost = left.select(column).distinct().join(right.select(column), column, "left_anti")
    return lost.agg(F.count("*").alias("n_missing")).select(
        (F.col("n_missing") == 0).alias("is_subset"), "n_missing"
    )


def group_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key, one row each.

    Rows rather than an array: the set of a hot key has no bound. The distinct is partially
    aggregated and shuffles on (key, value), so no task holds a whole key.
    """
    return df.select(key, value).distinct()


def group_list(
    ranked: DataFrame, key: str, columns: Sequence[str], k: int, rank: str = "rank"
) -> DataFrame:
    """Per key one array per column, in rank order, of at most ``k`` ranked rows.

    The bound is part of the operator: only lists limited by a rank become arrays.
    """
    rows = ranked.where(F.col(rank) <= k)
    packed = F.array_sort(F.collect_list(F.struct(rank, *columns)))
    lists = rows.groupBy(key).agg(packed.alias("_rows"))
    return lists.select(key, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def group_first(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First value of every column per key, by an explicit order."""
    return first_per_group(df.select(key, *dict.fromkeys([*columns, *order])), [key], list(order)).select(
        key, *columns
    )


def explode_list(lists: DataFrame, key: str, column: str, item: str) -> DataFrame:
    """One row per list entry with its position from 0."""
    return lists.select(key, F.posexplode(column).alias("position", item))


def list_positions(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    return ranked.withColumn("position", F.col(rank) - 1)


def remove_excluded(truth: DataFrame, excluded: DataFrame, on: Sequence[str] = ("item_id",)) -> DataFrame:
    """Ground truth rows without the excluded ids (or (user, id) pairs)."""
    return attach(truth, excluded.select(*on), list(on), "left_anti")


def hits_in_list(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: size of the left list and how many of its entries occur in the right list.

    Repeats on the left count. They are counted per (key, value) before the join.
    """
    counted = left.groupBy(key, value).agg(F.count("*").alias("_n"))
    marks = right.select(key, value).distinct().withColumn("_hit", F.lit(1))
    joined = counted.join(marks, [key, value], "left")
    return joined.groupBy(key).agg(
        F.sum("_n").alias("list_size"),
        F.sum(F.when(F.col("_hit").isNotNull(), F.col("_n")).otherwise(0)).alias("hit_count"),
    )


def enrich_recommendations(
    lists: DataFrame, list_column: str, profiles: DataFrame, items: DataFrame
) -> DataFrame:
    """Explode bounded lists and attach the user's profile text and the item's metadata.

    ``lists``: (user_id, <list_column> array). ``profiles``: (user_id, user_profile_text),
    repeats allowed. ``items``: one row per item_id.
    """
    rows = explode_list(lists, "user_id", list_column, "item_id")
    profile = profiles.select("user_id", "user_profile_text").dropDuplicates(["user_id", "user_profile_text"])
    return rows.join(profile, "user_id", "left").join(items, "item_id", "left")


def flatten_matches(matches: DataFrame) -> DataFrame:
    """Search output with ``query`` and ``base`` structs to flat columns.

    The two structs may share field names; the vectors get their side's name.
    """
    flat = [
        F.col(f"{side}.{f}").alias(f"{owner}_embedding" if f == "embedding" else f)
        for side, owner in (("query", "user"), ("base", "item"))
        for f in matches.schema[side].dataType.names
    ]
    rest = [c for c in matches.columns if c not in ("query", "base")]
    return matches.select(*rest, *flat)


def best_of(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """Top ``k`` rows per key by score, ties by ``tie``."""
    return top_k(df, [key], [F.col(score).desc(), F.col(tie).asc()], k)


def with_group_count(df: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    """Every row with its group's row count.

    Count and join back instead of a window: the count is partially aggregated, and the join
    can split a hot key over tasks, which a window cannot.
    """
    return attach(df, df.groupBy(key).agg(F.count("*").alias(name)), key, "left")


