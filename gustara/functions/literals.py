"""Python-literal text columns: to JSON, then to typed maps.

``from_json`` reads single quotes but turns a literal ``None`` into a NULL parent, so the text
is rewritten to JSON first. That rewrite is the only row-level Python here, in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.schemas import REVIEW_MAP
from gustara.session import spread


_UNREADABLE = (ValueError, SyntaxError, TypeError, MemoryError, RecursionError)
# Bare words JSON knows and Python does not; a text holding one takes the exact way.
_JSON_WORDS = re.compile("true|false|null|NaN|Infinity")


def _read_dict(text: str) -> dict | None:
    """The dict a Python literal spells, or None.

    Without backslashes, double quotes and JSON words, a text that reads as JSON once its quotes
    are exchanged means the same in both languages, and the JSON reader is several times faster.
    Everything else goes through the Python literal parser.
    """
    text = text.strip()
    if "\\" not in text and '"' not in text and not _JSON_WORDS.search(text):
        try:
            value = json.loads(text.replace("'", '"'))
            return value if isinstance(value, dict) else None
        except _UNREADABLE:
            pass
    try:
        value = ast.literal_eval(text)
    except _UNREADABLE:
        return None
    return value if isinstance(value, dict) else None


def _dict_to_json(text: str) -> str | None:
    value = _read_dict(text)
    if value is None:
        return None
    try:
        return json.dumps({str(k): v for k, v in value.items()}, ensure_ascii=False)
    except _UNREADABLE:
        return None


@F.pandas_udf(T.StringType())
def python_literal_to_json(texts: pd.Series) -> pd.Series:
    """JSON text of a Python dict literal; NULL when the text is not one."""
    return texts.map(_dict_to_json, na_action="ignore")


def literal_entry(text: Column, key: str, default: str = "") -> Column:
    """Text form of one entry of a Python dict literal; NULL when the text is not a dict."""

    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series) -> pd.Series:
        found = texts.map(_read_dict, na_action="ignore")
        return found.map(lambda d: str(d.get(key, default)) if isinstance(d, dict) else None)

    return read(text)


def explode_reviews(
    items: DataFrame, item_id: str = "item_id", reviews: str = "reviews", partitions: int | None = None
) -> DataFrame:
    """``{user: {rating, dateLastModified, text}}`` per item to one row per review.

    Column names come out lower-cased; the review date stays text for ``parse_timestamp``. The texts
    are parsed in ``partitions`` tasks, or where they are if it is None.
    """
    parsed = spread(items, partitions).select(item_id, F.from_json(python_literal_to_json(reviews), REVIEW_MAP).alias("m"))
    # A plain explode makes the planner add a filter on the map, which parses every text twice.
    entries = parsed.select(item_id, F.explode_outer("m").alias("user_id", "review"))
    entries = entries.where(F.col("user_id").isNotNull())
    return entries.select(
        item_id,
        "user_id",
        F.col("review.rating").alias("rating"),
        F.col("review.dateLastModified").alias("datelastmodified"),
        F.col("review.text").alias("text"),
    )


def literal_failures(df: DataFrame, literal: str) -> DataFrame:
    """One row: literals present and how many could not be parsed."""
    return df.select(literal, python_literal_to_json(literal).alias("_json")).agg(
        F.count(literal).alias("n_values"),
        F.count_if(F.col(literal).isNotNull() & F.col("_json").isNull()).alias("n_unparsed"),
    )
