"""Explicit schemas: input tables, history records, model answers."""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, dtype: T.DataType, comment: str = "") -> T.StructField:
    return T.StructField(name, dtype, True, {"comment": comment} if comment else None)


_TEXT = T.StringType()
_TEXTS = T.ArrayType(T.StringType())

RAW_INTERACTIONS = T.StructType(
    [
        _field("user_id", _TEXT),
        _field("item_id", _TEXT),
        _field("rating", _TEXT),
        _field("date_last_modified", _TEXT),
    ]
)

RAW_ITEMS = T.StructType(
    [
        _field("item_id", _TEXT),
        _field("title", _TEXT),
        _field("aver_rate", T.DoubleType()),
        _field("review_nums", T.IntegerType()),
        _field("ingredients", _TEXT),
        _field("cooking_directions", _TEXT),
        _field("nutritions", _TEXT),
        _field("reviews", _TEXT),
    ]
)

# Nutrition dictionaries: nutrient -> attributes. The percentage stays text, because sources
# mix numbers with marks such as '< 1' and '-'.
NUTRITION_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))

REVIEW_MAP = T.MapType(
    T.StringType(),
    T.StructType(
        [
            _field("rating", T.DoubleType()),
            _field("dateLastModified", _TEXT),
            _field("text", _TEXT),
        ]
    ),
)

HISTORY_RECORD = T.StructType(
    [
        _field("item_id", _TEXT),
        _field("rating", T.DoubleType()),
        _field("date", _TEXT),
        _field("user_comment", _TEXT),
    ]
)

# Answer schemas of the generative steps. The field comments go into the prompt, so a model
# sees the same contract that the parser enforces.
ITEM_PROFILE = T.StructType(
    [
        _field("food_type", _TEXT, "kind of dish, such as dessert or main course"),
        _field("cuisine_type", _TEXT, "cuisine the dish belongs to"),
        _field("dietary_preferences", _TEXTS, "diets the dish suits"),
        _field("flavor_profile", _TEXTS, "dominant flavors"),
        _field("serving_daypart", _TEXTS, "times of day it is served"),
        _field("notes", _TEXT, "one line summary"),
        _field("target_audience", _TEXT, "people likely to enjoy the dish"),
        _field("justification", _TEXT, "evidence for the values above"),
    ]
)

USER_PROFILE = T.StructType(
    [
        _field("liked_cuisines", _TEXTS, "cuisines the user rates well, best first"),
        _field("cuisine_preference", _TEXT, "the leading cuisine"),
        _field("dietary_preference", _TEXT, "the leading diet"),
        _field("food_preferences", _TEXTS, "kinds of dishes preferred"),
        _field("top_cuisine_choices", _TEXTS, "regional cuisines often chosen"),
        _field("dietary_preferences", _TEXTS, "diets and restrictions"),
        _field("flavor_preferences", _TEXTS, "flavors looked for"),
        _field("daypart_preferences", _TEXTS, "times of day and meals"),
        _field("lifestyle_tags", _TEXTS, "habits seen in the history"),
        _field("convenience_preference", _TEXT, "quick or elaborate cooking"),
        _field("diversity_openness", _TEXT, "willingness to try new dishes"),
        _field("notes", _TEXT, "short summary"),
        _field("justification", _TEXT, "evidence in the history"),
        _field("user_story", _TEXT, "how the taste developed"),
        _field("future_preferences", _TEXT, "what may be liked next"),
    ]
)

POINTWISE_JUDGEMENT = T.StructType(
    [
        _field("would_like", T.BooleanType(), "true only if the user would like the item"),
        _field("confidence", _TEXT, "high, medium or low"),
        _field("justification", _TEXT, "matches or mismatches between both profiles"),
    ]
)

PAIRWISE_JUDGEMENT = T.StructType(
    [
        _field("preferred_model", _TEXT, "A or B, the list that fits the user better"),
        _field("confidence", _TEXT, "high, medium or low"),
        _field("justification", _TEXT, "why that list fits better"),
    ]
)
