"""Item and user text: directions, nutrition, history blocks, comparison prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustara.functions.literals import literal_entry, python_literal_to_json
from gustara.functions.scalars import fixed2, split_bullets
from gustara.schemas import NUTRITION_MAP
from gustara.session import spread

# ---- Fixed values: results depend on these names, markers and formats ----------------------
NUTRIENTS = (
    "niacin",
    "sugars",
    "sodium",
    "carbohydrates",
    "vitaminB6",
    "calories",
    "thiamin",
    "fat",
    "folate",
    "caloriesFromFat",
    "calcium",
    "fiber",
    "magnesium",
    "iron",
    "cholesterol",
    "protein",
    "vitaminA",
    "potassium",
    "saturatedFat",
    "vitaminC",
)
PERCENT_KEY = "percentDailyValue"
NO_PERCENTAGE = -1.0
NOT_A_NUMBER = -2.0
BELOW_ONE = "< 1"
DASH = "-"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
HISTORY_RULE = "-" * 44
BANNER = "#" * 43
HISTORY_START = f"{BANNER} USER HISTORY START {BANNER}\n"
HISTORY_END = f"{BANNER} USER HISTORY END {BANNER}\n"
LIST_MARK = "=" * 23
COMPARE_LINE = (
    "Compare the two lists of recommended recipes below and determine which list better aligns"
    " with the user's profile and preferences.\n\n"
)
# ---- End of fixed values -------------------------------------------------------------------


def normalize_directions(c: Column | str) -> Column:
    """Cooking directions as one lower-case text, or as joined sentences for dict literals.

    NULL gives ''. Text that is not a readable dict literal is lower-cased. A dict gives its
    ``directions`` lines, trimmed, non-empty, sentences marked with '. ' and joined by blanks.
    """
    raw = F.col(c) if isinstance(c, str) else c
    looks_like_dict = _strip_blank(raw).startswith("{")
    # The literal reader only sees rows that look like one.
    directions = literal_entry(F.when(looks_like_dict, raw), "directions")
    lines = F.filter(
        F.transform(F.split(directions, "\n", -1), lambda x: _strip_blank(x)), lambda x: x != ""
    )
    marked = F.transform(
        lines, lambda x: F.when(_starts_upper(x), F.concat(F.lit(". "), x)).otherwise(x)
    )
    joined = F.regexp_replace(F.array_join(marked, " "), r"^\.+|\.+$", "")
    joined = F.replace(joined, F.lit(" . "), F.lit(". "))
    joined = _strip_blank(F.replace(joined, F.lit(".."), F.lit(".")))
    return (
        F.when(raw.isNull(), F.lit(""))
        .when(directions.isNotNull(), joined)
        .otherwise(F.lower(raw))
    )


def _strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _starts_upper(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def parse_nutrition(c: Column | str) -> Column:
    """Nutrition literal to ``map<nutrient, map<attribute, text>>``."""
    return F.from_json(python_literal_to_json(c), NUTRITION_MAP)


def nutrition_numeric(
    df: DataFrame, literal: str, keys: tuple[str, ...] = NUTRIENTS, partitions: int | None = None
) -> DataFrame:
    """Add one double column per nutrient.

    -2: nutrient missing, value None or not a number. -1: no percentage or '-'. 0: '< 1'.
    """
    parsed = spread(df, partitions).withColumn("_nutrition", parse_nutrition(literal))
    return parsed.withColumns({k: _nutrient_value("_nutrition", k) for k in keys}).drop("_nutrition")


def _nutrient_value(nutrition: str, key: str) -> Column:
    attributes = F.element_at(F.col(nutrition), F.lit(key))
    value = F.trim(F.element_at(attributes, F.lit(PERCENT_KEY)))
    return (
        F.when(attributes.isNull(), F.lit(NOT_A_NUMBER))
        .when(~F.map_contains_key(attributes, PERCENT_KEY), F.lit(NO_PERCENTAGE))
        .when(value == BELOW_ONE, F.lit(0.0))
        .when(value == DASH, F.lit(NO_PERCENTAGE))
        .otherwise(F.coalesce(F.when(value.rlike(NUMBER), value.try_cast("double")), F.lit(NOT_A_NUMBER)))
    )


def nutrition_text(
    df: DataFrame, literal: str, name: str = "percent_daily_values", keys: tuple[str, ...] = NUTRIENTS
) -> DataFrame:
    """Add ``nutrient: value percent`` lines in key order; missing nutrients have no line."""
    parsed = df.withColumn("_nutrition", parse_nutrition(literal))
    lines = [_nutrient_line("_nutrition", k) for k in keys]
    return parsed.withColumn(name, F.concat_ws("\n", *lines)).drop("_nutrition")


def _nutrient_line(nutrition: str, key: str) -> Column:
    attributes = F.element_at(F.col(nutrition), F.lit(key))
    value = F.element_at(attributes, F.lit(PERCENT_KEY))
    shown = (
        F.when(~F.map_contains_key(attributes, PERCENT_KEY), F.lit("-1 percent"))
        .when(value.isNull(), F.lit("None"))
        .when(F.trim(value) == BELOW_ONE, F.lit("0.0 percent"))
        .otherwise(F.concat(value, F.lit(" percent")))
    )
    return F.when(attributes.isNotNull(), F.concat(F.lit(f"{key}: "), shown))


def parse_items(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """Item catalogue with its three parsed text columns."""
    parsed = spread(items, partitions).withColumns(
        {
            "parsed_ingredients": split_bullets("ingredients"),
            "parsed_recipe": normalize_directions("cooking_directions"),
        }
    )
    return nutrition_text(parsed, "nutritions")


def history_text(
    history: DataFrame,
    items: DataFrame,
    compat: bool = False,
    n: int = 25,
) -> DataFrame:
    """One text block per user from ranked history rows.

    ``history``: (user_id, rank, item_id, rating, date, user_comment) as ``recent_history`` gives
    it; the ``n`` newest rows a user count, so a block is bounded. ``items``: (item_id, title,
    parsed_ingredients, parsed_recipe). A missing comment is empty text, or ``nan`` under
    ``compat``. Output: (user_id, n_history, history_string).
    """
    missing = F.lit("nan" if compat else "")
    metadata = items.select("item_id", "title", "parsed_ingredients", "parsed_recipe")
    rows = history.where(F.col("rank") <= n).join(metadata, "item_id", "left")
    entry = F.concat(
        F.lit("\n>>> Recipe Title: "), F.coalesce("title", F.lit("")),
        F.lit("\n>>> User Rating: "), F.col("rating").cast("double").cast("string"),
        F.lit("\n>>> Date of Interaction: "), F.col("date"),
        F.lit("\n\n>>> User Comment: "), F.coalesce("user_comment", missing),
        F.lit("\n\n>>> Ingredients:\n"), F.coalesce("parsed_ingredients", F.lit("")),
        F.lit("\n\n>>> Cooking Directions:\n"), F.coalesce("parsed_recipe", F.lit("")),
        F.lit(f"\n{HISTORY_RULE}\n"),
    )
    blocks = (
        rows.select("user_id", "rank", "rating", entry.alias("entry"))
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n_history"),
            F.avg("rating").alias("avg_rating"),
            F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("entries"),
        )
    )
    header = F.concat(
        F.lit("The user has rated "), F.col("n_history").cast("string"),
        F.lit(" recipes, with an average rating of "), fixed2("avg_rating"),
        F.lit(".\n"),
    )
    body = F.array_join(F.col("entries.entry"), "")
    return blocks.select(
        "user_id",
        "n_history",
        F.concat(F.lit(HISTORY_START), header, body, F.lit(HISTORY_END)).alias("history_string"),
    )


def item_prompt_text(title: str, ingredients: str, directions: str) -> Column:
    """Short per-item prompt body."""
    return F.concat(
        F.lit("A dish to profile:\n\nTitle: "), F.coalesce(title, F.lit("")),
        F.lit("\n\nIngredients:\n"), F.coalesce(ingredients, F.lit("")),
        F.lit("\n\nCooking Directions:\n"), F.coalesce(directions, F.lit("")),
        F.lit("\n\nDescribe this dish as a structured profile."),
    )


def user_prompt_text(
    history: DataFrame, totals: DataFrame, profile_column: str | None = None, n: int = 10
) -> DataFrame:
    """Short per-user prompt body from the ``n`` newest rows and whole-history totals.

    ``history``: (user_id, rank, title, rating, text, aver_rate, parsed_ingredients,
    parsed_recipe[, profile]). ``totals``: (user_id,
    n_rated, avg_rating) over the whole history.
    """
    entry = F.concat(
        F.lit("\nRecipe Title: "), F.coalesce("title", F.lit("")),
        F.lit("\nUser Rating: "), F.col("rating").cast("double").cast("string"),
        F.lit("\nUser Comment: "), F.coalesce("text", F.lit("")),
        F.lit("\nRecipe Average Rating: "), F.coalesce(F.col("aver_rate").cast("string"), F.lit("")),
        F.lit("\nIngredients:\n"), F.coalesce("parsed_ingredients", F.lit("")),
        F.lit("\nCooking Directions:\n"), F.coalesce("parsed_recipe", F.lit("")), F.lit("\n"),
    )
    if profile_column:
        line = F.concat(F.lit("Recipe Profile: "), F.col(profile_column), F.lit("\n"))
        entry = F.concat(entry, F.coalesce(line, F.lit("")))
    entry = F.concat(entry, F.lit("----\n"))
    bodies = (
        history.where(F.col("rank") <= n)
        .select("user_id", "rank", entry.alias("entry"))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("entries"))
    )
    return bodies.join(totals, "user_id").select(
        "user_id",
        F.concat(
            F.lit("Ratings given: "), F.col("n_rated").cast("string"),
            F.lit(", mean rating "), fixed2("avg_rating"),
            F.lit(".\n"), F.array_join(F.col("entries.entry"), ""),
            F.lit("\nDescribe this person as a structured profile."),
        ).alias("prompt"),
    )


def first_is_a(user_id: Column | str, seed: int) -> Column:
    """Seeded A/B order: true when the list of the first model is shown as list A."""
    key = F.concat(F.col(user_id) if isinstance(user_id, str) else user_id, F.lit(f":{seed}"))
    return F.instr(F.lit("02468ace"), F.substring(F.md5(key), 1, 1)) > 0


def pair_prompt(pairs: DataFrame, seed: int = 0, models: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Add ``model_a``, ``model_b`` and ``comparison_prompt`` to paired lists.

    ``pairs``: user_id, user_profile_text and, per model of ``models``, the arrays ``title_<model>`` and
    ``item_profile_text_<model>``. Ranks start at 0; a list ends with its shorter column.
    """
    first, (one, two) = first_is_a("user_id", seed), models
    lists = {m: _list_body(F.col(f"title_{m}"), F.col(f"item_profile_text_{m}")) for m in models}
    in_a = F.when(first, lists[one]).otherwise(lists[two])
    in_b = F.when(first, lists[two]).otherwise(lists[one])
    prompt = F.concat(
        F.lit("USER PROFILE:\n"), F.coalesce("user_profile_text", F.lit("")), F.lit(COMPARE_LINE),
        *[
            part
            for name, body in (("A", in_a), ("B", in_b))
            for part in (
                F.lit(f"\n{LIST_MARK} BEGIN LIST of MODEL {name} {LIST_MARK}\n"),
                body,
                F.lit(f"\n{LIST_MARK} END LIST {LIST_MARK}\n"),
            )
        ],
    )
    return pairs.withColumns(
        {
            "model_a": F.when(first, F.lit(one)).otherwise(F.lit(two)),
            "model_b": F.when(first, F.lit(two)).otherwise(F.lit(one)),
            "comparison_prompt": prompt,
        }
    )


def _list_body(titles: Column, profiles: Column) -> Column:
    shown = F.least(F.size(titles), F.size(profiles))
    entries = F.transform(
        F.slice(titles, F.lit(1), shown),
        lambda title, i: F.concat(
            F.lit(">>> Rank "), i.cast("string"), F.lit("\n>>> Recipe Title: "), F.coalesce(title, F.lit("")),
            F.lit("\n>>> Recipe Profile: "), F.coalesce(F.get(profiles, i), F.lit("")),
            F.lit(f"\n{HISTORY_RULE}\n"),
        ),
    )
    return F.array_join(entries, "")


def schema_prompt(schema: T.StructType) -> str:
    """``[  name (comment)  name (comment)  ]`` in field order."""
    body = "".join(f" {f.name} ({(f.metadata or {}).get('comment', '')}) " for f in schema.fields)
    return f"[ {body} ]"


def output_ddl(schema: T.StructType) -> str:
    """``name TYPE, name ARRAY<TYPE>`` form of an answer schema."""
    names = {"string": "STRING", "boolean": "BOOL", "array<string>": "ARRAY<STRING>"}
    types = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return ", ".join(f"{name} {names.get(kind, kind.upper())}" for name, kind in types)


def prompt_parts(instruction: str, *columns: str) -> Column:
    """Instruction and row texts as separate prompt parts, NULL texts as ''."""
    return F.array(F.lit(instruction), *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def prompt_text(instruction: str, *columns: str) -> Column:
    return F.concat(F.lit(instruction), *[F.coalesce(F.col(c), F.lit("")) for c in columns])
