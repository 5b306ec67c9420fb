"""Golden rows of the text functions."""

from __future__ import annotations

import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gustara.functions import scalars as S
from gustara.functions import text as X
from gustara.functions.literals import _read_dict, explode_reviews, literal_failures, python_literal_to_json
from gustara.schemas import POINTWISE_JUDGEMENT


def apply(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def test_split_bullets(spark):
    assert apply(spark, S.split_bullets, [None, "", "a^b", "a^"]) == ["", "- ", "- a\n- b", "- a\n- "]


def test_normalize_directions(spark):
    cases = {
        None: "",
        "Plain TEXT": "plain text",
        "{'directions': 'Mix.\\nBake.\\n\\nthen serve'}": "Mix. Bake. then serve",
        "{'other': 1}": "",
        "{broken": "{broken",
        "{Broken As Well": "{broken as well",
        "{1, 2}": "{1, 2}",
        "{'directions': None}": "None",
        " {'directions': 'lower. then'}": "lower. then",
        "{'directions': 'a.. b'}": "a. b",
        "{'directions': ['x', 'y']}": "['x', 'y']",
    }
    assert apply(spark, X.normalize_directions, list(cases)) == list(cases.values())


NUTRITION = [
    "{'fat': {'percentDailyValue': '< 1'}}",
    "{'fat': {'percentDailyValue': ' < 1 '}}",
    "{'fat': {'percentDailyValue': '-'}}",
    "{'fat': {'percentDailyValue': None}}",
    "{'fat': {'percentDailyValue': 12}}",
    "{'fat': {'percentDailyValue': '12.5'}}",
    "{'fat': {'percentDailyValue': 'abc'}}",
    "{'fat': {'amount': 3}}",
    "{}",
    "{'fat': {'percentDailyValue': '1d'}}",
    "not a dict",
]


def test_nutrition_numeric(spark):
    df = spark.createDataFrame(list(enumerate(NUTRITION)), "i int, v string")
    got = [r["fat"] for r in X.nutrition_numeric(df, "v").orderBy("i").collect()]
    assert got == [0.0, 0.0, -1.0, -2.0, 12.0, 12.5, -2.0, -1.0, -2.0, -2.0, -2.0]


def test_nutrition_text(spark):
    df = spark.createDataFrame(list(enumerate(NUTRITION[:9])), "i int, v string")
    got = [r["t"] for r in X.nutrition_text(df, "v", "t").orderBy("i").collect()]
    assert got == [
        "fat: 0.0 percent", "fat: 0.0 percent", "fat: - percent", "fat: None", "fat: 12 percent",
        "fat: 12.5 percent", "fat: abc percent", "fat: -1 percent", "",
    ]
    two = spark.createDataFrame([("{'iron': {'percentDailyValue': 1}, 'sugars': {'percentDailyValue': 2}}",)], "v string")
    assert X.nutrition_text(two, "v", "t").first()["t"] == "sugars: 2 percent\niron: 1 percent"


def test_literal_reader_keeps_none_and_escapes(spark):
    texts = ["{'a': {'b': None}, 'c': 1}", "{'a': 'it\\'s \"x\"'}", "{'a': True}", "[1]", "{", None]
    assert apply(spark, python_literal_to_json, texts) == [
        '{"a": {"b": null}, "c": 1}', '{"a": "it\'s \\"x\\""}', '{"a": true}', None, None, None,
    ]
    bad = literal_failures(spark.createDataFrame([(t,) for t in texts], "v string"), "v").first()
    assert (bad["n_values"], bad["n_unparsed"]) == (5, 2)


values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda inner: st.dictionaries(st.text(), inner, max_size=3) | st.lists(inner, max_size=3),
    max_leaves=8,
)


@given(st.dictionaries(st.text(), values, max_size=4))
@settings(max_examples=300, deadline=None)
def test_quick_literal_path_agrees_with_the_parser(value):
    assert _read_dict(repr(value)) == ast.literal_eval(repr(value)) == value


@given(st.text(alphabet="{}[]':,\"\\ntrufalseNoN0123.e-+ "))
@settings(max_examples=500, deadline=None)
def test_quick_literal_path_refuses_what_the_parser_refuses(text):
    try:
        expected = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        expected = None
    assert _read_dict(text) == (expected if isinstance(expected, dict) else None)


def test_explode_reviews(spark, rows):
    df = spark.createDataFrame(
        [
            ("1", "{}"),
            ("2", "{'u1': {'rating': 4, 'dateLastModified': '2016-01-02T03:04:05', 'text': 'it\\'s'}}"),
            ("3", "{'u1': {'rating': 1.5, 'dateLastModified': 'x', 'text': None}, 7: {'rating': 5}}"),
        ],
        "item_id string, reviews string",
    )
    assert rows(explode_reviews(df)) == sorted(
        [
            ("2", "u1", 4.0, "2016-01-02T03:04:05", "it's"),
            ("3", "u1", 1.5, "x", None),
            ("3", "7", 5.0, None, None),
        ],
        key=repr,
    )


def test_parse_timestamp(spark):
    texts = [
        "2016-01-02T03:04:05", "2016-01-02T03:04:05.25", "2016-01-02\nT03:04:05", "2016-01-02T03:04:05+02:00",
        "garbage", "12:30", "01/02/2016", None,
    ]
    got = apply(spark, lambda v: F.date_format(S.parse_timestamp(v), "yyyy-MM-dd HH:mm:ss.SS"), texts)
    assert got == [
        "2016-01-02 03:04:05.00", "2016-01-02 03:04:05.25", "2016-01-02 03:04:05.00", "2016-01-02 01:04:05.00",
        None, None, "2016-01-02 00:00:00.00", None,
    ]


def test_parse_failures_are_counted(spark):
    df = spark.createDataFrame([("2016-01-02",), ("soon",), (None,)], "v string").withColumn("t", S.parse_timestamp("v"))
    assert tuple(S.parse_failures(df, "v", "t").first()) == (2, 1)


def test_envelope_and_answer(spark):
    good = '{"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}'
    assert apply(spark, S.envelope_text, [good, '{"candidates": []}', "no json", None]) == ["hi", None, None, None]
    texts = ['{"would_like": true, "confidence": "low"}', "no json", '{"would_like": "maybe"}']
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(S.parse_answer("v", POINTWISE_JUDGEMENT).alias("a"), "v")
    got = {r["v"]: (r["a"]["would_like"], r["a"]["_bad"] is not None) for r in df.collect()}
    assert got == {texts[0]: (True, False), texts[1]: (None, True), texts[2]: (None, True)}


def test_fixed2_formats_like_python(spark):
    rng = random.Random(3)
    values = [n / d for d in range(1, 65) for n in range(1, 6 * d, 7)] + [rng.uniform(0.25, 600) for _ in range(2000)]
    values += [3.125, 2.675, 0.375, 5.0, 4.995, 1.005, -3.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r["v"], r["o"]) for r in df.select("v", S.fixed2("v").alias("o")).collect() if r["o"] != f"{r['v']:.2f}"]
    assert wrong == []


def test_history_text(spark):
    history = spark.createDataFrame(
        [("u", 1, "i", 5.0, "2020-01-02", "good"), ("u", 2, "j", 4.0, "2020-01-01", None)],
        "user_id string, rank int, item_id string, rating double, date string, user_comment string",
    )
    items = spark.createDataFrame(
        [("i", "Soup", "- a", "mix"), ("j", "Cake", "- b", "bake")],
        "item_id string, title string, parsed_ingredients string, parsed_recipe string",
    )
    bar, rule = "#" * 43, "-" * 44
    for compat, missing in ((False, ""), (True, "nan")):
        row = X.history_text(history, items, compat).first()
        assert row["n_history"] == 2
        assert row["history_string"] == (
            f"{bar} USER HISTORY START {bar}\nThe user has rated 2 recipes, with an average rating of 4.50.\n"
            "\n>>> Recipe Title: Soup\n>>> User Rating: 5.0\n>>> Date of Interaction: 2020-01-02\n\n"
            ">>> User Comment: good\n\n>>> Ingredients:\n- a\n\n>>> Cooking Directions:\nmix\n"
            f"{rule}\n"
            "\n>>> Recipe Title: Cake\n>>> User Rating: 4.0\n>>> Date of Interaction: 2020-01-01\n\n"
            f">>> User Comment: {missing}\n\n>>> Ingredients:\n- b\n\n>>> Cooking Directions:\nbake\n"
            f"{rule}\n{bar} USER HISTORY END {bar}\n"
        )


def test_pair_prompt_order_and_shorter_list(spark):
    users = [f"u{i}" for i in range(40)]
    df = spark.createDataFrame(
        [(u, "taste", ["v1", "v2"], ["pv1"], ["a1"], ["pa1"]) for u in users],
        "user_id string, user_profile_text string, title_vs array<string>, item_profile_text_vs array<string>, "
        "title_als array<string>, item_profile_text_als array<string>",
    )
    got = X.pair_prompt(df, 1, ("vs", "als")).collect()
    assert {r["model_a"] for r in got} == {"vs", "als"}
    for r in got:
        first, second = ("v1", "a1") if r["model_a"] == "vs" else ("a1", "v1")
        assert r["comparison_prompt"].index(f"Title: {first}") < r["comparison_prompt"].index(f"Title: {second}")
        assert "v2" not in r["comparison_prompt"] and ">>> Rank 0\n" in r["comparison_prompt"]
    again = {r["user_id"]: r["model_a"] for r in X.pair_prompt(df.repartition(7), 1, ("vs", "als")).collect()}
    assert again == {r["user_id"]: r["model_a"] for r in got}


def test_schema_prompt():
    text = X.schema_prompt(POINTWISE_JUDGEMENT)
    assert text.startswith("[  would_like (") and text.endswith(")  ]") and ")  confidence (" in text
    assert X.output_ddl(POINTWISE_JUDGEMENT) == "would_like BOOL, confidence STRING, justification STRING"


@pytest.mark.parametrize("path,stem,relative", [("file:/a/b/12.jpg", "12", "b/12.jpg"), ("s3://x/a/c.d.png", "c.d", "c.d.png")])
def test_file_names(spark, path, stem, relative):
    df = spark.createDataFrame([(path,)], "p string")
    row = df.select(S.file_stem("p").alias("s"), S.relative_path("p", "/a").alias("r")).first()
    assert (row["s"], row["r"]) == (stem, relative)
