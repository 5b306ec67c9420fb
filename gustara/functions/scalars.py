"""Small column expressions: casts, timestamps, lists, JSON, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_TEXT_PATH = "$.candidates[0].content.parts[0].text"

# Looser spellings tried after ISO 8601, in this order.
LOOSE_TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_newlines(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(""))


def parse_timestamp(c: Column | str, loose: tuple[str, ...] = LOOSE_TIMESTAMP_FORMATS) -> Column:
    """ISO 8601 first, then the loose formats; NULL when none fits, never an error.

    The cast also reads a bare time as today's, so it only sees text that starts with a date.
    """
    text = strip_newlines(c)
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in loose])


def date_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def split_bullets(c: Column | str, separator: str = r"\^") -> Column:
    """``a^b`` to one ``- `` bullet per line; NULL to the empty text, '' to one empty bullet."""
    parts = F.split(_col(c), separator, -1)
    bullets = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.coalesce(bullets, F.lit(""))


def map_get(m: Column | str, key: str, default: Column) -> Column:
    """Value under ``key``; the default only when the key is absent, not when its value is NULL."""
    m = _col(m)
    return F.when(F.map_contains_key(m, key), F.element_at(m, F.lit(key))).otherwise(default)


def envelope_text(c: Column | str) -> Column:
    """Answer text inside a model response envelope."""
    return F.get_json_object(_col(c), ENVELOPE_TEXT_PATH)


def parse_answer(c: Column | str, schema: T.StructType) -> Column:
    """Model answer text to a typed struct.

    A malformed answer leaves every field NULL and the text itself in ``_bad`` instead of
    failing the job, so such rows can be counted.
    """
    with_bad = T.StructType(schema.fields + [T.StructField("_bad", T.StringType())])
    return F.from_json(
        _col(c), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )


def norm(vec: Column | str) -> Column:
    squares = F.transform(_col(vec), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def is_valid_vector(vec: Column | str) -> Column:
    """Not NULL, not empty, every element a finite number, and a length above zero that is finite too."""
    vec = _col(vec)
    limit = F.lit(float("inf"))
    numbers = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    usable = F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & numbers, F.lit(False))
    return usable & F.coalesce(F.when(usable, (norm(vec) > 0) & (norm(vec) < limit)), F.lit(False))


def fixed2(c: Column | str) -> Column:
    """Two decimals of a double, rounded on its exact binary value with ties to even.

    ``format_string`` rounds the shortest decimal text half up, which differs on ties such as
    3.125. Here 200 times the value is split as 128 + 64 + 8 times, whose fractions add up
    exactly (for values of at least a quarter), so a tie is recognised as one.
    """
    value = _col(c).cast("double")
    scaled = [F.abs(value) * m for m in (128.0, 64.0, 8.0)]
    wholes = [F.floor(s) for s in scaled]
    fraction = sum((s - w for s, w in zip(scaled[1:], wholes[1:])), scaled[0] - wholes[0])
    halves = wholes[0] + wholes[1] + wholes[2] + F.floor(fraction)
    rest = fraction - F.floor(fraction)
    below = F.shiftright(halves, 1)
    up = (halves % 2 == 1) & ((rest > 0) | (below % 2 == 1))
    cents = below + up.cast("long")
    digits = F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    return F.when(value < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def concat_or_null(*cols: Column | str) -> Column:
    """SQL ``||``: NULL as soon as one part is NULL."""
    return F.concat(*[_col(c) for c in cols])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def parse_failures(df: DataFrame, raw: str, parsed: str) -> DataFrame:
    """One row: texts present and how many of them the parser could not read."""
    return df.agg(
        F.count(raw).alias("n_values"),
        F.count_if(F.col(raw).isNotNull() & F.col(parsed).isNull()).alias("n_unparsed"),
    )


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+)\.[^./]+$", 1)


def relative_path(path: Column | str, root: str) -> Column:
    """Path below the first ``root`` in it, wherever the file system prefix ends; all of it without one."""
    marker = root.rstrip("/") + "/"
    at = F.instr(_col(path), F.lit(marker))
    return F.when(at > 0, F.substr(_col(path), at + len(marker))).otherwise(_col(path))
