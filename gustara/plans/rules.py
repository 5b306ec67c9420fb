"""Instructions and keyword rules of the offline providers for the given tables.

Part names are an adjective and a noun; the noun stands for the kind of dish, the size or
colour word for the flavor, the raw material of the brand line for the cuisine.
"""

from __future__ import annotations

from gustara.functions.text import schema_prompt
from gustara.providers.offline import KeywordProvider
from gustara.schemas import ITEM_PROFILE, PAIRWISE_JUDGEMENT, POINTWISE_JUDGEMENT, USER_PROFILE

KINDS = (("bolt", "fastener"), ("gear", "drive"), ("ring", "seal"), ("widget", "device"), ("gizmo", "gadget"), ("plate", "panel"))
FLAVORS = (("red", "red"), ("blue", "blue"), ("hot", "hot"), ("cold", "cold"), ("new", "new"), ("small", "small"), ("large", "large"))
CUISINES = (("brand#1", "first house"), ("brand#2", "second house"))

ITEM_INSTRUCTION = f"Describe the item from its ingredients, directions and daily values. Answer as {schema_prompt(ITEM_PROFILE)} in plain words without quotes."
USER_INSTRUCTION = f"Describe the taste of the user from the history below. Answer as {schema_prompt(USER_PROFILE)} in plain words without quotes."
HYDE_INSTRUCTION = f"Write a new, richer profile of a user like this one, plausible but not copied. Answer as {schema_prompt(USER_PROFILE)} in plain words without quotes."
POINTWISE_INSTRUCTION = f"Decide whether this user would like this item. Say false unless the profiles clearly agree. Answer as {schema_prompt(POINTWISE_JUDGEMENT)}."
PAIRWISE_INSTRUCTION = f"Decide which of the two lists fits the user better; exactly one must be chosen. Answer as {schema_prompt(PAIRWISE_JUDGEMENT)}."

ITEM_PROVIDER = KeywordProvider(
    ITEM_PROFILE, {"food_type": KINDS, "cuisine_type": CUISINES, "flavor_profile": FLAVORS, "serving_daypart": KINDS}
)
USER_PROVIDER = KeywordProvider(
    USER_PROFILE,
    {
        "liked_cuisines": CUISINES,
        "cuisine_preference": CUISINES,
        "food_preferences": (("widget", "device"), ("gear", "drive")),
        "flavor_preferences": FLAVORS,
        "notes": KINDS,
    },
)
HYDE_PROVIDER = KeywordProvider(
    USER_PROFILE,
    {"cuisine_preference": CUISINES, "flavor_preferences": FLAVORS, "food_preferences": KINDS, "notes": FLAVORS},
)


def most_frequent_sql(text: str, rules: tuple[tuple[str, str], ...], default: str = "unknown") -> str:
    """SQL of the keyword provider's text fields."""
    counts = [f"CAST((length({text}) - length(replace({text}, '{w}', ''))) / {len(w)} AS BIGINT)" for w, _ in rules]
    top = counts[0] if len(counts) == 1 else f"greatest({', '.join(counts)})"
    cases = " ".join(f"WHEN {c} = {top} THEN '{a}'" for c, (_, a) in zip(counts, rules))
    return f"CASE WHEN {top} = 0 THEN '{default}' {cases} END"


def present_sql(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    """SQL of the keyword provider's list fields, joined by commas."""
    found = ", ".join(f"CASE WHEN contains({text}, '{w}') THEN '{a}' END" for w, a in rules)
    return f"concat_ws(',', {found})"


def profile_json_sql(text: str, provider: KeywordProvider) -> str:
    """SQL of the whole answer text, spelled as the provider spells its JSON."""
    fields = []
    for f in provider.schema.fields:
        rules = provider.rules.get(f.name, ())
        if f.dataType.simpleString() == "array<string>":
            found = ", ".join(f"""CASE WHEN contains({text}, '{w}') THEN '"{a}"' END""" for w, a in rules)
            value = f"'[' || concat_ws(', ', {found}) || ']'" if rules else "'[]'"
        else:
            value = f"""'"' || {most_frequent_sql(text, rules, provider.default)} || '"'""" if rules else f"""'"{provider.default}"'"""
        fields.append(f"""'"{f.name}": ' || {value}""")
    return "'{' || " + " || ', ' || ".join(fields) + " || '}'"


def embed_sql(source: str, key: str, text: str, dim: int) -> str:
    """SQL of the hashing provider: one (key, v) row per text that has an embedding."""
    return f"""SELECT {key}, list(coalesce(x, 0) / norm ORDER BY d) AS v FROM (
      SELECT k.{key}, k.d, s.x, k.norm FROM (SELECT n.{key}, n.norm, unnest(range({dim})) AS d FROM (
        SELECT {key}, sqrt(sum(x * x)) AS norm FROM (SELECT {key}, d, CAST(sum(sign) AS DOUBLE) AS x FROM (
          SELECT {key}, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) % {dim} AS d, CASE WHEN contains('02468ace', substr(md5(t), 8, 1)) THEN 1 ELSE -1 END AS sign
          FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \t\n\r\f\v]+')) AS t FROM {source}) WHERE t <> '') GROUP BY 1, 2) GROUP BY 1 HAVING sum(x * x) > 0) n) k
      LEFT JOIN (SELECT {key}, d, CAST(sum(sign) AS DOUBLE) AS x FROM (
          SELECT {key}, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) % {dim} AS d, CASE WHEN contains('02468ace', substr(md5(t), 8, 1)) THEN 1 ELSE -1 END AS sign
          FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \t\n\r\f\v]+')) AS t FROM {source}) WHERE t <> '') GROUP BY 1, 2) s
      ON s.{key} = k.{key} AND s.d = k.d) GROUP BY {key}"""
