"""Secrets in texts by a trigram inverted index and verified regular expressions, in DataFrame functions.

Each rule's expression is turned into a Boolean trigram query: alternatives of trigrams that every
match must hold. The index holds the postings of the trigrams that some query names. Intersected
postings give candidate (rule, document) pairs, which the expression itself verifies. A rule with an
alternative without a trigram has no query and scans every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import beside_texts, named, quoted, without

MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``lead`` and ``value`` follow each other; a match counts if the value has ``least`` characters."""

    kind: str
    lead: str
    value: str
    least: int = 1
    any_case: str = ""

    @property
    def pattern(self) -> str:
        lead = self.lead.replace(self.any_case, f"(?i:{self.any_case})", 1) if self.any_case else self.lead
        return f"({lead})({self.value})"


# The kinds asked for, in their order, then further well-known credential formats.
RULES = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 8,
         "password|passwd|secret|token|api_?key"),
    Rule("access", "", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{32,}", 32),
    Rule("private_key", "", r"-----BEGIN\x20(?:RSA\x20|EC\x20|OPENSSH\x20)?PRIVATE\x20KEY-----"),
    Rule("repo_token", "", r"(?:ghp|gho|ghs)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "", r"(?:xoxb|xoxp)-[A-Za-z0-9-]{10,}"),
    Rule("map_key", "", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")

# Marks set around matches; the texts' own copies are replaced first, one character by one.
OPEN, MIDDLE, CLOSE, STAND_IN = "\u0001", "\u0002", "\u0003", "\u0004"


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams of which every match holds one whole set; None: no query."""
    gap = None
    skeletons = _expand(sre_parser.parse(pattern), gap)
    found = set()
    for parts in skeletons:
        text, grams = "", set()
        for part in [*parts, gap]:
            if part is not gap:
                text += part.lower()
                continue
            grams.update(text[i : i + 3] for i in range(len(text) - 2))
            text = ""
        if not grams:
            return None
        found.add(frozenset(grams))
    return sorted((s for s in found if not any(o < s for o in found)), key=sorted)


def _expand(items, gap) -> list[list]:
    """The literal characters of each alternative, with gaps where anything else stands."""
    out: list[list] = [[]]
    for op, value in items:
        if op is sre.LITERAL:
            more = [[chr(value)]]
        elif op is sre.IN and len(value) <= 4 and all(o is sre.LITERAL for o, _ in value):
            more = [[chr(c)] for _, c in value]
        elif op is sre.SUBPATTERN:
            more = _expand(value[3], gap)
        elif op is sre.BRANCH:
            more = [s for branch in value[1] for s in _expand(branch, gap)]
        elif op is sre.MAX_REPEAT and value[:2] == (0, 1):
            more = [[], *_expand(value[2], gap)]
        elif op is sre.MAX_REPEAT and value[0] >= 1:
            more = [[*s, gap] if value[1] != 1 else s for s in _expand(value[2], gap)]
        elif op is sre.AT:
            more = [[]]
        else:
            more = [[gap]]
        if len(out) * len(more) > MOST_ALTERNATIVES:
            more = [[gap]]
        out = [a + b for a in out for b in more]
    return out


def trigram_postings(docs: DataFrame, trigrams: list[str], key: Column, text: Column) -> DataFrame:
    """The inverted index of the given trigrams: (trigram, key), once per document row."""
    low = docs.select(key.alias("key"), F.lower(text).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))
    return low.select("key", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules whose trigram query the postings of a key satisfy.

    Rows that share a key pool their postings, which can only add candidates.
    """
    spark = docs.sparkSession
    clauses = [
        (rule.kind, number, len(grams), gram)
        for rule in rules
        for number, grams in enumerate(trigram_query(rule.pattern) or [])
        for gram in sorted(grams)
    ]
    asked = spark.createDataFrame(clauses, "kind string, clause int, need int, trigram string")
    postings = trigram_postings(docs, sorted({c[3] for c in clauses}), key, text).distinct()
    joined = postings.join(F.broadcast(asked), "trigram")  # one row per trigram of the fixed rules
    held = joined.groupBy("key", "kind", "clause").agg(F.count("*").alias("has"), F.first("need").alias("need"))
    return held.where("has = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """``start:end`` of the rule's matches, comma-joined, in code points; empty if there are none."""
    marked = F.regexp_replace(text, rule.pattern, f"{OPEN}$1{MIDDLE}$2{CLOSE}")
    parts = F.split(marked, OPEN)

    def step(state: Column, part: Column) -> Column:
        lead = F.length(F.substring_index(part, MIDDLE, 1))
        value = F.length(F.substring_index(F.substring_index(part, CLOSE, 1), MIDDLE, -1))
        end = state["at"] + lead + value
        span = F.concat(F.lit(","), state["at"].cast("string"), F.lit(":"), end.cast("string"))
        said = F.when(value >= rule.least, F.concat(state["out"], span)).otherwise(state["out"])
        # Everything of the part but the two marks inside it was text.
        return F.struct((state["at"] + F.length(part) - 2).alias("at"), said.alias("out"))

    first = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.lit("").alias("out"))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.substring(F.aggregate(rest, first, step, lambda s: s["out"]), 2, 2**31 - 1)


def entry_of(rank: int, kind: str) -> Callable[[Column], Column]:
    def entry(span: Column) -> Column:
        edge = F.split(span, ":")
        start, end = edge[0].cast("int"), edge[1].cast("int")
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))

    return entry


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None
) -> DataFrame:
    """Add ``secrets``: an array of (start, rank, kind, end) by start, then by the rules' order.

    Offsets are code points, ends exclusive; matches of a rule are leftmost and do not overlap. NULL
    texts count as empty and give an empty array. All rows stay, repeated ones each with its own
    result; a column named ``secrets`` is replaced.
    """
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    kept = [c for c in (keep or docs.columns) if c in without(docs, ["secrets"])]
    clean = F.translate(whole, OPEN + MIDDLE + CLOSE, STAND_IN * 3)
    given = docs.select(*[F.col(quoted(c)) for c in kept])
    numbers = [F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(kept)]
    rows = docs.select(*numbers, clean.alias("__clean"), F.col(quoted(doc_id)).alias("__key"))
    # A row without an id has no posting to be found by: all rules scan it.
    found = candidates(docs, F.col(quoted(doc_id)), whole, rules).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
    rows = beside_texts(rows, found, "__key", "left")
    spans = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            asked = F.col("__clean").rlike(rule.pattern)
        else:
            asked = F.col("__key").isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
        listed = F.when(asked, spans_of(F.col("__clean"), rule)).otherwise(F.lit(""))

        spans.append(F.transform(F.filter(F.split(listed, ","), lambda s: s != ""), entry_of(rank, rule.kind)))
    return rows.select(*named(given), F.array_sort(F.concat(*spans)).alias("secrets"))
