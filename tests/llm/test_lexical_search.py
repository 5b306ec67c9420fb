"""Ranked lexical search against scoring every document, and odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from gustara.llm import lexical_search as ls
from gustara.llm.common import prepare
from gustara.session import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DRAW = random.Random(4)
WORDS = ["".join(DRAW.choice("abcdefgé中") for _ in range(DRAW.randint(1, 6))) for _ in range(500)]


def prose(n, draw=DRAW):
    return " ".join(WORDS[min(int(draw.expovariate(0.02)), 499)] for _ in range(n))


def split(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute_force(docs, items, k):
    counted = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in split(text)}
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in asked
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, None if none else i, -s, n + 1) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


ODD = [None, "", " .,;\n", "ABC abc Abc", "Éa éa 中文中文", "x y", "one-two_three\x00four", "7 7 7"]


@pytest.mark.parametrize("partitions", [1, 6])
def test_same_ranks_as_scoring_everything(session, partitions):
    texts = [*ODD, *[prose(DRAW.randint(1, 200)) for _ in range(150)], *["one equal text"] * 30]
    docs = [(n * 11 % 401, t) for n, t in enumerate(texts)] + [(None, prose(50)), (None, prose(20)), (7, prose(30)), (7, "one equal text")]
    items = [(n, prose(DRAW.randint(1, 40))) for n in range(20)]
    items += [(20, "one EQUAL text"), (21, None), (22, ""), (23, "neverseenword"), (None, "abc"), (3, "7"), (24, WORDS[0]), (25, "éa É中")]
    given = session.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id bigint, text string, score string, segment int, item_id int")
    asked = session.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id int, text string, term string, weight int")
    found = ls.rank_documents(given.repartition(partitions), asked.repartition(3), k=10)
    got = sorted([tuple(r) for r in found.select("item", "id", "score", "rank").collect()], key=repr)
    assert got == brute_force(docs, items, 10)


def test_many_blocks_of_queries_and_groups(session):
    docs = [(n, prose(60)) for n in range(200)]
    items = [(n, prose(10)) for n in range(30)]
    index = ls.build_index(session.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    terms = ls.query_terms(session.createDataFrame(items, "item_id string, text string"))
    found = ls.search(index, terms, k=3, group_bytes=1000, block_terms=40)
    got = sorted([(int(r["item"]), r["id"], r["score"], r["rank"]) for r in found.collect()], key=repr)
    assert got == brute_force(docs, items, 3)


def test_documents_that_cannot_be_a_result_are_skipped():
    draw = random.Random(8)
    docs = [(n, prose(40, draw)) for n in range(6000)]
    segment = ls.Segment()
    for i, t in docs:
        segment.add(i, t)
    row = dict(zip(["ids", "segment", "lengths", "terms", "counts", "docs", "freqs"], segment.row(0)))
    counted = [Counter(split(t)) for _, t in docs]
    df, n_terms = Counter(t for c in counted for t in c), sum(sum(c.values()) for c in counted)
    weights = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for t, n in df.items()}
    lists, scored, all_entries = ls.Lists(row, weights, len(docs), n_terms), 0, 0
    items = [(n, prose(12, draw)) for n in range(40)]
    got = []
    for item, text in items:
        best = ls.Best(10)
        scored += ls.search_segment(lists, sorted(set(split(text))), best)
        all_entries += sum(df[t] for t in set(split(text)))
        got += [(item, i, -s, n + 1) for n, (s, _, i) in enumerate(best.rows)]
    assert sorted(got, key=repr) == brute_force(docs, items, 10)
    assert 0 < scored < 0.5 * all_entries


def test_long_texts_and_empty_tables(session, monkeypatch):
    text = prose(3000)
    whole, parts = ls.Segment(), ls.Segment()
    whole.add(1, text)
    monkeypatch.setattr(ls, "LONG_TEXT", 100)
    parts.add(1, text)
    assert whole.lengths == parts.lengths and Counter(split(text)) == {
        t.decode(): int(n) for t, code in parts.vocabulary.items() for n in parts.freqs[0][parts.terms[0] == code]
    }
    kind = "doc_id bigint, text string"
    none, some = session.createDataFrame([], kind), session.createDataFrame([(1, "a b")], kind)
    asked = session.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ls.rank_documents(none, asked).count() == 0
    assert ls.rank_documents(some, asked.limit(0)).count() == 0
    assert [r["score"] for r in ls.rank_documents(some, asked).collect()] == [s for *_, s, _ in brute_force([(1, "a b")], [(1, "a")], 10)]


def test_index_is_held_and_searched_by_segment(session, monkeypatch):
    """One row group per segment, and no shuffle of the segments on their way to the queries."""
    docs, items = [(n, prose(30)) for n in range(100)], [(n, prose(5)) for n in range(3)]
    monkeypatch.setattr(ls, "materialize", lambda df, *given, **named: materialize(parts(df) if "index" in given else df, *given, **named))

    def parts(index):  # five segments in one file
        return index.coalesce(1)

    index = ls.build_index(session.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata for f in index.inputFiles()]
    assert [m.num_row_groups for m in files] == [5] and index.count() == 5
    found = ls.search(index, ls.query_terms(session.createDataFrame(items, "item_id bigint, text string")), k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Exchange" not in plan[plan.index("MapInArrow") :]
    assert sorted(map(tuple, found.select("item", "id", "score", "rank").collect()), key=repr) == brute_force(docs, items, 5)
