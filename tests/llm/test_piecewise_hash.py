"""Fingerprints against byte-by-byte Python, the edit chain against a sorted list, odd tables."""

from __future__ import annotations

import hashlib
import random

import pytest

from gustara.llm import piecewise_hash as ph
from gustara.llm.common import prepare

MASK = 2**32 - 1


def plain_fingerprint(text):
    """The definition, one byte at a time."""
    raw = (text or "").encode()
    hashes = []
    for n in range(len(raw)):
        h = 0
        for back in range(6, -1, -1):
            h = (h * 0x01000193 + (raw[n - back] + 1 if n - back >= 0 else 0)) & MASK
        h = h * 0x85EBCA6B & MASK
        h ^= h >> 15
        hashes.append(h * 0xC2B2AE35 & MASK)
    bits = 2
    while sum(h >> (32 - bits) == 0 for h in hashes) > 63 and bits <= 32:
        bits += 1

    def signature(bits):
        found, piece, open_ = "", 0, False
        for h in hashes:
            piece, open_ = piece + h & MASK, True
            if bits <= 32 and h >> (32 - bits) == 0:
                found, piece, open_ = found + letter(piece), 0, False
        return found + (letter(piece) if open_ else "")

    return f"{2**bits}:{signature(bits)}:{signature(bits + 1)}" if raw else "4::"


def letter(piece):
    mixed = piece * 0x85EBCA6B & MASK
    mixed ^= mixed >> 13
    return chr(ph.ALPHABET[(mixed * 0xC2B2AE35 & MASK) >> 26])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (n, *one), (m, *two) = a.split(":"), b.split(":")
    best = 0.0
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            if int(n) << i == int(m) << j and x and y:
                table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
                for r in range(len(x) + 1):
                    for c in range(len(y) + 1):
                        if not r or not c:
                            table[r][c] = r + c
                        else:
                            table[r][c] = min(table[r - 1][c] + 1, table[r][c - 1] + 1, table[r - 1][c - 1] + (0 if x[r - 1] == y[c - 1] else 2))
                best = max(best, 1 - table[-1][-1] / (len(x) + len(y)))
    return best


DRAW = random.Random(9)
WORDS = ["".join(DRAW.choice("abcdeé中 ") for _ in range(DRAW.randint(1, 9))) for _ in range(300)]
TEXTS = [" ".join(DRAW.choice(WORDS) for _ in range(n)) for n in (1, 3, 20, 80, 300, 1500)]
ODD = ["", "a", "ab", "x" * 5000, "abc" * 3000, "\0" * 50, "né 中文 \U0001f600", *TEXTS]


def test_fingerprints_are_those_of_the_definition(monkeypatch):
    for text in [None, *ODD]:
        assert ph.fingerprint(text) == plain_fingerprint(text)
    whole = [ph.fingerprint(t) for t in ODD]
    monkeypatch.setattr(ph, "BLOCK_BYTES", 100)  # texts across many blocks, ends let go early
    monkeypatch.setattr(ph, "ENDS_HELD", 70)
    assert [ph.fingerprint(t) for t in ODD] == whole


def test_likeness_is_the_edit_distance():
    prints = [ph.fingerprint(t) for t in ODD] + [ph.fingerprint(ph.edited(a, b)) for a, b in zip(ODD, ODD[1:])]
    pairs = [(a, b) for a in prints for b in prints]
    got = ph.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([plain_likeness(a, b) for a, b in pairs])
    assert ph.likeness([None], [""])[0] == 1.0 and ph.likeness([], []).size == 0
    text = TEXTS[-1]
    changed = ph.fingerprint(text[:2000] + "one more word" + text[2000:])
    assert 0.9 < ph.likeness([ph.fingerprint(text)], [changed])[0] < 1.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_document_meets_the_next_one(spark, partitions):
    session = prepare(spark)
    texts = [*ODD, None, TEXTS[3], TEXTS[3]]
    rows = [(i * 5 % 17, t, "s", "f", 1) for i, t in enumerate(texts)] + [(None, TEXTS[2], "s", "f", 1), (4, TEXTS[4], "s", "f", 2), (4, TEXTS[4], "s", "f", 2)]
    schema = "doc_id bigint, text string, slice string, fingerprint string, kind int"
    given = session.createDataFrame(DRAW.sample(rows, len(rows)), schema).repartition(partitions)
    got = ph.fingerprint_edits(given).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append(t or "")
    order = [i for i in sorted(k for k in by_id if k is not None)] + [None]
    for row in got:
        mine, after = by_id[row["doc_id"]], by_id[order[(order.index(row["doc_id"]) + 1) % len(order)]]
        possible = [(a, b) for a in mine for b in ([*after, *mine] if len(mine) > 1 else after)]
        wanted = {(len(a), ph.fingerprint(a), hashlib.sha256(ph.edited(a, b).encode()).hexdigest(), ph.fingerprint(ph.edited(a, b))) for a, b in possible}
        assert (row["n_chars"], row["fingerprint"], row["edited_sha256"], row["edited_fingerprint"]) in wanted
        assert row["near_edited"] == pytest.approx(plain_likeness(row["fingerprint"], row["edited_fingerprint"]))


def test_one_document_and_none(spark):
    session = prepare(spark)
    schema = "doc_id string, text string"
    alone = ph.fingerprint_edits(session.createDataFrame([("x", "some words of a text")], schema)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["n_chars"] == 20
    assert ph.fingerprint_edits(session.createDataFrame([], schema)).count() == 0
    assert ph.fingerprint_documents(session.createDataFrame([("x", None)], schema)).first()["fingerprint"] == "4::"
