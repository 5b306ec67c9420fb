"""The dealt operators against brute force, and on NULLs, empty texts and tables, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from gustara.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    language_id,
    line_dedup,
    order_minhash,
    secret_scan,
    token_counts,
    toxicity,
    warc,
)
from gustara.llm.common import prepare

DRAW = random.Random(5)
VOCABULARY = ["".join(DRAW.choice("abcdefghijklmnop") for _ in range(DRAW.randint(2, 9))) for _ in range(400)]


def prose(words: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(words))


ODD = [None, "", " ", "\n\n", "ab  c\t\n d", "né 中文 \U0001f600'll", "x" * 3000, prose(4000, 1), "a", "a", "<s> ▁ </s>"]


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def frame(session, texts, extra="score string, n_tokens string, key int"):
    rows = [(i, t, "s", "t", i) for i, t in enumerate(texts)] + [(None, "no id", "s", "t", 0)]
    return session.createDataFrame(rows, f"doc_id bigint, text string, {extra}")


def test_bpe_gives_the_ids_of_the_library_and_decodes(session):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    )
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(frame(session, ODD))).collect()
    assert len(got) == len(ODD) + 1
    for row in got:
        text = row["text"] or ""
        assert np.frombuffer(row["tokens"], "<u4").tolist() == library.encode_ordinary(text)
        assert row["decoded"] == text.encode() and row["score"] == "s"
    assert byte_bpe.encode_documents(frame(session, []).limit(0)).count() == 0


def test_token_counts_at_every_prefix(session):
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    counter = token_counts.load(token_counts.model_path())
    for text in ODD[1:]:
        short = text[:120]
        counts = [len(library.encode(short[:p])) for p in range(len(short) + 1)]
        assert counter.prefix_counts(short).tolist() == counts
        for budget in range(counts[-1] + 2):
            assert counter.fit(short, budget) == max(p for p, n in enumerate(counts) if n <= budget)
    for row in token_counts.token_counts(frame(session, ODD), limit=50).collect():
        text = row["text"] or ""
        assert row["n_tokens"] == len(library.encode(text)) and row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 50) and len(library.encode(text[: row["fit_chars"]])) <= 50
    cut = token_counts.truncate(frame(session, ODD), 20).collect()
    assert all(len(library.encode(r["text"] or "")) <= 20 for r in cut) and cut[0]["text"] is None


def test_secrets_are_those_of_the_expressions(session):
    key = "0123456789abcdef" * 3
    texts = [*ODD, f'a "token": "{key}" Password=abcdefgh secret=short api_key : {key}', f"\x01AKIA{'Q' * 16}\x02 {key}", "ghp_" + "a" * 40]
    base = [
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
        re.compile("()(AKIA[A-Z0-9]+)"),
        re.compile("()([0-9a-f]+)"),
    ]
    for row in secret_scan.scan_secrets(frame(session, texts)).collect():
        want = sorted(
            (m.start(), rank, m.end())
            for rank, (rule, least) in enumerate(zip(base, (8, 16, 32), strict=True))
            for m in rule.finditer(row["text"] or "")
            if len(m[2]) >= least
        )
        assert [(s["start"], s["rank"], s["end"]) for s in row["secrets"] if s["rank"] < 3] == want
        assert ("ghp_" in (row["text"] or "")) == any(s["kind"] == "repo_token" for s in row["secrets"])
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is None


def brute_line_dedup(texts, least):
    spoken = [[(i, " ".join(x.split())) for i, x in enumerate((t or "").split("\n")) if x.strip()] for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for doc, lines in enumerate(spoken):
        for at in range(len(lines)):
            total = 0
            for to in range(at, len(lines)):
                total += len(lines[to][1].split())
                if total >= least:
                    run = tuple(x for _, x in lines[at : to + 1])
                    if run in seen:
                        gone[doc].update(i for i, _ in lines[at : to + 1])
                    seen.add(run)
                    break
    return [t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_deletes_later_copies_of_runs(session):
    lines = [prose(DRAW.randint(1, 12), 100 + i) for i in range(30)]
    texts = ["\n".join(DRAW.choice(lines) if DRAW.random() < 0.3 else lines[(k + i) % 30] for i in range(12)) for k in range(25)]
    texts += [None, "", "\n", "alone", texts[0], " \n".join(texts[1].split("\n"))]
    done = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(session, texts), min_words=20).collect()}
    assert [done[i]["text"] for i in range(len(texts))] == brute_line_dedup(texts, 20)
    assert done[None]["text"] == "no id" and done[0]["score"] == "s"
    assert line_dedup.dedup_lines(frame(session, texts).limit(0)).count() == 0


def test_benchmark_passages_are_found_with_substitutions(session):
    items = [prose(30, 500 + i) for i in range(6)] + ["too short", None, ""]
    bench = session.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    changed = items[1].split()
    for at in (9, 19):
        changed[at] = "zzz"
    texts = [*ODD, f"{prose(40, 7)} {items[0].upper()}. {prose(9, 8)}", " ".join(changed), prose(300, 9), " ".join(items[2].split()[:10])]
    got = {r["doc_id"]: r for r in decontaminate.mark_contaminated(frame(session, texts), bench).collect()}
    at = len(ODD)
    assert {i for i, r in got.items() if r["contaminated"]} == {at, at + 1}
    assert (got[at]["first_item"], got[at]["matched"], got[at + 1]["first_item"], got[at + 1]["matched"]) == (0, 30, 1, 28)
    kept = decontaminate.drop_contaminated(frame(session, texts), bench)
    assert kept.count() == len(texts) + 1 - 2 and kept.columns == frame(session, texts).columns


def in_order(a, b):
    """Longest common subsequence by the whole table; 0 where too few words are common to reach 0.8."""
    if (Counter(a) & Counter(b)).total() < 0.8 * max(len(a), len(b)):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        hit = np.append(0, row[:-1] + np.array([w == word for w in b]))
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def test_banded_alignment_is_the_whole_table_where_it_links():
    code = {w: i * 2654435761 % 2**61 for i, w in enumerate("abcdefgh")}
    for trial in range(400):
        draw = random.Random(trial)
        a = [draw.choice("abcdefgh"[: draw.randint(1, 8)]) for _ in range(draw.randint(1, 40))]
        b = [w for w in a if draw.random() > 0.08]
        for _ in range(draw.randint(0, 6)):
            b.insert(draw.randint(0, len(b)), draw.choice("abcdefgh"))
        x, y = (np.array([code[w] for w in t], np.int64) for t in (a, b))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        most = int(table[-1, -1])
        whole = max(len(a), len(b))
        assert order_minhash.similar(x, y, 0.8) == order_minhash.similar(y, x, 0.8) == (bool(b) and most >= 0.8 * whole)
        if b:
            assert order_minhash.aligned(x, y, whole) == most
            assert order_minhash.chained(x.view(np.uint64), y.view(np.uint64), whole) <= most


def test_order_minhash_finds_the_classes_of_brute_force(session):
    base = [prose(200, 900 + i) for i in range(8)]
    texts = list(ODD) + base + [base[0], base[0]]
    for i in range(60):
        words = base[i % 8].split()
        for _ in range(DRAW.randint(1, 6)):
            words[DRAW.randrange(200)] = DRAW.choice(VOCABULARY)
        texts.append(" ".join(words))
    said = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if said[a] and said[b] and in_order(said[a], said[b]) >= 0.8 * max(len(said[a]), len(said[b])):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(frame(session, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == group
    kept = [r["doc_id"] for r in order_minhash.keep_one(frame(session, texts)).collect()]
    assert sorted(kept, key=str) == sorted([None, *set(group)], key=str)


def test_tiles_give_the_same_links_as_pairs(monkeypatch, session):
    monkeypatch.setattr(order_minhash, "TILE_WORDS", 500)
    test_order_minhash_finds_the_classes_of_brute_force(session)


@pytest.mark.parametrize("tile_rows", [16_384, 40])
def test_vectors_link_as_in_brute_force(session, tile_rows):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(40, 24))
    data = np.vstack([centers, centers[DRAW.randrange(40)] + draw.normal(size=(80, 24)) * 0.2, centers[:5], centers[:5] * 3]).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [1.0, None], [1.0, 2.0]]
    rows += [(1000 + i, v, "x") for i, v in enumerate(bad)]
    table = session.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links string")
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    group = list(range(len(data)))
    for a, b in np.argwhere(near):
        x, y = sorted((group[a], group[b]))
        group = [x if g == y else g for g in group]
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(table, tile_rows=tile_rows).collect()}
    assert [got[i]["n_links"] for i in range(len(data))] == (near.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(data))] == group
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(len(bad)))
    assert embedding_dedup.link_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "rows", "noise"), [(64, 3000, 0.02), (1024, 120, 0.005), (5, 300, 0.1)])
def test_dense_cluster_of_near_copies(session, size, rows, noise):
    draw = np.random.default_rng(size)
    data = draw.normal(size=size) / np.sqrt(size) + draw.normal(size=(rows, size)) * noise
    data = np.vstack([data, draw.normal(size=(rows // 4, size))])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    table = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_vectors(table).collect()}
    assert [got[i] for i in range(len(data))] == (near.sum(1) - 1).tolist()
    assert max(got.values()) > rows // 2


def test_vectors_with_repeated_and_missing_ids(session):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (None, [1.0, 0.0]), (None, None)]
    table = session.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.link_vectors(table).collect()}
    assert len(got) == 4 and got[None] == (0, None, None)
    # The row of id 1 has one of its vectors, and what links with it says the same.
    assert sorted([got[2], got[3]]) in ([(0, 2, True), (1, 1, False)], [(0, 3, True), (1, 1, False)])
    assert got[1] == (1, 1, True)


@pytest.mark.parametrize("share", [0.01, 0.2])
def test_range_join_leaves_no_pair_out(share):
    points = np.random.default_rng(1).normal(size=(900, 8)) * 0.125
    asking, offered = np.arange(0, 900, 2), np.arange(300, 900)
    found = [np.column_stack(p) for p in embedding_dedup.range_join(points, asking, offered, share)]
    found = {tuple(p) for p in np.vstack(found).tolist()}
    gaps = ((points[asking][:, None] - points[offered]) ** 2).sum(-1)
    wanted = {(int(asking[i]), int(offered[j])) for i, j in np.argwhere(gaps <= share)}
    assert wanted <= found and all(((points[a] - points[b]) ** 2).sum() <= share + 2e-5 for a, b in found)


def test_warc_round_trip(session, tmp_path):
    long = "é" * 600
    html = [long, "short", "short", None, "", long, "WARC/1.1\r\n\r\n" + "y" * 2000, long]
    pages = session.createDataFrame(
        [(i, f"http://h.example/{i % 2} a\n", h, "e") for i, h in enumerate(html)] + [(9, None, "", "e")], "page_id bigint, url string, html string, size string"
    )
    rows = warc.archive_pages(pages, str(tmp_path / "archive")).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 9 and all(r["intact"] for r in rows)
    for i, h in enumerate([*html, ""][:8]):
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i]["refers_to"] == (7 if i in (0, 5) else None)
        assert got[i]["record_type"] == ("revisit" if i in (0, 5) else "response")
    keys = [(r["url_key"], r["captured"]) for r in rows]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_loser_tree_merges_runs():
    for count in range(6):
        runs = [sorted(("r", DRAW.choice("abc"), str(DRAW.randint(0, 9)), DRAW.randint(0, 9)) for _ in range(DRAW.randint(0, 7))) for _ in range(count)]
        merged = list(warc.LoserTree(runs))
        assert [warc.order_of(r) for r in merged] == sorted(warc.order_of(r) for run in runs for r in run)


def test_toxicity_learns_repeated_rows_once(session):
    rows = [(i, prose(30, i) + (" vile slur" if i % 3 == 0 else "")) for i in range(200)]
    docs = session.createDataFrame(rows, "doc_id bigint, text string")
    labels = session.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    once = toxicity.fit_toxicity(docs, labels)
    emptied = docs.union(docs).union(docs.selectExpr("doc_id", "cast(null as string)"))
    again = toxicity.fit_toxicity(emptied, labels.union(labels))
    assert once.weights.any()
    assert np.allclose(once.weights, again.weights) and once.bias == pytest.approx(again.bias)


def test_toxicity_learns_marked_words_and_scores_whole_texts(session):
    rows = [(i, f"{prose(40, i)} {'grumbler' if i % 3 == 0 else ''} {prose(40, -i)}", None, None, 0) for i in range(300)]
    kinds = "doc_id bigint, text string, score string, n_tokens string, key int"
    docs = session.createDataFrame(rows + [(1000, None, None, None, 0), (1001, "", None, None, 0)], kinds)
    labels = session.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5000, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in scored if r["doc_id"] < 300)
    assert all(0 <= r["score"] < 0.5 for r in scored if r["doc_id"] >= 1000)
    assert toxicity.drop_toxic(docs, model).count() == 202
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(docs, none).collect())


def test_language_of_held_out_and_odd_texts(session):
    sounds = {"aa": "aeioulmn", "bb": "ktrpszgx"}
    rows = [
        (i, " ".join("".join(random.Random(i * 99 + k).choice(sounds[n]) for _ in range(5)) for k in range(30)), n)
        for i in range(200)
        for n in [("aa", "bb")[i % 2]]
    ]
    docs = session.createDataFrame(rows + [(900, None, None), (901, "12 !?", "aa"), (902, rows[0][1] * 400, None)], "doc_id bigint, text string, lang string")
    model = language_id.fit_language(docs)
    got = {r["doc_id"]: r for r in language_id.identify_language(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == n for i, _, n in rows]) > 0.95
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    nothing = language_id.fit_language(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify_language(docs, nothing).collect()} == {"und"}
