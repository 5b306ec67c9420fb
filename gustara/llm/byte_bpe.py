"""Byte-level BPE encoding and decoding over padded matrices of distinct pieces.

Texts are split by a pattern; every distinct piece of a batch is one row of a matrix of token ids,
padded to the width of its length bucket. In each round every row merges its leftmost pair of
minimum rank, all rows at once; ranks of pairs come from a hash table in numpy arrays, and rows
without a pair left leave the matrix. Pieces met before are taken from a bounded memory.
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import islice

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from gustara.llm.common import text_stage

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Pieces above this many bytes merge one by one through a heap: a matrix would take a round per byte.
MATRIX_BYTES = 1024
MATRIX_CELLS = 1 << 20
# Pieces and ids remembered between two batches.
PIECES_KEPT, IDS_KEPT = 200_000, 1 << 21
PIECES_AT_ONCE = 1 << 17
LONG_TEXT = 1 << 19
CONTRACTIONS, WORD = "'s|'t|'re|'ve|'m|'ll|'d", r" ?\p{L}+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PairTable:
    """Ranks of mergeable pairs of token ids: open addressing over two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY)
        self.values = np.full(1 << bits, NONE)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        slot = key * SPREAD >> self.shift
        while key.size:
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            slots, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = key[placed], value[placed]
            rest = np.ones(key.size, bool)
            rest[placed] = False
            key, value, slot = key[rest], value[rest], slot[rest] + np.uint64(1) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE where it does not merge; a negative id is padding."""
        found = np.full(left.size, NONE)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[live].astype(np.uint64) << np.uint64(32) | right[live].astype(np.uint64)
        slot = key * SPREAD >> self.shift
        while live.size:
            seen = self.keys[slot]
            hit = seen == key
            found[live[hit]] = self.values[slot[hit]]
            more = ~hit & (seen != EMPTY)
            live, key, slot = live[more], key[more], slot[more] + np.uint64(1) & self.mask
        return found


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if sizes.size else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Decoder:
    """Bytes of the tokens of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_start[ids], self.token_size[ids]).tobytes()


class ByteBpe(Decoder):
    """Encoder and decoder of one vocabulary. Ids are what tiktoken's ``encode_ordinary`` gives."""

    def __init__(self, path: str, pattern: str):
        self.whole = read_ranks(path)
        super().__init__(self.whole)
        self.pairs = PairTable(self.whole)
        self.byte_ids = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        # Words begin with a blank or a letter, contractions with an apostrophe: trying words first
        # gives the same pieces in less time.
        self.split = regex.compile(pattern.replace(f"{CONTRACTIONS}|{WORD}|", f"{WORD}|{CONTRACTIONS}|", 1))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _forget_much(self) -> None:
        if len(self.index) > PIECES_KEPT or self.used > IDS_KEPT:
            self._forget()

    def _keep(self, pieces: list[str], rows: list[np.ndarray]) -> None:
        count, need = len(self.index), sum(r.size for r in rows)
        while self.flat.size < self.used + need:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.starts.size < count + len(rows):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.empty_like(self.sizes)])
        sizes = np.array([r.size for r in rows], np.int64)
        self.starts[count : count + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[count : count + len(rows)] = sizes
        self.flat[self.used : self.used + need] = np.concatenate(rows)
        self.used += need
        self.index.update(zip(pieces, range(count, count + len(pieces)), strict=True))

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before, by length bucket."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        known: list[tuple[str, np.ndarray]] = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.whole.get(raw)
            if rank is not None:
                known.append((piece, np.array([rank], np.int32)))
            elif len(raw) > MATRIX_BYTES:
                known.append((piece, self._merge_long(raw)))
            else:
                buckets.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                known += zip((p for p, _ in part), self._merge_rows([raw for _, raw in part], width), strict=True)
        if known:
            self._keep([p for p, _ in known], [r for _, r in known])

    def _merge_rows(self, raws: list[bytes], width: int) -> list[np.ndarray]:
        sizes = np.array([len(r) for r in raws])
        ids = np.full((len(raws), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raws), width - 1)
        ranks = np.hstack([ranks, np.full((len(raws), 1), NONE)])
        row, out = np.arange(len(raws)), [None] * len(raws)
        while row.size:
            at = ranks.argmin(1)
            line = np.arange(row.size)
            best = ranks[line, at]
            ended = best == NONE
            if ended.any():
                for r, tokens, size in zip(row[ended], ids[ended], sizes[ended], strict=True):
                    out[r] = tokens[:size].copy()
                go = ~ended
                width = max(1, int(sizes[go].max(initial=1)))
                row, at, best, sizes = row[go], at[go], best[go], sizes[go]
                ids, ranks = ids[go, :width], ranks[go, :width]
                line = np.arange(row.size)
                if not row.size:
                    break
            ids[line, at] = best
            column = np.arange(width)
            moved = column[None, :] > at[:, None]
            # Cells behind the merged pair move one to the left; the last one becomes padding.
            ids = np.where(moved, np.hstack([ids[:, 1:], np.full((row.size, 1), -1, np.int32)]), ids)
            ranks = np.where(moved, np.hstack([ranks[:, 1:], np.full((row.size, 1), NONE)]), ranks)
            sizes = sizes - 1
            after = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1)
            ranks[line, at] = self.pairs.ranks(best, after)
            before = at > 0
            ranks[line[before], at[before] - 1] = self.pairs.ranks(ids[line[before], at[before] - 1], best[before])
        return out

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over linked tokens."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        first = self.pairs.ranks(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        ahead, behind = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        pair_rank = first.tolist() + [int(NONE)]

        def rank(a: int, b: int) -> int:
            return int(self.pairs.ranks(np.array([a], np.int32), np.array([b], np.int32))[0])

        while heap:
            found, at = heapq.heappop(heap)
            if pair_rank[at] != found:
                continue
            right = ahead[at]
            ids[at], ids[right], pair_rank[right] = found, -1, int(NONE)
            ahead[at] = ahead[right]
            if ahead[at] < len(ids):
                behind[ahead[at]] = at
                pair_rank[at] = rank(found, ids[ahead[at]])
            else:
                pair_rank[at] = int(NONE)
            if pair_rank[at] != NONE:
                heapq.heappush(heap, (pair_rank[at], at))
            left = behind[at]
            if left >= 0:
                pair_rank[left] = rank(ids[left], found)
                if pair_rank[left] != NONE:
                    heapq.heappush(heap, (pair_rank[left], left))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _pieces(self, text: str):
        """Pieces of a text, a bounded number at a time."""
        if len(text) <= LONG_TEXT:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while part := list(islice(found, PIECES_AT_ONCE)):
            yield part

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of whole texts; the new pieces of a batch go through the matrices together."""
        batches, long = [], {}
        fresh: set[str] = set()
        self._forget_much()
        for i, text in enumerate(texts):
            parts = self._pieces(text)
            if len(text) > LONG_TEXT:
                long[i] = parts
                batches.append([])
            else:
                batches.append(next(parts))
                fresh.update(batches[-1])
        self._learn(fresh.difference(self.index))
        out = [self._look_up(pieces) for pieces in batches]
        for i, parts in long.items():
            out[i] = np.concatenate([self._encode_part(pieces) for pieces in parts])
        return out

    def _encode_part(self, pieces: list[str]) -> np.ndarray:
        self._forget_much()
        self._learn(set(pieces).difference(self.index))
        return self._look_up(pieces)

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return gather(self.flat, self.starts[at], self.sizes[at])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@functools.lru_cache(maxsize=2)
def load_decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encode_documents(
    docs: DataFrame,
    text: str = "text",
    out: str = "tokens",
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the token ids of the whole text, packed as little-endian unsigned 32-bit integers.

    NULL and empty texts have no tokens. All rows and columns stay (``keep`` names fewer); a column
    already named ``out`` is replaced. Only the vocabulary is held in a worker, with a bounded
    memory of pieces.
    """

    def make():
        bpe = load(vocabulary_path(vocabulary), pattern)
        return lambda texts: [[ids.astype("<u4").tobytes() for ids in bpe.encode_all([t or "" for t in texts])]]

    return text_stage(docs, text, make, {out: "binary"}, keep)


def round_trip(
    docs: DataFrame,
    text: str = "text",
    out: str = "tokens",
    decoded: str | None = "decoded",
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out`` (as ``encode_documents``) and ``decoded`` (as ``decode_documents`` of it) in one stage.

    Without ``decoded`` the bytes do not leave the stage: a text that they differ from is an error.
    """

    def make():
        bpe = load(vocabulary_path(vocabulary), pattern)

        def both(texts: list) -> list[list]:
            tokens = bpe.encode_all([t or "" for t in texts])
            back = [bpe.decode(ids) for ids in tokens]
            packed = [ids.astype("<u4").tobytes() for ids in tokens]
            if decoded is not None:
                return [packed, back]
            if any(b != (t or "").encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)):
                raise ValueError("decoded bytes differ from the text")
            return [packed]

        return both

    return text_stage(docs, text, make, {out: "binary", **({decoded: "binary"} if decoded is not None else {})}, keep)


def decode_documents(
    encoded: DataFrame,
    tokens: str = "tokens",
    out: str = "decoded",
    vocabulary: str = VOCABULARY,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the bytes that the packed ids of ``tokens`` stand for. NULL ids give no bytes."""

    def make():
        bpe = load_decoder(vocabulary_path(vocabulary))
        return lambda packed: [[bpe.decode(np.frombuffer(p or b"", "<u4").astype(np.int64)) for p in packed]]

    return text_stage(encoded, tokens, make, {out: "binary"}, keep)
