"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes runs through the UTF-8 text. Where its leading bits are zero, a piece
ends: with ``k`` zero bits pieces are about ``2**k`` bytes long (the block size). Each piece becomes
one of 64 characters, drawn from the sum of its rolling hashes, so an edit changes the pieces it
touches and no others. A fingerprint is ``block:pieces:pieces at twice the block``, where the block
is the smallest one, from 4 bytes on, that gives at most 64 pieces: whole texts of any length are
covered, and texts of like length get compatible blocks. Two fingerprints are compared by the edit
distance (insertions and deletions) of their pieces at a common block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gustara.llm.common import document_key, quoted, text_stage
from gustara.session import materialize

WINDOW = 7
LEAST_BITS = 2
PIECES = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
STEP, SPREAD, FOLD = np.uint32(0x01000193), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
BLOCK_BYTES = 1 << 16
# Ends of pieces held for one text before those of blocks that are surely too small are let go.
ENDS_HELD = 1 << 13
DONE, FIRST, LAST = 0, 1, 2


def _rolling(values: np.ndarray) -> np.ndarray:
    """Mixed hash of every window of seven values."""
    size = values.size - WINDOW + 1
    out = values[:size].copy()
    for lag in range(1, WINDOW):
        out *= STEP
        out += values[lag : lag + size]
    out *= SPREAD
    out ^= out >> np.uint32(15)
    out *= FOLD
    return out


def _bits(hashes: np.ndarray) -> int:
    """Fewest leading zero bits, from LEAST_BITS on, that at most PIECES - 1 of the hashes have."""
    if hashes.size < PIECES:
        return LEAST_BITS
    limit = int(np.partition(hashes, PIECES - 1)[PIECES - 1])
    return max(LEAST_BITS, 33 - limit.bit_length()) if limit else 33


def _ends(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hash and running sum where pieces may end, the sum over the whole text, and the bits of its block.

    A block that has too many pieces already is given up for good, so what is held stays small.
    """
    held_hash, held_sum = np.empty(0, np.uint32), np.empty(0, np.uint32)
    bits, total = LEAST_BITS, np.uint32(0)
    lead = np.zeros(WINDOW - 1, np.uint32)
    for at in range(0, len(raw), BLOCK_BYTES):
        values = np.frombuffer(raw, np.uint8, min(BLOCK_BYTES, len(raw) - at), at).astype(np.uint32)
        values += np.uint32(1)
        values = np.concatenate([lead, values])
        lead = values[1 - WINDOW :]
        hashes = _rolling(values)
        sums = np.cumsum(hashes, dtype=np.uint32)
        sums += total
        total = sums[-1]
        ends = np.flatnonzero(hashes >> np.uint32(32 - bits) == 0) if bits <= 32 else np.empty(0, np.int64)
        held_hash = np.concatenate([held_hash, hashes[ends]])
        held_sum = np.concatenate([held_sum, sums[ends]])
        if held_hash.size > ENDS_HELD:
            bits = max(bits, _bits(held_hash))
            kept = _at_level(held_hash, bits)
            held_hash, held_sum = held_hash[kept], held_sum[kept]
    return held_hash, held_sum, int(total), max(bits, _bits(held_hash))


def _at_level(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint32(32 - bits) == 0 if bits <= 32 else np.zeros(hashes.size, bool)


def _pieces(sums: np.ndarray, total: int) -> str:
    """One character per piece; the last piece goes to the end of the text."""
    edges = np.concatenate([np.zeros(1, np.uint32), sums, np.array([total], np.uint32)])
    found = np.diff(edges)  # wraps around, as the sums did
    if sums.size and sums[-1] == np.uint32(total):
        found = found[:-1]  # the text ends with a piece
    mixed = found * SPREAD
    mixed ^= mixed >> np.uint32(13)
    return ALPHABET[(mixed * FOLD) >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """Fingerprint of a whole text. NULL and empty texts have no pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return f"{1 << LEAST_BITS}::"
    hashes, sums, total, bits = _ends(raw)
    return f"{1 << bits}:{_pieces(sums[_at_level(hashes, bits)], total)}:{_pieces(sums[_at_level(hashes, bits + 1)], total)}"


def _common(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of many pairs of at most 64 characters, bit-parallel."""
    n = len(left)
    masks = np.zeros((n, 128), np.uint64)
    for row, pieces in enumerate(left):
        place = np.frombuffer(pieces.encode(), np.uint8)
        np.bitwise_or.at(masks[row], place, np.uint64(1) << np.arange(place.size, dtype=np.uint64))
    steps = np.zeros((n, max((len(r) for r in right), default=0)), np.uint8)
    for row, pieces in enumerate(right):
        steps[row, : len(pieces)] = np.frombuffer(pieces.encode(), np.uint8)
    line, rest = np.arange(n), np.full(n, np.uint64(2**64 - 1))
    for column in range(steps.shape[1]):
        match = rest & masks[line, steps[:, column]]
        rest = (rest + match) | (rest - match)
    return np.bitwise_count(~rest).astype(np.int64)


def likeness(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """1 for equal fingerprints, 0 for blocks that have nothing in common, else by edit distance.

    At a common block size it is 1 - distance / (both lengths), the better of two common sizes.
    Two equal piece lists of different texts stay below 1 only if the fingerprints differ elsewhere.
    A NULL is like the fingerprint of an empty text.
    """
    empty = fingerprint("")
    pairs = [(a or empty, b or empty) for a, b in zip(left, right, strict=True)]
    rows, mine, theirs = [], [], []
    for row, (a, b) in enumerate(pairs):
        (size_a, one_a, two_a), (size_b, one_b, two_b) = a.split(":"), b.split(":")
        same = [(one_a, one_b, int(size_a), int(size_b)), (two_a, one_b, 2 * int(size_a), int(size_b))]
        same += [(one_a, two_b, int(size_a), 2 * int(size_b)), (two_a, two_b, 2 * int(size_a), 2 * int(size_b))]
        for x, y, block_x, block_y in same:
            if block_x == block_y and x and y:
                rows.append(row)
                mine.append(x)
                theirs.append(y)
    out = np.zeros(len(pairs))
    if rows:
        lengths = np.array([len(x) + len(y) for x, y in zip(mine, theirs, strict=True)])
        np.maximum.at(out, rows, 2.0 * _common(mine, theirs) / lengths)
    out[[a == b for a, b in pairs]] = 1.0
    return out


def fingerprint_documents(docs: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add ``out`` to all rows; NULL texts count as empty. A column already named ``out`` is replaced."""
    return text_stage(docs, text, lambda: lambda texts: [[fingerprint(t) for t in texts]], {out: "string"}, keep)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters (or all) of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


EDITED = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(texts: list[str], prints: list[str], next_texts: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, next_texts, strict=True)]
    changed_prints = [fingerprint(c) for c in changed]
    columns = [
        [len(t) for t in texts],
        [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
        prints,
        changed_prints,
        likeness(prints, changed_prints),
        likeness(prints, next_prints),
    ]
    types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id`` and the columns of EDITED, where the edit takes in the next document.

    The next document follows in ascending order of ids (NULL ids last, equal ids by a hash of the
    text); after the last comes the first. NULL texts are empty; every row stays, repeated ones too;
    an empty table gives no rows. Other columns are not looked at.

    Texts are shuffled once, into ranges of the order. A task reads its range from front to back,
    holding one batch, and leaves out the last document of the range; that one and the first of the
    range are written with their texts, and meet across ranges: two texts per task, whatever the
    number of documents.
    """
    keyed = docs.select(*document_key(docs, doc_id, text), F.col(quoted(doc_id)).alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange("no_id", "doc", "version").sortWithinPartitions("no_id", "doc", "version")
    report = T._parse_datatype_string(EDITED).fields
    rest = [T.StructField("text", T.StringType()), T.StructField("slice", T.IntegerType()), T.StructField("kind", T.IntegerType())]
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), *report, *rest])

    def batch(ids: pa.Array, columns: list[pa.Array], texts: list[str | None], kind: int) -> pa.RecordBatch:
        n, task = len(ids), TaskContext.get().partitionId()
        tail = [pa.array(texts, pa.string()), pa.array([task] * n, pa.int32()), pa.array([kind] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([ids, *columns, *tail], names=schema.names)

    def edge(ids: pa.Array, text: str, found: str, kind: int) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        none[2] = pa.array([found], pa.string())
        return batch(ids, none, [text], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for given in batches:
            if not given.num_rows:
                continue
            ids, texts = given.column("id"), given.column("text").to_pylist()
            prints = [fingerprint(t) for t in texts]
            if held is None:
                yield edge(ids.slice(0, 1), texts[0], prints[0], FIRST)
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, prints = [held[1], *texts], [held[2], *prints]
            if len(texts) > 1:
                yield batch(ids.slice(0, len(texts) - 1), _report(texts[:-1], prints[:-1], texts[1:], prints[1:]), [None] * (len(texts) - 1), DONE)
            held = ids.slice(len(texts) - 1), texts[-1], prints[-1]
        if held is not None:
            yield edge(*held, LAST)

    found = materialize(ordered.select("id", "text").mapInArrow(run, schema), "fingerprints", partition_by="kind")
    edges = found.select("kind", "slice", "id", "text", "fingerprint")
    first = edges.where(F.col("kind") == FIRST)
    # One number per task: which range follows which; the first follows the last.
    order = W.orderBy("slice")
    least = F.min("slice").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    slices = first.select("slice", F.coalesce(F.lead("slice").over(order), least).alias("following"))
    nexts = first.select(F.col("slice").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    met = edges.where(F.col("kind") == LAST).join(slices, "slice").join(nexts, "following").select("id", "text", "fingerprint", "next_text", "next_print")
    done = T.StructType(schema.fields[: len(report) + 1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            ids, *others = given.columns
            yield pa.RecordBatch.from_arrays([ids, *_report(*[c.to_pylist() for c in others])], names=done.names)

    rows = found.where(F.col("kind") == DONE).select(*done.names).unionByName(met.mapInArrow(close, done))
    return rows.withColumnRenamed("id", doc_id)
