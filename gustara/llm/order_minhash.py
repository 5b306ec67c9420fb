"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its five-word k-mers, each labelled with its occurrence number. A sketch
takes the two smallest k-mers by a hash and keeps them in text order, so texts agree in a sketch
only if they share k-mers in the same order. Bands of two sketches are the buckets. Within a bucket,
members are aligned with few chosen ones until what is left has to be compared with all others, so a
group of copies costs links in its size, not its square. A pair links if the words that a banded
alignment matches in order are at least 0.8 of the words of the longer text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gustara.llm.common import beside_texts, named, numbered, quoted, text_stage
from gustara.llm.components import components
from gustara.operators.skew import attach
from gustara.session import materialize

WORDS, SIMILARITY = 5, 0.8
BANDS, SKETCHES_PER_BAND, TAKEN = 20, 2, 2
# Words of one side of a tile, and word columns counted at once in it.
TILE_WORDS, TILE_COLUMNS = 400_000, 4096
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
MOST = np.uint64(2**64 - 1)
WORD = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes:
    """64-bit hashes of words, the same in every process, with a bounded memory."""

    def __init__(self, most: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def kmers(hashes: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Occurrence-labelled k-mers in text order; a text of fewer words is one k-mer."""
    if not hashes.size:
        return np.empty(0, np.uint64)
    size = min(size, hashes.size)
    count = hashes.size - size + 1
    joined = np.zeros(count, np.uint64)
    for i in range(size):
        joined = mix(joined * MIX[2] + hashes[i : i + count])
    same = np.sort(joined)
    if (same[1:] != same[:-1]).all():
        return mix(joined)
    order = np.argsort(joined, kind="stable")
    begins = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    label = np.empty(count, np.uint64)
    label[order] = np.arange(count) - np.repeat(begins, np.diff(np.append(begins, count)))
    return mix(joined + label * MIX[2])


def bands_of(marks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One bucket number per band of order sketches of labelled k-mers."""
    if not marks.size:
        return np.empty(0, np.int64)
    # Labelled k-mers are uniform 64-bit numbers already: times an odd number they are in a new random order.
    seeds = mix(np.arange(1, bands * SKETCHES_PER_BAND + 1, dtype=np.uint64) * MIX[2]) | np.uint64(1)
    taken, row = min(TAKEN, marks.size), np.arange(seeds.size)
    best = np.zeros((seeds.size, 0), np.uint64)
    places = np.zeros((seeds.size, 0), np.int64)
    step = 1 << 12
    for at in range(0, marks.size, step):
        part = marks[None, at : at + step] * seeds[:, None]
        for _ in range(min(taken, part.shape[1])):
            near = part.argmin(axis=1)
            best = np.hstack([best, part[row, near][:, None]])
            places = np.hstack([places, near[:, None] + at])
            part[row, near] = MOST
        if best.shape[1] > taken:
            stay = np.argsort(best, axis=1, kind="stable")[:, :taken]
            best, places = np.take_along_axis(best, stay, 1), np.take_along_axis(places, stay, 1)
    ordered = marks[np.sort(places, axis=1)]
    sketch = np.zeros(seeds.size, np.uint64)
    for i in range(taken):
        sketch = mix(sketch * MIX[2] + ordered[:, i])
    bucket = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(SKETCHES_PER_BAND):
        bucket = mix(bucket * MIX[2] + sketch[i::SKETCHES_PER_BAND])
    return bucket.view(np.int64)


def chained(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words that an increasing chain of common k-mers matches in order: no more than an alignment does."""
    width = min(WORDS, a.size, b.size)
    _, x, y = np.intersect1d(kmers(a), kmers(b), assume_unique=True, return_indices=True)
    near = np.abs(x - y) <= band
    order = np.argsort(x[near])
    x, y = x[near][order], y[near][order]
    if not y.size:
        return 0
    if (y[1:] <= y[:-1]).any():
        tops: list[int] = []
        last: list[int] = []
        before = np.full(y.size, -1)
        for i, place in enumerate(y.tolist()):
            at = bisect.bisect_left(tops, place)
            before[i] = last[at - 1] if at else -1
            if at == len(tops):
                tops.append(place)
                last.append(i)
            else:
                tops[at], last[at] = place, i
        chain, i = [], last[-1]
        while i >= 0:
            chain.append(i)
            i = before[i]
        x, y = x[chain[::-1]], y[chain[::-1]]
    return int(np.minimum(np.minimum(np.diff(x), np.diff(y)), width).sum()) + width


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most words that two texts match in order, no match further than ``band`` off the diagonal.

    The column of the alignment table is one whole number of a bit per place in the band; a bit is 0
    where the alignment grows, so a word of ``b`` costs a few operations on it.
    """
    places: dict[int, list[int]] = {}
    for place, word in enumerate(a.tolist()):
        places.setdefault(word, []).append(place)
    full = (1 << (2 * band + 1)) - 1
    column, matched = full, 0
    for j, word in enumerate(b.tolist()):
        low = j - band  # the place of bit 0
        if j:
            matched += ~column & 1
            column = column >> 1 | 1 << (2 * band)
        here = places.get(word)
        if here:
            hits = 0
            for place in here[bisect.bisect_left(here, low) : bisect.bisect_right(here, j + band)]:
                hits |= 1 << (place - low)
            grown = column & hits
            column = (column + grown | column - grown) & full
    return matched + (~column & full).bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the words aligned in order are at least ``similarity`` of the longer text's words.

    Unmatched words bound how far a match can lie off the diagonal, so the band loses no such pair.
    Words that both texts begin and end with match; bounds from below and above come before the alignment.
    """
    longer, shorter = max(a.size, b.size), min(a.size, b.size)
    need = int(np.ceil(similarity * longer - 1e-9))
    band = longer - need
    if shorter < need:
        return False
    apart = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(apart[0]) if apart.size else shorter
    a, b, need = a[head:], b[head:], need - head
    shorter -= head
    apart = np.flatnonzero(a[::-1][:shorter] != b[::-1][:shorter])
    tail = int(apart[0]) if apart.size else shorter
    a, b, need = a[: a.size - tail], b[: b.size - tail], need - tail
    if need <= 0 or min(a.size, b.size) < need:
        return need <= 0
    a, b = a.view(np.uint64), b.view(np.uint64)
    if np.intersect1d(kmers(a, 1), kmers(b, 1), assume_unique=True).size < need:
        return False
    return chained(a, b, band) >= need or aligned(a, b, band) >= need


def common_words(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common occurrence-labelled words of every left with every right text, as products of 0/1 matrices."""
    sides = [np.concatenate(s) if s else np.empty(0, np.int64) for s in (left, right)]
    shared = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    counts = np.zeros((len(left), len(right)), np.float32)
    places = []
    for flat, texts in zip(sides, (left, right), strict=True):
        row = np.repeat(np.arange(len(texts)), [t.size for t in texts])
        column = np.searchsorted(shared, flat)
        held = column < shared.size
        held[held] = shared[column[held]] == flat[held]
        places.append((row[held], column[held]))
    for at in range(0, shared.size, TILE_COLUMNS):
        width = min(TILE_COLUMNS, shared.size - at)
        halves = []
        for (row, column), texts in zip(places, (left, right), strict=True):
            here = (column >= at) & (column < at + width)
            half = np.zeros((len(texts), width), np.float32)
            half[row[here], column[here] - at] = 1
            halves.append(half)
        counts += halves[0] @ halves[1].T
    return counts


def tile_pairs(bucket: int, rows: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links between asking and offered rows of one bucket that lie in different components.

    A row is (id, component, asks, asks here, offered here, words, bands). A pair counts in the first
    bucket that both share.
    """
    left, right = [r for r in rows if r[3]], [r for r in rows if r[4]]
    if len(left) * len(right) > 64:
        sizes = [np.array([r[5].size for r in side]) for side in (left, right)]
        # Aligned words are common ones, so too few common ones rule a pair out.
        least = similarity * np.maximum(sizes[0][:, None], sizes[1]) - 0.5
        labelled = [[kmers(r[5].view(np.uint64), 1) for r in side] for side in (left, right)]
        chosen = zip(*np.nonzero(common_words(*labelled) >= least), strict=True)
    else:
        chosen = ((i, j) for i in range(len(left)) for j in range(len(right)))
    out = []
    for i, j in chosen:
        a, b = left[i], right[j]
        if a[1] == b[1] or (b[2] and a[0] < b[0]):
            continue
        shared = np.flatnonzero(a[6] == b[6])
        if a[6][shared[0]] == bucket and similar(a[5], b[5], similarity):
            out.append((max(a[0], b[0]), min(a[0], b[0])))
    return out


def compare_rest(group: DataFrame, pivots: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket that no pivot has brought into one component.

    Members apart from their bucket's pivot ask all others. Buckets are cut into tiles of bounded
    words by a hash of the id, each part of asking rows with each part of offered ones; a tile's
    pairs stay inside its task, only links leave it.
    """
    known = attach(group, pivots, "bucket").withColumn("asks", F.col("component") != F.col("pc"))
    total = F.ceil(F.sum("n") / TILE_WORDS).cast("int").alias("parts")
    split = known.groupBy("bucket").agg(F.max("asks").alias("any"), total).where("any").select("bucket", "parts")
    placed = attach(known.select("bucket", "id", "component", "asks"), split, "bucket")
    mine = F.pmod(F.xxhash64("id"), "parts").cast("int")
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    asked = F.when(F.col("asks"), F.transform(parts, lambda j: F.struct(mine.alias("i"), j.alias("j")))).otherwise(F.array())
    offered = F.transform(parts, lambda i: F.struct(i.alias("i"), mine.alias("j")))
    tiles = placed.withColumn("tile", F.explode(F.array_union(asked, offered)))
    tiles = materialize(
        tiles.select(
            "bucket", "tile.i", "tile.j", "id", "component", "asks",
            (F.col("asks") & (mine == F.col("tile.i"))).alias("left"), (mine == F.col("tile.j")).alias("right"),
        ),
        "tiles",
    )
    filled = tiles.join(words, "id").select("bucket", "i", "j", "id", "component", "asks", "left", "right", "words", "bands")
    sorted_tiles = filled.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, links = None, [], []
        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:8]]
            lists = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in batch.columns[8:]]
            for i, (bucket, a, b, *row) in enumerate(zip(*plain, strict=True)):
                if (bucket, a, b) != tile:
                    links += tile_pairs(tile[0], rows, similarity) if rows else []
                    tile, rows = (bucket, a, b), []
                rows.append((*row, *(flat[at[i] : at[i + 1]] for flat, at in lists)))
        links += tile_pairs(tile[0], rows, similarity) if rows else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return materialize(sorted_tiles.mapInArrow(work, "a bigint, b bigint"), "rest")


def sketch_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h1, h2, n, bands): two hashes of the word sequence, its word count and its buckets.

    Rows without an id or without a word have no sketch: they link with nothing.
    """
    rows = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("said"))

    def make():
        hashed = WordHashes()

        def stage(texts):
            firsts, seconds, counts, bands = [], [], [], []
            for said in texts:
                words = words_of(said)
                whole = hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()
                marks = kmers(hashed(words))
                firsts.append(int.from_bytes(whole[:8], "little", signed=True))
                seconds.append(int.from_bytes(whole[8:], "little", signed=True))
                counts.append(len(words))
                bands.append(bands_of(marks))
            return firsts, seconds, counts, bands

        return stage

    added = {"h1": "bigint", "h2": "bigint", "n": "bigint", "bands": "array<bigint>"}
    return text_stage(rows.where("id is not null and said is not null"), "said", make, added, ["id"]).where("n > 0")


def words_by_id(ids: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, words, bands): the hashed words and buckets of the documents with these ids."""
    rows = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("id"), F.col(quoted(text)).alias("said"))

    def make():
        hashed = WordHashes()

        def stage(texts):
            words = [hashed(words_of(t)) for t in texts]
            return [w.view(np.int64) for w in words], [bands_of(kmers(w)) for w in words]

        return stage

    added = {"words": "array<bigint>", "bands": "array<bigint>"}
    return text_stage(beside_texts(rows, ids, "id", "left_semi"), "said", make, added, ["id"])


def align_pairs(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids that link."""
    first = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("x")), "a")
    both = first.join(words.select(F.col("id").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(2), batch.column(3))]
            links = []
            for i in range(batch.num_rows):
                x, y = (values[at[i] : at[i + 1]] for values, at in sides)
                links.append(similar(x, y, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return materialize(both.mapInArrow(check, "a bigint, b bigint"), "aligned")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size) per row with an integer id: near-duplicates share ``class_id``, the smallest id.

    Words are runs of letters, digits and underscores, lower case; texts with the same words are
    copies. Rows sharing an id are in one class. A NULL or wordless text is a class of its own; rows
    with a NULL id are left out.
    """
    ids = docs.select(F.col(quoted(doc_id)).cast("bigint").alias("id")).where("id is not null")
    sketched = materialize(sketch_documents(docs, doc_id, text), "sketches")
    copies = sketched.groupBy("h1", "h2").agg(F.min("id").alias("node"))
    member = materialize(attach(sketched.select("id", "h1", "h2"), copies, ["h1", "h2"]).select("id", "node"), "members")
    nodes = sketched.join(materialize(copies.select("node").distinct(), "nodes").withColumnRenamed("node", "id"), "id", "left_semi")
    buckets = nodes.select("id", "n", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    buckets = materialize(attach(buckets, shared, "bucket", "left_semi"), "buckets")
    words = materialize(words_by_id(buckets.select("id").distinct(), docs, doc_id, text), "words")
    links = member.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    # Every member with its bucket's smallest id first; then what is still apart from it with all others.
    first = F.min(F.struct("id", "n")).alias("p")
    centers = buckets.groupBy("bucket").agg(first).select("bucket", F.col("p.id").alias("b"), F.col("p.n").alias("m"))
    pairs = attach(buckets, centers, "bucket").where("id <> b").where(F.least("n", "m") >= similarity * F.greatest("n", "m"))
    pairs = materialize(pairs.select(F.col("id").alias("a"), "b").distinct(), "pairs")
    found = align_pairs(pairs, words, similarity)
    group = attach(buckets, components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    group = materialize(group, "grouped")
    pivots = group.groupBy("bucket").agg(F.min(F.struct("id", "component")).alias("p")).select("bucket", F.col("p.component").alias("pc"))
    found = found.unionByName(compare_rest(group, pivots, words, similarity))
    classes = components(links.unionByName(found))
    rows = attach(ids, classes, "id", "left").select("id", F.coalesce("component", "id").alias("class_id"))
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return attach(materialize(rows, "classes"), sizes, "class_id").select("id", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that of the smallest id, with its own columns; rows without an id stay.

    Of rows that share that id the first one by a hash of the text stays.
    """
    classes = near_duplicates(docs, doc_id, text, similarity).groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    marked = classes.where("id <> class_id or n > 1").select("id", (F.col("id") != F.col("class_id")).alias("gone"))
    said = F.xxhash64(F.col(quoted(text))).alias("said")
    rows = docs.select(*numbered(docs), F.col(quoted(doc_id)).cast("bigint").alias("id"), said)
    left = beside_texts(rows, marked, "id", "left").where(~F.coalesce("gone", F.lit(False)))
    # The join has the rows of an id together already; rows without one are spread by their text.
    alone = F.when(F.col("id").isNull(), F.col("said"))
    ranked = left.withColumn("place", F.row_number().over(W.partitionBy("id", alone).orderBy("said")))
    return ranked.where("id is null or place = 1").select(*named(docs))
