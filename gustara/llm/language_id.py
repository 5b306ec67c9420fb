"""Language of a text by a small byte convolutional network in numpy.

Texts are cut into fixed-length windows of UTF-8 bytes. A window's bytes are embedded, filters of
several widths slide over them, the maximum of each filter over the window goes through a softmax
layer. A text gets the mean of its windows' probabilities, weighted by their bytes. Training uses a
bounded number of windows per language, prediction all windows of every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import text_stage
from gustara.llm.toxicity import held_out
from gustara.operators.ordering import top_k

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS, DEPTH = 8, 6
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 500, 3
BLOCK = 48
UNDETERMINED = "und"


@dataclass
class ByteConvolution:
    """Embedding (byte 0 is padding and embeds to zero), filters by width, dense layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        """Which inputs a filter of each width sees within the widest span."""
        reach = np.repeat(WIDTHS, FILTERS)
        return (np.repeat(np.arange(max(WIDTHS)), DEPTH)[:, None] < reach[None, :]).astype(np.float32)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteConvolution:
        draw = np.random.default_rng(seed)
        count, span = FILTERS * len(WIDTHS), max(WIDTHS) * DEPTH
        embed = draw.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        embed[0] = 0
        filters = draw.normal(0, 1 / np.sqrt(span), (span, count)).astype(np.float32) * cls.mask()
        dense = draw.normal(0, 0.1, (count, len(languages))).astype(np.float32)
        return cls(languages, embed, filters, np.zeros(count, np.float32), dense, np.zeros(len(languages), np.float32))

    def spans(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes below every position of the widest filter: (windows, positions, inputs)."""
        seen = self.embed[windows].reshape(len(windows), -1)
        wide = np.lib.stride_tricks.sliding_window_view(seen, max(WIDTHS) * DEPTH, axis=1)
        return np.ascontiguousarray(wide[:, ::DEPTH])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each window, a block of windows at a time."""
        out = np.empty((len(windows), self.filters.shape[1]), np.float32)
        for at in range(0, len(windows), BLOCK):
            spans = self.spans(windows[at : at + BLOCK])
            made = spans.reshape(-1, spans.shape[2]) @ self.filters
            out[at : at + BLOCK] = made.reshape(len(spans), -1, made.shape[1]).max(1)
        return np.maximum(out + self.shift, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.dense + self.bias)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        asked = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        raws = [texts[i].encode("utf-8", "replace") for i in asked]
        counts = np.array([-(-len(r) // WINDOW) for r in raws])
        ends = np.cumsum(counts)
        at = 0
        while at < len(asked):
            # Texts together up to a bounded number of windows; a long text goes in slices.
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4096, "right")))
            part = raws[at:upto]
            if len(part) == 1:
                total = np.zeros(len(self.languages))
                for cut in range(0, len(part[0]), 4096 * WINDOW):
                    total += self._weighted(part[0][cut : cut + 4096 * WINDOW]).sum(0)
                sums = total[None, :]
            else:
                weighted = np.concatenate([pad(r) for r in part])
                sizes = np.concatenate([window_sizes(len(r)) for r in part])
                probability = self.probabilities(weighted) * sizes[:, None]
                sums = np.add.reduceat(probability, np.cumsum(counts[at:upto]) - counts[at:upto], axis=0)
            share = sums / sums.sum(1, keepdims=True)
            for i, best, row in zip(asked[at:upto], share.argmax(1), share, strict=True):
                names[i], scores[i] = self.languages[best], float(min(1.0, row[best]))
            at = upto
        return names, scores

    def _weighted(self, raw: bytes) -> np.ndarray:
        return self.probabilities(pad(raw)) * window_sizes(len(raw))[:, None]


LETTER = regex.compile(r"\p{L}")


def pad(raw: bytes) -> np.ndarray:
    """The windows of one text, the last one filled with zeros."""
    rows = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


def window_sizes(size: int) -> np.ndarray:
    rows = -(-size // WINDOW)
    return np.minimum(WINDOW, size - np.arange(rows) * WINDOW).astype(np.float64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 8, rate: float = 0.01) -> ByteConvolution:
    """Fit the network by Adam on labelled windows."""
    net, draw = ByteConvolution.fresh(languages), np.random.default_rng(11)
    names = ("embed", "filters", "shift", "dense", "bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    mask, span, step = net.mask(), max(WIDTHS), 0
    for epoch in range(epochs):
        order = draw.permutation(len(label))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x, y = windows[rows], label[rows]
            spans = net.spans(x)
            made = (spans.reshape(-1, spans.shape[2]) @ net.filters).reshape(len(x), -1, net.filters.shape[1])
            place = made.argmax(1)
            top = np.take_along_axis(made, place[:, None, :], 1)[:, 0] + net.shift
            hidden = np.maximum(top, 0)
            error = softmax(hidden @ net.dense + net.bias)
            error[np.arange(len(x)), y] -= 1
            error /= len(x)
            back = error @ net.dense.T * (top > 0)
            # Only the place of each filter's maximum gets a gradient.
            held = np.take_along_axis(spans, place[:, :, None], 1)
            grads = {
                "dense": hidden.T @ error, "bias": error.sum(0), "shift": back.sum(0),
                "filters": np.einsum("nfs,nf->sf", held, back) * mask,
            }
            down = (back[:, :, None] * net.filters.T[None]).reshape(len(x), -1, span, DEPTH)
            bytes_below = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(span)]
            grads["embed"] = np.stack(
                [np.bincount(bytes_below.ravel(), down[..., d].ravel(), 256) for d in range(DEPTH)], 1
            )
            grads["embed"][0] = 0
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.99 * second[n] + 0.01 * grads[n] ** 2
                move = pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    return net


def fit_language(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE, windows_per_text: int = WINDOWS_PER_TEXT,
) -> ByteConvolution:
    """Train on ``windows_per_text`` windows of at most ``texts_per_language`` texts per language.

    The texts are the first ones by a hash of the id, the windows lie at hashed places of the whole
    text; every second one is cut short, as short texts are asked for too. Rows with a NULL or
    held-out id, a NULL language or no text are not learned from. The driver receives these windows
    only: their number is bounded by the parameters and the number of languages.
    """
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    rows = rows.where(
        F.col("__id").isNotNull() & F.col("__lang").isNotNull() & (F.length("__text") > 0) & ~held_out(F.col("__id"))
    )
    order = [F.xxhash64("__id"), F.col("__id"), F.xxhash64("__text")]
    numbers = F.explode(F.sequence(F.lit(0), F.lit(windows_per_text - 1)))
    start = F.pmod(F.xxhash64("__id", "__n"), F.greatest(F.lit(1), F.length("__text") - WINDOW)).cast("int") + 1
    windows = rows.withColumn("__n", numbers).select("__id", "__lang", "__n", F.substring("__text", start, F.lit(WINDOW)).alias("__text"))
    chosen = top_k(windows, ["__lang", "__n"], order, texts_per_language, "__rank")
    found = chosen.select("__lang", "__n", "__rank", "__text").toArrow().to_pydict()
    languages = sorted(set(found["__lang"]))
    if not languages:
        return ByteConvolution([], *(np.zeros((1, 1), np.float32),) * 5)
    data = np.zeros((len(found["__text"]), WINDOW), np.uint8)
    label = np.array([languages.index(n) for n in found["__lang"]])
    order = sorted(range(len(label)), key=lambda i: (found["__n"][i], found["__rank"][i], found["__lang"][i]))
    for i in order:
        raw = found["__text"][i].encode("utf-8", "replace")[:WINDOW]
        if (found["__rank"][i] + found["__n"][i]) % 2:
            raw = raw[: 12 + found["__rank"][i] * 37 % (WINDOW - 12)]
        data[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return train(data[order], label[order], languages)


def identify_language(docs: DataFrame, model: ByteConvolution, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` for the whole text.

    NULL texts and texts without a letter are ``und`` with score 0, as are all if no language was
    learned. Equal probabilities give the first language by name. All rows stay; columns of these
    names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: sent.value.predict(texts)

    return text_stage(docs, text, make, {"lang_pred": "string", "score": "double"}, keep)
