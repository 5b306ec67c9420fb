"""Exact token counts at every prefix of a text, by dynamic programming over the last token.

The encoding of a prefix ends in one token; without it the encoding of a shorter prefix is left.
So count[p] = count[p - len(t)] + 1 for the one token t that ends at p and is compatible with the
last token of the prefix before it: the pair of both must encode to itself. Pieces never reach
from a non-blank into a following blank, so a text falls into words whose counts add up; distinct
words are solved once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustara.llm.common import quoted, text_stage

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
WORDS_KEPT = 250_000
PAIRS_KEPT = 500_000
LONG_TEXT = 1 << 19


class PrefixCounter:
    """Token counts of prefixes as a SentencePiece BPE model with byte fallback gives them."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.suffixes = {p[i:] for p in self.score for i in range(len(p))}
        self.words = re.compile(self._word_pattern())
        # By left token: whether the pair with a right token encodes to itself.
        self._pairs: dict[str, dict[str, bool]] = {}
        self._pair_count = 0
        self._ends: dict[str, int] = {}
        self.alone = {p for p in self.score if len(p) == 1 or self._merged(p) == [p]}

    def _merged(self, text: str) -> list[str]:
        """The merges themselves, best score first and leftmost, for the few characters of a pair."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _word_pattern(self) -> str:
        """Segments that no piece crosses, so that their counts add up.

        Letters, digits and other characters are segments of their own if no piece mixes them, blanks
        belong to what follows; else a text falls at blanks only, or not at all.
        """
        bare = [p.lstrip(BLANK) for p in self.score]
        if any(BLANK in p for p in bare):
            return r"(?s).+"
        kinds = (rf"[^{BLANK}\W\d_]+", rf"[^{BLANK}\w]+", r"[\d_]+")
        if all(any(re.fullmatch(k, p) for k in kinds) for p in bare if p):
            return "|".join(f"{BLANK}*{k}" for k in kinds) + f"|{BLANK}+"
        return f"{BLANK}*[^{BLANK}]+|{BLANK}+"

    def _compatible(self, known: dict[str, bool], left: str, right: str) -> bool:
        answer = known[right] = self._merged(left + right) == [left, right]
        self._pair_count += 1
        return answer

    def _solve(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Words in order, each with the counts of all its prefixes, the empty one first.

        A word goes on from the prefix it shares with the word before it. The list is reused.
        """
        if self._pair_count > PAIRS_KEPT:
            self._pairs, self._pair_count = {}, 0
        suffixes, alone, pairs = self.suffixes, self.alone, self._pairs
        before, counts, lasts = "", [0], [""]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del counts[shared + 1 :], lasts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, starts = end - 1, []
                while start >= 0 and (token := word[start:end]) in suffixes:
                    if token in alone:
                        starts.append(start)
                    start -= 1
                # A character without a piece is a token of its own, written as its bytes.
                for start in reversed(starts or [end - 1]):
                    token = word[start:end]
                    if start:
                        left = lasts[start]
                        known = pairs.get(left)
                        if known is None:
                            known = pairs[left] = {}
                        fits = known.get(token)
                        if fits is None:
                            fits = self._compatible(known, left, token)
                        if not fits:
                            continue
                    lasts.append(token)
                    counts.append(counts[start] + (1 if token in self.score else len(token.encode())))
                    break
                else:
                    raise ValueError(f"no token ends prefix {end} of {word!r}")
            before = word
            yield word, counts

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the counts stored at the ends of their words, added up."""
        if len(self._ends) > WORDS_KEPT:
            self._ends = {}
        return [self._count_long(t) if len(t) > LONG_TEXT else n for t, n in zip(texts, self._count_short(texts), strict=True)]

    def _count_short(self, texts: list[str]) -> list[int]:
        words = [self.words.findall(self.normalize(t)) if 0 < len(t) <= LONG_TEXT else [] for t in texts]
        self._learn(set().union(*words))
        return [sum(map(self._ends.__getitem__, w)) for w in words]

    def _count_long(self, text: str) -> int:
        total, found = 0, (m.group() for m in self.words.finditer(self.normalize(text)))
        while part := list(islice(found, LONG_TEXT // 4)):
            if len(self._ends) > WORDS_KEPT:
                self._ends = {}
            self._learn(set(part))
            total += sum(map(self._ends.__getitem__, part))
        return total

    def _learn(self, words: set[str]) -> None:
        self._ends.update((w, counts[-1]) for w, counts in self._solve(words.difference(self._ends)))

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def _one_to_one(self, text: str) -> str:
        normal = self.normalize(text) if text else ""
        if text and len(normal) != len(text) + 1:
            raise ValueError("prefixes of this model's normalized text are not prefixes of the text")
        return normal

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:p]`` for p = 0 .. len(text), each as the library encodes that prefix.

        Needs a normalizer that maps characters one to one behind one leading blank; a model with
        another one is refused.
        """
        normal = self._one_to_one(text)
        words = self.words.findall(normal)
        steps = {w: np.array(counts) for w, counts in self._solve(set(words))}
        counts, base = [np.zeros(1, np.int64)], 0
        for word in words:
            counts.append(base + steps[word][1:])
            base += int(steps[word][-1])
        whole = np.concatenate(counts)
        if text:
            whole = whole[1:]
            whole[0] = 0  # the empty prefix has no leading blank either
        return whole

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Every word has a token at least, so the cut lies in the word at whose end the budget is
        reached: the stored counts of the words before it are added up, its own prefixes decide.
        """
        at = total = 0
        found = (m.group() for m in self.words.finditer(self._one_to_one(text)))
        while part := list(islice(found, 4096)):
            self._learn(set(part))
            for word in part:
                upto = total + self._ends[word]
                if upto >= budget:
                    _, counts = next(self._solve([word]))
                    inside = max(i for i, n in enumerate(counts) if total + n <= budget)
                    return max(0, at + inside - 1)  # the leading blank is no character of the text
                at, total = at + len(word), upto
        return len(text)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame, text: str = "text", limit: int = 4096, model: str = MODEL, keep: list[str] | None = None
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` of the whole text.

    ``fit_chars`` is the length of the longest prefix within ``limit`` tokens, so cutting there needs
    no second encoding. NULL counts as empty: no bytes, no tokens. All rows stay; columns of these
    names are replaced.
    """

    def make():
        counter = load(model_path(model))

        def stage(texts):
            texts = [t or "" for t in texts]
            tokens = counter.count_all(texts)
            fits = [len(t) if n <= limit else counter.fit(t, limit) for t, n in zip(texts, tokens, strict=True)]
            return [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens], fits

        return stage

    added = {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean", "fit_chars": "bigint"}
    return text_stage(docs, text, make, added, keep)


def prefix_token_counts(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", model: str = MODEL) -> DataFrame:
    """Add ``out``: the exact token count of every prefix, the empty one first. NULL counts as empty."""

    def make():
        counter = load(model_path(model))
        return lambda texts: [[counter.prefix_counts(t or "") for t in texts]]

    return text_stage(docs, text, make, {out: "array<bigint>"})


def truncate(docs: DataFrame, budget: int, text: str = "text", model: str = MODEL) -> DataFrame:
    """Cut every text to its longest prefix of at most ``budget`` tokens; NULL stays NULL."""
    counted = token_counts(docs.withColumn("__cut", F.col(quoted(text))), "__cut", budget, model)
    cut = F.expr("substring(__cut, 1, cast(fit_chars as int))")
    return counted.select(*[cut.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns if c in counted.columns])
