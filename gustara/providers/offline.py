"""Deterministic providers that need no network."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import types as T



@dataclass(frozen=True)
class KeywordProvider:
    """Answers a schema from keywords found in the row's texts (the parts after the first).

    Text field: the answer of the most frequent keyword, ties to the earlier rule, else the
    default. List field: the answers of all keywords present, in rule order. Boolean field:
    whether any keyword is present.
    """

    schema: T.StructType
    rules: dict[str, tuple[tuple[str, str], ...]]
    default: str = "unknown"

    def generate(self, requests: list[list[str]], params: dict[str, Any]) -> list[str]:
        return [json.dumps(self._answer("\n".join(parts[1:]).lower()), ensure_ascii=False) for parts in requests]

    def _answer(self, text: str) -> dict[str, Any]:
        answer: dict[str, Any] = {}
        for f in self.schema.fields:
            rules = self.rules.get(f.name, ())
            counts = [text.count(word) for word, _ in rules]
            if isinstance(f.dataType, T.ArrayType):
                answer[f.name] = [value for (_, value), n in zip(rules, counts) if n]
            elif isinstance(f.dataType, T.BooleanType):
                answer[f.name] = any(counts)
            else:
                top = max(counts, default=0)
                answer[f.name] = rules[counts.index(top)][1] if top else self.default
        return answer


@dataclass(frozen=True)
class ProfileMatchProvider:
    """Pointwise judge over (instruction, user profile JSON, item profile JSON).

    Liked when the item's kind is among the user's preferred kinds; confidence is high when the
    item's cuisine is the user's leading one as well.
    """

    def generate(self, requests: list[list[str]], params: dict[str, Any]) -> list[str]:
        return [json.dumps(self._judge(parts)) for parts in requests]

    def _judge(self, parts: list[str]) -> dict[str, Any]:
        user, item = _profile(parts[1]), _profile(parts[2])
        liked = profile_match(user, item)
        same = bool(item.get("cuisine_type")) and item.get("cuisine_type") == user.get("cuisine_preference")
        why = "kind of item preferred by user" if liked else "kind of item not among preferences"
        return {"would_like": liked, "confidence": "high" if same else "low", "justification": why}


@dataclass(frozen=True)
class ListMatchProvider:
    """Pairwise judge over (instruction, comparison prompt): more matching items wins, ties A."""

    profile_mark: str = ">>> Recipe Profile: "
    user_mark: str = "USER PROFILE:\n"
    list_mark: str = " BEGIN LIST of MODEL "

    def generate(self, requests: list[list[str]], params: dict[str, Any]) -> list[str]:
        return [json.dumps(self._judge(parts[1])) for parts in requests]

    def _judge(self, prompt: str) -> dict[str, Any]:
        head, list_a, list_b = prompt.split(self.list_mark)
        user = _profile(head.split(self.user_mark, 1)[1])
        a, b = (self._matches(user, body) for body in (list_a, list_b))
        margin = abs(a - b)
        return {
            "preferred_model": "B" if b > a else "A",
            "confidence": "high" if margin >= 3 else "low",
            "justification": f"{a} against {b} matching items",
        }

    def _matches(self, user: dict[str, Any], body: str) -> int:
        lines = [line for line in body.split("\n") if line.startswith(self.profile_mark)]
        return sum(profile_match(user, _profile(line[len(self.profile_mark) :])) for line in lines)


def profile_match(user: dict[str, Any], item: dict[str, Any]) -> bool:
    return item.get("food_type") in (user.get("food_preferences") or [])


def _profile(text: str) -> dict[str, Any]:
    try:
        value, _ = json.JSONDecoder().raw_decode(text.strip())
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


class HashingProvider:
    """Signed feature hashing of blank-separated lower-case tokens, unit length.

    Bucket: first seven hex digits of the token's md5 modulo ``dim``. Sign: plus when the
    eighth digit is even. A text without tokens, or whose counts cancel, has no embedding.
    """

    def __init__(self, dim: int = 64, cache_size: int = 200_000):
        self.dim = dim
        self.cache_size = cache_size
        self._slots = _Slots(dim)

    def embed(self, texts: list[str], task_type: str = "RETRIEVAL_DOCUMENT") -> list[np.ndarray]:
        return [self._embed_one(t) for t in texts]

    def _embed_one(self, text: str) -> np.ndarray:
        tokens = text.lower().encode("utf-8", "surrogatepass").split()  # bytes split at blanks of ASCII only
        if not tokens:
            return np.empty(0)
        if len(self._slots) > self.cache_size:
            self._slots.clear()
        slots = np.fromiter(map(self._slots.__getitem__, tokens), np.int64, len(tokens))
        counts = np.bincount(slots, minlength=2 * self.dim).reshape(self.dim, 2)
        counts = (counts[:, 1] - counts[:, 0]).astype(np.float64)
        length = np.sqrt((counts**2).sum())
        return counts / length if length else np.empty(0)


class _Slots(dict):
    """Token to twice its bucket, plus one for the sign plus; computed once per token."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        digest = hashlib.md5(token).hexdigest()
        slot = self[token] = int(digest[:7], 16) % self.dim * 2 + (digest[7] in "02468ace")
        return slot

    def __reduce__(self):
        return _Slots, (self.dim,)
