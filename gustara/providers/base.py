"""Batch providers for generation and embedding.

A provider is any picklable object with one of the two methods below; hosted models plug in
here. ``open`` is called once per task, so a client lives as long as its partition.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol, TypeVar

import numpy as np

Answer = TypeVar("Answer")


class TextProvider(Protocol):
    def generate(self, requests: list[list[str]], params: dict[str, Any]) -> list[str]:
        """One answer text per request; a request is its list of prompt parts."""
        ...


class EmbeddingProvider(Protocol):
    dim: int

    def embed(self, texts: list[str], task_type: str) -> list[np.ndarray]:
        """One vector per text, empty where the text has no embedding."""
        ...


@dataclass(frozen=True)
class Retry:
    """Fixed wait between attempts; the last failure is kept.

    ``give_up`` calls that fail one after the other, each with all its attempts, are an outage and
    end the task; None never ends it.
    """

    attempts: int = 5
    wait_seconds: float = 3.0
    give_up: int | None = 100

    def call(self, fn: Callable[[], Answer]) -> Answer:
        for attempt in range(1, self.attempts + 1):
            try:
                return fn()
            except Exception:  # noqa: BLE001 - a provider may raise anything
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait_seconds)
        raise ValueError("attempts must be at least 1")

    def isolate(self, rows: list, answer: Callable[[list], list], failed: Callable[[Exception], Any]) -> list:
        """One result per row: ``answer`` of batches that are halved while they fail, ``failed`` of rows that fail alone."""
        pending, out, in_a_row = [rows] if rows else [], [], 0
        while pending:
            part = pending.pop()
            try:
                out += self.call(lambda: answer(part))
                in_a_row = 0
            except Exception as failure:  # noqa: BLE001
                in_a_row += 1
                if self.give_up is not None and in_a_row >= self.give_up:
                    raise RuntimeError(f"{in_a_row} calls of the provider failed in a row") from failure
                if len(part) == 1:
                    out.append(failed(failure))
                else:
                    half = len(part) // 2
                    pending += [part[half:], part[:half]]
        return out


@dataclass(frozen=True)
class GenerationParams:
    temperature: float = 0.5
    thinking_budget: int | None = 512
    max_output_tokens: int = 2048
    extra: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        config: dict[str, Any] = {
            "temperature": self.temperature,
            "maxOutputTokens": self.max_output_tokens,
            **self.extra,
        }
        if self.thinking_budget is not None:
            config["thinking_config"] = {"thinking_budget": self.thinking_budget}
        return {"generationConfig": config}


def envelope(text: str) -> str:
    """Answer text in the response envelope the extraction step reads."""
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]}, ensure_ascii=False)
