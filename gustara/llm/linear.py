"""Character n-gram features and a logistic model over ratio-scaled columns, in numpy."""

from __future__ import annotations

import numpy as np

BITS = 20
ORDERS = (3, 4, 5)
CHUNK = 1 << 20
STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


class Grams:
    """Distinct hashed character n-grams of whole texts, as sorted-free arrays of bucket numbers."""

    def __init__(self, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
        self.shift, self.orders = np.uint32(32 - bits), orders
        self.mark = np.zeros(1 << bits, np.int32)
        self.seen = np.zeros(1 << bits, bool)

    def _distinct(self, codes: np.ndarray, fresh_from: int) -> np.ndarray:
        """Buckets of the n-grams that end at or behind ``fresh_from``, each once."""
        parts, size = [], codes.size
        state = np.zeros(size, np.uint32)
        for n in range(1, max(self.orders) + 1):
            state = state[: size - n + 1] if n > 1 else state
            state = state * STEP + codes[n - 1 :]
            if n in self.orders:
                state_n = state[max(0, fresh_from - n + 1) :] + np.uint32(n)
                parts.append((state_n ^ (state_n >> np.uint32(15))) * MIX >> self.shift)
            if size <= n:
                break
        found = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        order = np.arange(found.size, dtype=np.int32)
        self.mark[found] = order  # the last of equal buckets stays
        return found[self.mark[found] == order]

    def of(self, text: str) -> np.ndarray:
        """Buckets of one text, lower case, with a blank before and behind it."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.size <= CHUNK:
            return self._distinct(codes, 0)
        reach, out = max(self.orders) - 1, []
        for at in range(0, codes.size, CHUNK):
            begin = max(0, at - reach)
            found = self._distinct(codes[begin : at + CHUNK], at - begin)
            found = found[~self.seen[found]]
            self.seen[found] = True
            out.append(found)
        out = np.concatenate(out)
        self.seen[out] = False
        return out


def log_count_ratio(columns: np.ndarray, rows: np.ndarray, label: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """Naive Bayes log-count ratio of every column between the two labels."""
    counts = [np.bincount(columns[label[rows] == side], minlength=size) + smoothing for side in (1, 0)]
    totals = [np.count_nonzero(label == side) + 2 * smoothing for side in (1, 0)]
    return np.log(counts[0] / totals[0]) - np.log(counts[1] / totals[1])


def fit_logistic(
    columns: np.ndarray, rows: np.ndarray, scale: np.ndarray, label: np.ndarray, weight: np.ndarray,
    penalty: float, rounds: int, rate: float,
) -> tuple[np.ndarray, float]:
    """Weights (already multiplied by ``scale``) and bias of a weighted logistic model, by Adam."""
    size, total = scale.size, weight.sum()
    value = scale[columns]
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        margin = np.bincount(rows, value * w[columns], label.size) + b
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / total
        slope = np.append(np.bincount(columns, value * error[rows], size) + penalty * w, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w * scale, float(b)
