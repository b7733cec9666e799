"""Ask-and-tell search over settings with a Gaussian process.

A few dozen scored settings are all a search ever holds, so proposing is a small step on
the driver; judging the proposals is the distributed part (``tuning.search_objective``).
The same space, seed and scores give the same proposals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Real:
    low: float
    high: float

    def at(self, u: float) -> float:
        return round(self.low + u * (self.high - self.low), 6)

    def place(self, value: float) -> float:
        return (value - self.low) / (self.high - self.low)


@dataclass(frozen=True)
class Whole:
    """A whole number: the proposed value rounded, halves to even."""

    low: int
    high: int

    def at(self, u: float) -> int:
        return round(self.low + u * (self.high - self.low))

    def place(self, value: float) -> float:
        return (value - self.low) / (self.high - self.low)


class Choice:
    def __init__(self, *options):
        self.options = options

    def at(self, u: float):
        return self.options[min(int(u * len(self.options)), len(self.options) - 1)]

    def place(self, value) -> float:
        return (self.options.index(value) + 0.5) / len(self.options)


class Search:
    """``ask`` for settings, ``tell`` their scores (higher is better), ask again.

    Without scores the proposals are stratified: each parameter's range is cut into as many
    parts as settings are asked for, and every part is used once. With scores they maximise
    the expected improvement under a Gaussian process with a squared-exponential kernel;
    within a batch a proposal counts as scored at its expected value.
    """

    def __init__(self, space: dict, seed: int = 0, candidates: int = 1_000, width: float = 0.3, noise: float = 1e-3):
        self.space, self.width, self.noise, self.candidates = space, width, noise, candidates
        self.random = np.random.default_rng(seed)
        self.told: list[tuple[dict, float]] = []

    def _setting(self, u: Sequence[float]) -> dict:
        return {name: kind.at(float(x)) for (name, kind), x in zip(self.space.items(), u)}

    def _places(self, settings: Sequence[dict]) -> np.ndarray:
        return np.array([[kind.place(s[name]) for name, kind in self.space.items()] for s in settings]).reshape(len(settings), len(self.space))

    def tell(self, settings: Sequence[dict], scores: Sequence[float]) -> None:
        self.told += [(s, float(v)) for s, v in zip(settings, scores)]

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / (2 * self.width**2))

    def expected(self, settings: Sequence[dict], known: Sequence[tuple[dict, float]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the scores of ``settings`` given the ``known`` ones."""
        x, y = self._places([s for s, _ in known]), np.array([v for _, v in known])
        centre, scale = y.mean(), y.std() or 1.0
        inner = self._kernel(x, x) + self.noise * np.eye(len(x))
        across = self._kernel(self._places(settings), x)
        mean = across @ np.linalg.solve(inner, (y - centre) / scale)
        spread = 1 - (across * np.linalg.solve(inner, across.T).T).sum(1)
        return centre + scale * mean, scale * np.sqrt(np.maximum(spread, 1e-12))

    def ask(self, n: int) -> list[dict]:
        if not self.told:
            cuts = np.stack([(self.random.permutation(n) + self.random.random(n)) / n for _ in self.space], axis=1)
            return [self._setting(u) for u in cuts]
        known, out = list(self.told), []
        for _ in range(n):
            drawn = [self._setting(u) for u in self.random.random((self.candidates, len(self.space)))]
            seen = [s for s, _ in known]
            fresh = [s for s in drawn if s not in seen] or drawn
            mean, spread = self.expected(fresh, known)
            gain = mean - max(v for _, v in known)
            z = gain / spread
            normal = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            below = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
            best = int(np.argmax(gain * below + spread * normal))
            out.append(fresh[best])
            known.append((fresh[best], float(mean[best])))
        return out
