"""Temperature mixing on a dictionary of sources, step by step: what the operator's tables are held to."""

from __future__ import annotations

import math
from dataclasses import dataclass

from lodestone.llm.mixing import ENTROPY, REPEATS, STEPS


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total, largest = sum(tokens.values()), max(tokens.values())
    raised = {s: (n / largest) ** exponent if total else 1.0 for s, n in tokens.items()}
    return {s: r / sum(raised.values()) for s, r in raised.items()}


def entropy(w: dict[str, float]) -> float:
    """As a share of the largest possible; 1 for a single source."""
    return -sum(p * math.log(p) for p in w.values() if p) / math.log(len(w)) if len(w) > 1 else 1.0


def repeats(tokens: dict[str, int], w: dict[str, float]) -> dict[str, float]:
    """Passes over each source when the budget gives the least repeated one exactly one pass, so that no document is left out."""
    per = {s: w[s] / n for s, n in tokens.items()}
    least = min(per.values())
    return {s: p / least for s, p in per.items()}


def _bisect(ok, lo: float = 0.0, hi: float = 1.0) -> float:
    """The exponent where ok, true towards lo, turns false."""
    if ok(hi):
        return hi
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: dict[str, float]
    passes: dict[str, float]


def plan(tokens: dict[str, int], target: float = ENTROPY, most: float = REPEATS) -> Plan:
    """Sources without tokens take no part."""
    some = {s: n for s, n in tokens.items() if n > 0}
    if not some:
        return Plan(1.0, {}, {})
    by_entropy = _bisect(lambda a: entropy(weights(some, a)) >= target)
    # the repetition limit wins: passes fall as the exponent rises
    by_limit = 1 - _bisect(lambda b: max(repeats(some, weights(some, 1 - b)).values()) <= most)
    a = max(by_entropy, by_limit)
    w = weights(some, a)
    return Plan(a, w, repeats(some, w))
