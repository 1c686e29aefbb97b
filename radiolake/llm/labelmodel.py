"""Noisy labelling functions combined by expectation maximisation.

One model per label. A labelling function votes 1 (has it), -1 (hasn't) or 0 (can't
say); votes are taken as independent given the truth. What comes to the driver is
the count of each vote pattern, at most 3^k rows for k functions, so the model sees
every row and its size doesn't grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Function:
    """hit: share of true cases that it votes 1 for; false: share of the others."""

    name: str
    hit: float
    false: float


def fit(patterns: dict[tuple[int, ...], int], functions: list[Function], prior: float, strength: float = 0.5, rounds: int = 25) -> dict[tuple[int, ...], float]:
    """pattern -> posterior. strength is the weight of the functions' given rates,
    as a share of all rows: it keeps a rare label from drifting to another cluster."""
    if not patterns:
        return {}
    votes = np.array(list(patterns), dtype=int).reshape(len(patterns), len(functions))
    n = np.array(list(patterns.values()), dtype=float)
    given_hit = np.array([f.hit for f in functions])
    given_false = np.array([f.false for f in functions])
    hit, false, base = given_hit.copy(), given_false.copy(), prior
    yes, no = votes == 1, votes == -1

    def posterior() -> np.ndarray:
        a = np.log(base) + (yes * np.log(hit) + no * np.log(1 - hit)).sum(1)
        b = np.log(1 - base) + (yes * np.log(false) + no * np.log(1 - false)).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -60, 60)))

    for _ in range(rounds):
        p = posterior()
        weight = strength * n.sum()
        true, other = p * n, (1 - p) * n
        hit = ((yes * true[:, None]).sum(0) + given_hit * weight * prior) / (((yes | no) * true[:, None]).sum(0) + weight * prior)
        false = ((yes * other[:, None]).sum(0) + given_false * weight) / (((yes | no) * other[:, None]).sum(0) + weight)
        hit, false = np.clip(hit, 0.02, 0.995), np.clip(false, 1e-5, 0.5)
        base = float(np.clip((true.sum() + prior * weight) / (n.sum() + weight), 1e-4, 0.5))
    p = posterior()
    return {k: float(x) for k, x in zip(patterns, p)}
