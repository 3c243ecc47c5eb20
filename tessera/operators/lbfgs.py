"""Limited-memory BFGS as a coroutine: it yields points and is sent their loss and gradient.

Several shards' solvers can so advance in step, each point's loss and gradient being one row of a single distributed
aggregate.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trace:
    loss_start: float = float("nan")
    loss_end: float = float("nan")
    evaluations: int = 0
    losses: list[float] = field(default_factory=list)


def minimise(x: np.ndarray, max_iter: int, trace: Trace, memory: int = 10, tolerance: float = 1e-8) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Returns the best point; Armijo backtracking keeps the loss from growing."""
    x = np.asarray(x, float)
    f, g = yield x
    trace.evaluations, trace.loss_start, trace.loss_end = 1, f, f
    trace.losses.append(f)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) < tolerance:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            q -= a * y
            alphas.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        step, slope = 1.0, -(g @ q)
        if slope >= 0:
            q, slope = g, -(g @ g)
        while True:
            new = x - step * q
            f1, g1 = yield new
            trace.evaluations += 1
            if f1 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step *= 0.5
        if f1 > f:
            break
        s, y = new - x, g1 - g
        if y @ s > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(f - f1) <= 1e-12 * max(1.0, abs(f))
        x, f, g = new, f1, g1
        trace.loss_end = f
        trace.losses.append(f)
        if done:
            break
    return x
