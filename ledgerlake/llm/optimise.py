"""L-BFGS over an objective that Spark evaluates, shared by the classifiers."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

MEMORY, SHRINK, LEAST_RATE, MOST_STEPS = 25, 0.4, 1e-8, 1000


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float) -> np.ndarray:
    """The point at which the gradient's norm is ``tolerance`` times that at ``start``.  ``evaluate`` returns value and gradient
    of a convex function.  Ends before only where no step lowers the value any more (the limit of double precision);
    MOST_STEPS is far beyond what the classifiers need and raises, rather than returning an unfinished fit."""
    theta = start
    loss, grad = evaluate(theta)
    goal = tolerance * np.linalg.norm(grad)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MOST_STEPS):
        if np.linalg.norm(grad) <= goal:
            return theta
        q, alphas = grad.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            alphas.append(a)
            q -= a * d
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(grad).max())
        for (s, d), a in zip(steps, reversed(alphas)):
            q += (a - (d @ q) / (s @ d)) * s
        rate = 1.0
        new_loss, new_grad = evaluate(theta - q)
        while new_loss > loss - 1e-4 * rate * (q @ grad) and rate > LEAST_RATE:
            rate *= SHRINK
            new_loss, new_grad = evaluate(theta - rate * q)
        if new_loss >= loss:
            return theta
        s, d = -rate * q, new_grad - grad
        if s @ d > 1e-12:
            steps = (steps + [(s, d)])[-MEMORY:]
        theta, loss, grad = theta + s, new_loss, new_grad
    raise RuntimeError(f"no minimum after {MOST_STEPS} steps")
