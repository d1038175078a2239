"""Derivative-free searches that ask for many candidates at a time.

``rate`` gets a list of points and returns their costs; a generation of candidates is
one call, so a search over a distributed objective costs one job an iteration. Costs
that are not finite count as ``WORST``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

WORST = 1e6
Rate = Callable[[list[np.ndarray]], Sequence[float]]


def first_simplex(start: np.ndarray) -> np.ndarray:
    """The start, and points that differ by 5 % in one coordinate (by 0.00025 where it is 0)."""
    start = np.asarray(start, float)
    out = np.tile(start, (len(start) + 1, 1))
    for i, v in enumerate(start):
        out[i + 1, i] = v * 1.05 if v else 0.00025
    return out


def offered(simplex: np.ndarray) -> np.ndarray:
    """Of a simplex sorted by cost: reflected, expanded, outer and inner contracted point, then the shrunken ones."""
    centre, worst = simplex[:-1].mean(0), simplex[-1]
    moved = [2 * centre - worst, 3 * centre - 2 * worst, 1.5 * centre - 0.5 * worst, 0.5 * centre + 0.5 * worst]
    return np.array([*moved, *(simplex[0] + 0.5 * (simplex[1:] - simplex[0]))])


def stepped(simplex: np.ndarray, cost: np.ndarray, points: np.ndarray, rated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next simplex, sorted, by Nelder and Mead's rules from the offered points and their costs."""
    n = len(simplex) - 1
    reflected, expanded, outer, inner = rated[:4]
    simplex, cost = simplex.copy(), cost.copy()
    take = None
    if reflected < cost[0]:
        take = 1 if expanded < reflected else 0
    elif reflected < cost[n - 1]:
        take = 0
    elif reflected < cost[n]:
        take = 2 if outer <= reflected else None
    else:
        take = 3 if inner < cost[n] else None
    if take is None:
        simplex[1:], cost[1:] = points[4:], rated[4:]
    else:
        simplex[n], cost[n] = points[take], rated[take]
    order = np.argsort(cost, kind="stable")
    return simplex[order], cost[order]


def settled(simplex: np.ndarray, cost: np.ndarray, tolerance: float = 1e-4) -> bool:
    return np.abs(simplex[1:] - simplex[0]).max() <= tolerance and np.abs(cost[1:] - cost[0]).max() <= tolerance


def _costs(rate: Rate, points: Sequence[np.ndarray]) -> np.ndarray:
    got = np.array([np.nan if v is None else v for v in rate(list(points))], float)
    return np.where(np.isfinite(got), got, WORST)


def simplex_search(rate: Rate, start: Sequence[float], rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Nelder and Mead's search: each round rates all the points that its rules may ask for at once."""
    simplex = first_simplex(np.asarray(start, float))
    cost = _costs(rate, simplex)
    order = np.argsort(cost, kind="stable")
    simplex, cost = simplex[order], cost[order]
    for _ in range(rounds):
        if settled(simplex, cost, tolerance):
            break
        points = offered(simplex)
        simplex, cost = stepped(simplex, cost, points, _costs(rate, points))
    return simplex[0], float(cost[0])


def probes(at: np.ndarray, bounds: Sequence[tuple[float, float]], width: float) -> np.ndarray:
    """Points beside ``at`` along each coordinate, inside the bounds: up, then down."""
    out = []
    for i, (lo, hi) in enumerate(bounds):
        for side in (width, -width):
            p = at.copy()
            p[i] = min(max(p[i] + side, lo), hi)
            out.append(p)
    return np.array(out)


def slopes(points: np.ndarray, rated: np.ndarray) -> np.ndarray:
    up, down = points[0::2], points[1::2]
    run = np.diagonal(up - down)
    return np.where(run > 0, (rated[0::2] - rated[1::2]) / np.where(run > 0, run, 1), 0.0)


def along(at: np.ndarray, slope: np.ndarray, bounds: Sequence[tuple[float, float]], steps: int) -> np.ndarray:
    """Points down the slope, clipped to the bounds; the first step moves one coordinate by 1, each next one half as far."""
    reach = np.abs(slope).max()
    way = -slope / reach if reach > 0 else np.zeros_like(slope)
    lo, hi = np.array(bounds, float).T
    return np.array([np.clip(at + way * 0.5**k, lo, hi) for k in range(steps)])


def gradient_search(rate: Rate, start: Sequence[float], bounds: Sequence[tuple[float, float]], rounds: int = 20, width: float = 1e-3, steps: int = 12, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Projected gradient descent; a round rates the probes of the slope, then all step lengths. Returns the best point seen."""
    at = np.clip(np.asarray(start, float), *np.array(bounds, float).T)
    best, least = at, float(_costs(rate, [at])[0])
    for _ in range(rounds):
        beside = probes(best, bounds, width)
        ahead = along(best, slopes(beside, rated := _costs(rate, beside)), bounds, steps)
        both, costs = np.concatenate([beside, ahead]), np.concatenate([rated, _costs(rate, ahead)])
        k = int(np.argmin(costs))
        if not costs[k] < least - tolerance * max(1.0, abs(least)):
            if costs[k] < least:
                best, least = both[k], float(costs[k])
            break
        best, least = both[k], float(costs[k])
    return best, least
