"""Damped least squares of the double-exponential curve for many searches at once.

A search is a curve's points (t, m, y: distinct intervals with their number and mean height, which a key's time
span bounds) and a start. Spark deals the searches to tasks; a task takes the searches of a batch side by side: one
round forms the errors, gradients and curvatures of all of them in one pass over their points, solves
their 4 by 4 systems together and moves each. A search that has ended leaves the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

# The functions below travel to the executors themselves, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A search has settled when three rounds running gain less than this share of the error,
# the tolerance least-squares solvers commonly use.
SETTLED_GAIN = 1e-8
# And only where no free parameter could, to first order, take more than this share off the error.
SETTLED_SHARE = 1e-3
# An error this small beside the values themselves is rounding, of which nothing is to be gained.
NEGLIGIBLE = 1e-8
# A gradient below this is none.
FLAT = 1e-14
FIRST_DAMPING, LEAST_DAMPING, MOST_DAMPING = 1e-3, 1e-12, 1e16

# Pairs of five columns, those of the first one first; and where the pairs of the others lie in a square.
ROWS, COLUMNS = np.triu_indices(5)
SQUARE = np.array([np.flatnonzero((ROWS == min(i, j)) & (COLUMNS == max(i, j)))[0] for i in range(1, 5) for j in range(1, 5)])

SEARCHING, CONVERGED, STALLED, HOPELESS, NEEDLESS = 0, 1, 2, 3, 4
Bounds = tuple[Sequence[float], Sequence[float]]


class Points:
    """The points of several searches one after the other; ``sums`` adds up columns within each search."""

    def __init__(self, t: np.ndarray, m: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> None:
        self.t, self.m, self.y, self.sizes = t, m, y, sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.edges = np.cumsum(sizes) - sizes

    def only(self, keep: np.ndarray) -> Points:
        inside = keep[self.owner]
        return Points(self.t[inside], self.m[inside], self.y[inside], self.sizes[keep])

    def sums(self, columns: np.ndarray) -> np.ndarray:
        return np.add.reduceat(columns, self.edges, axis=-1)

    def curves(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both components of each curve, and both amplitudes, at the points."""
        a1, l1, a2, l2 = theta.T[:, self.owner]
        return np.exp(-l1 * self.t), np.exp(-l2 * self.t), a1, a2

    def judge(self, theta: np.ndarray, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error, gradient (n, 4) and curvature (n, 4, 4) of the searches; in log space above ``floor``."""
        e1, e2, a1, a2 = self.curves(theta)
        value = a1 * e1 + a2 * e2
        # What is off, and the four slopes; then all products of two of them.
        v = np.stack([value, e1, -a1 * self.t * e1, e2, -a2 * self.t * e2])
        if floor is not None:
            value = value + floor
            v[1:] /= value
            v[0] = np.log(value)
        v[0] = self.y - v[0]
        sums = self.sums(v[ROWS] * v[COLUMNS] * self.m)
        return sums[0], sums[1:5].T, sums[SQUARE].T.reshape(-1, 4, 4)


def _steps(theta: np.ndarray, pull: np.ndarray, curve: np.ndarray, damping: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The damped step of each search. A parameter at its bound that a step would push out stays, and the others are solved for again."""
    own = np.einsum("nii->ni", curve)
    damped = curve + np.einsum("ni,ij->nij", damping[:, None] * np.maximum(own, 1e-12), np.eye(4))
    moves, steps, todo = ~held, np.zeros_like(theta), np.arange(len(theta))
    while len(todo):
        some = moves[todo]
        system, right = damped[todo] * (some[:, :, None] & some[:, None, :]), (pull[todo] * some)[:, :, None]
        try:
            x = np.linalg.solve(system + ~some[:, :, None] * np.eye(4), right)[:, :, 0]
        except np.linalg.LinAlgError:
            # Directions without information have no step.
            x = (np.linalg.pinv(system, rcond=4 * np.finfo(float).eps, hermitian=True) @ right)[:, :, 0]
        out = some & (((theta[todo] <= low) & (x < 0)) | ((theta[todo] >= high) & (x > 0)))
        steps[todo] = x * some
        again = out.any(axis=1)
        moves[todo[again]] &= ~out[again]
        todo = todo[again]
    return steps * moves


def _share(pull: np.ndarray, curve: np.ndarray, cost: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The largest share of the error that one free parameter could take away, to first order."""
    own = np.einsum("nii->ni", curve)
    return np.where(held, 0.0, pull**2 / np.maximum(own * cost[:, None], 1e-300)).max(axis=1)


def search(points: Points, start: np.ndarray, floor: float | None, bounds: Bounds, rounds: int, accepted) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (n, 4) and status of each search.

    ``CONVERGED``: it has settled, or the gradient is small. ``STALLED``: it finds no lower point though the gradient
    is not small. ``SEARCHING``: its rounds are used up. ``HOPELESS``: the error at the start is no number. ``accepted``
    is told of searches as they converge (numbers and parameters) and answers which ones need not go on: ``NEEDLESS``.
    A parameter at a bound that the gradient pushes outwards is held for the round.
    """
    low, high = (np.asarray(b, float) for b in bounds)
    out, status = start.copy(), np.full(len(start), SEARCHING)
    with np.errstate(all="ignore"):
        rounding = NEGLIGIBLE * points.sums(points.m * points.y**2)
        theta, number = start.copy(), np.arange(len(start))
        cost, pull, curve = points.judge(theta, floor)
        damping, settled = np.full(len(start), FIRST_DAMPING), np.zeros(len(start), int)
        now = np.where(np.isfinite(cost), SEARCHING, HOPELESS)
        for done_rounds in range(rounds + 1):
            ended = now != SEARCHING
            if ended.any():
                out[number], status[number] = theta, now
                good = number[now == CONVERGED]
                needless = accepted(good, out[good]) if len(good) else np.zeros(0, int)
                status[needless[status[needless] == SEARCHING]] = NEEDLESS
                keep = status[number] == SEARCHING
                if not keep.any():
                    break
                points = points.only(keep)
                theta, number, cost, pull, curve, damping, settled, rounding = (x[keep] for x in (theta, number, cost, pull, curve, damping, settled, rounding))
            if done_rounds == rounds:
                break
            now = np.full(len(theta), SEARCHING)
            held = ((theta <= low) & (pull < 0)) | ((theta >= high) & (pull > 0))
            flat = (held | (np.abs(pull) < FLAT * (1 + cost[:, None]))).all(axis=1)
            trial = np.clip(theta + _steps(theta, pull, curve, damping, held, low, high), low, high)
            t_cost, t_pull, t_curve = points.judge(trial, floor)
            better = np.isfinite(t_cost) & np.isfinite(t_curve).all(axis=(1, 2)) & (t_cost <= cost) & ~flat
            settled = np.where(better, np.where(cost - t_cost <= SETTLED_GAIN * cost, settled + 1, 0), settled)
            # Damped steps gain little anywhere, so a search has settled only where no parameter could gain much either.
            stuck = ~better & (damping * 4 > MOST_DAMPING)
            at_rest = _share(pull, curve, cost + rounding, held) <= SETTLED_SHARE
            theta, cost = np.where(better[:, None], trial, theta), np.where(better, t_cost, cost)
            pull, curve = np.where(better[:, None], t_pull, pull), np.where(better[:, None, None], t_curve, curve)
            done = better & (settled >= 3) & (_share(pull, curve, cost + rounding, held) <= SETTLED_SHARE)
            damping = np.where(better, np.maximum(damping / 5, LEAST_DAMPING), damping * 4)
            now = np.where(flat | done | (stuck & at_rest), CONVERGED, np.where(stuck, STALLED, SEARCHING))
        out[number[status[number] == SEARCHING]] = theta[status[number] == SEARCHING]
    return out, status
