"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law of inertia the positive pivots of A - s I = L D L^T count the
eigenvalues above s. Bisection on these counts isolates the k-th largest eigenvalue;
Rayleigh quotient iteration converges to it cubically inside its interval, and two more
counts certify that the value found is number k. A multiple eigenvalue has an interval
that no count can split; its vectors are kept orthogonal to each other.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Bunch and Parlett's bound: growth is least if a single pivot must reach this share.
ALPHA = (1 + 17**0.5) / 8
# Steps of one search; bisection alone needs about 60.
STEPS = 300


class Factors:
    """L D L^T of a symmetric matrix with complete pivoting and 1 x 1 or 2 x 2 pivots."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, float)
        n = len(a)
        self.order = np.arange(n)
        self.lower = np.zeros((n, n))
        self.blocks: list[tuple[int, np.ndarray]] = []
        at = 0
        while at < n:
            rest = np.abs(a[at:, at:])
            single = int(np.argmax(np.diagonal(rest)))
            largest = rest[single, single]
            np.fill_diagonal(rest, 0)
            row, column = np.unravel_index(int(np.argmax(rest)), rest.shape)
            if largest >= ALPHA * rest[row, column]:
                chosen = [single]
            else:
                chosen = [min(row, column), max(row, column)]
            for step, place in enumerate(chosen):
                self._swap(a, at + step, at + place)
            size = len(chosen)
            pivot = a[at : at + size, at : at + size].copy()
            self.blocks.append((at, pivot))
            below = a[at + size :, at : at + size]
            if below.size and np.any(pivot):
                scaled = below @ np.linalg.inv(pivot)
                self.lower[at + size :, at : at + size] = scaled
                a[at + size :, at + size :] -= scaled @ below.T
            at += size

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.lower[[i, j]] = self.lower[[j, i]]
            self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """Number of positive eigenvalues."""
        return sum(int((np.linalg.eigvalsh(pivot) > 0).sum()) for _, pivot in self.blocks)

    def solve(self, right: np.ndarray, least: float) -> np.ndarray:
        """Solution for one right side; a pivot below `least` counts as `least`."""
        y = right[self.order].astype(float)
        for j in range(len(y)):
            y[j + 1 :] -= self.lower[j + 1 :, j] * y[j]
        for at, pivot in self.blocks:
            values, vectors = np.linalg.eigh(pivot)
            values = np.where(np.abs(values) < least, least, values)
            y[at : at + len(pivot)] = vectors @ ((vectors.T @ y[at : at + len(pivot)]) / values)
        for j in range(len(y) - 1, -1, -1):
            y[j] -= self.lower[j + 1 :, j] @ y[j + 1 :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


class Slices:
    """Counts of the eigenvalues above points, each counted once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.known: dict[float, int] = {}

    def above(self, point: float) -> int:
        if point not in self.known:
            self.known[point] = self.shifted(point).positive()
        return self.known[point]

    def shifted(self, point: float) -> Factors:
        return Factors(self.matrix - point * np.eye(len(self.matrix)))

    def bracket(self, k: int, low: float, high: float) -> tuple[float, float]:
        """The closest known points with at least k, and fewer than k, eigenvalues above."""
        for point, count in self.known.items():
            if count >= k:
                low = max(low, point)
            else:
                high = min(high, point)
        return low, high


def leading(matrix: np.ndarray, count: int, floor: float = 1e-12) -> list[tuple[float, np.ndarray]]:
    """The `count` largest eigenvalues of a positive semidefinite matrix, with unit vectors.

    Values not above `floor` of the trace are rounding and are left out, so there may be
    fewer, none for a zero matrix. Raises ArithmeticError if a number cannot be certified.
    """
    trace = float(np.trace(matrix))
    found: list[tuple[float, np.ndarray]] = []
    if not trace > 0:
        return found
    scaled = matrix / trace
    slices = Slices(scaled)
    for k in range(1, min(count, len(matrix)) + 1):
        # in exact arithmetic no eigenvalue exceeds the trace
        if slices.above(floor) < k:
            break
        value, vector = _eigenpair(slices, k, [v for _, v in found], floor)
        found.append((value * trace, vector))
    return found


def _orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _eigenpair(slices: Slices, k: int, others: list[np.ndarray], floor: float) -> tuple[float, np.ndarray]:
    a = slices.matrix
    norm = float(np.linalg.norm(a))
    tight = 16 * EPS * norm
    vector = np.random.default_rng(k).standard_normal(len(a))
    vector = _orthogonal(vector, others)
    low, high = slices.bracket(k, floor, 1.0 + 16 * len(a) * EPS)
    for _ in range(STEPS):
        wide = high - low > tight
        if wide and not (slices.above(low) == k and slices.above(high) == k - 1):
            # not isolated yet: halve the interval by a count
            slices.above((low + high) / 2)
            low, high = slices.bracket(k, low, high)
            continue
        quotient = float(vector @ a @ vector)
        inside = low - tight <= quotient <= high + tight
        residual = float(np.linalg.norm(a @ vector - quotient * vector))
        if inside and residual <= 4 * tight:
            near = residual + tight
            if slices.above(quotient - near) >= k > slices.above(quotient + near):
                return quotient, vector
        if not inside and wide:
            slices.above((low + high) / 2)
            low, high = slices.bracket(k, low, high)
        shift = quotient if inside else (low + high) / 2
        vector = _orthogonal(slices.shifted(shift).solve(vector, EPS * norm), others)
    raise ArithmeticError(f"eigenvalue {k} could not be certified")
