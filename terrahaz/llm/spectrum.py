"""Leading eigenvectors of a symmetric matrix by spectrum slicing.

The signs of D in V - sI = L D L' count the eigenvalues above s.  Such counts
bisect the spectrum until an interval holds one eigenvalue; Rayleigh quotient
iteration finishes it; two more counts certify its number.
"""

from __future__ import annotations

import numpy as np

BUNCH_KAUFMAN = (1 + 17 ** 0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: positive signs in D of a pivoted LDL' of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    size, k, above = len(a), 0, 0
    while k < size:
        below = np.abs(a[k + 1:, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most = below.max() if len(below) else 0.0
        pair = False
        if abs(a[k, k]) < BUNCH_KAUFMAN * most:
            row = np.abs(a[k:, r])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < BUNCH_KAUFMAN * most * most:
                pair = abs(a[r, r]) < BUNCH_KAUFMAN * row.max()
                to = k + pair
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if pair:  # such a block has one eigenvalue of either sign
            above += 1
            rest = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(a[k:k + 2, k:k + 2], rest.T)
            k += 2
            continue
        above += a[k, k] > 0
        if a[k, k]:
            rest = a[k + 1:, k]
            a[k + 1:, k + 1:] -= np.outer(rest / a[k, k], rest)
        k += 1
    return int(above)


class Slices:
    """Counts at the shifts asked so far; narrows an interval around the eigenvalue of a number."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        top = float(np.abs(matrix).sum(1).max())  # no eigenvalue is farther from 0
        self.known = {-top: len(matrix), 2 * top: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = count_above(self.matrix, shift)
        return self.known[shift]

    def around(self, number: int) -> tuple[float, float]:
        """The narrowest known interval with eigenvalue ``number`` (from 1, falling): low < e <= high."""
        low = max(s for s, n in self.known.items() if n >= number)
        return low, min(s for s, n in self.known.items() if s > low and n < number)

    def halve(self, number: int) -> None:
        low, high = self.around(number)
        self.above((low + high) / 2)


def _shifted_solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    a = matrix - shift * np.eye(len(matrix))
    nudge = np.finfo(float).eps * np.abs(matrix).max()
    while True:
        try:
            return np.linalg.solve(a, right)
        except np.linalg.LinAlgError:  # an eigenvalue to the last bit: any tiny change serves
            a = a + nudge * np.eye(len(a))
            nudge *= 2


def _rayleigh(matrix: np.ndarray, start: float, scale: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from two inverse iterations at ``start``."""
    v = rng.standard_normal(len(matrix))
    for _ in range(2):
        v = _shifted_solve(matrix, start, v / np.linalg.norm(v))
    v /= np.linalg.norm(v)
    value, best = float(v @ matrix @ v), np.inf
    for _ in range(20):
        residual = np.linalg.norm(matrix @ v - value * v)
        if residual >= best / 2 and best < 1e-12 * scale:
            break
        best = min(best, residual)
        w = _shifted_solve(matrix, value, v)
        if not np.isfinite(w).all():
            break
        v = w / np.linalg.norm(w)
        value = float(v @ matrix @ v)
    return value, v


def _cluster(matrix: np.ndarray, middle: float, width: float, size: int, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that rounding does not part: one inverse iteration for all of them."""
    q = rng.standard_normal((len(matrix), size))
    for _ in range(4):
        q, _ = np.linalg.qr(_shifted_solve(matrix, middle + 2 * width + 1e-14 * scale, q))
    values, turn = np.linalg.eigh(q.T @ matrix @ q)
    return values[::-1], (q @ turn)[:, ::-1]


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues, falling, of a symmetric matrix, and their unit eigenvectors as columns.

    Only eigenvalues above rounding (order times epsilon times the largest) are
    returned.  The entry of largest magnitude in a vector is positive.  Raises
    ArithmeticError if the counts contradict a number.
    """
    size = len(matrix)
    if not size or not np.abs(matrix).max():
        return np.zeros(0), np.zeros((size, 0))
    slices, rng = Slices(matrix), np.random.default_rng(0)
    scale = float(np.abs(matrix).sum(1).max())
    rounding = size * np.finfo(float).eps * scale
    values, vectors = [], []
    while len(values) < min(most, size):
        k = len(values) + 1
        low, high = slices.around(k)
        while (slices.known[low], slices.known[high]) != (k, k - 1) and high - low > rounding:
            slices.halve(k)
            low, high = slices.around(k)
        if high <= rounding:
            break
        if (slices.known[low], slices.known[high]) == (k, k - 1):
            value, v = _rayleigh(matrix, (low + high) / 2, scale, rng)
            while not low - rounding <= value <= high + rounding and high - low > rounding:  # it went to a neighbour
                slices.halve(k)
                low, high = slices.around(k)
                value, v = _rayleigh(matrix, (low + high) / 2, scale, rng)
            found, columns = [value], v[:, None]
        else:
            found, columns = _cluster(matrix, (low + high) / 2, high - low, slices.known[low] - k + 1, scale, rng)
        for value, v in zip(found, columns.T, strict=True):
            k = len(values) + 1
            if len(values) >= most or value <= rounding:
                break
            for other, u in zip(values, vectors, strict=True):
                if abs(other - value) < 1e-2 * scale:  # close ones lose orthogonality first
                    v = v - u * (u @ v)
            v = v / np.linalg.norm(v)
            edge = 4 * rounding + np.linalg.norm(matrix @ v - value * v)
            if slices.above(value - edge) < k or slices.above(value + edge) >= k:
                raise ArithmeticError(f"eigenvalue {value} is not number {k}")
            values.append(float(value))
            vectors.append(v if v[np.abs(v).argmax()] > 0 else -v)
        else:
            continue
        break
    return np.array(values), np.array(vectors).T.reshape(size, -1)
