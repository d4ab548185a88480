"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

A factorisation L D Lᵀ of the shifted matrix has as many positive pivots as there are
eigenvalues above the shift. Such counts isolate one eigenvalue after another, Rayleigh
quotient iteration converges to it from inside its interval, and counts on both sides of the
value found certify that its number is right. The matrices are small (embedding dimensions).
"""

from __future__ import annotations

import bisect
import math

import numpy as np

EPS = np.finfo(np.float64).eps
#: Bunch and Parlett's constant: when a two-by-two pivot is the safer one.
_ALPHA = (1 + math.sqrt(17)) / 8


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix lie above the shift.

    By Sylvester's law of inertia these are the positive pivots of L D Lᵀ. Pivots are one by
    one or two by two, with complete pivoting, so the factorisation is stable whatever the
    signs are. Pivots that vanish count as eigenvalues at the shift, not above.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = EPS * max(1.0, len(a)) * np.abs(a).max(initial=0.0) * EPS
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        largest = off.max()
        if diagonal[i] >= _ALPHA * largest:
            if diagonal[i] <= tiny:
                return above  # nothing is left
            pivot = a[i, i]
            above += pivot > 0
            rest = np.delete(np.arange(len(a)), i)
            column = a[rest, i]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / pivot
        else:
            i, j = np.unravel_index(int(off.argmax()), off.shape)
            block = a[np.ix_([i, j], [i, j])]
            above += 1  # such a block always has one positive and one negative eigenvalue
            rest = np.delete(np.arange(len(a)), [i, j])
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
    return above


class Slicer:
    """Counts of eigenvalues above shifts, each shift counted once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
        self.width = 8 * len(matrix) * EPS * self.bound  # values that are closer count as one
        self.shifts, self.counts = [-self.bound - self.width, self.bound + self.width], [len(matrix), 0]

    def above(self, shift: float) -> int:
        at = bisect.bisect_left(self.shifts, shift)
        if at == len(self.shifts) or self.shifts[at] != shift:
            self.shifts.insert(at, shift)
            self.counts.insert(at, eigenvalues_above(self.matrix, shift))
        return self.counts[at]

    def bracket(self, number: int) -> tuple[float, float]:
        """The tightest known shifts around the eigenvalue with this number, from 1 down the spectrum."""
        at = max(i for i, n in enumerate(self.counts) if n >= number)
        return self.shifts[at], self.shifts[at + 1]

    def isolate(self, number: int) -> tuple[float, float, int]:
        """An interval with this eigenvalue and as few others as can be told apart, and how many it holds."""
        while True:
            low, high = self.bracket(number)
            held = self.above(low) - self.above(high)
            if held == 1 or high - low <= self.width:
                return low, high, held
            self.above((low + high) / 2)

    def certified(self, number: int, *values: float) -> bool:
        """Whether counts on both sides give these falling values the numbers from this one on."""
        return (
            self.above(values[0] + 4 * self.width) <= number - 1
            and self.above(values[-1] - 4 * self.width) >= number + len(values) - 1
        )

    def halve(self, number: int) -> None:
        low, high = self.bracket(number)
        self.above((low + high) / 2)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    while True:
        try:
            with np.errstate(all="ignore"):
                found = np.linalg.solve(matrix - shift * np.eye(len(matrix)), right)
            if np.isfinite(found).all() and np.abs(found).max() > 0:
                return found / np.abs(found).max()
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge  # the shift was an eigenvalue to the last bit


def _orthogonal(block: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    for _ in range(2):  # twice is enough
        block = block - earlier @ (earlier.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def _iterate(slicer: Slicer, low: float, high: float, earlier: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; None where it leaves the interval."""
    v, nudge = slicer.matrix, max(slicer.width, np.finfo(np.float64).tiny)
    x = _orthogonal(np.random.default_rng(7).standard_normal((len(v), 1)), earlier)
    shift, before = (low + high) / 2, np.inf
    for step in range(60):
        x = _orthogonal(_solve(v, shift, x, nudge / 64), earlier)
        value = float((x.T @ v @ x)[0, 0])
        residual = float(np.linalg.norm(v @ x - value * x))
        if residual <= slicer.width / 4 and residual >= before / 2:  # as exact as it gets
            return (value, x) if low - slicer.width <= value <= high + slicer.width else None
        before = residual
        if step >= 2 or residual < (high - low) / 4:
            if not low <= value <= high:
                return None
            shift = value
    return None


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix and unit eigenvectors as columns.

    At most ``most``, in falling order; those that are zero to working precision are left
    out. Each vector's entry of largest size is positive. Values too close to be told apart
    share an eigenspace, for which an orthonormal basis is given. The number of each value is
    certified by counts on both sides of it.
    """
    d = len(matrix)
    values, vectors = [], np.zeros((d, 0))
    slicer = Slicer((matrix + matrix.T) / 2)
    if d and slicer.bound > 0:
        usable = min(most, slicer.above(slicer.width))
        while len(values) < usable:
            number = len(values) + 1
            low, high, held = slicer.isolate(number)
            found = _iterate(slicer, low, high, vectors) if held == 1 else None
            if found is not None and not slicer.certified(number, *found[:1]):
                found = None
            if held == 1 and found is None and high - low > slicer.width:
                slicer.halve(number)  # a neighbour drew the iteration; closer in it cannot
                continue
            if found is not None:
                new, block = [found[0]], found[1]
            else:
                block = np.random.default_rng(7).standard_normal((d, held))
                for _ in range(4):
                    shift = (low + high) / 2 + slicer.width / 64
                    block = _orthogonal(_solve(slicer.matrix, shift, block, slicer.width / 64), vectors)
                new = [float(x) for x in np.einsum("ij,ij->j", block, slicer.matrix @ block)]
                order = np.argsort(new)[::-1]
                new, block = [new[i] for i in order], block[:, order]
            if not slicer.certified(number, *new):
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            values += new
            vectors = np.hstack((vectors, block))
    values, vectors = np.array(values[:most]), vectors[:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return values, vectors * signs
