"""Leading eigenpairs of a symmetric matrix: Householder reflections to tridiagonal form,
bisection on Sturm counts, inverse iteration, and the reflections undone.

The matrix has a row per dimension of the data, never per row of a table.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
# Eigenvalues closer than this share of the matrix's norm are one cluster, whose vectors
# are kept orthogonal to each other explicitly.
CLUSTER = 1e-3
MAX_SOLVES = 12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections that lead there."""
    a = np.array(matrix, np.float64)
    size = len(a)
    reflections = []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = np.zeros_like(x)
        if np.any(x[1:]):
            v = x / scale
            v[0] += np.copysign(np.sqrt(v @ v), v[0])
            v /= np.sqrt(v @ v)
            # H A H for H = 1 - 2 v v', as one symmetric update of rank two.
            p = 2.0 * (a[k + 1 :, k + 1 :] @ v)
            p -= (p @ v) * v
            a[k + 1 :, k + 1 :] -= np.outer(v, p) + np.outer(p, v)
            x -= 2.0 * (v @ x) * v
            a[k, k + 1 :] = x
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def counts_below(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each of the given numbers: the sign changes of the
    Sturm sequence, which are the negative pivots of T - at."""
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(np.int64)
    for a, b2 in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = a - at - b2 / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket cannot shrink."""
    size = len(diagonal)
    radius = np.zeros(size)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    # Gershgorin's discs hold all eigenvalues.
    norm = max(np.abs(diagonal - radius).max(), np.abs(diagonal + radius).max())
    slack = 2 * EPS * norm * size
    low = np.full(k, (diagonal - radius).min() - slack)
    high = np.full(k, (diagonal + radius).max() + slack)
    wanted = size - 1 - np.arange(k)  # eigenvalues below the one sought
    squares, tiny = off * off, norm * EPS * EPS
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = counts_below(diagonal, squares, middle, tiny) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _factored(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> list[tuple]:
    """Rows of the elimination of T - shift with row exchanges: (swap, factor, u0, u1, u2)."""
    rows = []
    size = len(diagonal)
    d, e, f = diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0
    for i in range(size - 1):
        below, next_d = off[i], diagonal[i + 1] - shift
        next_e = off[i + 1] if i + 2 < size else 0.0
        if abs(below) > abs(d):
            factor = d / below
            rows.append((True, factor, below, next_d, next_e))
            d, e, f = e - factor * next_d, f - factor * next_e, 0.0
        else:
            d = d if abs(d) > tiny else tiny
            factor = below / d
            rows.append((False, factor, d, e, f))
            d, e, f = next_d - factor * e, next_e - factor * f, 0.0
    rows.append((False, 0.0, d if abs(d) > tiny else tiny, 0.0, 0.0))
    return rows


def _solved(rows: list[tuple], right: np.ndarray) -> np.ndarray:
    x = right.tolist()
    last = len(rows) - 1
    for i, (swap, factor, *_) in enumerate(rows[:-1]):
        if swap:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= factor * x[i]
    for i in range(last, -1, -1):
        _, _, u0, u1, u2 = rows[i]
        x[i] = (x[i] - (u1 * x[i + 1] if i < last else 0.0) - (u2 * x[i + 2] if i + 1 < last else 0.0)) / u0
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, for eigenvalues in falling order.

    Each comes from inverse iteration. Those of one cluster are shifted a little apart and
    made orthogonal to the ones before them after every solve.
    """
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng = np.random.default_rng(0)
    vectors = np.zeros((size, len(values)))
    first, shift = 0, 0.0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(value, shift - 4 * EPS * norm) if j > first else value
        rows = _factored(diagonal, off, shift, EPS * norm)
        group = vectors[:, first:j]
        x = rng.standard_normal(size)
        for solve in range(MAX_SOLVES):
            x /= np.abs(x).max()
            x = _solved(rows, x)
            grown = np.abs(x).max()
            for _ in range(2):
                x -= group @ (group.T @ x)
            length = np.sqrt(x @ x)
            if not length or not np.isfinite(length):
                x = rng.standard_normal(size)
                continue
            # A solve that grows this much has reached the eigenvector; one more cleans it.
            done = solve >= 2 and grown * norm * EPS * size > 0.01
            x /= length
            if done:
                break
        vectors[:, j] = x
    return vectors


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; the
    entry of largest size of each is positive."""
    k = min(k, len(matrix))
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2.0 * np.outer(v, v @ vectors[i + 1 :])
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)
