"""Symmetric eigenvectors by spectral divide and conquer on QDWH polar decompositions.

The polar factor of ``A - s I`` is +1 on the subspace of eigenvalues above ``s`` and -1 below it, so
``(U + I) / 2`` projects on the upper one.  The matrix restricted to each subspace is split again,
until one dimension, or a block that is a multiple of the identity, is left.  Only matrices the
size of one vector by itself are handled here.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps.

    Every step is one QR factorisation; six or fewer take any matrix that is not numerically
    singular to its factor.
    """
    n = len(a)
    x = a / np.linalg.norm(a, 2)
    # a lower bound of the least singular value; one that is too small costs at most a step
    low = max(1 / (math.sqrt(n) * max(np.linalg.norm(np.linalg.pinv(x), 1), 1.0)), EPS)
    for _ in range(30):
        square = low * low
        d = (4 * (1 - square) / (square * square)) ** (1 / 3) if low < 1 else 0.0
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d)), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < 1e-2 * EPS ** (1 / 3) * math.sqrt(n) and abs(1 - low) < 1e-8:
            break
    return x


def _halves(projector: np.ndarray, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement."""
    rng = np.random.default_rng(0)
    n = len(projector)
    q, _ = np.linalg.qr(projector @ rng.standard_normal((n, above)))
    q, _ = np.linalg.qr(projector @ q)  # once more, so that the basis is as exact as the projector
    rest = rng.standard_normal((n, n - above))
    for _ in range(2):
        rest -= projector @ rest
        rest, _ = np.linalg.qr(rest - q @ (q.T @ rest))
    return q, rest


def _shifts(a: np.ndarray) -> list[float]:
    """Places to split at: the middle of the diagonal first, then others between its ends."""
    diagonal = np.sort(np.diag(a))
    middle = float(np.median(diagonal))
    spread = np.linalg.norm(a - middle * np.eye(len(a)))
    mean = float(diagonal.mean())
    return [middle, mean, *[mean + spread * t for t in (0.013, -0.011, 0.1, -0.09, 0.31, -0.29, 0.7, -0.6)]]


def eigenvectors(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    The upper subspace is always split first; lower ones only while components are missing.
    """
    a = (a + a.T) / 2
    scale = np.linalg.norm(a, 2) if a.size else 0.0
    values, vectors = [], []

    def split(block: np.ndarray, basis: np.ndarray) -> None:
        n = len(block)
        if len(values) >= wanted or n == 0:
            return
        mean = np.trace(block) / n
        if n == 1 or np.linalg.norm(block - mean * np.eye(n)) <= 4 * EPS * scale:
            values.extend(np.diag(block))
            vectors.extend(basis.T)
            return
        best = None
        for shift in _shifts(block):
            moved = block - shift * np.eye(n)
            if not np.any(moved):
                continue
            sign = polar_sign(moved)
            projector = (sign + np.eye(n)) / 2
            above = int(round(np.trace(projector)))
            if not 0 < above < n:
                continue
            upper, lower = _halves(projector, above)
            mixed = np.linalg.norm(upper.T @ block @ lower)
            if best is None or mixed < best[0]:
                best = (mixed, upper, lower)
            if mixed <= 16 * math.sqrt(n) * EPS * scale:
                break  # the subspaces are invariant to double precision
        if best is None:  # all eigenvalues agree to double precision
            values.extend(np.diag(block))
            vectors.extend(basis.T)
            return
        for half in best[1:]:
            inner = half.T @ block @ half
            split((inner + inner.T) / 2, basis @ half)

    split(a, np.eye(len(a)))
    if not values:
        return np.zeros(0), np.zeros((len(a), 0))
    found = np.array(vectors).T
    found, _ = np.linalg.qr(found)
    rates = np.einsum("ij,ij->j", found, a @ found)  # Rayleigh quotients: twice as many right digits
    order = np.argsort(-rates, kind="stable")[:wanted]
    return rates[order], found[:, order]
