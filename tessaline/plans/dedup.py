"""Pruning of near-constant and correlated candidates, from moments alone."""

from __future__ import annotations

import numpy as np

from .moments import Moments

#: Least standard deviation, correlation of a duplicate, pool size from which components replace clusters.
LEAST_SD, THRESHOLD, LARGE_POOL = 0.005, 0.95, 3000


#: Rows that correlations of candidates are taken from (a fixed value); a table of no more rows counts whole.
SAMPLE_ROWS = 5000
#: A sample spread over so many times LEAST_SD is not checked on all rows.
SURE = 10


def complete_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster labels of complete linkage cut at a height, by nearest-neighbour merging."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    best = d[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    while n > 1:
        i = int(best.argmin())
        if not best[i] <= cut:
            break
        i, j = sorted((i, int(near[i])))
        row = np.maximum(d[i], d[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        best[j] = np.inf
        label[label == label[j]] = label[i]
        for k in np.flatnonzero(np.isfinite(best) & ((near == i) | (near == j))).tolist() + [i]:
            near[k] = int(d[k].argmin())
            best[k] = d[k, near[k]]
    return label


def standardised(x: np.ndarray) -> np.ndarray:
    """Columns centred and of length 1, so that products are correlations; constant ones are 0."""
    c = x - x.mean(axis=0)
    size = np.sqrt(np.einsum("nd,nd->d", c, c))
    return c / np.where(size > 1e-150, size, np.inf)


def correlated_components(z: np.ndarray, threshold: float, block: int = 512) -> np.ndarray:
    """Labels of the connected components of the pairs of standardised columns correlated over the threshold."""
    label = np.arange(z.shape[1])

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at in range(0, z.shape[1], block):
        over = np.abs(z[:, at : at + block].T @ z[:, at:]) > threshold
        for i in range(len(over)):
            for j in np.flatnonzero(over[i, i + 1 :]) + i + 1:
                a, b = find(at + i), find(at + int(j))
                label[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(label))])


def deduplicate(x: np.ndarray, complexity: np.ndarray, threshold: float = THRESHOLD, method: str = "auto", representative: str = "variance", target: np.ndarray | None = None, large: int = LARGE_POOL) -> list[int]:
    """The columns of x (rows of a sample) that stay, one per cluster of mutually correlated ones, in their order.

    Under `large` columns clusters are by complete linkage, else components.
    """
    if method not in ("auto", "hierarchical", "union-find"):
        raise ValueError(f"unknown method: {method}")
    z, d = standardised(x), x.shape[1]
    linkage = method == "hierarchical" or (method == "auto" and d < large)
    c = np.abs(np.clip(z.T @ z, -1, 1)) if linkage else None
    label = complete_linkage(1 - c, 1 - threshold) if linkage else correlated_components(z, threshold)
    sd = x.std(axis=0)
    relevance = None if target is None else np.abs(standardised(target[:, None])[:, 0] @ z)

    def pick(members: np.ndarray) -> int:
        if representative == "variance":
            return int(members[np.argmax(sd[members])])
        if representative == "complexity":
            return int(min(members, key=lambda k: (complexity[k], -sd[k], k)))
        if representative == "correlation":
            if relevance is None:
                raise ValueError("representative='correlation' needs a target")
            return int(members[np.argmax(relevance[members])])
        raise ValueError(f"unknown representative: {representative}")

    keep, order = set(), np.argsort(label, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if d else []:
        chosen = pick(members)
        keep.add(chosen)
        if not linkage and 1 < len(members) <= 20:
            # Chained members that are not correlated with the representative themselves stay.
            near = np.abs(z[:, chosen] @ z[:, members])
            keep.update(int(k) for k, r in zip(members, near) if k != chosen and r < threshold)
    return sorted(keep)


def family_correlation(m: Moments, families: list[str]) -> dict[tuple[str, str], float]:
    """Mean absolute correlation per pair of families; the diagonal leaves itself out, a single member gives 1."""
    c = np.abs(m.correlation())[: len(families), : len(families)]
    names, fam = sorted(set(families)), np.array(families)
    out = {}
    for a in names:
        for b in names:
            block = c[np.ix_(fam == a, fam == b)]
            if a == b:
                k = len(block)
                out[a, b] = 1.0 if k == 1 else float((block.sum() - np.trace(block)) / (k * (k - 1)))
            else:
                out[a, b] = float(block.mean())
    return out
