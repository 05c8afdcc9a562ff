"""Frequencies at which a target oscillates along a feature."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame

from ..plans.expr import Feature
from ..plans.order import bin_means, distinct_up_to, select_ranks, tie_columns

#: Fewest rows, least and most bins of a spectrum, share of the Nyquist limit that is searched.
LEAST_ROWS, LEAST_BINS, MOST_BINS, NYQUIST = 8, 20, 200, 0.4


def binned(df: DataFrame, features: Sequence[Feature], target: Column, tie: Sequence[str], nyquist: float = NYQUIST) -> list[tuple[int, np.ndarray]]:
    """Per feature the number of its distinct values and the target's mean in equal-count bins along it; equal values are ordered by the columns `tie`.

    The rows at which bins start are found by radix selection, so nothing is
    sorted. Distinct values count only as far as they matter for bins and limit.
    """
    if not features:
        return []
    n, ties = df.count(), tie_columns(df, tie)
    unique = distinct_up_to(df, features, max(2 * MOST_BINS, math.ceil(MOST_BINS / nyquist)))
    if n < LEAST_ROWS:
        return [(u, np.zeros(0)) for u in unique]
    bins = [min(max(u // 2, LEAST_BINS), MOST_BINS) for u in unique]
    size = [max(1, n // b) for b in bins]
    ranks = [[r for r in range(0, (b + 1) * s, s) if r < n] for b, s in zip(bins, size)]
    found = select_ranks(df, features, ranks, ties)
    means = bin_means(df, features, ties, target.cast("double"), [[f[r] for r in own] for f, own in zip(found, ranks)])
    return [(u, np.concatenate((m[:b], np.full(max(0, b - len(m)), np.nan)))) for u, m, b in zip(unique, means, bins)]


def peaks(mean: np.ndarray, unique: int, scale: float = math.pi, count: int = 5, least_power: float = 0.1, max_k: float | None = None, nyquist: float = NYQUIST) -> list[tuple[float, float]]:
    """(frequency, power as a share of the greatest) of the local maxima of the windowed spectrum, strongest first."""
    limit = unique * nyquist / 2 * 2 * math.pi / scale
    limit = min(limit, max_k) if max_k is not None else limit
    if limit < 0.5 or len(mean) < 3 or not np.isfinite(mean).all():
        return []
    n = len(mean)
    line = mean[0] + (mean[-1] - mean[0]) * np.arange(n) / (n - 1)
    power = np.abs(np.fft.rfft((mean - line) * np.hanning(n)))
    power[:2] = 0
    if power.max() < 1e-10:
        return []
    k = np.arange(len(power)) * 2 * math.pi / scale
    inside = k <= limit
    power, k = power[inside] / power.max(), k[inside]
    found = []
    for i in range(1, len(power)):
        last = i == len(power) - 1
        if last and len(power) < 3:
            break
        if power[i] > power[i - 1] and (last or power[i] >= power[i + 1]) and power[i] >= least_power and k[i] > 0.1:
            found.append((float(k[i]), float(power[i])))
    return sorted(found, key=lambda p: -p[1])[:count]


def calibrate(found: Sequence[Sequence[tuple[float, float]]], count: int) -> list[float]:
    """Frequencies that many features share: near ones merged by power, the strongest kept, at most count, a low one among them; empty if there are none."""
    every = sorted(p for f in found for p in f if p[0] >= 0.25)
    groups: list[list[tuple[float, float]]] = []
    for k, w in every:
        if groups:
            weight = sum(x[1] for x in groups[-1])
            centre = sum(x[0] * x[1] for x in groups[-1]) / weight
            if abs(k - centre) <= 1.5:
                groups[-1].append((k, w))
                continue
        groups.append([(k, w)])
    scored = sorted(groups, key=lambda g: -sum(x[1] for x in g) * math.sqrt(len(g)))[:count]
    out = sorted({round(sum(k * w for k, w in g) / sum(w for _, w in g), 2) for g in scored})
    return [0.5, *out[: count - 1]] if out and min(out) > 2 else out
