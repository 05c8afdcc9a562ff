"""Selection of features from moments: greedy ridge, orthogonal matching pursuit, relevance minus redundancy."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from .dedup import LARGE_POOL
from .expr import Feature
from .moments import Joined, Moments

#: Fixed values.
GREEDY_RIDGE, OMP_RIDGE, PARENT_RIDGE, REDUNDANCY = 1.0, 1e-6, 1e-8, 0.5
R2_STOP, LEAST_PIVOT, TIE, LEAST_RETAINED, OMP_LOOKAHEAD = 0.9999, 1e-12, 1e-12, 1e-8, 8


@dataclass
class History:
    """The steps of a selection, in order; score_kind r2, mrmr or class_union; score_split train, validation or fold_validation.

    A class union holds the history of each class, and has no R² of its own.
    """

    steps: list[dict] = field(default_factory=list)
    score_kind: str = "r2"
    score_split: str = "train"
    per_class: dict = field(default_factory=dict)

    def add(self, feature: Feature, index: int, marginal: float, total: float, **more) -> None:
        self.steps.append({"name": feature.label, "family": feature.family, "index": index, "marginal_r2": float(marginal), "cumulative_r2": float(total)} | more)

    @property
    def chosen(self) -> list[int]:
        return [s["index"] for s in self.steps]

    @property
    def final_r2(self) -> float | None:
        if self.score_kind == "class_union":
            return None
        return self.steps[-1]["cumulative_r2"] if self.steps else 0.0

    def to_df(self, spark):
        keys = ["name", "family", "marginal_r2", "cumulative_r2"]
        return spark.createDataFrame([(k, *(s[x] for x in keys)) for k, s in enumerate(self.steps)], "step int, name string, family string, marginal_r2 double, cumulative_r2 double")


def argmax(scores: np.ndarray) -> int:
    """The first of the scores within TIE of the largest."""
    return int(np.flatnonzero(scores >= np.nanmax(scores) - TIE)[0])


def ridge(m: Moments, cols: Sequence[int], target: int, alpha: float) -> np.ndarray:
    cols = list(cols)
    g = m.rows(cols)
    return np.linalg.solve(g[:, cols] + alpha * np.eye(len(cols)), g[:, target])


def r2(fit: Moments, score: Moments, cols: Sequence[int], target: int, alpha: float) -> float:
    """R² on the score part of a ridge readout of the fit part."""
    total = score.diag[target]
    if not total > 0:
        return 0.0
    cols = list(cols)
    u = ridge(fit, cols, target, alpha) if cols else np.zeros(0)
    s = score.rows(cols)
    bias = score.mean[target] - fit.mean[target] - (score.mean[cols] - fit.mean[cols]) @ u
    ss = total - 2 * u @ s[:, target] + u @ s[:, cols] @ u + score.n * bias**2
    return float(1 - ss / total)


def _extended_r2(fit: Moments, score: Moments, active: list[int], target: int, alpha: float, d: int) -> np.ndarray:
    """R² on the score part with each candidate added to the active ones; -inf where the pivot is too small."""
    pivot = fit.diag[:d] + alpha
    b = fit.rows([target])[0, :d].astype(float).copy()
    if active:
        rows = fit.rows(active)
        inverse = np.linalg.inv(rows[:, active] + alpha * np.eye(len(active)))
        u0 = inverse @ rows[:, target]
        c = inverse @ rows[:, :d]
        pivot = pivot - np.einsum("kd,kd->d", rows[:, :d], c)
        b -= rows[:, :d].T @ u0
    good = pivot > LEAST_PIVOT
    u = np.where(good, b / np.where(good, pivot, 1), 0)
    total = score.diag[target]
    mean = score.mean - fit.mean
    ss = total - 2 * u * score.rows([target])[0, :d] + u * u * score.diag[:d]
    bias = mean[target] - u * mean[:d]
    if active:
        s = score.rows(active)
        w = u0[:, None] - c * u
        ss = ss - 2 * (w * s[:, [target]]).sum(0) + (w * (s[:, active] @ w)).sum(0) + 2 * u * (w * s[:, :d]).sum(0)
        bias = bias - mean[active] @ w
    out = 1 - (ss + score.n * bias**2) / total if total > 0 else np.zeros(d)
    out = np.where(good, out, -np.inf)
    out[active] = -np.inf
    return out


def made_ready(parts: Sequence, columns: Sequence[int], ranking: np.ndarray | None = None) -> None:
    """The cross products of these columns, with those of the best-ranked ones that are likely to follow."""
    for p in parts:
        if p is not None:
            p.ready(columns, ranking)


def greedy(train: Moments, features: Sequence[Feature], target: int, count: int, score: Moments | None = None, min_delta: float | str = "auto", parents: bool = True, diversity: float = 0.0, lookahead: int = 0, parent_retain: float = 0.0) -> History:
    """Forward selection by ridge R² (on the score part where there is one).

    parent_retain: after a compound feature its free ancestors come along, each
    if it adds that share of the compound's own gain on the training part.
    """
    d, part = len(features), score or train
    floor = 2.0 / max(train.n, 1) if min_delta == "auto" else float(min_delta)
    history, active, now = History(score_split="validation" if score else "train"), [], 0.0
    barred = np.zeros(d, bool)
    place = {f.key: k for k, f in enumerate(features)}
    above = [sorted({place[a] for a in _ancestors(f) if a in place and place[a] != k}) for k, f in enumerate(features)]
    if parents:
        made_ready([train], sorted({a for own in above for a in own}))
        for k in range(d):
            if above[k] and _gain_over(train, above[k], k, target) < floor:
                barred[k] = True
    used: dict[str, int] = {}

    def take(k: int, gain: float, total: float) -> None:
        active.append(k)
        used[features[k].family] = used.get(features[k].family, 0) + 1
        history.add(features[k], k, gain, total)

    while len(active) < min(count, d):
        scores = _extended_r2(train, part, active, target, GREEDY_RIDGE, d)
        scores[barred] = -np.inf
        if not np.isfinite(scores).any():
            break
        ranked = scores - np.array([diversity * 0.01 * used.get(f.family, 0) / max(len(active), 1) for f in features]) if diversity else scores
        best = argmax(ranked)
        if lookahead and len(active) + 1 < count:
            top = [int(k) for k in np.argsort(-ranked, kind="stable")[:lookahead] if np.isfinite(ranked[k])]
            made_ready([train, score], top, ranked)
            best = max(top, key=lambda k: np.max(_extended_r2(train, part, [*active, k], target, GREEDY_RIDGE, d)))
        gain = scores[best] - now
        if gain < floor and (active or gain <= 0 or floor > 0):
            break
        now = float(scores[best])
        made_ready([train, score], [best], ranked)
        take(best, gain, now)
        if parent_retain > 0 and gain > LEAST_RETAINED:
            made_ready([train], above[best])
            before = r2(train, train, active, target, GREEDY_RIDGE)
            for k in above[best]:
                if k not in active and len(active) < d:
                    total = r2(train, train, [*active, k], target, GREEDY_RIDGE)
                    if total - before >= parent_retain * gain:
                        made_ready([train, score], [k])
                        take(k, total - before, total)
                        before = now = total
        if now >= R2_STOP:
            break
    return history


def _gain_over(m: Moments, above: list[int], k: int, target: int) -> float:
    """What feature k adds to its ancestors; asks only for the ancestors' cross products."""
    rows = m.rows([*above, target])
    g = np.empty((len(above) + 1, len(above) + 1))
    g[:-1, :-1], g[-1, -1] = rows[:-1][:, above], m.diag[k]
    g[:-1, -1] = g[-1, :-1] = rows[:-1, k]
    b, total = np.append(rows[-1, above], rows[-1, k]), m.diag[target]
    if not total > 0:
        return 0.0

    def explained(n: int) -> float:
        u = np.linalg.solve(g[:n, :n] + PARENT_RIDGE * np.eye(n), b[:n])
        return float((2 * u @ b[:n] - u @ g[:n, :n] @ u) / total)

    return explained(len(above) + 1) - explained(len(above))


def _ancestors(f: Feature) -> set[int]:
    out = set()
    for c in f.children:
        out |= {c.key} | _ancestors(c)
    return out


def _residual_correlation(m: Moments, active: list[int], target: int, d: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(|correlation| of each candidate with the residual, the residual's sum of squares, the fit)."""
    g, v, c = m.rows([target])[0, :d].astype(float).copy(), float(m.diag[target]), np.zeros(0)
    if active:
        rows = m.rows(active)
        c = np.linalg.solve(rows[:, active] + OMP_RIDGE * np.eye(len(active)), rows[:, target])
        g = g - rows[:, :d].T @ c
        v = float(v - 2 * c @ rows[:, target] + c @ rows[:, active] @ c)
    size = np.sqrt(np.maximum(m.diag[:d], 0))
    floor = 1e-13 * m.diag[target]
    scale = size * np.sqrt(max(v, 0))
    return (np.abs(g) / np.where(scale > 0, scale, np.inf) if v > floor else np.zeros(d)), (v if v > floor else 0.0), c


def omp(train: Moments, features: Sequence[Feature], target: int, count: int, score: Moments | None = None, within: Callable[[list[int], np.ndarray], np.ndarray | None] | None = None, group_weight: float = 0.0, diversity: float = 0.0, lookahead: int = 0) -> History:
    """Orthogonal matching pursuit; the score part never takes part in the ranking.

    within: (active, fit) -> mean |correlation| with the residual inside groups,
    which enters with group_weight. lookahead: of so many best ones, the one
    whose best successor leaves the least residual.
    """
    d, history, active, now = len(features), History(score_split="validation" if score else "train"), [], 0.0
    used: dict[str, int] = {}
    while len(active) < min(count, d):
        corr, left, c = _residual_correlation(train, active, target, d)
        if not left:
            break
        if within is not None and group_weight:
            inside = within(active, c)
            if inside is not None:
                corr = (1 - group_weight) * corr + group_weight * inside
        corr[active] = -np.inf
        ranked = corr * (1 - 0.3 * diversity * np.array([used.get(f.family, 0) for f in features]) / len(active)) if diversity and active else corr
        best = argmax(ranked)
        if lookahead and len(active) + 1 < count:
            top = [int(k) for k in np.argsort(-ranked, kind="stable")[:lookahead] if corr[k] > 0]
            if len(top) > 1:
                made_ready([train], top, ranked)
                best = min(top, key=lambda k: _left_after_two(train, active, k, target, d))
        if corr[best] <= 0:
            break
        made_ready([train, score], [best], ranked)
        active.append(best)
        used[features[best].family] = used.get(features[best].family, 0) + 1
        total = r2(train, score or train, active, target, OMP_RIDGE)
        history.add(features[best], best, total - now, total, selection_score=float(corr[best]))
        now = total
    return history


def _left_after_two(m: Moments, active: list[int], k: int, target: int, d: int) -> float:
    """The residual's sum of squares after k and the best feature to follow it."""
    trial = [*active, k]
    corr, left, _ = _residual_correlation(m, trial, target, d)
    corr[trial] = -np.inf
    if not left or not corr.max() > 0:
        return left
    m.ready([int(corr.argmax())], corr)
    return _residual_correlation(m, [*trial, int(corr.argmax())], target, d)[1]


def mrmr(parts: Sequence[Moments], features: Sequence[Feature], target: int, count: int, split: str = "train", redundancy: float = REDUNDANCY) -> History:
    """Relevance minus mean correlation with what is chosen, averaged over the parts; not an R²."""
    d = len(features)

    def correlation(k: int) -> np.ndarray:
        """Mean |correlation| of column k with each candidate."""
        out = []
        for p in parts:
            size = np.sqrt(np.maximum(p.diag, 0))
            scale = size[:d] * size[k]
            out.append(np.clip(np.abs(p.rows([k])[0, :d]) / np.where(scale > 1e-300, scale, np.inf), 0, 1))
        return np.mean(out, axis=0)

    relevance, shared = correlation(target), np.zeros(d)
    history, active = History(score_kind="mrmr", score_split=split), []
    while len(active) < min(count, d):
        score = relevance - (redundancy * shared / len(active) if active else 0)
        score = np.where(relevance > 0, score, -np.inf)
        score[active] = -np.inf
        if not np.isfinite(score).any():
            break
        best = argmax(score)
        active.append(best)
        history.add(features[best], best, relevance[best], score[best])
        made_ready(parts, [best], score)
        shared = shared + correlation(best)
    return history


def _complement(folds: Sequence[Moments]) -> list[Joined]:
    return [Joined([f for j, f in enumerate(folds) if j != k]) for k in range(len(folds))]


def kfold(folds: Sequence[Moments], features: Sequence[Feature], target: int, count: int, method: str, large: int = LARGE_POOL) -> History:
    """Selection scored on held-out folds. Greedy has no noise floor and no parent filter here. From `large` candidates on selection is by correlation."""
    d = len(features)
    if method != "correlation" and d >= large:
        warnings.warn(f"{d} candidates: correlation selection instead of {method} over folds", RuntimeWarning, stacklevel=2)
        method = "correlation"
    if method == "correlation":
        return mrmr(folds, features, target, count, "fold_validation")
    train = _complement(folds)
    history, active, now, spread = History(score_split="fold_validation"), [], 0.0, []
    while len(active) < min(count, d):
        if method == "greedy":
            each = np.array([_extended_r2(t, f, active, target, GREEDY_RIDGE, d) for t, f in zip(train, folds)])
            scores = each.mean(axis=0)
            if not np.isfinite(scores).any():
                break
            best = argmax(scores)
            if active and scores[best] < now - 1e-8:
                break
            made_ready(folds, [best], scores)
            values = each[:, best]
        else:
            ranked = [_residual_correlation(t, active, target, d)[0] for t in train]
            corr = np.mean(ranked, axis=0)
            corr[active] = -np.inf
            best = argmax(corr)
            if corr[best] <= 0:
                break
            made_ready(folds, [best], corr)
            values = np.array([r2(t, f, [*active, best], target, OMP_RIDGE) for t, f in zip(train, folds)])
        total = float(values.mean())
        made_ready(folds, [best])
        active.append(best)
        spread.append(float(values.std()))
        history.add(features[best], best, total - now, total, fold_r2_std=spread[-1])
        now = total
    if spread and max(spread) > 0.05:
        warnings.warn(f"R² varies over folds by up to {max(spread):.3f}", RuntimeWarning, stacklevel=2)
    return history


def check_count(select) -> None:
    if select is not None and (isinstance(select, bool) or not isinstance(select, (int, np.integer)) or select < 0):
        raise ValueError(f"select must be a non-negative integer: {select!r}")


METHODS = ("greedy", "omp", "correlation")


def select_features(method: str, features: Sequence[Feature], targets: Sequence[int], count: int, train: Moments, score: Moments | None = None, folds: Sequence[Moments] = (), classes: Sequence = (), large: int = LARGE_POOL, **options) -> History:
    """One history: of one target, or the union over one-versus-rest targets (each feature at its first class) with the history of each class."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}: {method}")
    check_count(count)
    if not features or not count:
        return History()

    def one(target: int) -> History:
        if len(folds) > 1 and score is None:
            return kfold(folds, features, target, count, method, large)
        if method == "greedy":
            return greedy(train, features, target, count, score, **options)
        if method == "omp":
            return omp(train, features, target, count, score, **options)
        return mrmr([score or train], features, target, count, "validation" if score else "train")

    if not classes:
        return one(targets[0])
    if len(folds) > 1 and score is None:
        raise NotImplementedError("classification over folds needs a validation target")
    union, seen = History(score_kind="class_union"), set()
    for label, t in zip(classes, targets):
        union.per_class[label] = own = one(t)
        for s in own.steps:
            if s["index"] not in seen:
                seen.add(s["index"])
                union.steps.append(s | {"class_label": label})
    return union


def diagnose_curve(history: History) -> str:
    """The shape of the cumulative R² curve."""
    if history.score_kind != "r2":
        raise ValueError("only a curve of R² can be diagnosed")
    curve = [s["cumulative_r2"] for s in history.steps]
    if not curve:
        return "empty"
    if max(curve[:3]) >= 0.95:
        return "steep-to-1"
    if curve[-1] < 0.5:
        return "slow-climb"
    if len(curve) >= 4 and curve[-1] - curve[-4] < 0.01:
        return "hard-plateau" if curve[-1] < 0.90 else "moderate-plateau"
    return "slow-climb" if curve[-1] < 0.80 else "moderate-plateau"
