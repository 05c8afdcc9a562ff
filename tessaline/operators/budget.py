"""Forecasts of candidates and of the driver's memory, and the errors that guard them."""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence

from ..plans.dedup import LARGE_POOL, SAMPLE_ROWS
from ..plans.expr import Feature
from ..plans.moments import CELLS
from .families import Config, pairs_of


#: Frequencies per feature that fft_carriers takes by default.
FOUND_FREQS = 5


class CandidateBudgetExceeded(RuntimeError):
    def __init__(self, step: str, needed: int, used: int, limit: int):
        super().__init__(f"{step}: {needed} candidates after {used} exceed the limit of {limit}")
        self.step, self.needed, self.used, self.limit = step, needed, used, limit


class MemoryBudgetExceeded(RuntimeError):
    def __init__(self, step: str, needed: int, limit: int):
        super().__init__(f"{step}: {needed / 1e6:.0f} MB on the driver exceed {limit / 1e6:.0f} MB")
        self.step, self.needed, self.limit = step, needed, limit


def predict_breakdown(step: str, sets: Sequence[Sequence[Feature]], config: Config, levels: dict[str, int] | None = None) -> dict[str, int]:
    """Candidates per family of a step: an upper bound. levels: distinct values of categorical columns, for their one-hot columns."""
    flat = [f for s in sets for f in s]
    numeric = [f.kind == "numeric" for f in flat]
    d, n = len(flat), sum(numeric)
    freqs = len(config.carrier_freqs) if not isinstance(config.carrier_freqs, str) else config.calibrate_n_freqs
    if step == "raw":
        onehot = sum((levels or {}).get(f.template, 0) for f in flat if f.kind == "categorical")
        return {"raw": d} | {k: n for k in ("squared", "log", "sqrt", "cube", "tanh", "reciprocal", "rank")} | ({"onehot": onehot} if onehot else {})
    if step == "am":
        pairs = pairs_of(sets)
        one = sum(numeric[i] or numeric[j] for i, j in pairs)
        two = sum(numeric[i] and numeric[j] for i, j in pairs)
        ratios = 2 * two if config.max_ratios_per_feature is None else min(2 * two, config.max_ratios_per_feature * n)
        return {"am_product": one, "am_diff": one, "am_ratio": ratios} | {k: two for k in ("am_sq_diff", "am_min", "am_max", "am_hmean", "am_normdiff", "am_logratio")} | {"am_damped": 2 * two, "am_relu": 2 * two, "am_power": 2 * two * len(config.power_scales)}
    if step == "fft_carriers":
        return {k: n * FOUND_FREQS for k in ("carrier_sin", "carrier_cos", "carrier_sin2", "carrier_cos2", "carrier_tri")}
    if step == "carriers":
        return {"carrier_sin": n * freqs, "carrier_cos": n * freqs, "carrier_tri": n * freqs, "carrier_step": n * len(config.step_pcts), "carrier_pulse": n * len(config.pulse_bands), "carrier_gauss": n * len(config.gauss_center_pcts) * len(config.gauss_widths)}
    if step in ("fm", "wm", "fm_nonsmooth"):
        cross = sum(f.kind == "numeric" for f in sets[0]) * len(sets[1])
        grid = {"fm": {"fm_sin": freqs * len(config.fm_depths), "pm_sin": freqs * len(config.pm_depths)}, "fm_nonsmooth": {"fm_tri": freqs * len(config.fm_depths), "fm_pulse": len(config.wm_center_pcts) * len(config.gauss_widths)}, "wm": {"wm_center": len(config.wm_center_pcts), "wm_width": len(config.wm_center_pcts) * len(config.wm_width_mods)}}[step]
        return {k: v * cross for k, v in grid.items()}
    if step in ("fields", "probe_fields"):
        import itertools

        from .families import LEVELS

        out = {"field_nearest": 0, "field_zone": 0, "field_zcount": 0}
        for size in range(2, config.field_max_dims + 1):
            combos = sum(1 for _ in itertools.combinations(range(d), size))
            centres = len(LEVELS.get(size) or config.field_pct_levels) ** size
            out["field_nearest"] += combos
            out["field_zone"] += combos * centres * len(config.field_scales)
            out["field_zcount"] += combos * len(config.field_scales)
        return out
    return {}


def risk(rows: int, candidates: int) -> str:
    each = rows / max(candidates, 1)
    return "low" if each > 50 else "moderate" if each > 10 else "high" if each > 2 else "extreme"


def estimate_candidates(n_numeric: int, n_other: int = 0, config: Config | None = None) -> dict[str, int]:
    """Totals per step for a table of so many columns, without data."""
    from ..plans.expr import raw

    config = config or Config()
    one = [[raw(f"n{k}") for k in range(n_numeric)] + [raw(f"b{k}", "bool") for k in range(n_other)]]
    out = {step: sum(predict_breakdown(step, one if step not in ("fm", "wm", "fm_nonsmooth") else one * 2, config).values()) for step in ("raw", "am", "carriers", "fm", "fm_nonsmooth", "wm", "fields")}
    return out | {"total": sum(out.values())}


def step_bytes(candidates: int, rows: int, folds: int = 1, dedup_rows: int = SAMPLE_ROWS, large: int = LARGE_POOL) -> dict:
    """The driver's bytes in a step of so many candidates: the sample's values twice, correlations (all under `large` candidates, a block of them beyond), cross products of CELLS at a time."""
    sample = 2 * 8 * candidates * min(rows, dedup_rows)
    pairs = 3 * 8 * (candidates * candidates if candidates < large else 512 * candidates)
    chosen = 8 * max(16 * candidates, min(candidates * candidates, 4 * CELLS))
    return {"peak_bytes": max(sample + pairs, chosen * folds), "candidate_bytes": sample, "dedup_bytes": pairs, "selection_bytes": chosen, "kfold_bytes": chosen * folds if folds > 1 else 0, "dedup_method": "hierarchical" if candidates < large else "union-find", "candidates": candidates}


def driver_memory() -> int:
    """Half of the machine's memory, 2 GiB where it can't be read."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2
    except (ValueError, OSError):
        return 2 << 30


def guard(step: str, needed: int, used: int, max_candidates: int | None, max_memory: int | None, rows: int, folds: int = 1, dedup_rows: int = SAMPLE_ROWS, large: int = LARGE_POOL) -> None:
    if max_candidates is not None and used + needed > max_candidates:
        raise CandidateBudgetExceeded(step, needed, used, max_candidates)
    peak = step_bytes(needed, rows, folds, dedup_rows, large)["peak_bytes"]
    if max_memory is not None and peak > max_memory:
        raise MemoryBudgetExceeded(step, peak, max_memory)
    if peak > 2e9:
        warnings.warn(f"{step}: {peak / 1e6:.0f} MB on the driver", ResourceWarning, stacklevel=3)
