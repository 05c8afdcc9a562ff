"""Composite searches over a pipeline."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..plans.dedup import SAMPLE_ROWS
from ..plans.expr import Feature, project
from ..plans.select import History
from . import families as fam
from .budget import CandidateBudgetExceeded, MemoryBudgetExceeded
from .families import Config
from .pipeline import FeatureSet, Pipeline

BUDGET = (CandidateBudgetExceeded, MemoryBudgetExceeded)


def discover_carrier_space(pipe: Pipeline, fs: FeatureSet, select: int = 15, method: str = "omp", spaces: Sequence[str] | None = None, include_raw: bool = True) -> tuple[FeatureSet, dict]:
    """Carriers in each coordinate space compete; (chosen, report). A space over budget is skipped and reported."""
    sets, skipped = [fs] if include_raw else [], {}
    for name in spaces or fx.SPACES:
        try:
            sets.append(pipe.carriers(fs, None, method, feature_space=name))
        except BUDGET as e:
            skipped[name] = str(e)
    chosen = pipe.select(pipe.fuse(*sets), select, method)
    wins: dict[str, int] = {}
    for f in chosen:
        moved = next((c for c in f.children if c.family == "space"), None)
        key = moved.label.partition("[")[0] if moved else "linear" if f.family.startswith("carrier") else "raw"
        wins[key] = wins.get(key, 0) + 1
    return chosen, {"winner_counts": wins, "spaces": list(spaces or fx.SPACES), "skipped": skipped}


def auto_run(pipe: Pipeline, select: int = 20, max_stage: int = 5, method: str = "omp", early_stop_marginal: float = 0.003, patience: int = 2) -> FeatureSet:
    """raw, then pairs, carriers and modulations of what was chosen so far, while they still gain.

    A memory budget that a later step would exceed shortens the run; a step
    that exceeds a budget all the same is tried once more with fewer raw
    features in the place of all (for modulations as the carriers).
    """
    if method == "correlation" or pipe.classification:
        raise ValueError("auto_run needs an R² method and a regression target")
    if pipe.max_memory is not None:
        max_stage = min(max_stage, pipe.predict_pipeline_memory(max_stage, select)["recommended_max_stage"])
    s0 = pipe.raw()
    pool, fewer, best, dull = s0, None, 0.0, 0
    steps: list[Callable[[FeatureSet, FeatureSet], FeatureSet]] = [
        lambda own, _: pipe.am(own), lambda own, _: pipe.carriers(own), lambda own, cur: pipe.fm(own, cur), lambda own, cur: pipe.fm_nonsmooth(own, cur), lambda own, cur: pipe.wm(own, cur)
    ]
    result = None
    for k, step in enumerate(steps[: max(max_stage, 0)]):
        try:
            new = step(s0, result)
        except BUDGET:
            fewer = fewer if fewer is not None else pipe.select(s0, min(3 * select, len(s0)), method)
            new = step(fewer, result)
        pool = pipe.fuse(pool, new)
        result = pipe.select(pool, select, method)
        gain, best = pipe.stages[-1].final_r2 - best, pipe.stages[-1].final_r2
        dull = dull + 1 if gain < early_stop_marginal else 0
        if k < 4 and dull >= patience:
            break
    return result if result is not None else pipe.select(pool, select, method)


def thin_grid(grid: Sequence, level: int) -> list:
    """Every level over 2 keeps 1/sqrt(2) of a grid, two values at least, evenly spaced."""
    n = max(2, round(len(grid) * (1 / 1.4142) ** (level - 2)))
    if n >= len(grid):
        return list(grid)
    return [grid[round(k * (len(grid) - 1) / (n - 1))] for k in range(n)]


def deepen(pipe: Pipeline, base: FeatureSet, select: int = 25, max_depth: int = 2, n_carry: int = 15, decay_stop: float = 0.5, marginal_carry_threshold: float = 0.001, early_stop_marginal: float = 0.003, method: str = "omp") -> FeatureSet:
    """Modulate the best features by one another, level by level, while the gain does not decay."""
    if method == "correlation" or pipe.classification:
        raise ValueError("deepen needs an R² method and a regression target")
    current = pipe.select(base, min(select, len(base)), method)
    best, last_gain = pipe.stages[-1].final_r2, None
    for depth in range(2, max_depth + 2):
        steps = pipe.stages[pipe._owners[id(current)]].history.steps
        carry = [f for f, s in zip(current, steps) if s["marginal_r2"] >= marginal_carry_threshold][:n_carry] or list(current)[:1]
        carried = pipe._record(f"carry_L{depth}", "select", FeatureSet(tuple(replace(f, kind="numeric") for f in carry)), History(), 0, len(carry), len(carry), "", time.time(), [current])
        c = pipe.config
        grids = replace(c, carrier_freqs=thin_grid(c.carrier_freqs, depth), fm_depths=thin_grid(c.fm_depths, depth), pm_depths=thin_grid(c.pm_depths, depth), wm_center_pcts=thin_grid(c.wm_center_pcts, depth), wm_width_mods=thin_grid(c.wm_width_mods, depth))
        began = time.time()
        made = fam.modulate(pipe.df, carried.features, carried.features, grids, ("fm_sin", "pm_sin", "wm_center", "wm_width"), pipe.exclude, skip_self=True, prefix=f"L{depth}_")
        made = [replace(f, template=fx.finite(f"({f.template})")) for f in made]
        if not made:
            break
        new = pipe._record(f"deepen_L{depth}_gen", "deepen_gen", FeatureSet(tuple(made)), History(), len(made), len(made), len(made), "", began, [carried])
        current = pipe.select(pipe.fuse(current, new), select, method)
        gain = pipe.stages[-1].final_r2 - best
        best = pipe.stages[-1].final_r2
        if (last_gain is not None and last_gain > 0 and gain / last_gain < decay_stop) or gain < early_stop_marginal:
            break
        last_gain = gain
    return current


def prune_run(pipe: Pipeline, select: int = 20, max_stage: int = 5, method: str = "omp", n_seeds: int = 3, subsample: float = 0.5) -> dict:
    """Families that auto_run chooses on hash samples of the rows: keep, exclude, family_counts. The pipeline stays as it is."""
    if not pipe.row_id:
        raise ValueError("samples need row_id columns")
    counts: dict[str, int] = {}
    seen: set[str] = set()
    for seed in range(n_seeds):
        share = max(subsample, min(1.0, 50 / max(pipe.n_rows, 1)))
        picked = pipe.df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pipe.row_id], F.lit(seed + 7)), F.lit(1 << 20)) < share * (1 << 20))
        fresh = Pipeline(picked, pipe.target, pipe.columns, pipe.types, row_id=pipe.row_id, config=pipe.config, exclude_families=pipe.exclude, max_candidates=pipe.max_candidates, max_memory=pipe.max_memory)
        for f in set(auto_run(fresh, select, max_stage, method).families):
            counts[f] = counts.get(f, 0) + 1
        seen |= {f for s in fresh.stages for f in s.output.families}
    return {"keep": sorted(counts), "exclude": sorted(seen - set(counts)), "family_counts": counts}


# ---------------------------------------------------------------- several passes


@dataclass
class StageResult:
    features: FeatureSet
    sources: frozenset
    r2: float


@dataclass
class FeaturePool:
    """Columns that are still free; each captured pass takes those that its features come from. Under min_cols columns a pool is exhausted."""

    df: DataFrame
    target: str
    columns: list[str]
    options: dict = field(default_factory=dict)
    passes: list[StageResult] = field(default_factory=list)
    min_cols: int = 3

    def __post_init__(self):
        if isinstance(self.min_cols, bool) or not isinstance(self.min_cols, int) or self.min_cols < 1:
            raise ValueError("min_cols must be a positive integer")

    @property
    def n_active(self) -> int:
        return len(self.columns)

    @property
    def active_names(self) -> list[str]:
        return list(self.columns)

    def build(self) -> Pipeline:
        return Pipeline(self.df, self.target, self.columns, {c: "numeric" for c in self.columns}, **({"max_candidates": None} | self.options))

    def capture(self, pipe: Pipeline, fs: FeatureSet) -> StageResult:
        if fs is not pipe.output:
            raise ValueError("capture needs the output of the pipeline's last stage")
        self.passes.append(StageResult(fs, frozenset().union(*fs.source_names) if len(fs) else frozenset(), pipe.stages[-1].final_r2))
        return self.passes[-1]

    def subtract(self, result: StageResult) -> None:
        self.columns = [c for c in self.columns if c not in result.sources]

    @property
    def exhausted(self) -> bool:
        return len(self.columns) < self.min_cols


@dataclass
class MultiPassResult:
    passes: list[StageResult]
    unused: list[str]

    @classmethod
    def from_passes(cls, passes: Sequence[StageResult], unused: Sequence[str]) -> "MultiPassResult":
        if not passes:
            raise ValueError("no pass")
        return cls(list(passes), list(unused))

    @property
    def pass_names(self) -> list[list[str]]:
        return [list(p.features.names) for p in self.passes]

    @property
    def unused_names(self) -> list[str]:
        return list(self.unused)

    @property
    def used_base_vars(self) -> set[str]:
        return set().union(*(p.sources for p in self.passes))

    @property
    def features(self) -> tuple[Feature, ...]:
        return tuple(f for p in self.passes for f in p.features)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return project(df, self.features, keep)

    def transform_with_unused(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return project(df, self.features, [*keep, *self.unused])


def multi_pass(df: DataFrame, target: str, columns: Sequence[str], recipe: Callable[[Pipeline], FeatureSet], k: int = 3, min_cols: int = 3, **options) -> MultiPassResult:
    """Up to k pipelines, each over the columns that no earlier one has used, at least min_cols. recipe: Pipeline -> FeatureSet of its last stage."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive number of passes")
    pool = FeaturePool(df, target, list(columns), options, min_cols=min_cols)
    for _ in range(k):
        if pool.exhausted:
            break
        pipe = pool.build()
        result = pool.capture(pipe, recipe(pipe))
        if not result.sources:
            pool.passes.pop()
            break
        pool.subtract(result)
    return MultiPassResult.from_passes(pool.passes, pool.columns)


Recipe = Callable[[Pipeline], FeatureSet]


def _wide(select: int, raw_k: int, made: Callable[[Pipeline, FeatureSet], Sequence[FeatureSet]], then: Callable[[Pipeline, FeatureSet], FeatureSet] | None = None) -> Recipe:
    """raw, what is made of it, and a selection from all of these."""

    def run(p: Pipeline) -> FeatureSet:
        base = p.raw(raw_k)
        out = p.select(p.fuse(base, *made(p, base)), select)
        return then(p, out) if then else out

    return run


def recipe_light(select: int = 15) -> Recipe:
    return lambda p: p.raw(select)


def recipe_std(select: int = 15, raw_k: int = 15, car_k: int = 15, fm_k: int = 15) -> Recipe:
    """Carriers of raw features, and raw features modulated by one another."""
    return _wide(select, raw_k, lambda p, base: (p.carriers(base, car_k), p.fm(base, base, fm_k)))


def recipe_am(select: int = 15, raw_k: int = 15, am_k: int = 15) -> Recipe:
    return _wide(select, raw_k, lambda p, base: (p.am(base, select=am_k),))


def _with_carriers(p: Pipeline, base: FeatureSet, car_k: int, fm_k: int) -> tuple[FeatureSet, FeatureSet]:
    """Carriers, and the carriers modulated by the raw features."""
    waves = p.carriers(base, car_k)
    return waves, p.fm(waves, base, fm_k)


def recipe_deep(select: int = 15, raw_k: int = 15, car_k: int = 15, fm_k: int = 15) -> Recipe:
    return _wide(select, raw_k, lambda p, base: _with_carriers(p, base, car_k, fm_k))


def recipe_carrier_first(select: int = 20, car_k: int = 15, am_k: int = 15, fm_k: int = 15, fm_thin: int = 8) -> Recipe:
    """Carriers of all raw features; pairs of carriers, and the best carriers modulated by one another."""

    def run(p: Pipeline) -> FeatureSet:
        waves = p.carriers(p.raw(), car_k)
        pairs, few = p.am(waves, select=am_k), p.select(waves, fm_thin)
        return p.select(p.fuse(waves, pairs, p.fm(few, few, fm_k)), select)

    return run


def recipe_explore(select: int = 15, raw_k: int = 15, am_k: int = 10, car_k: int = 10, fm_k: int = 10) -> Recipe:
    return _wide(select, raw_k, lambda p, base: (p.am(base, select=am_k), *_with_carriers(p, base, car_k, fm_k)))


def recipe_explore_deep(select: int = 15, raw_k: int = 15, am_k: int = 10, car_k: int = 10, fm_k: int = 10, deepen_depth: int = 1, deepen_carry: int = 10) -> Recipe:
    deeper = lambda p, out: deepen(p, out, select, deepen_depth, deepen_carry)
    return _wide(select, raw_k, lambda p, base: (p.am(base, select=am_k), *_with_carriers(p, base, car_k, fm_k)), deeper)


def recipe_tower(raw_k: int = 5, car_k: int = 3, fm_k: int = 1) -> Recipe:
    """One feature of depth three: raw, carriers, modulated carriers."""

    def run(p: Pipeline) -> FeatureSet:
        base = p.raw(raw_k)
        return p.fm(p.carriers(base, car_k), base, fm_k)

    return run


def recipe_tower_wm(raw_k: int = 5, car_k: int = 3, fm_k: int = 3, wm_k: int = 1) -> Recipe:
    """One feature of depth four: a window over the modulated carriers."""

    def run(p: Pipeline) -> FeatureSet:
        base = p.raw(raw_k)
        return p.wm(p.fm(p.carriers(base, car_k), base, fm_k), base, wm_k)

    return run


def recipes() -> dict[str, Recipe]:
    """The recipes with their default counts, by name."""
    return {f.__name__.removeprefix("recipe_"): f() for f in (recipe_light, recipe_std, recipe_am, recipe_deep, recipe_carrier_first, recipe_explore, recipe_explore_deep, recipe_tower, recipe_tower_wm)}


def recipe_grid(build: Callable[[], Pipeline], named: dict[str, Recipe], methods: Sequence[str] = ("greedy", "omp", "correlation")) -> list[dict]:
    """Each recipe with each method of selection, on a fresh pipeline: recipe, method, selected, r2 (None where the method has none), seconds, names."""
    out = []
    for name, recipe in named.items():
        for method in methods:
            pipe, began = build(), time.time()
            pipe.default_method = method
            chosen = recipe(pipe)
            last = pipe.stages[-1]
            out.append({"recipe": name, "method": method, "selected": len(chosen), "r2": last.final_r2 if last.history.score_kind == "r2" else None, "seconds": time.time() - began, "names": list(chosen.names)})
    return out


def apply_stage(df: DataFrame, step: str, columns: Sequence[str], types: dict[str, str] | None = None, config: Config | None = None, include_input: bool = False, feature_space: str = "linear", least_sd: float = 0.005, threshold: float = 0.95, max_complexity: int | None = None, dedup_rows: int = SAMPLE_ROWS) -> list[Feature]:
    """The candidates of one step without a target: made, pruned of constants and duplicates, limited in complexity."""
    from ..plans.expr import raw
    from ..plans.prune import Sample, prune
    from ..plans.stats import infer_types

    config, types = config or Config(), types or infer_types(df, columns)
    own = [raw(c, types[c]) for c in columns]
    make = {"raw": lambda: fam.unary(df, own), "am": lambda: fam.pairwise(df, [own], config), "carriers": lambda: fam.carriers(df, own, config, feature_space), "fields": lambda: fam.fields(df, own, config)}
    if step not in make:
        raise ValueError(f"apply_stage does not know the step {step}: use one of {sorted(make)}")
    made = [replace(f, family="input") for f in own] * include_input + make[step]()
    made = list({f.key: f for f in reversed(made)}.values())[::-1]
    finite = [f if not f.children or f.values else replace(f, template=fx.finite(f"({f.template})")) for f in made]
    if not finite:
        return []
    _, live = prune(df, Sample(df, columns, (), dedup_rows, df.count()), finite, least_sd, threshold)
    return [finite[k] for k in live if max_complexity is None or finite[k].complexity <= max_complexity]
