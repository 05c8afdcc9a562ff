"""The stage pipeline: enumerate, prune and select features of a DataFrame, compose stages, apply them to new rows."""

from __future__ import annotations

import functools
import json
import time
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dedup
from ..plans.expr import Feature, from_json, project, raw, to_json
from ..plans.moments import Joined, Sums, collect_moments
from ..plans.prune import Sample, prune
from ..plans.select import History, check_count, diagnose_curve, select_features
from ..plans.stats import check_finite, infer_types
from . import families as fam
from . import frequency
from .budget import driver_memory, guard, predict_breakdown, risk, step_bytes
from .families import Config

#: Rows from which a table in too few pieces is dealt out again.
SPREAD_ROWS = 50_000
#: Most classes of a classification target.
MOST_CLASSES = 1000
#: Raw and pairwise features that a calibration of frequencies looks at (a fixed value).
CALIBRATED = 20
#: Products of columns that probe_fields looks at in one pass.
PROBED = 500


@dataclass(frozen=True)
class FeatureSet:
    """An immutable, ordered set of features; holds no data."""

    features: tuple[Feature, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.label for f in self.features)

    @property
    def feature_types(self) -> tuple[str, ...]:
        return tuple(f.kind for f in self.features)

    @property
    def families(self) -> tuple[str, ...]:
        return tuple(f.family for f in self.features)

    @property
    def source_names(self) -> tuple[frozenset, ...]:
        return tuple(f.sources for f in self.features)

    def __len__(self) -> int:
        return len(self.features)

    def __iter__(self):
        return iter(self.features)


@dataclass
class Stage:
    name: str
    step: str
    output: FeatureSet
    history: History
    n_generated: int
    n_filtered: int
    n_deduped: int
    method: str
    elapsed: float
    parents: tuple[int, ...] = ()
    metadata: dict = field(default_factory=dict)

    @property
    def n_selected(self) -> int:
        return len(self.output)

    @property
    def final_r2(self) -> float | None:
        return self.history.final_r2

    @property
    def per_class_histories(self) -> dict:
        return self.history.per_class

    @property
    def diagnosis(self) -> str:
        return diagnose_curve(self.history) if self.history.score_kind == "r2" else self.history.score_kind

    @property
    def curve(self) -> list[float]:
        return [s["cumulative_r2"] for s in self.history.steps]

    @property
    def family_census(self) -> dict[str, int]:
        return {k: self.output.families.count(k) for k in sorted(set(self.output.families))}


@dataclass(frozen=True)
class Checkpoint:
    length: int
    candidates: int
    families: frozenset


def atomic(method):
    """Any exception leaves the pipeline as it was before the call."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        before = self.checkpoint()
        try:
            return method(self, *args, **kwargs)
        except Exception:
            self.rewind(before)
            raise

    return run


class Pipeline:
    """Discovers features of numeric columns for a target.

    df: rows with the columns and the target, without null or non-finite
    values. val: rows of the same columns that selection is scored on. base
    and val_base: columns of baseline predictions; features then explain what
    is left. row_id: columns that identify a row, needed for folds, samples
    and frequencies. group: a column whose groups weigh in the OMP ranking.
    dedup_rows: correlations of candidates are those of so many rows, sampled
    by hash (all rows of a smaller table). large_pool: candidates from which
    deduplication goes by components, and selection over folds by correlation.
    """

    def __init__(self, df: DataFrame, target: str, columns: Sequence[str] | None = None, types: dict[str, str] | None = None, *, val: DataFrame | None = None, base: str | None = None, row_id: Sequence[str] = (), folds: int = 3, seed: int = 0, config: Config | None = None, exclude_families: Sequence[str] = (), max_candidates: int | None = 100_000, max_memory: int | str | None = None, classification: bool = False, group: str | None = None, group_weight: float = 0.0, use_folds: bool = False, select_options: dict | None = None, dedup_rows: int = dedup.SAMPLE_ROWS, large_pool: int = dedup.LARGE_POOL):
        self.df, self.val, self.target, self.base = df, val, target, base
        self.columns = list(columns) if columns is not None else [c for c, t in df.dtypes if c not in (target, base, group, *row_id) and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
        if len(set(self.columns)) != len(self.columns):
            raise ValueError("column names must be unique")
        missing = [c for c in [*self.columns, target] if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if val is not None and [c for c in [*self.columns, target] if c not in val.columns]:
            raise ValueError("the validation rows lack columns")
        check_finite(df, [*self.columns, target])
        if types is not None and (set(types) != set(self.columns) or not set(types.values()) <= {"numeric", "bool", "categorical"}):
            raise ValueError("types must name each column numeric, bool or categorical")
        self.types = types or infer_types(df, self.columns)
        self.config = replace(config or Config())
        self.row_id, self.seed, self.exclude = list(row_id), seed, frozenset(exclude_families) | frozenset(self.config.excluded)
        if isinstance(folds, bool) or not isinstance(folds, int) or folds < 2:
            raise ValueError(f"folds must be an integer of at least 2: {folds!r}")
        shape = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
        self.n_rows, cores = shape[0] or 0, df.sparkSession.sparkContext.defaultParallelism
        if self.n_rows >= SPREAD_ROWS and shape[1] > 2 * self.n_rows / cores:
            # A table in fewer pieces than there are cores: its columns are dealt out, as every pass computes far more than it reads.
            self.df = df.repartition(cores)
        if use_folds and folds > self.n_rows // 2:
            raise ValueError(f"{folds} folds need at least {2 * folds} rows")
        self.folds, self.use_folds = folds, use_folds and val is None
        if use_folds and not self.row_id:
            raise ValueError("folds need row_id columns")
        self.classification, self.group, self.group_weight = classification, group, group_weight
        if group and group_weight and self.use_folds:
            raise ValueError("group-aware ranking and folds exclude each other")
        self.classes = [r[0] for r in df.select(target).distinct().limit(MOST_CLASSES + 1).collect()] if classification else []
        if len(self.classes) > MOST_CLASSES:
            raise ValueError(f"over {MOST_CLASSES} classes: {target} looks continuous")
        self.classes = sorted(self.classes)
        self.dedup_rows, self.large_pool = dedup_rows, large_pool
        self.default_method = "omp"
        self._sample: Sample | None = None
        self.select_options = dict(select_options or {})
        self.max_candidates, self.max_memory = max_candidates, driver_memory() if max_memory == "auto" else max_memory
        self.stages: list[Stage] = []
        self._owners: dict[int, int] = {}
        self._used, self._families = 0, frozenset()
        self._inputs = tuple(raw(c, self.types[c]) for c in self.columns)
        if self.config.carrier_freqs == "fft":
            self._calibrate()

    # ------------------------------------------------------------ bookkeeping

    def checkpoint(self) -> Checkpoint:
        return Checkpoint(len(self.stages), self._used, self._families)

    def rewind(self, to: Checkpoint | None = None) -> None:
        """Back to a checkpoint, or one stage back."""
        length = to.length if to else max(0, len(self.stages) - 1)
        if to and to.length > len(self.stages):
            raise ValueError("that checkpoint is ahead of the pipeline")
        self._used = to.candidates if to else self._used - (self.stages[-1].n_generated if self.stages else 0)
        self._families = to.families if to else self._families
        del self.stages[length:]
        self._owners = {k: v for k, v in self._owners.items() if v < length}

    def _record(self, name, step, output, history, generated, filtered, deduped, method, began, parents, **metadata) -> FeatureSet:
        method = method if method is not None else self.default_method
        self.stages.append(Stage(name, step, output, history, generated, filtered, deduped, method, time.time() - began, tuple(self._owners[id(p)] for p in parents if id(p) in self._owners), metadata))
        self._owners[id(output)] = len(self.stages) - 1
        self._families |= set(output.families)
        return output

    @property
    def unused_families(self) -> set[str]:
        """Families that no stage's output has had, of those that were not excluded."""
        every = {"raw", *fam.fx.UNARY, "reciprocal", "rank", "onehot", *[k for s in ("am", "carriers", "fm", "fm_nonsmooth", "wm", "fields") for k in predict_breakdown(s, [self._inputs, self._inputs], self.config)]}
        return every - self.exclude - self._families

    def recap(self) -> list[dict]:
        return [{"stage": k, "name": s.name, "generated": s.n_generated, "filtered": s.n_filtered, "deduped": s.n_deduped, "selected": s.n_selected, "r2": s.final_r2, "method": s.method, "seconds": round(s.elapsed, 3), "families": s.family_census} for k, s in enumerate(self.stages)]

    # ------------------------------------------------------------ selection

    def _targets(self) -> list[Column]:
        y = F.col(f"`{self.target}`").cast("double")
        if self.classification:
            return [F.when(F.col(f"`{self.target}`") == c, 1.0).otherwise(0.0) for c in self.classes]
        return [y - F.col(f"`{self.base}`") if self.base else y]

    def _fold(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in self.row_id], F.lit(self.seed)), F.lit(self.folds)).cast("int")

    @property
    def sample(self) -> Sample:
        """The rows that candidates are compared on, taken once."""
        if self._sample is None:
            self._sample = Sample(self.df, self.columns, self.row_id, self.dedup_rows, self.n_rows)
        return self._sample

    def _choose(self, features: list[Feature], select: int | None, method: str | None, pruned: bool) -> tuple[list[Feature], History, int, int]:
        """(chosen, history, after the constant filter, after deduplication)."""
        method = method or self.default_method
        check_count(select)
        if not features:
            return [], History(), 0, 0
        filtered = deduped = len(features)
        own = features
        if pruned:
            filtered, live = prune(self.df, self.sample, features, large=self.large_pool)
            own = [features[k] for k in live]
            deduped = len(own)
        if select is None or not own:
            return own, History(), filtered, deduped
        targets, options = self._targets(), dict(self.select_options)
        sums = Sums(self.df, own, targets, self._fold() if self.use_folds else None)
        parts = [sums.parts[k] for k in sorted(sums.parts)]
        score = Sums(self.val, own, targets).parts[0] if self.val is not None else None
        if method == "omp" and self.group and self.group_weight and not self.use_folds:
            by = F.col(f"`{self.group}`")
            options |= {"within": lambda active, c: sums.within(by, active, c), "group_weight": self.group_weight}
        history = select_features(method, own, list(range(len(own), len(own) + len(targets))), min(select, len(own)), Joined(parts), score, parts if self.use_folds else [], self.classes, self.large_pool, **options)
        return [own[k] for k in history.chosen], history, filtered, deduped

    def _stage(self, name: str, step: str, sets: Sequence[FeatureSet], make, select, method, **metadata) -> FeatureSet:
        began = time.time()
        check_count(select)
        needed = self.predict_candidates(step, *sets)["candidates"]
        guard(name, needed, self._used, self.max_candidates, self.max_memory, self.n_rows, self.folds if self.use_folds else 1, self.dedup_rows, self.large_pool)
        candidates = make()
        self._used += len(candidates)
        chosen, history, filtered, deduped = self._choose(candidates, select, method, True)
        return self._record(name, step, FeatureSet(tuple(chosen)), history, len(candidates), filtered, deduped, method, began, sets, **metadata)

    # ------------------------------------------------------------ stages

    @atomic
    def raw(self, select: int | None = None, method: str | None = None) -> FeatureSet:
        return self._stage("raw", "raw", [FeatureSet(self._inputs)], lambda: fam.unary(self.df, self._inputs, self.exclude), select, method)

    @atomic
    def am(self, *sets: FeatureSet, select: int | None = None, method: str | None = None) -> FeatureSet:
        if not sets:
            raise ValueError("am needs at least one feature set")
        return self._stage("am", "am", sets, lambda: fam.pairwise(self.df, [s.features for s in sets], self.config, self.exclude), select, method)

    @atomic
    def carriers(self, s: FeatureSet, select: int | None = None, method: str | None = None, feature_space: str = "linear") -> FeatureSet:
        fam.fx.space(feature_space)
        return self._stage("carriers", "carriers", [s], lambda: fam.carriers(self.df, s.features, self.config, feature_space, self.exclude), select, method, feature_space=feature_space)

    def fft_freqs(self, s: FeatureSet, n_per_feature: int = 5, min_power_ratio: float = 0.1, max_k: float | None = None, y_target: Column | None = None, nyquist_fraction: float = frequency.NYQUIST) -> dict[int, list[float]]:
        """Frequencies found per position of a feature."""
        if not self.row_id:
            raise ValueError("frequencies need row_id columns, which break ties")
        live = [k for k, f in enumerate(s) if f.kind == "numeric"]
        found = frequency.binned(self.df, [s.features[k] for k in live], y_target if y_target is not None else self._targets()[0], self.row_id, nyquist_fraction) if live else []
        out = {k: [p[0] for p in frequency.peaks(mean, unique, self.config.carrier_phase_scale, n_per_feature, min_power_ratio, max_k, nyquist_fraction)] for k, (unique, mean) in zip(live, found)}
        return {k: v for k, v in out.items() if v}

    @atomic
    def fft_carriers(self, s: FeatureSet, select: int | None = None, method: str | None = None, n_per_feature: int = 5, min_power_ratio: float = 0.1, max_k: float | None = None, y_target: Column | None = None, nyquist_fraction: float = frequency.NYQUIST) -> FeatureSet:
        freqs = self.fft_freqs(s, n_per_feature, min_power_ratio, max_k, y_target, nyquist_fraction)
        if not freqs:
            warnings.warn("no periodicity found: plain carriers", stacklevel=3)
            return self.carriers(s, select, method)
        return self._stage("fft_carriers", "fft_carriers", [s], lambda: fam.carriers(self.df, s.features, self.config, "linear", self.exclude, freqs, squares=True), select, method, periodicities={s.names[k]: v for k, v in freqs.items()})

    def _calibrate(self) -> None:
        """carrier_freqs = "fft": frequencies that the best raw and pairwise features of two folds share; the default grid without any."""
        self.config = replace(self.config, carrier_freqs=Config().carrier_freqs)
        if not self.row_id:
            raise ValueError("frequencies need row_id columns, which break ties")
        own = Pipeline(self.df, self.target, self.columns, dict.fromkeys(self.columns, "numeric"), base=self.base, row_id=self.row_id, folds=2, seed=self.seed, config=self.config, exclude_families=self.exclude, use_folds=not self.classification, classification=self.classification, dedup_rows=self.dedup_rows, large_pool=self.large_pool)
        s0 = own.raw(select=CALIBRATED)
        both = own.fuse(s0, own.am(s0, select=CALIBRATED)) if len(s0) else s0
        found = frequency.binned(self.df, both.features, self._targets()[0], self.row_id)
        freqs = frequency.calibrate([frequency.peaks(m, u, self.config.carrier_phase_scale, 10, 0.05) for u, m in found], self.config.calibrate_n_freqs)
        if freqs:
            self.config = replace(self.config, carrier_freqs=freqs)

    def _modulated(self, name, carrier, mod, kernels, select, method):
        return self._stage(name, name, [carrier, mod], lambda: fam.modulate(self.df, carrier.features, mod.features, self.config, kernels, self.exclude), select, method)

    @atomic
    def fm(self, carrier: FeatureSet, mod: FeatureSet, select: int | None = None, method: str | None = None) -> FeatureSet:
        return self._modulated("fm", carrier, mod, ("fm_sin", "pm_sin"), select, method)

    @atomic
    def fm_nonsmooth(self, carrier: FeatureSet, mod: FeatureSet, select: int | None = None, method: str | None = None) -> FeatureSet:
        return self._modulated("fm_nonsmooth", carrier, mod, ("fm_tri", "fm_pulse"), select, method)

    @atomic
    def wm(self, carrier: FeatureSet, mod: FeatureSet, select: int | None = None, method: str | None = None) -> FeatureSet:
        return self._modulated("wm", carrier, mod, ("wm_center", "wm_width"), select, method)

    @atomic
    def fields(self, s: FeatureSet, select: int | None = None, method: str | None = None) -> FeatureSet:
        return self._stage("fields", "fields", [s], lambda: fam.fields(self.df, s.features, self.config, None, self.exclude), select, method)

    @atomic
    def probe_fields(self, s: FeatureSet, select: int | None = None, method: str | None = None, max_groups: int = 6, size: int = 2) -> FeatureSet:
        """Zones within groups of columns that act together: those whose product explains most beyond their own parts."""
        numeric = [k for k, f in enumerate(s) if f.kind == "numeric"]
        pairs = [(i, j) for a, i in enumerate(numeric) for j in numeric[a + 1 :]]
        if not pairs:
            warnings.warn("no groups of columns to probe", stacklevel=3)
            return self._record("probe_fields", "probe_fields", FeatureSet(()), History(), 0, 0, 0, method, time.time(), [s])
        from ..plans.expr import derive
        from ..plans.select import PARENT_RIDGE, r2

        gain = []
        for at in range(0, len(pairs), PROBED):
            some = pairs[at : at + PROBED]
            used = sorted({k for p in some for k in p})
            features = [*(s.features[k] for k in used), *[derive("{0} * {1}", [s.features[i], s.features[j]], "probe", "probe") for i, j in some]]
            m, t = collect_moments(self.df, features, self._targets()[:1])[0], len(features)
            for k, (i, j) in enumerate(some):
                own = [used.index(i), used.index(j)]
                gain.append(r2(m, m, [*own, len(used) + k], t, PARENT_RIDGE) - r2(m, m, own, t, PARENT_RIDGE))
        groups = [pairs[k] for k in np.argsort(-np.array(gain), kind="stable")[:max_groups]]
        return self._stage("probe_fields", "probe_fields", [s], lambda: fam.fields(self.df, s.features, self.config, groups, self.exclude), select, method, groups=groups)

    def field_pipeline(self, s: FeatureSet, n_zones: int = 5, n_adjust: int = 5, min_adjust_gain: float = 0.0) -> FeatureSet:
        """Zones chosen greedily, then products of them with the features that still add so much."""
        zones = self.fields(s, select=n_zones, method="greedy")
        before = self.checkpoint()
        began = time.time()
        extra = fam.zone_adjustments(self.df, [f for f in zones if f.family == "field_zone"], s.features)
        chosen, history, *_ = self._choose(extra, n_adjust, "greedy", True) if extra else ([], History())
        keep = [f for f, step in zip(chosen, history.steps) if step["marginal_r2"] >= min_adjust_gain]
        self.rewind(before)
        return self._record("field_pipeline", "fields", FeatureSet((*zones.features, *keep)), history, len(extra), len(extra), len(extra), "greedy", began, [zones])

    @atomic
    def fuse(self, *sets: FeatureSet) -> FeatureSet:
        """The columns of the sets, an expression that repeats once. A single set comes back as it is."""
        if not sets:
            raise ValueError("fuse needs at least one feature set")
        if len(sets) == 1:
            return sets[0]
        seen = {f.key: f for s in reversed(sets) for f in reversed(s.features)}
        order = list(dict.fromkeys(f.key for s in sets for f in s))
        return self._record("fuse", "fuse", FeatureSet(tuple(seen[k] for k in order)), History(), 0, len(order), len(order), "", time.time(), sets)

    @atomic
    def select(self, fs: FeatureSet, select: int, method: str | None = None) -> FeatureSet:
        """Choose again among a set's columns; nothing is pruned or excluded."""
        if select is None:
            raise ValueError("select needs a count")
        began = time.time()
        chosen, history, *_ = self._choose(list(fs.features), select, method, False)
        return self._record("select", "select", FeatureSet(tuple(chosen)), history, len(fs), len(fs), len(fs), method, began, [fs])

    # ------------------------------------------------------------ use

    @property
    def output(self) -> FeatureSet:
        if not self.stages:
            raise ValueError("the pipeline has no stage")
        return self.stages[-1].output

    def transform(self, df: DataFrame, keep: Sequence[str] = (), fs: FeatureSet | None = None) -> DataFrame:
        """The last stage's columns for new rows, batch or streaming: a projection of frozen expressions."""
        return project(df, (fs or self.output).features, keep)

    @functools.cached_property
    def _levels(self) -> dict[str, int]:
        """Distinct values of the categorical columns."""
        own = [c for c, t in self.types.items() if t == "categorical"]
        return dict(zip(own, self.df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in own]).first())) if own else {}

    def predict_candidates(self, step: str, *sets: FeatureSet, select: int | None = None) -> dict:
        """An upper bound of a step's candidates, and what follows from it."""
        breakdown = predict_breakdown(step, [s.features for s in sets] or [self._inputs], self.config, self._levels)
        breakdown = {k: n for k, n in breakdown.items() if k not in self.exclude}
        total = sum(breakdown.values())
        left = None if self.max_candidates is None else self.max_candidates - self._used - total
        return {"candidates": total, "breakdown": breakdown, "n_samples": self.n_rows, "samples_per_candidate": self.n_rows / max(total, 1), "overfit_risk": risk(self.n_rows, total), "select": select, "selection_pressure": total / select if select else None, "effective_ratio": self.n_rows / select if select else None, "candidates_used": self._used, "candidates_after": self._used + total, "candidates_remaining": left}

    def _step_bytes(self, candidates: int) -> dict:
        return step_bytes(candidates, self.n_rows, self.folds if self.use_folds else 1, self.dedup_rows, self.large_pool)

    def estimate_memory(self, step: str, *sets: FeatureSet) -> dict:
        """Bytes on the driver in a step, which holds a sample of the candidates and sums, never all rows."""
        forecast = self.predict_candidates(step, *sets)
        rows = min(self.n_rows, self.dedup_rows)
        return self._step_bytes(forecast["candidates"]) | {"breakdown_bytes": {k: 8 * n * rows for k, n in forecast["breakdown"].items()}, "n_samples": self.n_rows}

    def print_memory(self, step: str, *sets: FeatureSet) -> str:
        """Print, and return, a step's forecast in words."""
        m = self.estimate_memory(step, *sets)
        mb = lambda n: f"{n / 2**30:.1f} GB" if n >= 2**30 else f"{n / 2**20:.0f} MB"
        state = "exceeds the budget" if self.max_memory is not None and m["peak_bytes"] > self.max_memory else "fits"
        limit = mb(self.max_memory) if self.max_memory is not None else "no limit"
        said = f"{step}: {mb(m['peak_bytes'])} at the peak ({limit}; {state}), {m['candidates']} candidates: sample {mb(m['candidate_bytes'])}, deduplication {mb(m['dedup_bytes'])}, selection {mb(m['selection_bytes'])}, folds {mb(m['kfold_bytes'])}"
        print(said)
        return said

    def predict_pipeline_memory(self, max_stage: int = 5, select: int = 20) -> dict:
        """The forecast of each step of auto_run, and the last step up to which all fit the budget."""
        mock = lambda n: [raw(f"mock{k}") for k in range(n)]
        at_most = lambda step, *sets: sum(n for k, n in predict_breakdown(step, list(sets), self.config, self._levels).items() if k not in self.exclude)
        first = at_most("raw", self._inputs)
        counts = [("raw", first), ("am", at_most("am", mock(first))), ("carriers", at_most("carriers", mock(first)))]
        counts += [(step, at_most(step, mock(first), mock(select))) for step in ("fm", "fm_nonsmooth", "wm")]
        stages, fits, best = [], True, 0
        for k, (name, n) in enumerate(counts[: max_stage + 1]):
            m = self._step_bytes(n)
            over = self.max_memory is not None and m["peak_bytes"] > self.max_memory
            fits = fits and not over
            best = k if fits else best
            stages.append({"name": name, **m, "pool_bytes_after": 0, "exceeds_budget": over})
        return {"stages": stages, "total_peak_bytes": max(x["peak_bytes"] for x in stages), "fits_in_budget": fits, "recommended_max_stage": best}

    # ------------------------------------------------------------ keeping

    def save(self) -> str:
        """The output as JSON: expressions and statistics, no data."""
        return json.dumps({"output": json.loads(to_json(self.output.features)), "recap": self.recap(), "target": self.target}, allow_nan=False)

    def save_all(self) -> str:
        """All stages as JSON, to go on from with restore()."""
        flat = [f for s in self.stages for f in s.output]
        history = lambda h: {"steps": h.steps, "score_kind": h.score_kind, "score_split": h.score_split, "per_class": [[k, history(v)] for k, v in h.per_class.items()]}
        stages = [{"size": len(s.output), "history": history(s.history)} | {k: getattr(s, k) for k in ("name", "step", "n_generated", "n_filtered", "n_deduped", "method", "elapsed", "parents")} for s in self.stages]
        own = {k: getattr(self, k) for k in ("target", "columns", "types", "base", "row_id", "folds", "seed", "max_candidates", "max_memory", "classification", "group", "group_weight", "use_folds", "dedup_rows", "large_pool", "n_rows", "classes")}
        config = {k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in vars(self.config).items()}
        return json.dumps({"features": json.loads(to_json(flat)), "stages": stages, "pipeline": own, "config": config, "exclude": sorted(self.exclude), "used": self._used, "families": sorted(self._families)}, allow_nan=False)

    @classmethod
    def restore(cls, text: str, df: DataFrame, val: DataFrame | None = None, select_options: dict | None = None) -> "Pipeline":
        """The pipeline of save_all() over rows with the same columns: it goes on where that one was."""
        spec = json.loads(text)
        own, config = spec["pipeline"], spec["config"]
        config |= {"excluded": frozenset(config["excluded"]), "pulse_bands": tuple(tuple(x) for x in config["pulse_bands"])}
        p = cls(df, own["target"], own["columns"], own["types"], val=val, base=own["base"], row_id=own["row_id"], folds=own["folds"], seed=own["seed"], config=Config(**config), exclude_families=spec["exclude"], max_candidates=own["max_candidates"], max_memory=own["max_memory"], classification=own["classification"], group=own["group"], group_weight=own["group_weight"], use_folds=own["use_folds"], select_options=select_options, dedup_rows=own["dedup_rows"], large_pool=own["large_pool"])
        features, at = from_json(json.dumps(spec["features"])), 0

        def history(h: dict) -> History:
            return History(h["steps"], h["score_kind"], h["score_split"], {k: history(v) for k, v in h["per_class"]})

        for s in spec["stages"]:
            output = FeatureSet(tuple(features[at : at + s["size"]]))
            at += s["size"]
            p.stages.append(Stage(s["name"], s["step"], output, history(s["history"]), s["n_generated"], s["n_filtered"], s["n_deduped"], s["method"], s["elapsed"], tuple(s["parents"])))
            p._owners[id(output)] = len(p.stages) - 1
        p._used, p._families = spec["used"], frozenset(spec["families"])
        return p


def load(text: str) -> FeatureSet:
    """The features of a saved pipeline; apply them with plans.expr.project."""
    return FeatureSet(tuple(from_json(json.dumps(json.loads(text)["output"]))))
