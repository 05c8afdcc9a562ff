"""Enumerators: from features and their training statistics to candidate features, in a fixed order."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import formulas as fx
from ..plans.expr import Feature, derive
from ..plans.stats import Stats, column_stats, distinct_counts


@dataclass
class Config:
    """Grids of parameters; the defaults are fixed values."""

    carrier_freqs: Sequence[float] | str = (0.5, 1, 2, 3)
    calibrate_n_freqs: int = 4
    fm_depths: Sequence[float] = (-2, -1, 1, 2)
    pm_depths: Sequence[float] = (0.5, 1, 2)
    wm_center_pcts: Sequence[float] = (30, 50, 70)
    wm_shift_scale: float = 1.0
    wm_width_mods: Sequence[float] = (0.5, 1, 2)
    step_pcts: Sequence[float] = (25, 50, 75)
    pulse_bands: Sequence[tuple[float, float]] = ((0, 0.33), (0.33, 0.67), (0.67, 1))
    gauss_center_pcts: Sequence[float] = (25, 50, 75)
    gauss_widths: Sequence[float] = (0.2, 0.5)
    max_ratios_per_feature: int | None = None
    power_scales: Sequence[float] = (0.5, 1, 2, 3)
    carrier_phase_scale: float = math.pi
    field_pct_levels: Sequence[float] = (20, 40, 60, 80)
    field_scales: Sequence[float] = (0.1, 0.3, 1)
    field_max_dims: int = 2
    excluded: frozenset = field(default_factory=frozenset)


def unary(df: DataFrame, features: Sequence[Feature], exclude: Iterable[str] = ()) -> list[Feature]:
    """All raw columns, then each transform over all columns."""
    stats, exclude = column_stats(df, features), set(exclude)
    out = [f for f in features if "raw" not in exclude]
    numeric = [(f, s) for f, s in zip(features, stats) if f.kind == "numeric"]
    for family, (template, label) in fx.UNARY.items():
        if family not in exclude:
            out += [derive(template, [f], label.format(f.label), family) for f, _ in numeric]
    if "reciprocal" not in exclude:
        out += [derive(fx.reciprocal(s.sd), [f], f"1/|{f.label}|", "reciprocal") for f, s in numeric if s.sd > fx.TINY]
    if "rank" not in exclude:
        for f, _ in numeric:
            values, counts = distinct_counts(df, f)
            out.append(derive("rank", [f], f"rank({f.label})", "rank", values=values, counts=counts))
    if "onehot" not in exclude:
        for f in features:
            if f.kind == "categorical":
                out += [derive(fx.onehot(v), [f], f"{f.label}=={v:g}", "onehot", kind="bool") for v in distinct_counts(df, f)[0]]
    return out


def pairs_of(sets: Sequence[Sequence[Feature]]) -> list[tuple[int, int]]:
    """Index pairs i < j of the concatenated sets: all of one set, or those across sets."""
    owner = [k for k, s in enumerate(sets) for _ in s]
    return [(i, j) for i, j in itertools.combinations(range(len(owner)), 2) if len(sets) == 1 or owner[i] != owner[j]]


def pairwise(df: DataFrame, sets: Sequence[Sequence[Feature]], config: Config, exclude: Iterable[str] = ()) -> list[Feature]:
    """The pairwise algebra. Products and differences need one numeric operand, the others two."""
    features, exclude = [f for s in sets for f in s], set(exclude)
    stats, pairs = column_stats(df, features), pairs_of(sets)
    numeric = [f.kind == "numeric" for f in features]
    mixed = [p for p in pairs if numeric[p[0]] or numeric[p[1]]]
    both = [p for p in pairs if numeric[p[0]] and numeric[p[1]]]
    out: list[Feature] = []

    def add(family: str, template: str, label: str, i: int, j: int) -> None:
        if family not in exclude:
            a, b = features[i], features[j]
            out.append(derive(template, [a, b], label.format(a.label, b.label), family))

    for i, j in mixed:
        add("am_product", "{0} * {1}", "{0}*{1}", i, j)
    for i, j in mixed:
        add("am_diff", "abs({0} - {1})", "|{0}-{1}|", i, j)
    allowed = set(both)
    for den in range(len(features)):
        if numeric[den] and stats[den].sd >= fx.TINY:
            above = [k for k in range(len(features)) if (min(k, den), max(k, den)) in allowed]
            for k in above[: config.max_ratios_per_feature]:
                add("am_ratio", fx.ratio(stats[den].sd), "{0}/{1}", k, den)
    templates = {(i, j): fx.pair_templates(stats[i].sd, stats[j].sd) for i, j in both}
    for names in (("am_sq_diff",), ("am_min", "am_max"), ("am_hmean",), ("am_normdiff",), ("am_logratio",), ("am_damped",), ("am_relu",)):
        for (i, j), own in templates.items():
            for family in names:
                for template, label in own.get(family, []):
                    add(family, template, label, i, j)
    for i, j in both:
        for a, b in ((i, j), (j, i)):
            span = stats[b].span if stats[b].span > fx.TINY else 1.0
            for s in config.power_scales:
                add("am_power", fx.power(s, stats[b].lo, span), "{0}^{1}" if s == 1 else f"{{0}}^({s:g}·{{1}})", a, b)
    return out


def carriers(df: DataFrame, features: Sequence[Feature], config: Config, space: str = "linear", exclude: Iterable[str] = (), freqs: dict[int, Sequence[float]] | None = None, squares: bool = False) -> list[Feature]:
    """Periodic, step, pulse and bump functions of each numeric feature, in a coordinate space.

    freqs: frequencies by position of the feature; features without any are left out.
    """
    exclude, numeric = set(exclude), [(k, f) for k, f in enumerate(features) if f.kind == "numeric" and (freqs is None or freqs.get(k))]
    own = [f for _, f in numeric]
    moved = own if space == "linear" else [derive(fx.space(space), [f], f"{space}[{f.label}]", "space") for f in own]
    levels = [] if squares else sorted({*config.gauss_center_pcts, *config.step_pcts})
    stats = column_stats(df, moved if space == "linear" else [*moved, *own], levels)
    stats, plain = stats[: len(own)], stats[-len(own) :] if own else []
    scale, sign = fx.num(config.carrier_phase_scale), fx.phase_label(config.carrier_phase_scale)
    out: list[Feature] = []
    for (k, f), x, s, p in zip(numeric, moved, stats, plain):
        if s.span <= fx.TINY:
            continue
        n01, name = fx.normalised(s.lo, s.hi), x.label
        add = lambda family, template, label, of=x: out.append(derive(template, [of], label, family)) if family not in exclude else None
        grid = freqs[k] if freqs is not None else config.carrier_freqs
        form = ".2f" if freqs is not None else "g"
        for q in grid:
            wave = f"({fx.num(q)} * {scale} * {n01})"
            add("carrier_sin", f"sin{wave}", f"sin({q:{form}}{sign}*{name})")
            add("carrier_cos", f"cos{wave}", f"cos({q:{form}}{sign}*{name})")
            if squares:
                add("carrier_sin2", f"sin{wave} * sin{wave}", f"sin²({q:{form}}{sign}*{name})")
                add("carrier_cos2", f"cos{wave} * cos{wave}", f"cos²({q:{form}}{sign}*{name})")
        for q in grid:
            add("carrier_tri", fx.triangle(f"({fx.num(q)} * {n01})"), f"tri({q:{form}}*{name})")
        if squares:
            continue
        for q in config.step_pcts:
            add("carrier_step", f"CASE WHEN {{0}} > {fx.num(p.quantiles[q])} THEN 1D ELSE 0D END", f"step({f.label}>{q:g}%)", f)
        for lo, hi in config.pulse_bands:
            add("carrier_pulse", f"CASE WHEN {n01} >= {fx.num(lo)} AND {n01} <= {fx.num(hi)} THEN 1D ELSE 0D END", f"pulse({name}:{lo:.0%}-{hi:.0%})")
        for q in config.gauss_center_pcts:
            for w in config.gauss_widths:
                add("carrier_gauss", fx.gauss(n01, fx.num((s.quantiles[q] - s.lo) / s.span), fx.num(w)), f"gauss({name},c={q:g}%,w={w:g})")
    return out


def modulate(df: DataFrame, carriers_: Sequence[Feature], modulators: Sequence[Feature], config: Config, families: Sequence[str], exclude: Iterable[str] = (), skip_self: bool = False, prefix: str = "") -> list[Feature]:
    """Kernels of families over carrier x modulator. Carriers must be numeric; both need a range."""
    exclude = set(exclude)
    quantiles = any(f in families for f in ("fm_pulse", "wm_center", "wm_width"))
    cs = column_stats(df, carriers_, config.wm_center_pcts if quantiles else ()) if carriers_ else []
    known = {f.key: s for f, s in zip(carriers_, cs)}
    rest = [f for f in modulators if f.key not in known]
    known |= {f.key: s for f, s in zip(rest, column_stats(df, rest))}
    ms = [known[f.key] for f in modulators]
    freqs = config.carrier_freqs if not isinstance(config.carrier_freqs, str) else Config().carrier_freqs
    grids: dict[str, list[tuple[str, dict]]] = {
        "fm_sin": [(f"FM_sin_k{k:g}_d{d:g}", {"k": k, "d": d}) for k in freqs for d in config.fm_depths],
        "pm_sin": [(f"PM_sin_k{k:g}_p{p:g}", {"k": k, "p": p}) for k in freqs for p in config.pm_depths],
        "fm_tri": [(f"FM_tri_k{k:g}_d{d:g}", {"k": k, "d": d}) for k in freqs for d in config.fm_depths],
        "fm_pulse": [(f"FM_pulse_c{q:g}_w{w:g}", {"q": q, "w": w, "shift": config.wm_shift_scale}) for q in config.wm_center_pcts for w in config.gauss_widths],
        "wm_center": [(f"WM_center_q{q:g}", {"q": q}) for q in config.wm_center_pcts],
        "wm_width": [(f"WM_width_q{q:g}_m{w:g}", {"q": q, "wmod": w}) for q in config.wm_center_pcts for w in config.wm_width_mods],
    }
    out: list[Feature] = []
    for c, s in zip(carriers_, cs):
        if c.kind != "numeric" or s.span <= fx.TINY:
            continue
        for m, t in zip(modulators, ms):
            if t.span <= fx.TINY or (skip_self and m.key == c.key):
                continue
            for family in families:
                for name, p in grids[family]:
                    template = fx.modulation(family, s.lo, s.hi, t.lo, t.hi, s.sd, s.quantiles.get(p.get("q"), 0.0), config.carrier_phase_scale, **p)
                    tag = prefix + (family if not prefix else family.split("_")[0] if family[:2] in ("fm", "pm") else family)
                    if template is not None and tag not in exclude:
                        out.append(derive(template, [c, m], f"{name}_{m.label}→{c.label}", tag))
    return out


#: Percentile levels of zone centres by number of dimensions.
LEVELS = {2: None, 3: (25, 50, 75), 4: (33, 67)}


def fields(df: DataFrame, features: Sequence[Feature], config: Config, groups: Sequence[Sequence[int]] | None = None, exclude: Iterable[str] = ()) -> list[Feature]:
    """Distance to the nearest centre, zones around centres, and how many zones hold the row, per combination of columns.

    A zone is kept if it is not constant on the training rows.
    """
    exclude = set(exclude)
    levels = sorted({*config.field_pct_levels, 25, 50, 75, 33, 67})
    stats = column_stats(df, features, levels) if features else []
    combos = groups if groups is not None else [c for n in range(2, config.field_max_dims + 1) for c in itertools.combinations(range(len(features)), n)]
    made: list[tuple[Feature, bool]] = []
    for combo in combos:
        own = [features[k] for k in combo]
        coords, grids = [], []
        for place, k in enumerate(combo):
            s = stats[k]
            span = s.span if s.span >= fx.TINY else 1.0
            coords.append(f"(({{{place}}} - {fx.num(s.lo)}) / {fx.num(span)})")
            grids.append([(s.quantiles[q] - s.lo) / span for q in (LEVELS.get(len(combo)) or config.field_pct_levels)])
        centres = list(itertools.product(*grids))
        distance = ["sqrt(" + " + ".join(f"pow({x} - {fx.num(c)}, 2D)" for x, c in zip(coords, centre)) + ")" for centre in centres]
        label = "+".join(f.label for f in own)
        near = distance[0] if len(distance) == 1 else f"least({', '.join(distance)})"
        made.append((derive(near, own, f"field_near({label})", "field_nearest"), False))
        for r in config.field_scales:
            inside = [f"CASE WHEN {x} <= {fx.num(r)} THEN 1D ELSE 0D END" for x in distance]
            made += [(derive(t, own, f"zone({label},c{k},r={r:g})", "field_zone", kind="numeric"), True) for k, t in enumerate(inside)]
            made.append((derive(" + ".join(inside), own, f"zcount({label},r={r:g})", "field_zcount"), True))
    spread = column_stats(df, [f for f, _ in made]) if made else []
    return [f for (f, gated), s in zip(made, spread) if (not gated or s.sd > fx.TINY) and f.family not in exclude]


def zone_adjustments(df: DataFrame, zones: Sequence[Feature], features: Sequence[Feature]) -> list[Feature]:
    """zone * feature, without constant ones."""
    out = [derive("{0} * {1}", [z, f], f"{z.label}*{f.label}", "field_adjust") for z in zones for f in features]
    return [f for f, s in zip(out, column_stats(df, out) if out else []) if s.sd >= fx.TINY]


class StructuralDedup:
    """Tells whether an expression is new; operands of commutative operations count without order."""

    def __init__(self) -> None:
        self.seen: set = set()
        self.dropped = 0

    def is_new(self, op: str, operands: Sequence[str], commutative: bool = False) -> bool:
        key = (op, frozenset(operands) if commutative else tuple(operands))
        if key in self.seen:
            self.dropped += 1
            return False
        self.seen.add(key)
        return True

    def seed_raw(self, names: Iterable[str]) -> None:
        for n in names:
            self.seen.add(("raw", (n,)))

    def report(self) -> dict[str, int]:
        return {"unique": len(self.seen), "dropped": self.dropped}
