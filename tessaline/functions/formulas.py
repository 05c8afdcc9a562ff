"""SQL templates of the feature formulas. {0}, {1} are operand columns; numbers are frozen statistics."""

from __future__ import annotations

import math

#: The constants of the formulas.
EPS = 1e-6
TINY = 1e-10
POWER_FLOOR = 1e-10
WIDTH_FLOOR = 1e-12
WINDOW_WIDTH = 0.3

def num(x: float) -> str:
    """A double literal."""
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError(f"not a finite statistic: {x}")
    return f"CAST({x!r} AS DOUBLE)" if x >= 0 else f"(-CAST({-x!r} AS DOUBLE))"


def finite(sql: str) -> str:
    return f"(CASE WHEN isnan({sql}) OR abs({sql}) = double('Infinity') THEN 0D ELSE {sql} END)"


UNARY = {
    "squared": ("{0} * {0}", "{0}^2"),
    "log": ("log1p(abs({0}))", "log|{0}|"),
    "sqrt": ("sqrt(abs({0}))", "sqrt|{0}|"),
    "cube": ("{0} * {0} * {0}", "{0}^3"),
    "tanh": ("tanh({0})", "tanh({0})"),
}


def reciprocal(sd: float) -> str:
    return f"1D / (abs({{0}}) + {num(EPS * sd)})"


def onehot(level: float) -> str:
    return f"CASE WHEN {{0}} = {num(level)} THEN 1D ELSE 0D END"


#: family: templates in both orders where the formula is not symmetric
def pair_templates(sd_a: float, sd_b: float) -> dict[str, list[tuple[str, str]]]:
    """The pairwise formulas but ratio and power: family -> (template, label)."""
    out = {
        "am_sq_diff": [("({0} - {1}) * ({0} - {1})", "({0}-{1})²")],
        "am_min": [("least({0}, {1})", "min({0},{1})")],
        "am_max": [("greatest({0}, {1})", "max({0},{1})")],
        "am_hmean": [(f"CASE WHEN abs({{0}} + {{1}}) > {num(TINY)} THEN 2D * {{0}} * {{1}} / ({{0}} + {{1}}) ELSE 0D END", "hmean({0},{1})")],
        "am_normdiff": [(f"CASE WHEN abs({{0}}) + abs({{1}}) > {num(TINY)} THEN abs({{0}} - {{1}}) / (abs({{0}}) + abs({{1}})) ELSE 0D END", "|{0}-{1}|/Σ")],
        "am_damped": [("{0} / (1D + abs({1}))", "{0}/(1+|{1}|)"), ("{1} / (1D + abs({0}))", "{1}/(1+|{0}|)")],
        "am_relu": [("greatest(0D, {0} - {1})", "relu({0}-{1})"), ("greatest(0D, {1} - {0})", "relu({1}-{0})")],
    }
    if sd_a > TINY and sd_b > TINY:
        out["am_logratio"] = [(f"ln(abs({{0}}) + {num(EPS * sd_a)}) - ln(abs({{1}}) + {num(EPS * sd_b)})", "log({0}/{1})")]
    return out


def ratio(sd_den: float) -> str:
    return f"{{0}} / (abs({{1}}) + {num(EPS * (sd_den + TINY))})"


def power(scale: float, lo: float, span: float) -> str:
    exponent = f"{num(scale)} * least(1D, greatest(0D, ({{1}} - {num(lo)}) / {num(span)}))"
    return finite(f"(signum({{0}}) * pow(abs({{0}}) + {num(POWER_FLOOR)}, {exponent}))")


def normalised(lo: float, hi: float, x: str = "{0}") -> str:
    return f"(({x} - {num(lo)}) / {num(hi - lo)})"


def triangle(phase: str) -> str:
    return f"2D * abs(2D * pmod({phase}, 1D) - 1D) - 1D"


def gauss(x: str, centre: str, width: str) -> str:
    return f"exp(-0.5D * pow(({x} - {centre}) / ({width} + {num(WIDTH_FLOOR)}), 2D))"


#: Coordinate spaces; {0} is the operand.
SPACES = {
    "linear": "{0}",
    "log": "signum({0}) * log1p(abs({0}))",
    "log2": "signum({0}) * (log1p(abs({0})) / " + num(math.log(2)) + ")",
    "log10": "signum({0}) * (log1p(abs({0})) / " + num(math.log(10)) + ")",
    "sqrt": "signum({0}) * sqrt(abs({0}))",
    "cbrt": "cbrt({0})",
    "exp": "signum({0}) * expm1(abs({0}))",
    "arcsinh": "asinh({0})",
    "logit": "ln(least(greatest({0}, 1e-6D), 0.999999D) / (1D - least(greatest({0}, 1e-6D), 0.999999D)))",
    "tanh": "tanh({0})",
}


def space(name: str) -> str:
    if name in SPACES:
        return SPACES[name]
    if name.startswith("pow:"):
        return f"signum({{0}}) * pow(abs({{0}}), {num(float(name[4:]))})"
    raise ValueError(f"unknown coordinate space: {name}")


def phase_label(scale: float) -> str:
    return "π" if math.isclose(scale, math.pi) else "×2π" if math.isclose(scale, 2 * math.pi) else f"×{scale:.4g}"


def modulation(family: str, lo, hi, mlo, mhi, sd, centre, scale, **p) -> str | None:
    """The kernel of a carrier {0} and a modulator {1}; None where the carrier has no spread."""
    c, m, ps = normalised(lo, hi), normalised(mlo, mhi, "{1}"), num(scale)
    if family == "fm_sin":
        return f"sin(({num(p['k'])} + {num(p['d'])} * {m}) * {ps} * {c})"
    if family == "pm_sin":
        return f"sin({num(p['k'])} * {ps} * {c} + {num(p['p'])} * {ps} * {m})"
    if family == "fm_tri":
        return triangle(f"(({num(p['k'])} + {num(p['d'])} * {m}) * {c})")
    if family == "fm_pulse":
        # The centre is in raw units although the carrier is normalised: observable behaviour, kept.
        return gauss(c, f"({num(centre)} + {num(p['shift'])} * ({m} - 0.5D))", num(p["w"]))
    if sd < TINY:
        return None
    if family == "wm_center":
        return gauss("{0}", f"({num(centre)} + {num(sd)} * ({m} - 0.5D))", num(WINDOW_WIDTH * sd))
    if family == "wm_width":
        return gauss("{0}", num(centre), f"greatest({num(WINDOW_WIDTH * sd)} * (1D + {num(p['wmod'])} * ({m} - 0.5D)), {num(WIDTH_FLOOR)})")
    raise ValueError(family)
