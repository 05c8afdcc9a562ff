"""Statistics of columns: one aggregation for all of a stage's inputs."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .expr import Feature, raw, with_features
from .levels import Levels, collect_levels
from .moments import spreads
from .order import distinct_up_to, percentiles, value_parts

#: Distinct values up to which a column is boolean, and over which it is numeric.
BOOL_LEVELS, NUMERIC_LEVELS = 2, 20
#: Fixed values of warn_rank_features: fewest rows, least share of distinct values, least mean gap, greatest variation of gaps.
LEAST_RANKED, DISTINCT_SHARE, TINY_GAP, EVEN = 30, 0.90, 1e-12, 0.05
#: Most distinct reference values that a rank feature carries in the plan (16 bytes each); more go to the executors as a file, with the same ranks.
RANK_LEVELS = 10_000


@dataclass
class Stats:
    lo: float
    hi: float
    sd: float
    mean: float
    quantiles: dict[float, float]

    @property
    def span(self) -> float:
        return self.hi - self.lo


def column_stats(df: DataFrame, features: Sequence[Feature], levels: Sequence[float] = ()) -> list[Stats]:
    """Min, max, population sd, mean and linear-interpolated percentiles (levels in percent) of each feature."""
    if not features:
        return []
    n, (low, high, mean, sd) = spreads(df, features)
    if not n:
        raise ValueError("no rows to take statistics from")
    levels = sorted(set(levels))
    found = percentiles(df, features, levels, n, list(zip(low, high))) if levels else [{}] * len(features)
    return [Stats(float(low[k]), float(high[k]), float(sd[k]), float(mean[k]), found[k]) for k in range(len(features))]


def check_finite(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if an input is null, NaN or infinite."""
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) | (F.abs(F.col(f"`{c}`").cast("double")) == float("inf"))) for c in columns]).first()
    wrong = [c for c, n in zip(columns, bad) if n]
    if wrong:
        raise ValueError(f"null or non-finite values in {wrong}: handle missing values first")


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """bool up to 2 distinct values, numeric over 20; those between take the majority type of the others."""
    if not columns:
        return {}
    counts = distinct_up_to(df, [raw(c) for c in columns], NUMERIC_LEVELS)
    out = {c: "bool" if n <= BOOL_LEVELS else "numeric" if n > NUMERIC_LEVELS else "" for c, n in zip(columns, counts)}
    clear = [t for t in out.values() if t]
    majority = min(sorted(set(clear)), key=lambda t: -clear.count(t)) if clear else "numeric"
    unclear = [c for c, t in out.items() if not t]
    if unclear:
        warnings.warn(f"ambiguous columns taken as {majority}: {unclear[:10]}", stacklevel=2)
    return {c: t or majority for c, t in out.items()}


def distinct_counts(df: DataFrame, feature: Feature) -> tuple[tuple[float, ...] | Levels, tuple[float, ...]]:
    """The distinct values in order and how often each occurs; over RANK_LEVELS of them as Levels, which hold both."""
    wide, (name,) = with_features(df, [feature])
    counts = wide.groupBy(name).count()
    rows = counts.select(F.col(name).cast("double"), F.col("count").cast("double")).limit(RANK_LEVELS + 1).toArrow()
    if rows.num_rows > RANK_LEVELS:
        return collect_levels(counts), ()
    x, n = (rows.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(x)
    return tuple(x[order].tolist()), tuple(n[order].tolist())


def running(per: DataFrame, value: str, weights: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """per (each value once) with, for each weight, the column below_<weight>: its sum over smaller values; and the totals.

    The values are cut into ranges whose sums come to the driver; a running sum
    stays within a range. A value's range follows from the value alone, so the
    offsets hold in whatever way and however often the plan runs.
    """
    parted = per.withColumn("__part", value_parts(per, value))
    sums = parted.groupBy("__part").agg(*[F.sum(w).cast("double") for w in weights]).collect()
    before, run = {}, [0.0] * len(weights)
    for part, *own in sorted(tuple(r) for r in sums):
        before[part] = list(run)
        run = [a + (b or 0.0) for a, b in zip(run, own)]
    inside = W.partitionBy("__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    for k, w in enumerate(weights):
        offset = F.element_at(F.create_map(*[F.lit(x) for part, own in before.items() for x in (part, own[k])]), F.col("__part")) if before else F.lit(0.0)
        parted = parted.withColumn(f"below_{w}", offset + F.coalesce(F.sum(w).over(inside).cast("double"), F.lit(0.0)))
    return parted.drop("__part"), dict(zip(weights, run))


def empirical_rank(df: DataFrame, reference: DataFrame, column: str, alias: str) -> DataFrame:
    """df with the share of reference values below its own; a value that the reference lacks gives null."""
    per = reference.select(F.col(column).cast("double").alias("__x")).groupBy("__x").agg(F.count("*").alias("__n"))
    below, total = running(per, "__x", ["__n"])
    return df.join(below.select("__x", "below___n"), F.col(column).cast("double") == F.col("__x"), "left").withColumn(alias, F.col("below___n") / F.lit(total["__n"] or 1.0)).drop("__x", "below___n")


def warn_rank_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that look like ranks or percentiles, with a warning: nearly all values distinct and evenly spaced. They leak if they were made on training and test rows together."""
    n, suspect = df.count(), []
    for c in columns if n >= LEAST_RANKED else ():
        x = df.select(F.col(f"`{c}`").cast("double").alias("__x")).groupBy("__x").count()
        x = x.withColumn("__part", value_parts(x, "__x"))
        gap = F.col("__x") - F.lag("__x").over(W.partitionBy("__part").orderBy("__x"))
        rows = sorted(tuple(r) for r in x.withColumn("__g", gap).groupBy("__part").agg(F.min("__x"), F.max("__x"), F.sum(F.col("__g") * F.col("__g")), F.count("*")).collect())
        unique = sum(r[4] for r in rows)
        mean = (rows[-1][2] - rows[0][1]) / (n - 1)
        if unique < DISTINCT_SHARE * n or mean < TINY_GAP:
            continue
        squares = sum(r[3] or 0.0 for r in rows) + sum((b[1] - a[2]) ** 2 for a, b in zip(rows[:-1], rows[1:]))
        if max(squares / (n - 1) - mean * mean, 0.0) ** 0.5 / mean < EVEN:
            suspect.append(c)
    if suspect:
        warnings.warn(f"columns look like ranks or percentiles, which leak if made on training and test rows together: {suspect[:10]}", UserWarning, stacklevel=2)
    return suspect
