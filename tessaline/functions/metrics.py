"""Metrics, splits, readouts and bootstraps as DataFrame aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.moments import Moments
from ..plans.select import r2, ridge
from ..plans.stats import running


def regression(y: str, p: str) -> list[Column]:
    """r2, mae and rmse aggregates."""
    e = F.col(y) - F.col(p)
    return [(1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")]


def classification(y: str, p: str, clip: float = 1e-15) -> list[Column]:
    """brier and log_loss aggregates of a 0/1 label and a probability."""
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return [F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("brier"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss")]


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row, auc: over the distinct scores, so ties count half. Null without rows of both labels. Scores with their counts are aggregated before the running sum."""
    per = df.groupBy(F.col(p).cast("double").alias("_p")).agg(F.sum(F.col(y).cast("double")).alias("_pos"), F.sum(1 - F.col(y).cast("double")).alias("_neg"))
    below, _ = running(per, "_p", ["_neg"])
    pairs = F.sum("_pos") * F.sum("_neg")
    return below.agg((F.sum(F.col("_pos") * (F.col("below__neg") + F.col("_neg") / 2)) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def bucket(keys: Sequence[str], seed: int, buckets: int = 1000) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(buckets))


def group_split(df: DataFrame, keys: Sequence[str], seed: int = 0, shares: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "val", "test"), alias: str = "split") -> DataFrame:
    """Whole groups go to a part by their hash: stable, and without a shuffle."""
    at, out, top = bucket(keys, seed), F.lit(names[-1]), 0.0
    edges = []
    for share, name in zip(shares[:-1], names):
        top += share
        edges.append((int(round(1000 * top)), name))
    for edge, name in reversed(edges):
        out = F.when(at < edge, name).otherwise(out)
    return df.withColumn(alias, out)


def random_split(df: DataFrame, row_id: Sequence[str], seed: int = 0, shares: Sequence[float] = (0.6, 0.2, 0.2), alias: str = "split") -> DataFrame:
    """Every row goes to train, val or test by the hash of its identity, so a lost task deals its rows as before."""
    return group_split(df, row_id, seed, shares, alias=alias)


def time_split(df: DataFrame, column: str, first: object, second: object, alias: str = "split") -> DataFrame:
    """train before `first`, val before `second`, test from there on."""
    return df.withColumn(alias, F.when(F.col(column) < F.lit(first), "train").when(F.col(column) < F.lit(second), "val").otherwise("test"))


def ridge_readout(train: Moments, val: Moments, d: int, alphas: Sequence[float] = tuple(np.logspace(-6, 6, 15))) -> tuple[float, np.ndarray, float]:
    """(alpha, weights, intercept) with the best validation R², in closed form from moments."""
    best = max(alphas, key=lambda a: r2(train, val, range(d), d, a))
    u = ridge(train, list(range(d)), d, best)
    return best, u, float(train.mean[d] - train.mean[:d] @ u)


def logistic_readout(df: DataFrame, inputs: Sequence[str], y: str, c: float = 0.5):
    """A function that adds a probability column to a table, fitted on the rows of df without nulls.

    Inputs are standardised (a constant one gives zeros); the penalty is half
    the squared weights against c times the summed log-loss, without the intercept.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = df.dropna(subset=[*inputs, y])
    row = known.agg(F.count("*").alias("n"), *[f(F.col(x).cast("double")).alias(f"{k}{i}") for i, x in enumerate(inputs) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row.n:
        raise ValueError("no rows without nulls to fit")
    scaled = {f"__x{i}": (F.col(x).cast("double") - row[f"m{i}"]) / (row[f"s{i}"] or 1.0) for i, x in enumerate(inputs)}
    together = VectorAssembler(inputCols=list(scaled), outputCol="__v")
    learner = LogisticRegression(featuresCol="__v", labelCol="__y", predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r", family="binomial", regParam=1 / (c * row.n), standardization=False, maxIter=2000, tol=1e-8)
    model = learner.fit(together.transform(known.withColumns(scaled).withColumn("__y", F.col(y).cast("double"))))

    def probability(rows: DataFrame, alias: str = "probability") -> DataFrame:
        """Null where an input is null."""
        found = model.transform(together.setHandleInvalid("keep").transform(rows.withColumns(scaled)))
        q = vector_to_array("__q")[1]
        return found.select(*rows.columns, F.when(F.isnan(q), None).otherwise(q).alias(alias))

    return probability


def out_of_fold(df: DataFrame, inputs: Sequence[str], y: str, group: str, folds: int = 5, c: float = 0.5, seed: int = 0, alias: str = "probability") -> DataFrame:
    """df with the probability that a logistic readout of the other folds gives each row; groups are whole in a fold, by hash."""
    fold, out = bucket([group], seed, folds), None
    for k in range(folds):
        held = df.where(fold == k)
        if not held.isEmpty():
            part = logistic_readout(df.where(fold != k), inputs, y, c)(held, alias)
            out = part if out is None else out.unionByName(part)
    return df.withColumn(alias, F.lit(None).cast("double")) if out is None else out


def matched_label(state: DataFrame, other: DataFrame, keys: Sequence[str], won: str, alias: str = "label") -> DataFrame:
    """The rows of state that have a match in other by keys (each at most once there), labelled 1.0 where the match won and they did not, else 0.0.

    A null outcome of either counts as not won.
    """
    is_won = F.coalesce(F.col(won).cast("double"), F.lit(0.0))
    matches = other.select(*keys, is_won.alias("__won"))
    joined = state.join(matches, list(keys))
    return joined.select(*[F.col(c) for c in state.columns], (F.col("__won") > is_won).cast("double").alias(alias))


def paired_bootstrap(df: DataFrame, pair: str, treated: Column, control: Column, draws: int = 4000, seed: int = 0) -> tuple[float, float, float]:
    """(mean, 2.5 %, 97.5 %) of the effect treated - control when whole pairs (a row each) are drawn again."""
    return grouped_bootstrap(df, pair, treated, control, draws, seed)


def grouped_bootstrap(df: DataFrame, group: str, loss_a: Column, loss_b: Column, draws: int = 1000, seed: int = 0) -> tuple[float, float, float]:
    """(mean, 2.5 %, 97.5 %) of the mean difference of two losses when whole groups are drawn again.

    Groups weigh by Poisson counts made of their own hash, so the draws are
    summed on the executors and only one row per draw comes back.
    """
    sums = df.groupBy(group).agg(F.sum(loss_a - loss_b).alias("_d"), F.count("*").alias("_n"))
    u = lambda k: (F.pmod(F.xxhash64(F.col(group), k, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 8)]))
    weighted = sums.select("_d", "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_k"), F.col(group))
    weight = sum((F.when(u(F.col("_k")) > F.lit(float(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    rows = weighted.withColumn("_w", weight).groupBy("_k").agg((F.sum(F.col("_d") * F.col("_w")) / F.nullif(F.sum(F.col("_n") * F.col("_w")), F.lit(0))).alias("m")).collect()
    values = np.array([r.m for r in rows if r.m is not None])
    mean = sums.agg(F.sum("_d") / F.sum("_n")).first()[0]
    return float(mean), float(np.quantile(values, 0.025)), float(np.quantile(values, 0.975))


def cyclical(column: str, period: float, harmonics: int = 2) -> list[Column]:
    """Sine and cosine of a calendar column at its true period."""
    phase = 2 * np.pi * F.col(column).cast("double") / F.lit(float(period))
    return [f(phase * h).alias(f"{n}{h}({column})") for h in range(1, harmonics + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]


def consensus(spark, selections: Sequence[Sequence], by: str = "label") -> DataFrame:
    """In how many selections each expression (by label) or each source column (by sources) occurs."""
    rows = [(k, x) for k, s in enumerate(selections) for x in {v for f in s for v in ([f.label] if by == "label" else f.sources)}]
    return spark.createDataFrame(rows, "fold int, item string").groupBy("item").agg(F.count_distinct("fold").alias("n_folds"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
