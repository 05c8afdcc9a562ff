"""Pruning of near-constant and correlated candidates, on a bounded sample of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup
from .expr import Feature
from .moments import spreads
from .vectorised import Program


class Sample:
    """The numeric columns of at most `most` rows of a table, those with the least hashes of their row id (without one, of all their columns); all rows of a smaller table."""

    def __init__(self, df: DataFrame, columns: Sequence[str], row_id: Sequence[str], most: int, n_rows: int):
        self.whole = n_rows <= most
        if not self.whole:
            h = F.xxhash64(*[F.col(f"`{c}`") for c in (row_id or columns)], F.lit("dedup"))
            share = F.lit(int(min(1.0, 2 * most / n_rows) * (1 << 62)))
            df = df.withColumn("__h", F.shiftrightunsigned(h, 2)).where(F.col("__h") < share).orderBy("__h", *[F.col(f"`{c}`") for c in columns]).limit(most)
        df = df.select(*[F.col(f"`{c}`").cast("double") for c in columns])
        self.columns = {c: k for k, c in enumerate(df.columns)}
        rows = df.toArrow()
        self.rows = np.stack([rows.column(k).to_numpy().astype(np.float64) for k in range(len(self.columns))], axis=1) if rows.num_rows else np.zeros((0, len(self.columns)))

    def values(self, features: Sequence[Feature]) -> np.ndarray:
        """The features of the sample's rows."""
        program = Program(features)
        x = self.rows[:, [self.columns[c] for c in program.inputs]]
        return np.concatenate([z for _, z in program.chunks(x)]) if len(x) else np.zeros((0, len(features)))


def prune(df: DataFrame, sample: Sample, features: Sequence[Feature], least_sd: float = dedup.LEAST_SD, threshold: float | None = dedup.THRESHOLD, large: int = dedup.LARGE_POOL) -> tuple[int, list[int]]:
    """(how many features vary by more than least_sd, those of them that stay after deduplication).

    The spread is that of all rows: it is measured on them wherever the sample
    does not show one that is SURE times as large. Correlations are the sample's.
    """
    x = sample.values(features)
    sd = x.std(axis=0)
    if not sample.whole:
        unsure = np.flatnonzero(~(sd > dedup.SURE * least_sd))
        if len(unsure):
            sd[unsure] = spreads(df, [features[k] for k in unsure])[1][3]
    live = np.flatnonzero(sd > least_sd)
    if threshold and len(live):
        kept = dedup.deduplicate(x[:, live], np.array([features[k].complexity for k in live]), threshold, large=large)
        return len(live), live[kept].tolist()
    return len(live), live.tolist()
