"""Features as nodes of an expression graph, and their compilation to layered projections."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import Levels, below, levels_from_json


@dataclass(frozen=True)
class Feature:
    """A column: an SQL template over child features, with its statistics already frozen in.

    key is structural: two features of one key have the same values. A raw
    input has no children and its column name as template; a rank carries its
    reference values instead of a template, many of them as a file (Levels).
    """

    template: str
    children: tuple["Feature", ...] = ()
    label: str = field(default="", compare=False)
    family: str = field(default="raw", compare=False)
    kind: str = field(default="numeric", compare=False)
    complexity: int = field(default=0, compare=False)
    values: tuple[float, ...] | Levels = ()
    counts: tuple[float, ...] = ()

    @property
    def key(self) -> int:
        cached = self.__dict__.get("_key")
        if cached is None:
            cached = hash((self.template, tuple(c.key for c in self.children), self.values, self.counts))
            object.__setattr__(self, "_key", cached)
        return cached

    def __hash__(self) -> int:
        return self.key

    @property
    def sources(self) -> frozenset[str]:
        return frozenset([self.template]) if not self.children else frozenset().union(*(c.sources for c in self.children))

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=-1)


def raw(name: str, kind: str = "numeric") -> Feature:
    return Feature(name, (), name, "raw", kind)


def derive(template: str, children: Sequence[Feature], label: str, family: str, **more) -> Feature:
    return Feature(template, tuple(children), label, family, complexity=1 + max(c.complexity for c in children), **more)


def _mapped_rank(levels: Levels):
    path, digest, n = levels.path, levels.digest, levels.total

    @F.pandas_udf("double")
    def rank(x: pd.Series) -> pd.Series:
        found = below(path, digest, x.to_numpy())
        return pd.Series(np.where(found < 0, n, found) / n)

    return rank


def _rank(values, counts):
    edges, smaller, n = np.array(values), np.concatenate(([0.0], np.cumsum(counts))), float(np.sum(counts))

    @F.pandas_udf("double")
    def rank(x: pd.Series) -> pd.Series:
        return pd.Series(smaller[np.searchsorted(edges, x.to_numpy(), side="left")] / n)

    return rank


def with_features(df: DataFrame, features: Iterable[Feature], prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """df with a column for each feature, and their names. Only what the features need is computed.

    One projection per level of the graph, so a shared ancestor is written once
    and no expression grows with depth.
    """
    features = list(features)
    names: dict[int, str] = {}
    needed: dict[int, Feature] = {}

    def visit(f: Feature) -> None:
        if f.key not in needed:
            for c in f.children:
                visit(c)
            needed[f.key] = f

    for f in features:
        visit(f)
    levels: dict[int, list[Feature]] = {}
    for f in needed.values():
        levels.setdefault(f.depth, []).append(f)
    for level in sorted(levels):
        made: dict[str, Column] = {}
        for f in levels[level]:
            name = f"__{prefix}{len(names)}"
            if not f.children:
                made[name] = F.col(f"`{f.template}`").cast("double")
            elif isinstance(f.values, Levels):
                made[name] = _mapped_rank(f.values.sent(df.sparkSession))(F.col(names[f.children[0].key]))
            elif f.values:
                made[name] = _rank(f.values, f.counts)(F.col(names[f.children[0].key]))
            else:
                made[name] = F.expr(f.template.format(*(names[c.key] for c in f.children)))
            names[f.key] = name
        df = df.withColumns(made)
    return df, [names[f.key] for f in features]


#: Expressions over which a projection runs without whole-stage code generation: its one method would be too large to compile well.
WIDE = 40


@contextmanager
def interpreted(spark, width: int):
    """Jobs of wide projections started inside run without whole-stage code generation; the session's setting comes back."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    if width > WIDE:
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def project(df: DataFrame, features: Sequence[Feature], keep: Sequence[str] = ()) -> DataFrame:
    """keep and the features, under their labels (a label that repeats gets a number)."""
    wide, names = with_features(df, features)
    seen: dict[str, int] = {k: 1 for k in keep}
    out = []
    for f, n in zip(features, names):
        seen[f.label] = seen.get(f.label, 0) + 1
        label = f.label if seen[f.label] == 1 else f"{f.label}#{seen[f.label]}"
        out.append(F.col(n).alias(label, metadata={"family": f.family, "kind": f.kind, "sources": sorted(f.sources)}))
    return wide.select(*[F.col(f"`{k}`") for k in keep], *out)


def to_json(features: Iterable[Feature]) -> str:
    """The features and all they need, shared nodes once."""
    index: dict[int, int] = {}
    nodes: list[dict] = []

    def add(f: Feature) -> int:
        if f.key not in index:
            children = [add(c) for c in f.children]
            index[f.key] = len(nodes)
            large = isinstance(f.values, Levels)
            nodes.append({"template": f.template, "children": children, "label": f.label, "family": f.family, "kind": f.kind, "complexity": f.complexity, "values": f.values.to_json() if large else f.values, "counts": f.counts})
        return index[f.key]

    return json.dumps({"features": [add(f) for f in features], "nodes": nodes}, allow_nan=False)


def from_json(text: str) -> list[Feature]:
    spec, made = json.loads(text), []
    for n in spec["nodes"]:
        n["children"], n["values"], n["counts"] = tuple(made[k] for k in n["children"]), levels_from_json(n["values"]) if isinstance(n["values"], dict) else tuple(n["values"]), tuple(n["counts"])
        made.append(Feature(**n))
    return [made[k] for k in spec["features"]]
