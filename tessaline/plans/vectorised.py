"""Features evaluated on NumPy columns, from the same SQL templates that Spark projects.

Statistics and selection look at thousands of candidates of a few input
columns. Their passes hand the inputs alone to the Python workers, which
evaluate the candidates there; what a pipeline returns is always projected by
Spark itself. Tests compare the two for every family.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import Feature
from .levels import Levels, below

TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)D?\b|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|\{(?P<child>\d+)\}|(?P<text>'[^']*')|(?P<op><=|>=|<>|[-+*/()<>=,]))")
#: Numbers of all nodes that a chunk of rows holds.
CHUNK_CELLS = 1 << 22

FUNCTIONS: dict[str, Callable] = {
    "abs": np.abs, "ln": np.log, "log1p": np.log1p, "sqrt": np.sqrt, "cbrt": np.cbrt, "exp": np.exp, "expm1": np.expm1, "sin": np.sin, "cos": np.cos, "tanh": np.tanh,
    "asinh": np.arcsinh, "signum": np.sign, "pow": np.power, "floor": np.floor, "isnan": np.isnan, "pmod": np.mod,
    "least": lambda *x: functools.reduce(np.minimum, x), "greatest": lambda *x: functools.reduce(np.maximum, x),
}
COMPARED = {"=": "==", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">="}


class _Reader:
    """Recursive descent over a template: Python source over children x[i] and numbers p[i]."""

    def __init__(self, template: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(template.rstrip()):
            m = TOKEN.match(template, at)
            if not m:
                raise ValueError(f"cannot read {template[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.numbers = 0, []
        self.source = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else ""

    def take(self, wanted: str = "") -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if wanted and text.upper() != wanted:
            raise ValueError(f"{wanted} expected, not {text!r}")
        self.at += 1
        return kind, text

    def chain(self, inner: Callable[[], str], words: dict[str, str]) -> str:
        out = inner()
        while (word := self.peek()) in words:
            self.take()
            out = f"({out} {words[word]} {inner()})"
        return out

    def either(self) -> str:
        return self.chain(self.both, {"OR": "|"})

    def both(self) -> str:
        return self.chain(self.compared, {"AND": "&"})

    def compared(self) -> str:
        return self.chain(self.sum, COMPARED)

    def sum(self) -> str:
        return self.chain(self.product, {"+": "+", "-": "-"})

    def product(self) -> str:
        return self.chain(self.signed, {"*": "*", "/": "/"})

    def signed(self) -> str:
        if self.peek() == "-":
            self.take()
            return f"(-{self.signed()})"
        return self.single()

    def single(self) -> str:
        kind, text = self.take()
        if kind == "number":
            self.numbers.append(float(text))
            return f"p[{len(self.numbers) - 1}]"
        if kind == "child":
            return f"x[{text}]"
        if text == "(":
            out = self.either()
            self.take(")")
            return out
        word = text.upper()
        if word == "CASE":
            cases = []
            while self.peek() == "WHEN":
                self.take()
                condition = self.either()
                self.take("THEN")
                cases.append((condition, self.either()))
            self.take("ELSE")
            out = self.either()
            self.take("END")
            for condition, value in reversed(cases):
                out = f"where({condition}, {value}, {out})"
            return out
        self.take("(")
        if word == "CAST":
            out = self.either()
            self.take("AS")
            self.take("DOUBLE")
            self.take(")")
            return out
        if word == "DOUBLE":
            self.numbers.append(float(self.take()[1].strip("'")))
            self.take(")")
            return f"p[{len(self.numbers) - 1}]"
        if text.lower() not in FUNCTIONS:
            raise ValueError(f"unknown function {text}")
        arguments = [self.either()]
        while self.peek() == ",":
            self.take()
            arguments.append(self.either())
        self.take(")")
        return f"{text.lower()}({', '.join(arguments)})"


@functools.lru_cache(maxsize=10_000)
def _compiled(source: str) -> Callable:
    return eval(f"lambda x, p: {source}", FUNCTIONS | {"where": np.where, "__builtins__": {}})


@functools.lru_cache(maxsize=200_000)
def _read(template: str) -> tuple[str, tuple[float, ...]]:
    r = _Reader(template)
    return r.source, tuple(r.numbers)


class Program:
    """The features of some list as a function of their input columns."""

    def __init__(self, features: Sequence[Feature]):
        place: dict[int, int] = {}
        self.inputs: list[str] = []
        self.nodes: list[tuple] = []

        def add(f: Feature) -> int:
            if f.key not in place:
                own = tuple(add(c) for c in f.children)
                if not f.children:
                    node = ("input", len(self.inputs))
                    self.inputs.append(f.template)
                elif isinstance(f.values, Levels):
                    node = ("levels", own, f.values.path, f.values.digest, f.values.total)
                elif f.values:
                    node = ("rank", own, np.array(f.values), np.concatenate(([0.0], np.cumsum(f.counts))) / float(np.sum(f.counts)))
                else:
                    node = ("formula", own, *_read(f.template))
                place[f.key] = len(self.nodes)
                self.nodes.append(node)
            return place[f.key]

        self.out = [add(f) for f in features]
        self.levels = [f.values for f in _every(features) if isinstance(f.values, Levels)]

    def __getstate__(self):
        return self.__dict__ | {"levels": []}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of features for rows of inputs."""
        held: list[np.ndarray] = []
        with np.errstate(all="ignore"):
            for kind, own, *more in self.nodes:
                if kind == "input":
                    held.append(x[:, own])
                elif kind == "levels":
                    path, digest, n = more
                    found = below(path, digest, held[own[0]])
                    held.append(np.where(found < 0, n, found) / n)
                elif kind == "rank":
                    edges, share = more
                    held.append(share[np.searchsorted(edges, held[own[0]], side="left")])
                else:
                    source, numbers = more
                    held.append(_compiled(source)([held[k] for k in own], numbers))
        out = np.empty((len(self.out), len(x)))  # a feature's values stay together
        for j, k in enumerate(self.out):
            out[j] = held[k]
        return out.T

    def chunks(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The features by chunks of rows."""
        step = max(32, CHUNK_CELLS // max(1, len(self.nodes) + len(self.out)))
        for at in range(0, len(x), step):
            yield slice(at, at + step), self(x[at : at + step])


def _every(features: Sequence[Feature]) -> list[Feature]:
    seen: dict[int, Feature] = {}

    def visit(f: Feature) -> None:
        if f.key not in seen:
            seen[f.key] = f
            for c in f.children:
                visit(c)

    for f in features:
        visit(f)
    return list(seen.values())


def scan(df: DataFrame, features: Sequence[Feature], *more: Column) -> tuple[DataFrame, Program]:
    """(rows with the inputs of the features as the array x, and `more`, the features as a function of x)."""
    program = Program(features)
    for levels in program.levels:
        levels.sent(df.sparkSession)
    x = [F.col(f"`{c}`").cast("double") for c in program.inputs]
    return df.select((F.array(*x) if x else F.array().cast("array<double>")).alias("x"), *more), program


def batches_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list]]:
    """(rows of x, the other columns) of batches of scan()."""
    for b in batches:
        if b.num_rows:
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width), b.columns[1:]
