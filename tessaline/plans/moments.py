"""Means and cross products of feature columns, as far as selection asks for them.

Moments is the dense form for few columns. Sums is the form for many: one pass
gives counts, means, spreads and cross products with the targets; the cross
products of single columns with all others come in further passes, some columns
at a time, when a selection gets to them. No task holds more than CELLS numbers
a group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import Feature
from .vectorised import Program, batches_of, scan

#: Tasks that merge partial sums.
MERGE_TASKS = 8
#: Numbers that a task collects for a group in one pass (8 MB), and most columns of the dense form (32 MB).
CELLS = 1 << 20
MOST_DENSE = 2048
#: Numbers that a task holds of the groups of group-aware selection before it passes them on.
GROUP_CELLS = 1 << 22


@dataclass
class Moments:
    """n rows, the mean of each column, and the matrix of centred cross products."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return other if not self.n else self
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))

    def take(self, columns) -> "Moments":
        columns = np.asarray(columns, int)
        return Moments(self.n, self.mean[columns], self.scatter[np.ix_(columns, columns)])

    @property
    def diag(self) -> np.ndarray:
        return np.diag(self.scatter)

    def rows(self, columns: Sequence[int]) -> np.ndarray:
        """The cross products of some columns with all."""
        return self.scatter[list(columns)]

    def ready(self, columns: Sequence[int], ranking: np.ndarray | None = None) -> None:
        """Nothing to fetch."""

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.diag, 0) / max(self.n, 1))

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.maximum(self.diag, 0))
        s[s < 1e-150] = np.inf
        return np.clip(self.scatter / np.outer(s, s), -1, 1)


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    c = x - mean
    return Moments(float(len(x)), mean, c.T @ c)


def _wide(df: DataFrame, features: Sequence[Feature], targets: Sequence[Column], group: Column | None, kind: str) -> tuple[DataFrame, Program]:
    """Rows of the features' inputs x, the targets y and the group g; and the features as a function of x."""
    return scan(df, features, F.array(*[t.cast("double") for t in targets]).alias("y"), (group if group is not None else F.lit(0)).cast(kind).alias("g"))


def _rows(batches: Iterator[pa.RecordBatch], program: Program, d: int):
    """(groups, features and targets, a line for each), by chunks of rows."""
    for x, (y, g) in batches_of(batches, len(program.inputs)):
        t = d - len(program.out)
        y = y.flatten().to_numpy(zero_copy_only=False).reshape(len(x), t)
        for rows, z in program.chunks(x):
            yield g.slice(rows.start, len(z)), np.concatenate((z.T, y[rows].T))


def _grouped(batches: Iterator[pa.RecordBatch], program: Program, d: int):
    """(group, features and targets of its rows, a line for each) of each chunk; groups are whole numbers."""
    for g, z in _rows(batches, program, d):
        g = g.to_numpy(zero_copy_only=False)
        for k in np.unique(g):
            yield int(k), z if (g == k).all() else z[:, g == k]


def _blobs(names: Sequence[str], rows) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in c], pa.binary() if isinstance(c[0], np.ndarray) else pa.string() if isinstance(c[0], str) else pa.int32() if isinstance(c[0], int) else pa.float64()) for c in columns], names=names)


def _sum_blobs(names: Sequence[str]):
    """Sums the last column, arrays of doubles, over rows whose other columns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, x in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(x)
                held[tuple(key)] = held[tuple(key)] + own if tuple(key) in held else own
        if held:
            yield _blobs(names, [(*k, v) for k, v in sorted(held.items())])

    return run


class Part:
    """The moments of one group of rows: n, mean, diag and rows(), which has to be made ready first."""

    def __init__(self, source: "Sums", n: float, mean: np.ndarray, diag: np.ndarray, cross: np.ndarray):
        self.source, self.n, self.mean, self.diag = source, n, mean, diag
        first = len(mean) - cross.shape[1]
        self.known: dict[int, np.ndarray] = {first + k: cross[:, k] for k in range(cross.shape[1])}

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.diag, 0) / max(self.n, 1))

    def ready(self, columns: Sequence[int], ranking: np.ndarray | None = None) -> None:
        self.source.fetch(columns, ranking)

    def rows(self, columns: Sequence[int]) -> np.ndarray:
        self.ready(columns)
        return np.stack([self.known[int(c)] for c in columns]) if len(columns) else np.zeros((0, len(self.mean)))


class Joined:
    """The moments of several parts as one."""

    def __init__(self, parts: Sequence):
        self.parts = [p for p in parts if p.n]
        self.n = sum(p.n for p in self.parts)
        first = (self.parts or list(parts))[0]
        self.mean = sum((p.mean * (p.n / self.n) for p in self.parts), np.zeros(len(first.mean)))
        self.diag = sum((p.diag + p.n * (p.mean - self.mean) ** 2 for p in self.parts), np.zeros(len(first.mean)))

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.diag, 0) / max(self.n, 1))

    def ready(self, columns: Sequence[int], ranking: np.ndarray | None = None) -> None:
        for p in self.parts[:1]:
            p.ready(columns, ranking)

    def rows(self, columns: Sequence[int]) -> np.ndarray:
        columns = list(columns)
        out = np.zeros((len(columns), len(self.mean)))
        for p in self.parts:
            d = p.mean - self.mean
            out += p.rows(columns) + p.n * np.outer(d[columns], d)
        return out


class Sums:
    """The moments of features followed by targets, for each value of a group column (whole numbers; 0 without one).

    parts: group -> Part. fetch() adds the cross products of columns to all of them.
    """

    def __init__(self, df: DataFrame, features: Sequence[Feature], targets: Sequence[Column], group: Column | None = None):
        self.df, self.features, self.targets, self.group = df, list(features), list(targets), group
        self.d, self.t = len(self.features) + len(self.targets), len(self.targets)
        self.passes = 0
        self.parts = self._first()
        whole = Joined(list(self.parts.values()))
        self.mean = whole.mean

    def _run(self, df: DataFrame, ddl: str, merge, deal: Sequence[str], tasks: int = MERGE_TASKS) -> list:
        self.passes += 1
        return df.repartition(tasks, *deal).mapInArrow(merge, ddl).collect()

    def _first(self) -> dict[int, Part]:
        d, t, names = self.d, self.t, ["g", "n", "mean", "diag", "cross"]

        def join(a: tuple, b: tuple) -> tuple:
            n, delta = a[0] + b[0], b[1] - a[1]
            w = a[0] * b[0] / n
            return n, a[1] + delta * (b[0] / n), a[2] + b[2] + delta * delta * w, a[3] + b[3] + np.outer(delta, delta[d - t :]) * w

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for g, z in _grouped(batches, program, d):
                mean = z.mean(axis=1)
                c = z - mean[:, None]
                own = float(z.shape[1]), mean, np.einsum("dn,dn->d", c, c), c @ c[d - t :].T
                held[g] = join(held[g], own) if g in held else own
            if held:
                yield _blobs(names, [(k, *v) for k, v in sorted(held.items())])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for b in batches:
                for g, n, *arrays in zip(*(c.to_pylist() for c in b.columns)):
                    own = n, *(np.frombuffer(x) for x in arrays[:2]), np.frombuffer(arrays[2]).reshape(d, t)
                    held[g] = join(held[g], own) if g in held else own
            if held:
                yield _blobs(names, [(k, *v) for k, v in sorted(held.items())])

        ddl = "g int, n double, mean binary, diag binary, cross binary"
        rows, program = _wide(self.df, self.features, self.targets, self.group, "int")
        parts = rows.mapInArrow(fold, ddl)
        held: dict[int, tuple] = {}
        for g, n, mean, diag, cross in sorted(self._run(parts, ddl, merge, ()), key=lambda r: (r[0], r[1], bytes(r[2]))):
            own = n, np.frombuffer(bytes(mean)), np.frombuffer(bytes(diag)), np.frombuffer(bytes(cross)).reshape(d, t)
            held[g] = join(held[g], own) if g in held else own
        zero = np.zeros(d)
        return {g: Part(self, *v) for g, v in sorted((held or {0: (0.0, zero, zero, np.zeros((d, t)))}).items())}

    def fetch(self, columns: Sequence[int], ranking: np.ndarray | None = None) -> None:
        """Cross products of these columns with all; where a pass is needed at all, of the best of the ranking too, as many as CELLS allow."""
        known = next(iter(self.parts.values())).known
        wanted = [int(c) for c in columns if int(c) not in known]
        if not wanted:
            return
        room = max(16, CELLS // self.d)
        if ranking is not None:
            for c in np.argsort(-ranking, kind="stable").tolist():
                if len(wanted) >= room:
                    break
                if c not in known and c not in wanted and np.isfinite(ranking[c]):
                    wanted.append(c)
        elif self.d <= room:
            wanted = [c for c in range(self.d) if c not in known]
        for at in range(0, len(wanted), room):
            self._fetch(wanted[at : at + room])

    def _fetch(self, wanted: list[int]) -> None:
        d, mean, names = self.d, self.mean, ["g", "block", "sums"]
        block = max(1, (1 << 17) // d)  # columns that go to a merging task together

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for g, z in _grouped(batches, program, d):
                c = z - mean[:, None]
                own = c[wanted] @ c.T
                held[g] = held[g] + own if g in held else own
            for g, sums in sorted(held.items()):
                yield _blobs(names, [(g, at // block, sums[at : at + block].ravel()) for at in range(0, len(wanted), block)])

        ddl = "g int, block int, sums binary"
        rows, program = _wide(self.df, self.features, self.targets, self.group, "int")
        parts = rows.mapInArrow(fold, ddl)
        for g, k, sums in self._run(parts, ddl, _sum_blobs(names), ("g", "block")):
            part, sums = self.parts[g], np.frombuffer(bytes(sums)).reshape(-1, d)
            off = part.mean - mean
            for j, c in enumerate(wanted[k * block : (k + 1) * block]):
                part.known[c] = sums[j] - part.n * off[c] * off
        for part in self.parts.values():
            for c in wanted:
                part.known.setdefault(c, np.zeros(d))

    def within(self, by: Column, active: Sequence[int], c: np.ndarray, least: int = 10) -> np.ndarray | None:
        """The mean, over the groups of `by` with that many rows, of each feature's |correlation| with the residual of the fit; None without such a group."""
        d, t, own, mean = self.d, self.d - self.t, list(active), self.mean

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for g, z in _rows(batches, program, d):
                x = z - mean[:, None]
                r = x[t] - c @ x[own]
                codes = g.dictionary_encode()
                at, keys = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    f, s = x[:t, part], r[part]
                    sums = np.concatenate(([len(part), s.sum(), s @ s], f.sum(axis=1), np.einsum("dn,dn->d", f, f), f @ s))
                    key = keys[at[part[0]]]
                    held[key] = held[key] + sums if key in held else sums
                if len(held) * 3 * d > GROUP_CELLS:
                    yield _blobs(["g", "sums"], list(held.items()))
                    held = {}
            if held:
                yield _blobs(["g", "sums"], list(held.items()))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for b in batches:
                for g, sums in zip(*(x.to_pylist() for x in b.columns)):
                    held[g] = held[g] + np.frombuffer(sums) if g in held else np.frombuffer(sums)
            n, total = 0, np.zeros(t)
            for sums in held.values():
                m, s, ss, f, ff, sf = sums[0], sums[1], sums[2], sums[3 : 3 + t], sums[3 + t : 3 + 2 * t], sums[3 + 2 * t :]
                v = ss - s * s / m
                if m >= least and v > 1e-20 * m:
                    scale = np.sqrt(np.maximum(ff - f * f / m, 0) * v)
                    total += np.abs(sf - s * f / m) / np.where(scale > 0, scale, np.inf)
                    n += 1
            yield _blobs(["n", "total"], [(float(n), total)])

        wide, program = _wide(self.df, self.features, self.targets, F.coalesce(by.cast("string"), F.lit("")), "string")
        parts = wide.mapInArrow(fold, "g string, sums binary")
        tasks = max(MERGE_TASKS, int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = self._run(parts, "n double, total binary", finish, ("g",), tasks)
        n = sum(r[0] for r in rows)
        return sum(np.frombuffer(bytes(r[1])) for r in rows) / n if n else None


def spreads(df: DataFrame, features: Sequence[Feature]) -> tuple[int, np.ndarray]:
    """(rows, and per feature the least, greatest, mean value and population standard deviation) in one pass."""
    d = len(features)
    rows, program = scan(df, features)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        delta, w = b[3] - a[3], a[0] * b[0] / n
        return np.stack((n, np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), a[3] + delta * (b[0] / n), a[4] + b[4] + delta * delta * w))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x, _ in batches_of(batches, len(program.inputs)):
            for _, z in program.chunks(x):
                z = z.T
                mean = z.mean(axis=1)
                c = z - mean[:, None]
                own = np.stack((np.full(d, float(z.shape[1])), z.min(axis=1), z.max(axis=1), mean, np.einsum("dn,dn->d", c, c)))
                held = own if held is None else join(held, own)
        if held is not None:
            yield _blobs(["sums"], [(held,)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for sums in b.column(0).to_pylist():
                own = np.frombuffer(sums).reshape(5, d)
                held = own if held is None else join(held, own)
        if held is not None:
            yield _blobs(["sums"], [(held,)])

    found = [np.frombuffer(bytes(r[0])).reshape(5, d) for r in rows.mapInArrow(fold, "sums binary").repartition(MERGE_TASKS).mapInArrow(merge, "sums binary").collect()]
    if not found:
        return 0, np.zeros((4, d))
    held = found[0]
    for own in sorted(found[1:], key=lambda x: x.tobytes()):
        held = join(held, own)
    return int(held[0, 0]), np.stack((held[1], held[2], held[3], np.sqrt(np.maximum(held[4], 0) / held[0])))


def collect_moments(df: DataFrame, features: Sequence[Feature], targets: Sequence[Column], group: Column | None = None) -> dict[int, Moments]:
    """For each value of group (0 without one): the dense moments of the features followed by the targets, which may be MOST_DENSE columns."""
    d = len(features) + len(targets)
    if d > MOST_DENSE:
        raise ValueError(f"{d} columns: the dense form takes at most {MOST_DENSE}")
    sums = Sums(df, features, targets, group)
    sums.fetch(range(d))
    return {g: Moments(p.n, p.mean, p.rows(range(d))) for g, p in sums.parts.items()}
