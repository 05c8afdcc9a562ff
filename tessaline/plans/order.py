"""Exact order statistics of many columns at once, by radix selection.

A rank is narrowed down by histograms of the order-preserving bits of the
values: a pass over the rows counts the buckets of every band that still holds
a wanted rank, and the next pass looks into the bucket with the rank only. What
a task holds is a fixed number of counters, nothing is sorted or shuffled but
counters, and the result does not depend on how the rows are dealt out. Equal
values are told apart by further key columns, each 64 bits, in the same way.
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

TOP = np.uint64(1 << 63)
#: Counters of a task over all bands, and rows of all bands that come to the driver as they are.
COUNTERS = 1 << 20
ROWS = 1 << 18
SLOT = 1 << 16
Key = tuple[int, ...]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | TOP)


def from_bits(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def tie_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """64-bit numbers that order rows as their columns do; a string column gives a hash instead."""
    out = []
    for n in names:
        kind, c = dict(df.dtypes)[n], F.col(f"`{n}`")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            out.append(c.cast("long"))
        elif kind.startswith("timestamp"):
            out.append(F.unix_micros(c.cast("timestamp")))
        elif kind == "date":
            out.append(F.unix_date(c).cast("long"))
        else:
            out.append(F.xxhash64(c))
    return out


@dataclass
class Band:
    """Rows of a column whose first keys are `fixed` and whose next one is in [base, base + 2^width); `below` rows of the column come before."""

    column: int
    fixed: Key
    base: int
    width: int
    below: int
    ranks: list[int]
    whole: bool = False  # its rows come to the driver


def _keys(z: np.ndarray, t: np.ndarray, column: int) -> list[np.ndarray]:
    return [ordered_bits(z[:, column]), *(t[:, k].view(np.uint64) ^ TOP for k in range(t.shape[1]))]


def _batches(batches: Iterator[pa.RecordBatch], program: Program, m: int):
    """(values, ties, other columns) of batches with the columns x (inputs), t (m ties) and others."""
    for x, (t, *more) in batches_of(batches, len(program.inputs)):
        t = t.flatten().to_numpy(zero_copy_only=False).reshape(len(x), m) if m else np.zeros((len(x), 0), np.int64)
        more = [c.to_numpy(zero_copy_only=False) for c in more]
        for rows, z in program.chunks(x):
            yield z, t[rows], [c[rows] for c in more]


def _count(bands: list[Band], shift: list[int], start: list[int], program: Program, m: int):
    """A function over batches: rows (slot, places, counts) of the bands' buckets, and (-1, band, keys) of the rows of whole ones."""
    groups: dict[tuple[int, Key], list[int]] = {}
    for i, b in enumerate(bands):
        groups.setdefault((b.column, b.fixed), []).append(i)
    for own in groups.values():
        own.sort(key=lambda i: bands[i].base)
    total = start[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(total, np.int64), []
        for z, t, _ in _batches(batches, program, m):
            keys, last = [], -1
            for (column, fixed), own in sorted(groups.items()):
                if column != last:
                    keys, last = _keys(z, t, column), column
                live = np.ones(len(z), bool)
                for key, value in zip(keys, fixed):
                    live &= key == np.uint64(value)
                live = np.flatnonzero(live)
                key = keys[len(fixed)][live]
                base = np.array([bands[i].base for i in own], np.uint64)
                size = np.array([(1 << bands[i].width) - 1 for i in own], np.uint64)
                at = np.searchsorted(base, key, side="right") - 1
                off = key - base[np.maximum(at, 0)]
                ok = (at >= 0) & (off <= size[np.maximum(at, 0)])
                at, off, live = at[ok], off[ok], live[ok]
                whole = np.array([bands[i].whole for i in own])[at]
                place = np.array([start[i] for i in own])[at] + (off >> np.array([shift[i] for i in own], np.uint64)[at]).astype(np.int64)
                counts += np.bincount(place[~whole], minlength=total)
                if whole.any():
                    rows.append((np.array(own)[at[whole]], np.stack([x[live[whole]] for x in keys], axis=1)))
        found = np.flatnonzero(counts)
        out = [(int(s), found[found // SLOT == s], counts[found[found // SLOT == s]]) for s in np.unique(found // SLOT)]
        out += [(-1, band, key.ravel().view(np.int64)) for band, key in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1].astype(np.int64).tobytes() for o in out], pa.binary()), pa.array([o[2].tobytes() for o in out], pa.binary())], names=["slot", "place", "value"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counters of a slot; rows of slot -1 pass."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for slot, place, value in zip(*(c.to_pylist() for c in b.columns)):
            if slot < 0:
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([place], pa.binary()), pa.array([value], pa.binary())], names=["slot", "place", "value"])
            else:
                own = held.setdefault(slot, np.zeros(SLOT, np.int64))
                own[np.frombuffer(place, np.int64) - slot * SLOT] += np.frombuffer(value, np.int64)
    for slot, own in sorted(held.items()):
        found = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([(found + slot * SLOT).tobytes()], pa.binary()), pa.array([own[found].tobytes()], pa.binary())], names=["slot", "place", "value"])


PART = "slot int, place binary, value binary"


def _picked(df: DataFrame, values: Sequence[Feature], ties: Sequence[Column], *more: Column) -> tuple[DataFrame, Program]:
    return scan(df, values, (F.array(*ties) if ties else F.array().cast("array<bigint>")).alias("t"), *more)


def select_ranks(df: DataFrame, values: Sequence[Feature], ranks: Sequence[Sequence[int]], ties: Sequence[Column] = (), bounds: Sequence[tuple[float, float]] | None = None) -> list[dict[int, Key]]:
    """For each feature the keys (bits of the value, then of the ties) of the rows at its ranks (from 0).

    bounds: the least and greatest value of each column, where known: saves a pass.
    """
    k, m = len(values), len(ties)
    picked, program = _picked(df, values, ties)
    done: list[dict[int, Key]] = [{} for _ in values]
    bands = []
    for c in range(k):
        low, width = 0, 64
        if bounds is not None:
            low, high = (int(ordered_bits(np.array([x]))[0]) for x in bounds[c])
            width = (high - low).bit_length()
        if len(ranks[c]):
            bands.append(Band(c, (), low, width, 0, sorted(set(ranks[c]))))
    while bands:
        bits = int(np.clip(np.log2(COUNTERS / len(bands)), 2, 12))
        shift = [max(0, b.width - bits) for b in bands]
        size = [0 if b.whole else 1 << (b.width - s) for b, s in zip(bands, shift)]
        start = [0, *np.cumsum(size).tolist()]
        parts = picked.mapInArrow(_count(bands, shift, start, program, m), PART)
        found = parts.repartition(1 + start[-1] // SLOT, "slot").mapInArrow(_add, PART).collect()
        counts, rows = np.zeros(start[-1], np.int64), {}
        for slot, place, value in found:
            place, value = np.frombuffer(bytes(place), np.int64), np.frombuffer(bytes(value), np.int64)
            if slot >= 0:
                counts[place] = value
            else:
                for band in np.unique(place):
                    rows.setdefault(int(band), []).append(value.view(np.uint64).reshape(-1, m + 1)[place == band])
        few, new = max(8, ROWS // max(1, sum(len(b.ranks) for b in bands))), []
        for i, b in enumerate(bands):
            if b.whole:
                key = np.concatenate(rows[i])
                key = key[np.lexsort(key.T[::-1])]
                for r in b.ranks:
                    done[b.column][r] = tuple(int(x) for x in key[r - b.below])
                continue
            after = np.cumsum(counts[start[i] : start[i + 1]])
            at = np.searchsorted(after, np.array(b.ranks) - b.below, side="right")
            for bucket in np.unique(at).tolist():
                own = [r for r, a in zip(b.ranks, at) if a == bucket]
                below = b.below + (int(after[bucket - 1]) if bucket else 0)
                n, base = b.below + int(after[bucket]) - below, b.base + (bucket << shift[i])
                if not shift[i] and len(b.fixed) == m:
                    done[b.column].update(dict.fromkeys(own, (*b.fixed, base)))
                elif n <= few:
                    new.append(Band(b.column, b.fixed, base, shift[i], below, own, True))
                elif not shift[i]:
                    new.append(Band(b.column, (*b.fixed, base), 0, 64, below, own))
                else:
                    new.append(Band(b.column, b.fixed, base, shift[i], below, own))
        bands = new
    return done


def percentiles(df: DataFrame, values: Sequence[Feature], levels: Sequence[float], n: int, bounds: Sequence[tuple[float, float]] | None = None) -> list[dict[float, float]]:
    """Linear-interpolated percentiles (levels in percent) of each feature over n rows without nulls."""
    places = {q: (n - 1) * q / 100 for q in levels}
    ranks = sorted({r for p in places.values() for r in (int(np.floor(p)), int(np.ceil(p)))})
    out = []
    for found in select_ranks(df, values, [ranks] * len(values), (), bounds):
        at = {r: from_bits(key[0]) for r, key in found.items()}
        out.append({q: float(at[int(np.floor(p))] + (at[int(np.ceil(p))] - at[int(np.floor(p))]) * (p - np.floor(p))) for q, p in places.items()})
    return out


def at_or_below(edges: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many edges are at or below each row; edges in order, both as one array per key."""
    out = np.searchsorted(edges[0], keys[0], side="right")
    if len(edges) > 1:
        tied = np.flatnonzero(np.searchsorted(edges[0], keys[0], side="left") < out)
        if len(tied):
            n = len(edges[0])
            both = [np.concatenate((e, k[tied])) for e, k in zip(edges, keys)]
            flag = np.arange(n + len(tied)) >= n
            order = np.lexsort((flag, *both[::-1]))
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(~flag[order])
            out[tied] = before[n:]
    return out


def bin_means(df: DataFrame, values: Sequence[Feature], ties: Sequence[Column], target: Column, edges: Sequence[Sequence[Key]]) -> list[np.ndarray]:
    """For each feature the mean of the target in the bins that start at its edges (the rows at them belong to the bin)."""
    k, m, width = len(values), len(ties), max(map(len, edges))
    own = [[np.array([e[i] for e in column], np.uint64) for i in range(m + 1)] for column in edges]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((k, width + 1)), np.zeros((k, width + 1))
        for z, t, (y,) in _batches(batches, program, m):
            for c in range(k):
                at = at_or_below(own[c], _keys(z, t, c))
                n[c] += np.bincount(at, minlength=width + 1)
                total[c] += np.bincount(at, weights=y, minlength=width + 1)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(k * (width + 1)) for _ in range(2)]
        for b in batches:
            for column, sums in zip(b.columns, held):
                for x in column.to_pylist():
                    sums += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], names=["n", "total"])

    picked, program = _picked(df, values, ties, target.alias("y"))
    rows = picked.mapInArrow(fold, "n binary, total binary").repartition(8).mapInArrow(merge, "n binary, total binary").collect()
    n, total = (sum(np.frombuffer(bytes(r[i])) for r in rows).reshape(k, width + 1) for i in (0, 1))
    with np.errstate(invalid="ignore"):
        return [(total[c] / n[c])[1 : len(edges[c]) + 1] for c in range(k)]


def distinct_up_to(df: DataFrame, values: Sequence[Feature], most: int) -> list[int]:
    """The number of distinct values of each feature, where over `most` only that it is more: no task holds more than most + 1 of a column."""
    k = len(values)

    def unique(x: np.ndarray) -> np.ndarray:
        return np.unique(x)[: most + 1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * k
        for z, _, _ in _batches(batches, program, 0):
            for c in range(k):
                if len(held[c]) <= most:
                    held[c] = unique(np.concatenate((held[c], z[:, c] + 0.0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], names=["at", "held"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[c] = unique(np.concatenate((held.get(c, np.zeros(0)), np.frombuffer(x))))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h.tobytes() for h in held.values()], pa.binary())], names=["at", "held"])

    picked, program = _picked(df, values, ())
    parts = picked.mapInArrow(fold, "at int, held binary")
    rows = parts.repartition(min(k, 8), "at").mapInArrow(merge, "at int, held binary").collect()
    out = dict((r[0], len(bytes(r[1])) // 8) for r in rows)
    return [out.get(c, 0) for c in range(k)]


def value_parts(df: DataFrame, value: str, parts: int | None = None) -> Column:
    """A number for ranges of values, about equally filled: a function of the value alone, so that every use of it agrees."""
    n = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(value, [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    at = F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(value))) if cuts else at
