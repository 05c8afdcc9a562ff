"""N-gram Jaccard join by vertical partitioning.

The shingles of a document are put in one global order, rarest first: by the
magnitude of a count sketch over all documents, then by hash. Documents with
equal sets are one class. Two classes that reach the threshold share a shingle
among the first (1 - t) |set| + 1 of each, so only these prefixes are dealt by
shingle; knowing both sizes, the shared one even stands among the first
|set| - overlap + 1 of each. A class of a shingle's group is compared first with
the group's pivot, the class that has the shingle earliest (a text of which the
others are edits has no rarer shingles than those they share); then, with the
components that this gives, whatever two classes of a group are still apart.
Pairs whose parity sketches differ in too many bits are out. A comparison cuts
the global order into fragments: partial overlaps are counted fragment by
fragment in tasks of their own and summed per pair.

Links join only classes of one component, so all links are those of its pairs.
A component of two classes is one link; in a larger one every pair is
compared: its classes are dealt by hash to chunks, and each two chunks meet in
a task, which multiplies the incidence matrices of their shingles.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIELDS, KEY, LOWER, U64, bounded, flat, in_arrow, join_evenly, mix, ranges, shuffle_partitions, stored, table, with_key, without_rows, words
from .graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
SKETCH_BITS = 22
BLOCK_BITS = 16
FRAGMENT = 512  # shingles of a pivot in a fragment, about
CROWD = 256  # classes compared with a pivot in one task, about; more of them are spread by salts
CHUNK = 1024  # classes of a component in a chunk, about
CHUNK_SHINGLES = 1 << 19  # shingles of a chunk, about, unless a single class has more
PIECE = 1 << 16  # shingles of the largest class of a component in a piece, about
STRIP = 2048  # shingles in a strip of an incidence matrix
FLUSH = 500_000  # postings that a map task holds
MEET = 2048  # classes of a shingle's group in a chunk, about
MOST_CLASHES = 100_000  # sets whose first 64-bit ids clash
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = U64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, checks): each row's set of shingles, sorted by hash, and a second hash of each shingle.

    A row with fewer words than a shingle has its whole sequence as one; a row
    without words has none. A word counts with 124 bits of hashes in prime
    fields, so no two words of the same length are one for a structural reason.
    """
    data = LOWER[data]
    start, end, row = words(data, offsets, ~SPACE)
    rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64)
    one, two = FIELDS.hash(data, start, end)
    one = one + mix(two)
    per_row = np.bincount(row, minlength=rows)
    n = len(one) - size + 1
    first = np.flatnonzero(row[:n] == row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
    out, check = np.full(len(first), U64(size)), np.full(len(first), U64(~size & (1 << 64) - 1))
    for k in range(size):
        out = mix(out * STEP + one[first + k])
        check = mix(check * STEP + two[first + k])
    owner = row[first]
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):
        at = np.searchsorted(row, short)
        extra = per_row[short].astype(np.uint64)
        other = ~extra
        for k in range(size - 1):
            live = per_row[short] > k
            place = np.where(live, at + k, 0)
            extra = np.where(live, mix(extra * STEP + one[place]), extra)
            other = np.where(live, mix(other * STEP + two[place]), other)
        out, check, owner = np.concatenate((out, extra)), np.concatenate((check, other)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        out, check, owner = out[order], check[order], owner[order]
    cut = np.searchsorted(owner, np.arange(rows + 1))
    order = np.concatenate([a + np.argsort(out[a:b]) for a, b in zip(cut[:-1], cut[1:])])
    out, check = out[order], check[order]
    keep = np.concatenate(([True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])))
    return out[keep], np.searchsorted(owner[keep], np.arange(rows + 1)), check[keep]


def class_ids(hashes: np.ndarray, offsets: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit ids of each row's set, from the two hashes of its shingles."""

    def summed(x: np.ndarray, key: int) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(x ^ U64(key)), dtype=np.uint64)))
        size = np.diff(offsets).astype(np.uint64)
        return mix(total[offsets[1:]] - total[offsets[:-1]] + size * U64(0x8CB92BA72F3D8DD7)).view(np.int64)

    return summed(hashes, 0x9E3779B97F4A7C15), summed(checks, 0xC2B2AE3D27D4EB4F)


def stand_in(cls: int, check: int) -> int:
    """The class of a set whose first id another set has too."""
    return int.from_bytes(hashlib.blake2b(f"{cls}:{check}".encode(), digest_size=8).digest(), "little", signed=True)


def clashes(classes: DataFrame) -> dict[tuple[int, int], int]:
    """classes: a row (cls, chk) per set. The stand-ins of sets whose first ids are the same but second ones differ, of the smallest second id none.

    First ids are random in effect: of 10^11 sets about 300 pairs are the same,
    and MOST_CLASHES bounds what is taken to the driver.
    """
    several = classes.groupBy("cls").agg(F.min("chk").alias("_min"), F.count("*").alias("_n")).where("_n > 1")
    found = classes.join(several, "cls").where("chk <> _min").select("cls", "chk").limit(MOST_CLASHES + 1).collect()
    if len(found) > MOST_CLASHES:
        raise ValueError(f"over {MOST_CLASHES} clashes of 64-bit ids: the hash does not suit these texts")
    return {(r[0], r[1]): stand_in(r[0], r[1]) for r in found}


def renamed(cls: np.ndarray, check: np.ndarray, names: dict[tuple[int, int], int]) -> np.ndarray:
    if not names:
        return cls
    return np.array([names.get(pair, pair[0]) for pair in zip(cls.tolist(), check.tolist())], np.int64)


SKETCH_WORDS = 16  # 64-bit words of a set's parity sketch


def parities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of SKETCH_WORDS words: bit b tells whether an odd number of the set's shingles falls on b.

    Sets that differ in d shingles have sketches that differ in d bits at most.
    """
    bits = 64 * SKETCH_WORDS
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    place, times = np.unique(row * bits + (mix(hashes ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64), return_counts=True)
    place = place[times % 2 == 1]
    out = np.zeros((len(offsets) - 1) * SKETCH_WORDS, np.uint64)
    np.bitwise_or.at(out, place >> 6, U64(1) << (place & 63).astype(np.uint64))
    return out.view(np.int64).reshape(-1, SKETCH_WORDS)


MEMBERS = "kind int, __key long, __tag long, doc_id long, n long, cls long, chk long, sig array<long>, block int, cells binary"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: key, doc_id, n, cls, chk. Rows of kind 1: a block of this task's sketch."""
    schema = pa.schema([("kind", pa.int32()), ("__key", pa.int64()), ("__tag", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("chk", pa.int64()), ("sig", pa.list_(pa.int64())), ("block", pa.int32()), ("cells", pa.binary())])
    sketch, held, count = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
    for batch in bounded(batches, "text"):
        h, offsets, checks = shingle_sets(*flat(batch.column(3)))
        held.append((h >> U64(64 - SKETCH_BITS)).astype(np.int32))
        count += len(h)
        if count > 2_000_000:
            sketch += np.bincount(np.concatenate(held), minlength=len(sketch)).astype(np.uint32)
            held, count = [], 0
        m = batch.num_rows
        none = pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())
        # Sets of under five shingles link with none but their like, so they need no sketch.
        long = np.diff(offsets) > 4
        sig = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(long * SKETCH_WORDS))), pa.int32()), pa.array(parities(h, offsets)[long].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), *batch.columns[:3], pa.array(np.diff(offsets)), *(pa.array(x) for x in class_ids(h, offsets, checks)), sig, *none], schema=schema)
    if count:
        sketch += np.bincount(np.concatenate(held), minlength=len(sketch)).astype(np.uint32)
    if sketch.any():
        blocks = sketch.reshape(-1, 1 << BLOCK_BITS)
        m = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *[pa.nulls(m, pa.int64())] * 6, pa.nulls(m, pa.list_(pa.int64())), pa.array(np.arange(m, dtype=np.int32)), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], schema=schema)


def _sum_blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the blocks that this task has."""
    held: dict[int, np.ndarray] = {}
    for batch in frames:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(cells), "<u4").astype(np.int64)
            held[block] = held[block] + own if block in held else own
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], names=["block", "cells"])


def magnitudes(members: DataFrame, spark: SparkSession) -> np.ndarray:
    """log2 of the sketch's cells as small integers: a table of fixed size, 2^SKETCH_BITS bytes."""
    rows = members.where("kind = 1").select("block", "cells").repartition(min(shuffle_partitions(spark), 1 << (SKETCH_BITS - BLOCK_BITS)), "block").transform(in_arrow, _sum_blocks, "block int, cells binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for block, cells in rows:
        out[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.log2(1.0 + np.frombuffer(cells, "<i8")) * 2
    return out


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + 1


def _prefixes(shared, parts: int):
    """Postings of the prefixes, packed into one blob per flush and part."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        token, cls, n, place = (np.concatenate(x) for x in zip(*held))
        part = (mix(token) % U64(parts)).astype(np.int64)
        order = np.lexsort((cls, part))
        token, cls, n, place, part = (x[order] for x in (token, cls, n, place, part))
        cut = np.searchsorted(part, np.arange(parts + 1))
        ids, blobs = [], []
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            if a < b:
                head = np.flatnonzero(np.concatenate(([True], cls[a + 1 : b] != cls[a : b - 1])))
                count = np.diff(np.append(head, b - a)).astype("<u4")
                ids.append(p)
                blobs.append(np.array([len(head)], "<u4").tobytes() + cls[a:b][head].tobytes() + n[a:b][head].astype("<u4").tobytes() + count.tobytes() + place[a:b].tobytes() + token[a:b].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, names = shared.value
        held, count, seen = [], 0, set()
        for batch in bounded(batches, "text"):
            h, offsets, checks = shingle_sets(*flat(batch.column(0)))
            cls = renamed(*class_ids(h, offsets, checks), names)
            fresh = []
            for k, c in enumerate(cls.tolist()):
                if offsets[k] < offsets[k + 1] and c not in seen:
                    seen.add(c)
                    fresh.append(k)
            if len(seen) > 500_000:
                seen.clear()
            if not fresh:
                continue
            fresh = np.array(fresh)
            n = np.diff(offsets)[fresh]
            rarity = size[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            keep = []
            for k, p in zip(fresh, prefix_length(n)):
                a, b = offsets[k], offsets[k + 1]
                # Rows are in order of hash, so a stable sort by rarity gives the global order.
                keep.append(a + np.argsort(rarity[a:b], kind="stable")[:p])
            length = np.array([len(x) for x in keep])
            # A place over 65535 counts as that: the filter by place then lets more pairs through, never fewer.
            place = np.minimum(ranges(np.zeros(len(length), np.int64), length), 65535).astype("<u2")
            held.append((h[np.concatenate(keep)], np.repeat(cls[fresh], length), np.repeat(n, length), place))
            count += int(length.sum())
            if count >= FLUSH:
                yield from pack(held)
                held, count = [], 0
        if held:
            yield from pack(held)

    return run


FOUND = "kind int, a long, b long, na long, nb long, members array<long>, sizes array<long>, places array<long>"
FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("members", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])


def possible(n: np.ndarray, place: np.ndarray, other_n: int, other_place: int) -> np.ndarray:
    """Whether classes with a shingle at these places of the global order can reach the threshold, if it is the first they share."""
    both = n + other_n
    least = (both * NUMERATOR + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR)
    return (place <= n - least) & (other_place <= other_n - least)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the postings of some parts: (kind 0) candidate pairs of a class and its pivot, (kind 1) groups of over two classes, each once."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blobs.setdefault(part, []).append(blob)
    for part in sorted(blobs):
        token, cls, n, place = [], [], [], []
        for blob in blobs.pop(part):
            m = int(np.frombuffer(blob, "<u4", 1)[0])
            count = np.frombuffer(blob, "<u4", m, 4 + 12 * m)
            total = int(count.sum())
            cls.append(np.repeat(np.frombuffer(blob, "<i8", m, 4), count))
            n.append(np.repeat(np.frombuffer(blob, "<u4", m, 4 + 8 * m).astype(np.int64), count))
            place.append(np.frombuffer(blob, "<u2", total, 4 + 16 * m).astype(np.int64))
            token.append(np.frombuffer(blob, "<u8", total, 4 + 16 * m + 2 * total))
        token, cls, n, place = (np.concatenate(x) for x in (token, cls, n, place))
        # Only tokens of several postings go on to the full sort.
        order = np.argsort(token, kind="stable")
        t = token[order]
        same = t[1:] == t[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((cls[order], token[order]))]
        token, cls, n, place = (x[order] for x in (token, cls, n, place))
        if len(token):
            keep = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
            token, cls, n, place = (x[keep] for x in (token, cls, n, place))
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        stop = np.append(head[1:], len(token))
        many = stop - head > 1
        # Of shingles with the same classes the one that comes first in the global order lets every pair through that another does.
        first: dict[bytes, tuple[int, int]] = {}
        for a, b in zip(head[many].tolist(), stop[many].tolist()):
            key = hashlib.blake2b(cls[a:b].tobytes(), digest_size=16).digest()
            if key not in first or place[a] < place[first[key][0]]:
                first[key] = a, b
        pairs, groups = [], []
        for a, b in first.values():
            left = np.arange(a, b)
            while len(left) > 1:
                pivot = left[np.lexsort((n[left], place[left]))[0]]
                near = (n[left] * DENOMINATOR >= n[pivot] * NUMERATOR) & (n[pivot] * DENOMINATOR >= n[left] * NUMERATOR)
                other = left[near & (left != pivot)]
                other = other[possible(n[other], place[other], n[pivot], place[pivot])]
                if len(other):
                    pairs.append(np.stack((cls[other], np.full(len(other), cls[pivot]), n[other], np.full(len(other), n[pivot]))))
                left = left[~near]
            if b - a > 2:
                groups.append((cls[a:b], n[a:b], place[a:b]))
        if pairs:
            p = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for at in range(0, p.shape[1], 100_000):
                q = p[:, at : at + 100_000]
                m = q.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), *(pa.array(x) for x in q), *[pa.nulls(m, pa.list_(pa.int64()))] * 3], schema=FOUND_SCHEMA)
        for at in range(0, len(groups), 1000):
            some = groups[at : at + 1000]
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *[pa.nulls(m, pa.int64())] * 4, *(pa.array([x[k] for x in some], pa.list_(pa.int64())) for k in (0, 1, 2))], schema=FOUND_SCHEMA)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two chunks of a group whose classes are in different components and may reach the threshold by size and place."""
    for batch in batches:
        out, held = [], 0
        for low, high, rows in zip(*(c.to_pylist() for c in batch.columns)):
            n, cls, comp, place, chunk = (np.array([r[k] for r in rows], np.int64) for k in ("n", "cls", "comp", "place", "chunk"))
            order = np.lexsort((cls, n))
            n, cls, comp, place, chunk = (x[order] for x in (n, cls, comp, place, chunk))
            for i in range(len(n) - 1):
                to = int(np.searchsorted(n, n[i] * DENOMINATOR // NUMERATOR, side="right"))
                live = (comp[i + 1 : to] != comp[i]) & possible(n[i + 1 : to], place[i + 1 : to], n[i], place[i])
                if low < high:
                    live &= chunk[i + 1 : to] != chunk[i]
                other = i + 1 + np.flatnonzero(live)
                if len(other):
                    out.append(np.stack((cls[other], np.full(len(other), cls[i]), n[other], np.full(len(other), n[i]))))
                    held += len(other)
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(out, axis=1), axis=1)], names=["a", "b", "na", "nb"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(out, axis=1), axis=1)], names=["a", "b", "na", "nb"])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, cls, targets (pivot, its size, salts from low to high). Rows (pivot, frag, salt, role, cls, shingles): role 0 is the pivot's own."""
    schema = pa.schema([("pivot", pa.int64()), ("frag", pa.int32()), ("salt", pa.int64()), ("role", pa.int32()), ("cls", pa.int64()), ("shingles", pa.binary())])
    for batch in bounded(batches, "text"):
        h, offsets, _ = shingle_sets(*flat(batch.column(0)))
        high = (h >> U64(32)).astype(np.int64)
        out, held = [[] for _ in schema], 0
        for k, (cls, targets) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            a, b = offsets[k], offsets[k + 1]
            for t in targets:
                count = 1 + t["n"] // FRAGMENT
                cut = np.searchsorted(high[a:b], np.arange(count + 1) * (1 << 32) // count + (np.arange(count + 1) == count))
                for f in range(count):
                    if cut[f] == cut[f + 1]:
                        continue
                    shingles = h[a + cut[f] : a + cut[f + 1]].tobytes()
                    for salt in range(t["low"], t["high"]):
                        for column, value in zip(out, (t["pivot"], f, salt, int(t["pivot"] != cls), cls, shingles)):
                            column.append(value)
                        held += len(shingles)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                            out, held = [[] for _ in schema], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by pivot, fragment, salt, role and class: the partial overlap of each class with the pivot in that fragment."""
    at, last, own = None, None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, common = [], [], []
        for pivot, frag, salt, role, cls, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if role == 0:
                at, last, own = (pivot, frag, salt), None, np.frombuffer(raw, np.uint64)
            elif at == (pivot, frag, salt) and cls != last:  # a repeated row comes twice
                last = cls
                other = np.frombuffer(raw, np.uint64)
                place = np.searchsorted(own, other)
                place[place == len(own)] = 0
                a.append(cls)
                b.append(pivot)
                common.append(int((own[place] == other).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int64())], names=["a", "b", "common"])


def verify(pairs: DataFrame, texts: DataFrame, spark: SparkSession) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the threshold, exactly, as (a, b). b is the pivot side; texts: (cls, text).

    The classes of a crowded pivot are dealt to several salts, and the pivot's
    fragments go to each of them, so no task has more than about CROWD classes
    of one fragment.
    """
    pairs = stored(spark, pairs.select("a", "b", "na", "nb").distinct(), "pairs")
    crowded = pairs.groupBy("b").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("b", F.ceil(F.col("_n") / CROWD).alias("salts"))
    salted = pairs.join(crowded, "b", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
    salt = F.pmod(F.xxhash64("a"), F.col("salts"))

    def target(low, high):
        return F.struct(F.col("b").alias("pivot"), F.col("nb").alias("n"), low.cast("long").alias("low"), high.cast("long").alias("high")).alias("to")

    sent = salted.select(F.col("a").alias("cls"), target(salt, salt + 1))
    home = salted.select(F.col("b").alias("cls"), target(F.lit(0), F.col("salts"))).distinct()
    targets = sent.unionByName(home).groupBy("cls").agg(F.collect_set("to").alias("targets"))
    fragments = texts.join(targets.hint("merge"), "cls").select("text", "cls", "targets").transform(in_arrow, _fragments, "pivot long, frag int, salt long, role int, cls long, shingles binary")
    dealt = fragments.repartition(shuffle_partitions(spark), "pivot", "frag", "salt").sortWithinPartitions("pivot", "frag", "salt", "role", "cls")
    counts = dealt.transform(in_arrow, _overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    # Different sets of under five shingles never reach the threshold.
    return pairs.join(counts, ["a", "b"]).where(F.greatest("na", "nb") > 4).where(F.col("common") * DENOMINATOR >= (F.col("na") + F.col("nb") - F.col("common")) * NUMERATOR).select("a", "b")


def plausible(pairs: DataFrame, sets: DataFrame, spark: SparkSession) -> DataFrame:
    """The pairs (a, b, na, nb) that may reach the threshold by the parity sketches of their sets; sets: (cls, sig). None that reaches it is lost."""
    pairs = stored(spark, pairs.where(F.greatest("na", "nb") > 4).select("a", "b", "na", "nb").distinct(), "proposed")
    own = {k: stored(spark, pairs.groupBy(k).agg(F.count("*").alias("_n")).join(sets.select(F.col("cls").alias(k), F.col("sig").alias(f"sig_{k}")), k), "sketches") for k in ("a", "b")}
    for k, other in (("a", "b"), ("b", "a")):
        pairs = join_evenly(pairs, own[k], k, "_n", [other])
    total = F.col("na") + F.col("nb")
    least = F.ceil(total * NUMERATOR / (NUMERATOR + DENOMINATOR))
    apart = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    # A set of under five shingles has no sketch: nothing differs then.
    return pairs.where(apart <= total - 2 * least).select("a", "b", "na", "nb")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, cls, comp, chunk, chunks, pieces. Rows (comp, low, high, piece, cls, chunk, n, shingles): a piece of a class for each two chunks that meet."""
    schema = pa.schema([("comp", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("piece", pa.int32()), ("cls", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
    for batch in bounded(batches, "text"):
        h, offsets, _ = shingle_sets(*flat(batch.column(0)))
        out, held = [[] for _ in schema], 0
        for k, (cls, comp, chunk, chunks, pieces) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            a, b = int(offsets[k]), int(offsets[k + 1])
            cut = [a, *(a + np.searchsorted(h[a:b], np.array([(p << 64) // pieces for p in range(1, pieces)], np.uint64))).tolist(), b]
            for piece in range(pieces):
                if cut[piece] == cut[piece + 1]:
                    continue
                shingles = h[cut[piece] : cut[piece + 1]].tobytes()
                for other in range(chunks):
                    for column, value in zip(out, (comp, min(chunk, other), max(chunk, other), piece, cls, chunk, b - a, shingles)):
                        column.append(value)
                    held += len(shingles) + 64
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out, held = [[] for _ in schema], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    shingle = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(shingle, return_inverse=True, return_counts=True)
    keep = times[column] > 1  # in one set only: shared with none
    number = np.cumsum(times > 1) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2^24 shingles
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, STRIP):
        a, b = np.searchsorted(column, (at, at + STRIP))
        strip = np.zeros((len(sets), min(STRIP, int(column[b - 1]) + 1 - at)), np.float32)
        strip[row[a:b], column[a:b] - at] = 1
        for a in range(0, len(sets), 256):
            out[a : a + 256] += strip[a : a + 256] @ strip.T
    return out.astype(np.int32)


LINKS = "a long, b long, na long, nb long, common long, links long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by component, chunks, piece and class (and pieces of the component): the links of each class, b null; or, where a class has several pieces, the partial overlap of each pair."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in LINKS.split(", ")])
    at, held = None, []

    def finish() -> Iterator[pa.RecordBatch]:
        cls, chunk, n, sets = (list(x) for x in zip(*held))
        (_, low, high, _), pieces = at
        common, cls, chunk, n = common_shingles(sets), np.array(cls), np.array(chunk), np.array(n)
        # Pairs within a chunk belong to the task where it meets itself.
        upper = np.triu(np.ones(common.shape, bool), 1)
        if low < high:
            upper &= chunk[:, None] != chunk
        if pieces == 1:
            upper &= common * DENOMINATOR >= (n[:, None] + n - common) * NUMERATOR
            links = upper.sum(0) + upper.sum(1)
            own = np.flatnonzero(links)
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cls[own]), none, none, none, none, pa.array(links[own])], schema=schema)
            return
        i, j = np.nonzero(upper & (common > 0) & (np.minimum(n[:, None], n) * DENOMINATOR >= np.maximum(n[:, None], n) * NUMERATOR))
        for k in range(0, len(i), 50_000):
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(cls[x]), pa.array(cls[y]), pa.array(n[x]), pa.array(n[y]), pa.array(common[x, y]), pa.nulls(len(x), pa.int64())], schema=schema)

    for batch in batches:
        for comp, low, high, piece, pieces, cls, chunk, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
            key = (comp, low, high, piece), pieces
            if key != at:
                if held:
                    yield from finish()
                at, held = key, []
            if not held or held[-1][0] != cls:  # a repeated row comes twice
                held.append((cls, chunk, n, np.frombuffer(raw, np.uint64)))
    if held:
        yield from finish()


def count_links(classes: DataFrame, texts: DataFrame, spark: SparkSession) -> DataFrame:
    """classes: (cls, n, comp), all classes of components of several. Rows (cls, links): with how many other classes each one reaches the threshold."""
    sizes = classes.groupBy("comp").agg(F.count("*").alias("_k"), F.sum("n").alias("_sum"), F.max("n").alias("_max"))
    sizes = sizes.select("comp", "_k", F.greatest(F.ceil(F.col("_k") / CHUNK), F.ceil(F.col("_sum") / CHUNK_SHINGLES)).alias("_c"), F.ceil(F.col("_max") / PIECE).cast("int").alias("pieces"))
    sizes = sizes.select("comp", "_k", F.least("_c", "_k").alias("chunks"), "pieces")
    sized = stored(spark, classes.join(sizes, "comp"), "sized")
    two = sized.where("_k = 2").select("cls", F.lit(1).cast("long").alias("links"))
    more = sized.where("_k > 2").select("cls", "comp", F.pmod(F.xxhash64("cls"), F.col("chunks")).alias("chunk"), "chunks", "pieces")
    sent = texts.join(more.hint("merge"), "cls").select("text", "cls", "comp", "chunk", "chunks", "pieces")
    dealt = sent.transform(in_arrow, _dealt, "comp long, low long, high long, piece int, cls long, chunk long, n long, shingles binary")
    pieces = more.select("comp", "pieces").where("pieces > 1").distinct()
    dealt = dealt.join(F.broadcast(pieces), "comp", "left").select("comp", "low", "high", "piece", F.coalesce("pieces", F.lit(1)).alias("pieces"), "cls", "chunk", "n", "shingles")
    met = dealt.repartition(shuffle_partitions(spark), "comp", "low", "high", "piece").sortWithinPartitions("comp", "low", "high", "piece", "cls").transform(in_arrow, _meet, LINKS)
    met = stored(spark, met, "met")
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common"))
    pairs = pairs.where(F.col("common") * DENOMINATOR >= (F.col("na") + F.col("nb") - F.col("common")) * NUMERATOR)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).cast("long").alias("links"))
    return two.unionByName(met.where("b is null").select(F.col("a").alias("cls"), "links")).unionByName(ends).groupBy("cls").agg(F.sum("links").alias("links"))


def near_members(docs: DataFrame, spark: SparkSession, links: bool) -> DataFrame:
    """One row per input row, stored: KEY, doc_id, n, cls, comp (null without shingles) and, with links, rep_id and links."""
    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = rows.select(*KEY, "text")
    members = stored(spark, rows.select(*KEY, "doc_id", "text").transform(in_arrow, _members, MEMBERS), "members")
    sets = members.where("kind = 0 and n > 0").groupBy("cls", "chk").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    sets = stored(spark, sets.select("cls", "chk", "rep.*", "n", "sig", "rows"), "sets")
    names = clashes(sets.select("cls", "chk"))
    if names:
        table_ = spark.createDataFrame([(*k, v) for k, v in names.items()], "cls long, chk long, _name long")
        rename = lambda df: df.join(F.broadcast(table_), ["cls", "chk"], "left").withColumn("cls", F.coalesce("_name", "cls")).drop("_name")
    else:
        rename = lambda df: df
    reps = rename(sets).drop("chk")
    shared = spark.sparkContext.broadcast((magnitudes(members, spark), names))
    total = reps.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * shuffle_partitions(spark), int(total * 0.2 // 1_000_000))
    postings = texts.select("text").transform(in_arrow, _prefixes(shared, parts), "part int, blob binary")
    found = stored(spark, postings.repartition(shuffle_partitions(spark), "part").transform(in_arrow, _groups, FOUND), "found")
    first = stored(spark, plausible(found.where("kind = 0"), reps, spark), "first")
    # The texts of classes that may link are taken out once, at every size by a shuffle.
    met = first.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    candidates = stored(spark, texts.join(reps.join(met, "cls").select("cls", *KEY).hint("merge"), KEY).select("cls", "text"), "texts")
    edges = stored(spark, verify(first, candidates, spark), "links")
    labels = components(edges, spark)
    second = plausible(still_apart(found, labels, spark).join(first.select("a", "b"), ["a", "b"], "left_anti"), reps, spark)
    second = stored(spark, second, "second")
    if not second.isEmpty():
        new = second.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(met, "cls", "left_anti")
        candidates = candidates.unionByName(stored(spark, texts.join(reps.join(new, "cls").select("cls", *KEY), KEY).select("cls", "text"), "texts"))
        edges = edges.unionByName(verify(second, candidates, spark))
        labels = components(edges, spark)
    placed = reps.join(labels, F.col("cls") == F.col("node"), "left").select("cls", *KEY, "n", "rows", F.coalesce("comp", "cls").alias("comp"))
    if links:
        several = placed.join(labels.select(F.col("node").alias("cls")), "cls", "left_semi")
        placed = placed.join(count_links(several.select("cls", "n", "comp"), candidates, spark), "cls", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    placed = stored(spark, placed, "placed").select("cls", "rows", "comp", *(["links"] if links else []))
    own = rename(members.where("kind = 0").select(*KEY, "doc_id", "n", "cls", "chk")).select(*KEY, "doc_id", "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    return stored(spark, join_evenly(own, placed, "cls", "rows", KEY), "rows")


def still_apart(found: DataFrame, labels: DataFrame, spark: SparkSession) -> DataFrame:
    """The pairs (a, b, na, nb) of classes of one group, not yet in one component, that may reach the threshold. Groups of many classes are compared by pairs of chunks."""
    groups = found.where("kind = 1").select(F.concat_ws(":", F.xxhash64("members"), F.xxhash64(F.lit(1), "members"), F.size("members")).alias("gid"), F.struct("members", "sizes", "places").alias("g"))
    groups = groups.groupBy("gid").agg(F.min_by("g", F.col("g.places")[0]).alias("g"))
    listed = groups.select("gid", F.ceil(F.size("g.members") / MEET).alias("chunks"), F.explode(F.arrays_zip("g.members", "g.sizes", "g.places")).alias("m"))
    listed = listed.select("gid", "chunks", F.col("m.members").alias("cls"), F.col("m.sizes").alias("n"), F.col("m.places").alias("place"))
    placed = listed.join(labels, F.col("cls") == F.col("node"), "left").select("gid", "chunks", "cls", "n", "place", F.coalesce("comp", "cls").alias("comp"))
    mixed = placed.groupBy("gid").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("gid")
    dealt = placed.join(mixed, "gid").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumns({"low": F.least("chunk", "_o"), "high": F.greatest("chunk", "_o")})
    met = dealt.groupBy("gid", "low", "high").agg(F.collect_list(F.struct("n", "cls", "comp", "place", "chunk")).alias("rows")).select("low", "high", "rows")
    return met.transform(in_arrow, _apart, "a long, b long, na long, nb long").distinct()


def jaccard_join(docs: DataFrame, spark: SparkSession, links: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, n_links, component_id.

    Documents link at a Jaccard similarity of 0.8 or more of their sets of
    five-word shingles (lower-cased A-Z; words between ASCII white space).
    Documents of equal sets are a class, and class_id is its smallest doc_id;
    n_links is the number of other classes that a document's own links with
    (0 for a text without shingles; links=False leaves class_id and n_links out).
    component_id is the smallest doc_id that links lead to. A text with fewer
    than five words is one shingle; a null, empty or blank text has none and
    links with nothing: its class_id and component_id are its doc_id. Repeated
    rows (one doc_id and text) are one member and come out as often as they
    came in; rows that share a doc_id with different texts are members of their
    own. A null doc_id stays null; it is no class_id or component_id unless a
    class or component has no other. An empty table gives an empty result;
    other columns are not read. Sets are told apart by 128 bits, shingles
    within a pair by 64; words are hashed in prime fields.
    """
    rows = near_members(docs, spark, links)
    least = stored(spark, rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")), "least")
    joined = join_evenly(rows, least, "comp", "_n", KEY).withColumn("component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    if not links:
        return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    first = stored(spark, rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_m")), "first")
    joined = join_evenly(joined, first, "cls", "_m", KEY)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("_first")).alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "component_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), spark)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one row stays, with its columns as they came.

    It is the one with the smallest doc_id, a null id last; of rows with that
    id one, by a hash of the text. Rows without words all stay. An empty table
    stays empty.
    """
    rows = near_members(docs, spark, False).withColumn("_first", F.struct(F.col("doc_id").isNull().alias("none"), *KEY))
    best = rows.where("comp is not null").groupBy("comp").agg(F.min("_first").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    best = stored(spark, best, "best")
    ties = join_evenly(rows.where("comp is not null"), best, "comp", "_n", KEY).where("_best is not null")
    gone = ties.where("_first <> _best").select(*KEY).distinct()
    once = ties.where("_first = _best").groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n > 1").select(*KEY)
    return without_rows(docs, stored(spark, gone, "gone"), stored(spark, once, "once"))
