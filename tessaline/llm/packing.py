"""Packing token sequences into bins with a grouping genetic algorithm.

Pieces of one length are interchangeable, so a packing is a list of patterns
(the lengths in a bin) with multiplicities over the histogram of lengths, which
has at most `capacity` entries however large the corpus is. Islands, one a
task, evolve such packings: crossover injects whole well-filled bins of one
parent, drops what the other parent would place twice, and packs the displaced
pieces by best fit, largest first. The elites migrate along a ring between
epochs. Documents then take the places of the best packing by their rank among
the pieces of their length.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, in_arrow, shuffle_partitions, stored, table
from .token_counts import PLAIN

CAPACITY = 2048
ISLANDS = 6
EPOCHS = 3
GENERATIONS = 8
POPULATION = 6

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


REMEMBERED = 500_000
#: The characters that PLAIN admits.
RANGE = [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028)]


def plain_pattern(pattern: str) -> re.Pattern:
    """A pattern with \\p{L} and \\p{N} for texts that PLAIN matches: the classes are written out."""

    def members(kind: str) -> str:
        inside = [i for i in RANGE if unicodedata.category(chr(i))[0] == kind]
        runs = [list(g) for _, g in itertools.groupby(enumerate(inside), lambda p: p[1] - p[0])]
        return "".join(f"\\u{i[1]:04x}-\\u{r[-1][1]:04x}" for r in runs for i in r[:1])

    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"\\p{{{kind}}}")
    inside = re.sub(r"(\[[^\]]*\])", lambda m: m[1].replace("\\p{L}", members("L")).replace("\\p{N}", members("N")), pattern)
    return re.compile(inside.replace("\\p{L}", f"[{members('L')}]").replace("\\p{N}", f"[{members('N')}]"))


class Memory(dict):
    """Remembers what make gives for a key; emptied by trim() once it is large."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, for a BPE tokenizer file with word ends.

    The words of a plain text are found by the file's own pattern, and each
    distinct one is encoded once by a rank table made of the file's own
    vocabulary, in which the byte 0xff, that UTF-8 never has, stands for the
    word end. All other texts go through the file's own library.
    """

    END = b"\xff"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        spec = json.loads(self.own.to_str())
        special = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.words, self.special = None, special
        if suffix and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.words = plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            byte_of, ranks = _byte_of(), {}
            for token, rank in spec["model"]["vocab"].items():
                if token not in special:
                    end = token.endswith(suffix)
                    ranks[bytes(byte_of[c] for c in (token.removesuffix(suffix) if end else token)) + self.END * end] = rank
            encode = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.memory = Memory(lambda word: struct.pack(f"<{len(ids := encode(word.encode() + self.END))}I", *ids))

    def ids(self, texts: list[str]) -> list[bytes]:
        out, slow = [b""] * len(texts), []
        if self.words:
            self.memory.trim()
            known = self.memory.__getitem__
        for i, t in enumerate(texts):
            if self.words and PLAIN.fullmatch(t) and unicodedata.is_normalized("NFC", t) and not any(s in t for s in self.special):
                out[i] = b"".join(map(known, self.words.findall(t.lower())))
            else:
                slow.append(i)
        for i, e in zip(slow, self.own.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document's ids end with id 0."""
    stop = np.array([0], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in bounded(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1).fill_null("").to_pylist())):
                ids += stop
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, run, PIECES_DDL)


# ---------------------------------------------------------------- packing a histogram

#: A packing: {pattern (lengths, largest first): multiplicity}.
Packing = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int, into: Packing | None = None) -> Packing:
    """Best fit, largest first. Whole groups of equal bins are filled at once, so the work does not grow with the counts.

    into: bins that are there already, whose free space is used too.
    """
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(pattern: tuple[int, ...], n: int, space: int) -> None:
        if space not in free:
            free[space] = []
            insort(spaces, space)
        free[space].append((pattern, n))

    for pattern, n in (into or {}).items():
        put(pattern, n, capacity - sum(pattern))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each, capacity - each * length)
                    left %= each
                else:
                    put((length,) * left, 1, capacity - left * length)
                    left = 0
                continue
            space = spaces[at]
            pattern, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            each = space // length
            # As many as fit, in as many of these bins as there are pieces for; the rest of the bins stay as they were.
            fill = min(n, left // each)
            if fill:
                put(pattern + (length,) * each, fill, space - each * length)
                left -= fill * each
                if n > fill:
                    put(pattern, n - fill, space)
            else:
                put(pattern + (length,) * left, 1, space - left * length)
                if n > 1:
                    put(pattern, n - 1, space)
                left = 0
    out: Packing = {}
    for groups in free.values():
        for pattern, n in groups:
            key = tuple(sorted(pattern, reverse=True))
            out[key] = out.get(key, 0) + n
    return out


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """(bins, minus the sum of squared fills): smaller is better."""
    return sum(packing.values()), -sum(n * (sum(p) / capacity) ** 2 for p, n in packing.items())


def crossover(mother: Packing, father: Packing, counts: dict[int, int], capacity: int, rng) -> Packing:
    """Well-filled bins of the father go in whole; of the mother's bins those that still can; the rest is packed by best fit."""
    left, child = dict(counts), {}

    def inject(pattern: tuple[int, ...], n: int) -> None:
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        n = min([n, *(left.get(x, 0) // k for x, k in need.items())])
        if n > 0:
            child[pattern] = child.get(pattern, 0) + n
            for x, k in need.items():
                left[x] -= n * k

    for parent, share, floor in ((father, 0.5, 0.995), (mother, 1.0, 0.97)):
        for pattern in sorted(parent, key=lambda p: (-sum(p), p)):
            if sum(pattern) >= floor * capacity and rng.random() < share:
                inject(pattern, parent[pattern])
    return best_fit({x: n for x, n in left.items() if n}, capacity, child)


def mutate(packing: Packing, counts: dict[int, int], capacity: int, rng) -> Packing:
    """Dissolve the worst bins and some others, and pack their pieces again in a slightly shuffled order of lengths."""
    keep, left = {}, {}
    for pattern, n in packing.items():
        gone = n if sum(pattern) < 0.98 * capacity else int(rng.binomial(n, 0.05))
        if n > gone:
            keep[pattern] = n - gone
        for x in pattern if gone else ():
            left[x] = left.get(x, 0) + gone
    some = {x: n for x, n in left.items() if rng.random() < 0.5}
    return best_fit({x: n for x, n in left.items() if x not in some}, capacity, best_fit(some, capacity, keep))


def evolve(counts: dict[int, int], population: list[Packing], capacity: int, generations: int, seed: int) -> list[Packing]:
    """The population after some generations, best first; the best one never gets worse.

    The first population is one best-fit packing and mutants of it; after the
    first generation a packing that reaches the lower bound ends the search.
    """
    rng, least = np.random.default_rng(seed), -(-sum(x * n for x, n in counts.items()) // capacity)
    while len(population) < POPULATION:
        population.append(mutate(population[0], counts, capacity, rng) if population else best_fit(counts, capacity))
    population.sort(key=lambda p: fitness(p, capacity))
    for generation in range(generations):
        if generation and fitness(population[0], capacity)[0] <= least:
            break
        a, b = sorted(rng.choice(len(population), 2, replace=False))
        child = crossover(population[b], population[a], counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, capacity, rng)
        if fitness(child, capacity) < fitness(population[-1], capacity) and child not in population:
            population[-1] = child
            population.sort(key=lambda p: fitness(p, capacity))
    return population


def pack_histogram(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> Packing:
    """The best packing that islands of tasks find; after each epoch the elite of an island goes on to the next one."""
    if not counts:
        return {}
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    elites: list[list[Packing]] = [[] for _ in range(islands)]
    best: Packing | None = None
    for epoch in range(epochs):
        seeds = [(k, json.dumps([[[list(p), n] for p, n in e.items()] for e in elites[k]])) for k in range(islands)]
        frame = spark.createDataFrame(seeds, "island int, packings string").repartitionByRange(islands, "island")

        def run(frames: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for island, text in zip(frame["island"], frame["packings"]):
                    start = [{tuple(p): n for p, n in e} for e in json.loads(text)]
                    top = evolve(counts, start, capacity, GENERATIONS, 1000 * epoch + int(island))[0]
                    yield pd.DataFrame({"island": [island], "packing": [json.dumps([[list(p), n] for p, n in top.items()])]})

        found = {r[0]: {tuple(p): n for p, n in json.loads(r[1])} for r in frame.mapInPandas(run, "island int, packing string").collect()}
        best = min([*found.values(), *([best] if best else [])], key=lambda p: fitness(p, capacity))
        if fitness(best, capacity)[0] <= least:
            break
        elites = [[found[k], found[(k - 1) % islands]] for k in range(islands)]
    return best


def places(packing: Packing) -> pd.DataFrame:
    """Rows (length, low, high, sequence, offset): the pieces of that length with a rank in [low, high) go to
    sequence + rank - low, at that offset. Sorted by length and low."""
    rows, rank, sequence = [], {}, 0
    for pattern, n in sorted(packing.items()):
        at = 0
        for length in pattern:
            low = rank.get(length, 0)
            rows.append((length, low, low + n, sequence, at))
            rank[length] = low + n
            at += length
        sequence += n
    return pd.DataFrame(sorted(rows), columns=["length", "low", "high", "sequence", "offset"])


#: Ranks of a length in a block, whose pieces and places meet in one task.
RANKS = 1 << 16


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by length, block, rank and kind: pieces (kind 1) with the place that came last (kind 0) before them."""
    last: tuple[int, int, int] | None = None  # low, sequence, offset
    for batch in batches:
        kind, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sequence, offset = (batch.column(k).fill_null(0).to_numpy() for k in (2, 3))
        place = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
        piece = np.flatnonzero(kind == 1)
        at = place[piece]
        low, seq, off = rank[at].copy(), sequence[at].copy(), offset[at].copy()
        if last is not None and len(at):
            carried = at < 0
            low[carried], seq[carried], off[carried] = last
        if len(place) and place[-1] >= 0:
            last = int(rank[place[-1]]), int(sequence[place[-1]]), int(offset[place[-1]])
        own = batch.take(pa.array(piece))
        yield pa.RecordBatch.from_arrays([*own.columns[4:9], pa.array((seq + rank[piece] - low).astype(np.int64)), pa.array(off.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def by_block(plan: pd.DataFrame) -> pd.DataFrame:
    """The places cut where a block of RANKS ranks ends: length, block, low, sequence, offset."""
    first, last = plan["low"].to_numpy(np.int64) // RANKS, (plan["high"].to_numpy(np.int64) - 1) // RANKS
    n = last - first + 1
    at = np.repeat(np.arange(len(plan)), n)
    block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[at]
    low = np.maximum(plan["low"].to_numpy(np.int64)[at], block * RANKS)
    return pd.DataFrame({"length": plan["length"].to_numpy(np.int64)[at], "block": block, "low": low, "sequence": plan["sequence"].to_numpy(np.int64)[at] + low - plan["low"].to_numpy(np.int64)[at], "offset": plan["offset"].to_numpy(np.int64)[at]})


def pack(docs: DataFrame, tokenizer: str, spark: SparkSession, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the id 0. Only documents of more than
    `capacity` ids are cut. Repeated rows, and rows that share a doc_id or have
    none, are packed each for itself; an empty table gives an empty result;
    columns other than doc_id and text are not read. Which of several pieces of
    one length takes which place is decided by partition, then doc_id, then
    piece. Pieces and places meet by length and block of ranks in a shuffle, so
    nothing that grows with the corpus is broadcast.
    """
    cut = pieces(docs, tokenizer, capacity).withColumn("_part", F.spark_partition_id())
    cut = stored(spark, cut, "pieces")
    cells = stored(spark, cut.groupBy("length", "_part").agg(F.count("*").alias("_n")), "lengths")
    counts = {int(r[0]): int(r[1]) for r in cells.groupBy("length").agg(F.sum("_n")).collect()}
    plan = by_block(places(pack_histogram(spark, counts, capacity)))
    before = cells.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_in", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_before") + F.col("_in"))
    none = lambda t: F.lit(None).cast(t)
    own = ranked.select(F.lit(1).alias("kind"), F.col("_rank").cast("long").alias("rank"), none("long").alias("sequence"), none("long").alias("offset"), "doc_id", "piece", "start", "length", "ids_crc32", F.floor(F.col("_rank") / RANKS).cast("long").alias("block"))
    slots = spark.createDataFrame(plan, "length long, block long, low long, sequence long, offset long") if len(plan) else spark.createDataFrame([], "length long, block long, low long, sequence long, offset long")
    slots = slots.select(F.lit(0).alias("kind"), F.col("low").alias("rank"), "sequence", "offset", none("long").alias("doc_id"), none("int").alias("piece"), none("long").alias("start"), "length", none("long").alias("ids_crc32"), "block")
    met = own.unionByName(slots).repartition(shuffle_partitions(spark), "length", "block").sortWithinPartitions("length", "block", "rank", "kind")
    return met.transform(in_arrow, _meet, PIECES_DDL + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spark)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents in their sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), spark)
