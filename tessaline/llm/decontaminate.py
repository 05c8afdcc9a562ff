"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark items (n consecutive words, or all words of a
shorter item) are hashed; the set is broadcast in blocks of a checked size, one
scan of the documents for each block. A scan hashes every window of the
document words in NumPy passes, looks the hashes up in the sorted set, and
verifies each hit by comparing the words' bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, LOWER, POWERS, U64, bounded, flat, in_arrow, merged, mix, stored, table, with_key, words

WINDOW = 10
#: Bytes of benchmark text in a block. Its index takes about eight times as much, on the driver and in each executor; a larger benchmark takes more blocks, and a scan for each.
BLOCK_BYTES = 4 << 20
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
STEP = U64(0x9E3779B97F4A7C15)


def _window_hashes(word_hash: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of size words that lie in one row."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[:n] == row[size - 1 :])
    h = np.full(len(first), U64(size), dtype=np.uint64)
    for k in range(size):
        h = mix(h * STEP + word_hash[first + k])
    return first, h


class Index:
    """The windows of a block of items: for each size of window the sorted hashes and the first word of each.

    Windows are kept as places in the items' text, so an entry takes 16 bytes.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int):
        data, offsets = flat(pa.array([t for _, t in items], pa.binary()))
        self.data = LOWER[data]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.start, self.end, self.row = words(self.data, offsets, IS_WORD)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not len(self.start):
            return
        h = POWERS.hash(POWERS.prefix(self.data), self.start, self.end)
        count = np.bincount(self.row, minlength=len(items))
        for n in np.unique(np.minimum(count[count > 0], size)).tolist():
            first, key = _window_hashes(h, self.row, n)
            if n < size:
                short = count[self.row[first]] == n
                first, key = first[short], key[short]
            order = np.argsort(key, kind="stable")
            self.sizes[n] = key[order], first[order].astype(np.int64)

    def window(self, first: int, n: int) -> bytes:
        raw = self.data
        return b" ".join([raw[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n])])

    def scan(self, data: np.ndarray, start, end, row) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(first word, last word + 1) of each verified window, and (row, item) pairs."""
        lows, highs, pairs = [], [], set()
        h = POWERS.hash(POWERS.prefix(data), start, end)
        raw = data.tobytes() if len(start) else b""
        for n, (keys, firsts) in self.sizes.items():
            first, wh = _window_hashes(h, row, n)
            low, high = np.searchsorted(keys, wh), np.searchsorted(keys, wh, side="right")
            known: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(high > low):
                f = int(first[i])
                own = b" ".join([raw[a:b] for a, b in zip(start[f : f + n], end[f : f + n])])
                if own not in known:
                    known[own] = np.unique(self.ids[self.row[[x for x in firsts[low[i] : high[i]] if self.window(x, n) == own]]]).tolist()
                if known[own]:
                    lows.append(f)
                    highs.append(f + n)
                    pairs.update((int(row[f]), item) for item in known[own])
        return np.array(lows, np.int64), np.array(highs, np.int64), sorted(pairs)


def _rows(benchmark: DataFrame) -> DataFrame:
    """item_id (without one a number made of the text) and the text's bytes, of the items that have any."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64(text)).alias("item_id"), F.encode(text, "UTF-8").alias("text")).where("length(text) > 0")


FOUND = ("_words", "_hits", "_items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, size: int = WINDOW) -> DataFrame:
    """docs with three more columns: _words (count), _hits (byte spans start, end alternating) and _items (ids found).

    Words are runs of a-z (after lower-casing A-Z), digits and bytes over 127.
    Null or empty texts have no words; items without words match nothing; an
    item without an id goes by a number made of its text. An empty benchmark
    finds nothing. Repeated rows are scanned each for itself. All columns of
    docs come along; columns of these three names are replaced.

    One block of the benchmark is on the driver and in the executors at a time:
    where there are several, the hits of each scan are stored, and the next
    block takes the place of the last.
    """
    rows = _rows(benchmark)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    out = docs.drop(*FOUND).select("*", F.lit(None).cast("long").alias("_words"), F.lit(None).cast("array<long>").alias("_hits"), F.lit(None).cast("array<long>").alias("_items"))

    def scanned(df: DataFrame, k: int):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Index([(r[0], bytes(r[1])) for r in block.collect()], size))
        return df.transform(in_arrow, _scanner(shared), df.schema), shared

    if blocks == 1:
        return scanned(out, 0)[0]
    slim, parts = with_key(out.select("doc_id", "text", *FOUND)).select(*KEY, "text", *FOUND), []
    for k in range(blocks):
        found, shared = scanned(slim, k)
        parts.append(stored(spark, found.where(F.size("_hits") > 0).select(*KEY, "_hits", "_items"), "hits"))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    counted = with_key(out).drop("_hits", "_items").join(every, KEY, "left")
    empty = F.array().cast("array<long>")
    counted = counted.withColumns({"_hits": F.coalesce("_hits", empty), "_items": F.coalesce("_items", empty)}).select(*out.columns)
    return scanned(counted, blocks)[0]  # no block has that number: counts the words


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in bounded(batches, "text"):
            names = batch.schema.names
            data, offsets = flat(batch.column(names.index("text")))
            data = LOWER[data]
            start, end, row = words(data, offsets, IS_WORD)
            lows, highs, pairs = index.scan(data, start, end, row)
            low, high = merged(lows, highs)  # windows never cross rows; adjoining runs of two rows are cut below
            hits = [list(x) if x else [] for x in (batch.column(names.index("_hits")).to_pylist())]
            items = [list(x) if x else [] for x in (batch.column(names.index("_items")).to_pylist())]
            for a, b in zip(low, high):
                while a < b:
                    r = int(row[a])
                    to = min(int(b), int(np.searchsorted(row, r, side="right")))
                    hits[r] += [int(start[a] - offsets[r]), int(end[to - 1] - offsets[r])]
                    a = to
            for r, item in pairs:
                items[r].append(item)
            n = np.bincount(row, minlength=batch.num_rows) if len(row) else np.zeros(batch.num_rows, np.int64)
            for name, values in (("_words", pa.array(n, pa.int64())), ("_hits", pa.array(hits, pa.list_(pa.int64()))), ("_items", pa.array(items, pa.list_(pa.int64())))):
                k = names.index(name)
                batch = batch.set_column(k, pa.field(name, values.type), values)
            yield batch

    return run


def _joined(spans: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(spans or [], np.int64).reshape(-1, 2)
    return merged(pairs[:, 0], pairs[:, 1])


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def contamination_report(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            data, offsets = flat(batch.column(1))
            rows = []
            for i, (n, hits, items) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                low, high = _joined(hits)
                hit = 0
                if len(low):
                    text = LOWER[data[offsets[i] : offsets[i + 1]]]
                    start, _, _ = words(text, np.array([0, len(text)]), IS_WORD)
                    inside = np.searchsorted(low, start, side="right") - 1
                    hit = int(((inside >= 0) & (start < high[np.maximum(inside, 0)])).sum())
                ids = sorted({str(x) for x in items or []})
                rows.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(REPORT)[1:]))], schema=REPORT)

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_words", "_hits", "_items").transform(in_arrow, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(found: DataFrame, max_share: float = 0.5) -> DataFrame:
    """The documents without their hit spans; one whose hit bytes exceed max_share of its text goes whole.

    The text of a document without hits comes back as it was, a null too.
    n_chars, where there is such a column, follows the new text.
    """
    kept = [f for f in found.schema.fields if f.name not in FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k, hits = names.index("text"), batch.column(names.index("_hits")).to_pylist()
            if any(hits):
                texts, stay = batch.column(k).cast(pa.binary()).to_pylist(), []
                for i, spans in enumerate(hits):
                    low, high = _joined(spans)
                    stay.append(not len(low) or (high - low).sum() <= max_share * len(texts[i]))
                    if len(low) and stay[-1]:
                        raw, at, left = texts[i], 0, []
                        for a, b in zip(low, high):
                            left.append(raw[at:a])
                            at = b
                        texts[i] = b"".join([*left, raw[at:]])
                fresh = pa.array(texts, pa.binary()).cast(batch.schema.field(k).type)
                batch = batch.set_column(k, batch.schema.field(k), fresh).filter(pa.array(stay))
            yield batch.select([f.name for f in kept])

    from pyspark.sql.types import StructType

    out = found.transform(in_arrow, run, StructType(kept))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), spark))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut out of the texts; documents that are mostly passage go."""
    return remove_contamination(find_contamination(docs, table(spark, sf_dir, "benchmark"), spark)).select(*docs.columns)
