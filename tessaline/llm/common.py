"""Helpers shared by the training-data operators.

Byte-level work is done on the Arrow buffers of a text column: one flat uint8
array for a batch of documents plus the offsets of its rows, so that hashing
runs as a handful of NumPy passes and never as a Python loop over bytes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one is set on one machine, and an error raised on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        else:
            folder = f"file://{tempfile.mkdtemp(prefix='tessaline-')}"
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Columns of a row's key.
KEY = ["__key", "__tag"]


def with_key(docs: DataFrame) -> DataFrame:
    """docs with the columns KEY: the doc_id (for a null id a hash of the text) and another hash of the text.

    Rows of one key are repeated rows: same doc_id, same text. Rows that share a
    doc_id with different texts, or have none, stay apart. The key is made of
    the row alone, so it is the same whenever and wherever it is computed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), "__tag": F.xxhash64(F.lit(0x7465737361), text)})


def without_rows(docs: DataFrame, gone: DataFrame, once: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone, and with one row of each key in once (both small tables of KEY, stored)."""
    keyed = with_key(docs)
    out = keyed.join(gone.unionByName(once), KEY, "left_anti")
    if not once.isEmpty():
        out = out.unionByName(keyed.join(once, KEY, "left_semi").dropDuplicates(KEY))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: A key of a join that more than 1/HOT of the rows have goes by broadcast; there are fewer than HOT of them.
HOT = 10_000


def join_evenly(left: DataFrame, right: DataFrame, on: str, weight: str, spread: list[str]) -> DataFrame:
    """left joined with right (left outer; right has each `on` once and, as `weight`, how many rows of left have it, or more).

    The rows of right that more than 1/HOT of all rows have, fewer than HOT of
    them, are broadcast, so that no task gets all rows of a hot key; the others
    meet in a shuffle, where rows that have their match already, or a null, are
    dealt out by the columns `spread`. right should be stored: it is read three times.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in right.columns if c not in (on, weight)]
    hot = F.col(weight) * HOT > F.lit(total)
    many = right.where(hot).select(F.col(on), F.lit(True).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in values])
    few = right.where(~hot).select(F.col(on).alias("__on"), F.lit(0).cast("long").alias("__salt"), *values)
    marked = left.join(F.broadcast(many), on, "left")
    marked = marked.withColumn("__own", F.when(F.col("__hot") | F.col(on).isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    met = marked.join(few, (F.col(on) == F.col("__on")) & (F.col("__own") == F.col("__salt")), "left")
    return met.select(*left.columns, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in values])


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their text holds about max_bytes; a longer single text is a batch of its own."""
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty. offsets[0] is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.n = base, 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n <= self.n:
            return
        n = max(n, self.n * 2)
        inverse = pow(self.base, -1, 1 << 64)
        for name, b in (("up", self.base), ("down", inverse)):
            out = np.full(n, U64(b), dtype=np.uint64)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))
        self.n = n

    def shrink(self) -> None:
        """Back to a short table, if a long text has made it long."""
        n = 1 << 16
        if self.n > n:
            self.up, self.down, self.n = self.up[:n].copy(), self.down[:n].copy(), n

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """P with P[j] - P[i] = sum of (byte + 1) * base^position over [i, j)."""
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hash(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes in [start, end), the same wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * U64(0x2545F4914F6CDD1D))


POWERS = Powers()


#: The four largest primes under 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103527590, 1597463007, 741103597, 2027808453)
FIELD_BLOCK = 1 << 18


class Fields:
    """Polynomial hashes in four prime fields. Two strings of n bytes that differ agree in one field for at most n of its 2^31 bases."""

    def __init__(self):
        self.n, self.tables = 0, []

    def powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per field the powers of its base and of the inverse, n of them at least."""
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.tables = [tuple(self._powers(b, p) for b in (base, pow(base, -1, p))) for base, p in zip(BASES, PRIMES)]
        return self.tables

    def _powers(self, base: int, p: int) -> np.ndarray:
        out, k = np.ones(self.n, np.uint64), 1
        while k < self.n:
            m = min(k, self.n - k)
            out[k : k + m] = out[:m] * U64(pow(base, k, p)) % U64(p)
            k *= 2
        return out.astype(np.uint32)

    def hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes in each [start, end), of two fields each; start and end in ascending order. Works in blocks of the data."""
        one, two, at = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + FIELD_BLOCK, side="right")))
            low = int(start[at])
            piece = data[low : int(end[to - 1])].astype(np.uint64) + U64(1)
            s, e = start[at:to] - low, end[at:to] - low
            found = []
            for (up, down), p in zip(self.powers(len(piece) + 1), PRIMES):
                term = piece * up[: len(piece)]
                if len(piece) > 1 << 24:
                    term %= U64(p)
                total = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(term, out=total[1:])
                found.append((total[e] - total[s]) % U64(p) * down[s] % U64(p))
            size = (e - s).astype(np.uint64)
            one[at:to] = mix(((found[0] << U64(32)) | found[1]) ^ mix(size + U64(1)))
            two[at:to] = mix(((found[2] << U64(32)) | found[3]) ^ mix(size + U64(2)))
            at = to
        return one, two


FIELDS = Fields()


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; runs never cross rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... start + length - 1."""
    if not len(starts):
        return np.zeros(0, np.int64)
    total = np.cumsum(lengths)
    return np.arange(total[-1]) - np.repeat(total - lengths, lengths) + np.repeat(starts, lengths)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]


def release() -> None:
    """Give memory that is no longer used back to the system: workers live on and serve other stages."""
    POWERS.shrink()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """A function over batches that releases its memory at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


#: Bytes of an Arrow batch on its way to a Python worker. Spark's default of 64 MB is several hundred MB of an executor beside its heap.
ARROW_BYTES = 2 << 20


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(tidy(run), schema), with batches of at most about ARROW_BYTES.

    The plan runs later, so the setting stays in the session; one that is lower already is left alone.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    size = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if size <= 0 or size > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(tidy(run), schema)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array,)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
