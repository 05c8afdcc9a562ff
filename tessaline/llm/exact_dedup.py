"""Exact deduplication by Grace hashing.

Map tasks first fold equal texts of their own rows (a hot group shrinks to one
record a task), then the records are dealt by a hash of the normalised text.
Each task of that exchange is a Grace partition: while a partition is larger
than the memory allowed, it is split by further hash bits into spill files in
the task's temporary folder; a bucket that fits goes through an open-addressing
table that compares complete contents. The verdicts join back by digest.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, LOWER_BYTES, in_arrow, join_evenly, shuffle_partitions, stored, table, with_key, without_rows

LOCAL_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20
FANOUT = 16
LEVELS = 16  # 64 hash bits; what still shares a bucket then has one hash value


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.hashes: list[int] = []
        self.texts: list[bytes] = []

    def find(self, key: int, text: bytes) -> int:
        """The entry of the text, made if it is new."""
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.hashes.append(key)
        self.texts.append(text)
        if 3 * len(self.texts) > 2 * len(self.slots):
            self._grow()
        return len(self.texts) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


class Groups:
    """The distinct texts seen, with the largest id and the number of rows of each."""

    def __init__(self) -> None:
        self.content, self.top, self.n, self.bytes = ContentTable(), [], [], 0

    def add(self, key: int, text: bytes, top: int, n: int) -> None:
        entry = self.content.find(key, text)
        if entry == len(self.top):
            self.top.append(top)
            self.n.append(n)
            self.bytes += len(text) + 96
        else:
            self.top[entry] = max(self.top[entry], top)
            self.n[entry] += n

    def records(self) -> Iterator[tuple[int, bytes, int, int]]:
        return zip(self.content.hashes, self.content.texts, self.top, self.n)


LEAST = -(1 << 63)
RECORD = struct.Struct("<QqqI")
PARTIAL = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])
VERDICT = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = Groups()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text = (text or b"").translate(LOWER_BYTES)
            groups.add(xxhash.xxh3_64_intdigest(text), text, LEAST if doc is None else doc, 1)
        if groups.bytes > LOCAL_BYTES:
            yield _partial(groups)
            groups = Groups()
    yield _partial(groups)


def _partial(groups: Groups) -> pa.RecordBatch:
    keys = np.array(groups.content.hashes, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(groups.content.texts, pa.binary()), pa.array(groups.top, pa.int64()), pa.array(groups.n, pa.int64())], schema=PARTIAL)


def grace(records: Iterator[tuple[int, bytes, int, int]], limit: int, level: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """The groups of the records. Over limit bytes of distinct texts they are split to spill files by four more hash bits."""
    groups = Groups()
    for r in records:
        groups.add(*r)
        if groups.bytes > limit and len(groups.top) > 1 and level < LEVELS:
            break
    else:
        yield from groups.records()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(os.path.join(folder, str(i)), "wb") for i in range(FANOUT)]
        for key, text, top, n in itertools.chain(groups.records(), records):
            files[(key >> (60 - 4 * level)) % FANOUT].write(RECORD.pack(key, top, n, len(text)) + text)
        del groups
        for f in files:
            f.close()
        for f in files:
            yield from grace(_spilled(f.name), limit, level + 1)
            os.unlink(f.name)


def _spilled(path: str) -> Iterator[tuple[int, bytes, int, int]]:
    with open(path, "rb", 1 << 20) as f:
        while head := f.read(RECORD.size):
            key, top, n, size = RECORD.unpack(head)
            yield key, f.read(size), top, n


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            yield from zip((int(x) for x in b.column(0).to_numpy().view(np.uint64)), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())

    rows: list[tuple[bytes, int, int]] = []
    for _, text, top, n in grace(records(), BUCKET_BYTES):
        rows.append((hashlib.sha256(text).digest(), top, n))
        if len(rows) >= 20_000:
            yield _verdicts(rows)
            rows = []
    if rows:
        yield _verdicts(rows)


def _verdicts(rows) -> pa.RecordBatch:
    digest, top, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([None if t == LEAST else t for t in top], pa.int64()), pa.array(n, pa.int64())], schema=VERDICT)


def verdicts(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per input row: KEY, doc_id, digest, keep_id, group_size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial = rows.transform(in_arrow, _local, "h long, content binary, top long, n long")
    found = stored(spark, partial.repartition(shuffle_partitions(spark), "h").transform(in_arrow, _buckets, "digest binary, keep_id long, group_size long"), "groups")
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = with_key(rows).select(*KEY, "doc_id", F.unhex(F.sha2(F.encode(lower, "UTF-8"), 256)).alias("digest"))
    return join_evenly(keyed, found.withColumn("_n", F.col("group_size")), "digest", "_n", KEY)


def exact_dedup(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text is the
    empty text, and empty texts form one group. The largest doc_id of a group
    stays; null ids come after all others, and a group of null ids only keeps
    null as keep_id and all its rows. Repeated rows (one id twice) count twice
    and are all kept or all dropped. Rows that share a doc_id with different
    texts are judged each by its own text. An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    return verdicts(docs, spark).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), spark)


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts, with its columns as they came.

    It is a row with the largest doc_id (a null id only if the group has no
    other); of several such rows, one. The decision is by row, so rows that
    share a doc_id with different texts do not take each other down. A null
    text is the empty text. An empty table stays empty.
    """
    rows = stored(spark, verdicts(docs, spark).select(*KEY, "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("best")), "verdicts")
    several = rows.where("best").groupBy("digest").agg(F.min("__tag").alias("_tag"), F.count("*").alias("_n")).where("_n > 1")
    ties = rows.where("best").join(several, "digest")
    gone = rows.where("not best").select(*KEY).unionByName(ties.where("__tag <> _tag").select(*KEY)).distinct()
    once = ties.where("__tag = _tag").select(*KEY).distinct()
    return without_rows(docs, stored(spark, gone, "gone"), stored(spark, once, "once"))
