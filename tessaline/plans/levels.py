"""The reference of a rank too large to go along inside a plan: a file of sorted values that every executor maps."""

from __future__ import annotations

import atexit
import base64
import hashlib
import os
import shutil
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 16  # levels in a block on the way to the driver
_DIR: list[str] = []
_SENT: set[tuple[str, str]] = set()
_MAPPED: dict[str, np.ndarray] = {}


def _dir() -> str:
    if not _DIR:
        _DIR.append(tempfile.mkdtemp(prefix="levels"))
        atexit.register(shutil.rmtree, _DIR[0], ignore_errors=True)
    return _DIR[0]


class Levels:
    """Distinct values in order, each with the number of reference rows below it, in a file of 16 bytes a value.

    Takes the place of Feature.values. The driver holds a block at a time; an
    executor has the file once on its disk and maps it.
    """

    def __init__(self, path: str, digest: str, size: int, total: float):
        self.path, self.digest, self.size, self.total = path, digest, size, total

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[float]:
        with open(self.path, "rb") as f:
            for part in iter(lambda: f.read(16 * BLOCK), b""):
                yield from np.frombuffer(part, "<f8")[::2].tolist()

    def __hash__(self) -> int:
        return int(self.digest[:15], 16)

    def __eq__(self, other) -> bool:
        return isinstance(other, Levels) and self.digest == other.digest

    def sent(self, spark: SparkSession) -> "Levels":
        """Itself, once its file goes to the executors of this session."""
        key = (spark.sparkContext.applicationId, self.digest)
        if key not in _SENT:
            spark.sparkContext.addFile(self.path)
            _SENT.add(key)
        return self

    def to_json(self) -> dict:
        with open(self.path, "rb") as f:
            parts = iter(lambda: f.read(16 * BLOCK), b"")
            return {"total": self.total, "blocks": [base64.b64encode(zlib.compress(p, 1)).decode() for p in parts]}


def write_levels(blocks: Iterable[bytes], total: float | None = None) -> Levels:
    """blocks: records (value, rows below) of two little-endian doubles; with no total, (value, rows of it)."""
    whole, run, size = hashlib.sha256(), 0.0, 0
    handle, path = tempfile.mkstemp(dir=_dir())
    with os.fdopen(handle, "wb") as f:
        for block in blocks:
            rows = np.frombuffer(block, "<f8").reshape(-1, 2).copy()
            if total is None:
                after = run + np.cumsum(rows[:, 1])
                rows[:, 1], run = np.concatenate(([run], after[:-1])), after[-1]
            size += len(rows)
            whole.update(rows.tobytes())
            f.write(rows.tobytes())
    total = run if total is None else total
    whole.update(np.float64(total).tobytes())
    final = f"{_dir()}/levels_{whole.hexdigest()}"
    os.replace(path, final)
    return Levels(final, whole.hexdigest(), size, float(total))


def levels_from_json(spec: dict) -> Levels:
    return write_levels((zlib.decompress(base64.b64decode(b)) for b in spec["blocks"]), spec["total"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, n = (c.to_numpy(zero_copy_only=False).astype("<f8") for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([np.stack((x[a : a + BLOCK], n[a : a + BLOCK]), axis=1).tobytes() for a in range(0, len(x), BLOCK)], pa.binary())], names=["block"])


def collect_levels(counts: DataFrame) -> Levels:
    """counts: columns (value, rows of it), sorted by range partitions and read one partition at a time."""
    value, n = counts.columns
    packed = counts.select(F.col(value).cast("double").alias("x"), F.col(n).cast("double").alias("n")).orderBy("x").mapInArrow(_pack, "block binary")
    return write_levels(r[0] for r in packed.toLocalIterator())


def below(path: str, digest: str, x: np.ndarray) -> np.ndarray:
    """The reference rows below each x, where -1 stands for all of them. Runs on executors."""
    if digest not in _MAPPED:
        own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _MAPPED[digest] = np.memmap(own, "<f8", "r").reshape(-1, 2)
    rows = _MAPPED[digest]
    at = np.searchsorted(rows[:, 0], x, side="left")
    out = np.full(len(x), -1.0)
    inside = at < len(rows)
    out[inside] = rows[at[inside], 1]
    return out
