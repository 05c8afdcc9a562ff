"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (n = 1, 2, 3 bytes of the
folded text) that both contain, whatever their counts, over the root of the
product of their own numbers: the blended presence spectrum. Nyström landmarks
turn it into a short feature vector, and one-versus-rest ridge regression in
that space gives a score per language. Both are linear in the presence of the
landmarks' n-grams, so a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, flat, in_arrow, table

#: Bound of the labelled sample: about so many texts of each language.
PER_LANGUAGE = 300
LANDMARKS = 96
#: Texts scored by one product.
ROWS = 128
RIDGE = 1e-2
LETTER = re.compile(r"[^\W\d_]")
N = (1, 2, 3)

#: The symbol of each byte: letters without case, bytes over 127, and one for all others.
SYMBOL = np.zeros(256, dtype=np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
SYMBOLS = 155


def _codes(symbols: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each symbol, as a number under SYMBOLS ** n."""
    m = len(symbols) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32)
    out = symbols[:m].copy()
    for k in range(1, n):
        out = out * SYMBOLS + symbols[k : k + m]
    return out


def distinct(symbols: np.ndarray, scratch: np.ndarray) -> list[np.ndarray]:
    """For each n the distinct n-grams of one text. scratch: SYMBOLS ** 3 numbers of any value."""
    out = []
    for n in N:
        codes = _codes(symbols, n)
        place = np.arange(len(codes), dtype=np.int32)
        scratch[codes] = place  # the last place of each n-gram stays
        out.append(codes[scratch[codes] == place])
    return out


def presence(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], width: int, scratch: np.ndarray) -> np.ndarray:
    """Rows over the tables' n-grams: 1 over the root of the text's number of distinct n-grams, where the text has the n-gram."""
    symbols, out = SYMBOL[data], np.zeros((len(offsets) - 1, width), dtype=np.float32)
    for k in range(len(out)):
        own = distinct(symbols[offsets[k] : offsets[k + 1]], scratch)
        total = sum(map(len, own))
        for codes, t in zip(own, tables):
            ids = t[codes]
            out[k, ids[ids >= 0]] = 1 / np.sqrt(max(total, 1))
    return out


def numbered(grams: list[np.ndarray]) -> list[np.ndarray]:
    """For each n a table from n-gram to its column, -1 for none."""
    tables, base = [], 0
    for n, own in zip(N, grams):
        t = np.full(SYMBOLS**n, -1, dtype=np.int32)
        t[own] = np.arange(base, base + len(own))
        base += len(own)
        tables.append(t)
    return tables


@dataclass
class Model:
    """languages; per n the n-grams of the landmarks; n-grams x languages."""

    languages: list[str]
    grams: list[np.ndarray]
    weights: np.ndarray

    def __post_init__(self):
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self._tables is None:
            self._tables, self._scratch = numbered(self.grams), np.zeros(SYMBOLS**3, np.int32)
        return presence(data, offsets, self._tables, len(self.weights), self._scratch) @ self.weights


def fit_texts(texts: list[bytes], labels: list[str], seed: int = 7) -> Model | None:
    """A model of the labelled texts; None without any."""
    if not texts:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    each = max(1, LANDMARKS // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:each] for k in range(len(languages))])
    scratch = np.zeros(SYMBOLS**3, np.int32)
    own = [distinct(SYMBOL[np.frombuffer(texts[k], np.uint8)], scratch) for k in chosen]
    grams = [np.unique(np.concatenate([o[n] for o in own])) for n in range(len(N))]
    tables, width = numbered(grams), sum(map(len, grams))
    landmarks = presence(*flat(pa.array([texts[k] for k in chosen], pa.binary())), tables, width, scratch)
    cross = np.concatenate([presence(*flat(pa.array(texts[at : at + ROWS], pa.binary())), tables, width, scratch) @ landmarks.T for at in range(0, len(texts), ROWS)]).astype(np.float64)
    value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, good] / np.sqrt(value[good])
    phi = cross @ root
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, 0.0)
    gram = phi.T @ (phi * weight[:, None]) + RIDGE / max(len(languages), 1) * np.eye(phi.shape[1])
    dual = root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return Model(languages, grams, landmarks.T @ dual.astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from a hash-chosen sample of about per_language texts of each non-null lang.

    Rows whose crc32(doc_id) mod 4 is 2 are never read for it, nor are null ids.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(per_language) / n)])
    picked = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    sample = sorted((r[0], r[1], bytes(r[2])) for r in picked.select("doc_id", "lang", F.encode("text", "UTF-8")).collect())
    return fit_texts([t for *_, t in sample], [lang for _, lang, _ in sample])


def predict(docs: DataFrame, model: Model | None, spark: SparkSession) -> DataFrame:
    """docs with lang_pred and score (0 to 1); a text that is null or has no letter is `und` with score 0.

    Without a model (no labelled row) every text is `und`. Columns of these
    names are replaced; all other columns come along. Repeated rows and rows
    without an id are each judged for themselves; an empty table gives an empty
    result. Whole texts are read.
    """
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for big in bounded(batches, "text"):
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                text = batch.column(batch.schema.get_field_index("text"))
                letters = np.array([bool(t and LETTER.search(t)) for t in text.to_pylist()])
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                if model is not None and letters.any():
                    s = model.scores(*flat(text))
                    best = s.argmax(axis=1)
                    pred = [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(s[np.arange(len(best)), best], 0, 1), 0).astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.transform(in_arrow, run, StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs), spark)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A text is rejected if it has no letter, or if no language scores so much.
LEAST_SCORE = 0.2


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter (so null and empty texts) or without a language that scores LEAST_SCORE go; an empty table stays empty."""
    return predict(docs, fit(docs), spark).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)
