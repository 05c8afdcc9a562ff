"""Token counts by batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes, and long texts are cut at safe boundaries:
before single spaces that stand between two characters that are not white
space, where the pre-tokenizer always starts a new piece. The segments of a
batch are encoded in one call. Texts of plain characters go through the batch
encoder of the rank table of the same vocabulary, any other text through the
tokenizer file's own library; tests hold both to the latter on whole texts.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_arrow, record_batch, table

#: Letters up to Latin Extended-B and general punctuation: every library agrees on their classes.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a0-\\u024f\\u2010-\\u2027]*")
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
SEGMENT = 1 << 16  # characters of a segment, about
#: Fixed value: the pre-token pattern of byte-level BPE.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def segments(text: str) -> Iterator[str]:
    """The text in parts of about SEGMENT characters whose tokens are those of the whole."""
    at = 0
    while len(text) - at > SEGMENT and (cut := BOUNDARY.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class ByteLevelCounter:
    """Counts the tokens of texts for a byte-level BPE tokenizer file, as its library does by default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(self.own.to_str())["added_tokens"]]
        self.ranks, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=table, special_tokens={})

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain: list[tuple[int, str]] = []
        other: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            to = plain if self.ranks and PLAIN.fullmatch(t) and not any(s in t for s in self.special) else other
            to += [(i, s) for s in segments(t)]
        if plain:
            for (i, _), ids in zip(plain, self.ranks.encode_ordinary_batch([s for _, s in plain], num_threads=1)):
                out[i] += len(ids)
        if other:
            for (i, _), e in zip(other, self.own.encode_batch_fast([s for _, s in other], add_special_tokens=False)):
                out[i] += len(e)
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted
    each for itself, an empty table gives an empty result, columns other than
    doc_id and text are not read. Whole texts are encoded, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ByteLevelCounter(tokenizer)
        for batch in bounded(batches, "text"):
            text = batch.column(1)
            n = counter.counts(text.fill_null("").to_pylist())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield record_batch(OUT, batch.column(0), size, n, [x > limit for x in n])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
