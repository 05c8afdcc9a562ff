"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered, encoded once with offsets, and the sorted
spans of its assistant texts are intersected with the token spans by binary
search. Control strings inside texts get a backslash after their first
character (one more where there are some already), which is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, shuffle_partitions, table

#: The template's control strings, without and with backslashes after their first character.
CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>|/?TURN(?=[ \]])|/?\|endoftext\|>|\|(?:endoftext|startoftext)\|>)")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>|/?TURN(?=[ \]])|/?\|endoftext\|>|\|(?:endoftext|startoftext)\|>)")
TURN = re.compile(r"\[TURN ([^\]]*)\](?:\n)|\[/TURN\]\n|<s>|</s>\n")
ROLE = re.compile(r"[\]\\\n%]")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] + m[2] + m[3], text)


def _role(role: str) -> str:
    return ROLE.sub(lambda m: f"%{ord(m[0]):02x}", role)


def _unrole(role: str) -> str:
    return re.sub("%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the assistant texts in it) of (role, text) turns."""
    parts, spans, at = ["<s>"], [], 3
    for role, text in turns:
        head, body = f"[TURN {_role(role)}]\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "[/TURN]\n"]
        at += len(head) + len(body) + 8
    parts.append("</s>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation, control strings undone."""
    turns, role, at = [], None, 0
    for m in TURN.finditer(formatted):
        if m[1] is not None:
            role, at = _unrole(m[1]), m.end()
        elif m[0] == "[/TURN]\n":
            turns.append((role, unescape(formatted[at : m.start()])))
    return turns


def loss_spans(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the spans that tokens cover, as (starts, ends): the text under the loss mask.

    tokens: rows (start, end). Both are sorted. For each span the tokens that
    meet it are found by binary search and cut to it; parts of one span that
    touch or overlap (a character of several tokens) become one.
    """
    if not spans or not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = tokens[:, 0], np.maximum.accumulate(tokens[:, 1])
    low, high = [], []
    for a, b in spans:
        first, last = np.searchsorted(end, a, side="right"), np.searchsorted(start, b, side="left")
        if first >= last:
            continue
        s, e = np.maximum(start[first:last], a), np.minimum(end[first:last], b)
        new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
        low.append(s[new])
        high.append(e[np.concatenate((new[1:] - 1, [len(e) - 1]))])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(low or none), np.concatenate(high or none)


class Formatter:
    """Formats conversations with one tokenizer: text, token mask and what is under the mask."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def format(self, turns: list[tuple[str, str]]) -> dict:
        """formatted, n_tokens, n_loss_tokens, and the loss text unescaped, all read back from the formatted text."""
        formatted, spans = render(turns)
        tokens = np.array(self.own.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        low, high = loss_spans(tokens, spans)
        text, k = [], 0
        for a, b in spans:
            part = []
            while k < len(low) and low[k] < b:
                part.append(formatted[low[k] : high[k]])
                k += 1
            text.append(unescape("".join(part)))
        at = np.searchsorted(high, tokens[:, 0], side="right")
        inside = at < len(low)
        n_loss = int((low[at[inside]] < tokens[inside, 1]).sum())
        return {"formatted": formatted, "n_tokens": len(tokens), "n_loss_tokens": n_loss, "loss": "".join(text)}


OUT = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64()), ("formatted", pa.string())]
)
DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long, formatted string"


def format_chats(turns: DataFrame, tokenizer: str, spark: SparkSession) -> DataFrame:
    """One row per conversation: its formatted text, counts, and digests read back from the output.

    Rows of a conversation are ordered by turn (null first), then role, then
    text; repeated rows are turns of their own. A null text is empty, a null
    role is the empty role; a row with a null conv_id is a conversation of its
    own. Where there is a column `part`, rows of one conv_id but several parts
    are several conversations. An empty table gives an empty result; other
    columns are not read. The sorted rows stream through a task, which holds
    one conversation at a time and encodes it whole.
    """

    def row(formatter: Formatter, conv, held) -> tuple:
        out = formatter.format(held)
        back = parse(out["formatted"])
        seen = hashlib.sha256()
        for role, text in back:
            seen.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss = out["loss"]
        return conv, len(back), seen.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out["formatted"]), out["n_tokens"], out["n_loss_tokens"], out["formatted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, rows, conv, held, size = Formatter(tokenizer), [], (None, 0), [], 0
        for batch in batches:
            for *c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if held and (c != conv or c[0] is None):
                    rows.append(row(formatter, conv[0], held))
                    size += len(rows[-1][-1])
                    held = []
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                conv = c
                held.append((role, text))
        if held:
            rows.append(row(formatter, conv[0], held))
        if rows:
            yield _rows(rows)

    part = F.col("part") if "part" in turns.columns else F.lit(0)
    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), part.cast("string").alias("part"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = picked.repartition(shuffle_partitions(spark), F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.transform(in_arrow, run, DDL)


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, which is its own even if the table has a conversation -1."""
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit("given").alias("part"))
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]", "added"), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "added")], "conv_id long, turn long, role string, text string, part string")
    return format_chats(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"), spark).drop("formatted")
