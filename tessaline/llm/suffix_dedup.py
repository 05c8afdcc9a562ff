"""Removal of repeated byte strings by a distributed, sparse suffix array.

A string of LENGTH bytes that repeats has the same anchor (the position of the
least hash of K bytes inside it) in every place, so only the suffixes at
anchors matter, about one byte in fifty, and each answers for the windows whose
anchor it is. Three steps:

1. Fingerprints of the anchors' K bytes are counted. Anchors whose fingerprint
   is unique go; a fingerprint decides nothing else.
2. Map tasks sort the suffixes at the other anchors into runs, front-code them
   (the length of the prefix shared with the suffix before, and the rest), and
   deal the runs by fingerprint. What a run holds twice, byte for byte, is
   covered there and goes on once. Loser trees that carry common-prefix lengths
   merge the runs without comparing a known prefix again. From the merged
   order's common prefixes, to the right and likewise to the left of the
   anchor, follows which windows are equal.
3. The covered spans come back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, POWERS, U64, bounded, flat, in_arrow, merged, mix, shuffle_partitions, table, with_key

LENGTH = 200
K = 100
WIDTH = LENGTH - K + 1
FLUSH = 1_000_000
RUN_SIZE = 100_000
#: Bits of an anchor on its way, from the top: its first window, how far the anchor is from there, how many windows follow, its bucket.
BACK_BITS, REACH_BITS, BUCKET_BITS = 7, 7, 18
#: The key of a document on its way: its two columns side by side.
DOC = np.dtype([("key", "<i8"), ("tag", "<i8")])


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """The first two columns of a batch as DOC."""
    out = np.empty(batch.num_rows, DOC)
    out["key"], out["tag"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, fingerprint): for each anchor the windows [first, last] that it answers for.

    Positions count from the start of the data. fingerprint is of the K bytes at the anchor.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.view(np.uint64)
    prefix = POWERS.prefix(data)
    m = len(data) - K + 1
    h = mix((prefix[K : K + m] - prefix[:m]) * POWERS.down[:m])
    low = (h & ~U64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n], low[WIDTH - 64 : WIDTH - 64 + n])
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)
    # A window must end within its row.
    ok = np.zeros(n + 1, bool)
    size = np.diff(offsets)
    for a, b in zip(offsets[:-1][size >= LENGTH], offsets[1:][size >= LENGTH]):
        ok[a : b - LENGTH + 1] = True
    ok = ok[:n]
    start = np.flatnonzero(ok & np.concatenate(([True], ~ok[:-1] | (at[1:] != at[:-1]))))
    stop = np.flatnonzero(ok & np.concatenate((~ok[1:] | (at[1:] != at[:-1]), [True])))
    # Rows that adjoin: a row's last window and the next row's first are never neighbours, as LENGTH - 1 starts lie between.
    anchor = at[start]
    return np.searchsorted(offsets, start, side="right") - 1, anchor, start, stop, h[anchor]


HEAD = "part int, blob binary"


def _shares(n: int, parts: int) -> Iterator[tuple[int, slice]]:
    """n rows that need not meet others, dealt evenly over the parts."""
    cut = np.arange(parts + 1) * n // parts
    for part, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if a < b:
            yield part, slice(a, b)


def _deal(parts: int):
    """Step 1, map side. One anchor of each fingerprint of a flush is dealt by it; the others repeat and go anywhere."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, place, mark = (np.concatenate(x) for x in zip(*held))
        part = (mix(mark ^ U64(0x5851F42D4C957F2D)) % U64(parts)).astype(np.int64)
        order = np.lexsort((mark, part))
        doc, place, mark, part = (x[order] for x in (doc, place, mark, part))
        again = np.concatenate(([False], mark[1:] == mark[:-1]))
        many = np.concatenate((again[1:], [False]))[~again].astype("u1")
        known_doc, known_place = doc[again], place[again]
        known = dict(_shares(len(known_doc), parts))
        doc, place, mark, part = (x[~again] for x in (doc, place, mark, part))
        cut = np.searchsorted(part, np.arange(parts + 1))
        ids, blobs = [], []
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            r = known.get(p, slice(0, 0))
            if a < b or r.start < r.stop:
                blob = [np.array([b - a, r.stop - r.start], "<u4"), mark[a:b], doc[a:b], place[a:b], many[a:b], known_doc[r], known_place[r]]
                ids.append(p)
                blobs.append(b"".join(x.tobytes() for x in blob))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in bounded(batches, "text"):
            data, offsets = flat(batch.column(2))
            row, anchor, first, last, mark = anchors(data, offsets)
            if len(row):
                place = (first - offsets[row]) << BACK_BITS | (anchor - first)
                place = place << REACH_BITS | (last - first)
                place = place << BUCKET_BITS | (mark & U64((1 << BUCKET_BITS) - 1)).astype(np.int64)
                held.append((keys_of(batch)[row], place, mark))
                count += len(row)
            if count >= FLUSH:
                yield from pack(held)
                held, count = [], 0
        if held:
            yield from pack(held)

    return run


EDGES = pa.schema([("__key", pa.int64()), ("__tag", pa.int64()), ("place", pa.int64())])


def _edges(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc["key"]), pa.array(doc["tag"]), pa.array(place)], schema=EDGES)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, reduce side: the anchors whose fingerprint is not unique."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, known = (int(x) for x in np.frombuffer(blob, "<u4", 2))
            at = 8 + 33 * n
            if known:
                yield _edges(np.frombuffer(blob, DOC, known, at), np.frombuffer(blob, "<i8", known, at + 16 * known))
            if n:
                blobs.setdefault(part, []).append(blob[:at])
    for part in sorted(blobs):
        columns: list[list] = [[] for _ in range(4)]
        for blob in blobs.pop(part):
            n, at = int(np.frombuffer(blob, "<u4", 1)[0]), 8
            for column, kind in zip(columns, ("<u8", DOC, "<i8", "u1")):
                column.append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
        mark, doc, place, many = (np.concatenate(c) for c in columns)
        _, group, size = np.unique(mark, return_inverse=True, return_counts=True)
        go = (many > 0) | (size[group] > 1)
        if go.any():
            yield _edges(doc[go], place[go])


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the longest common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return at + (n - at) - (x.bit_length() + 7) // 8


def front_code(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(shared, rest) of a sorted run."""
    shared, rest, before = [], [], b""
    for s in run:
        k = common_prefix(before, s)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return shared, rest


class Run:
    """A front-coded sorted run, read in order: text, and what it shares with the text before."""

    def __init__(self, shared, rest, number: int):
        self.shared, self.rest, self.number, self.at, self.text, self.lcp = shared, rest, number, -1, b"", 0
        self.step()

    def step(self) -> None:
        self.at += 1
        if self.at < len(self.shared):
            self.lcp = self.shared[self.at]
            self.text = self.text[: self.lcp] + self.rest[self.at]
        else:
            self.text = None


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, text, prefix shared with the text before) in sorted order, by a loser tree.

    A waiting run keeps what its text shares with the last winner. Of two texts
    that share more and less with it the former is smaller, and only at a tie
    are characters compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    losers: list[Run | None] = [None] * size

    def duel(a: Run | None, b: Run | None) -> tuple[Run | None, Run | None]:
        """(winner, loser); the loser's lcp becomes what it shares with the winner."""
        if a is None or a.text is None:
            return b, a
        if b is None or b.text is None:
            return a, b
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        k = common_prefix(a.text, b.text, a.lcp)
        x, y = a.text, b.text
        first = (k == len(x)) if k == len(x) or k == len(y) else x[k] < y[k]
        if k == len(x) == len(y):
            first = a.number < b.number
        winner, loser = (a, b) if first else (b, a)
        loser.lcp = k
        return winner, loser

    def build(node: int) -> Run | None:
        if node >= size:
            return runs[node - size] if node - size < len(runs) else None
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    for r in runs:
        r.lcp = 0
    top = build(1) if size > 1 else (runs[0] if runs else None)
    while top is not None and top.text is not None:
        yield top.number, top.at, top.text, top.lcp
        node = size + top.number
        top.step()  # its lcp is with the winner that just left
        while node > 1:
            node //= 2
            top, losers[node] = duel(top, losers[node])


RUN = "part int, blob binary"


def _runs(parts: int):
    """Step 2, map side: key, edges and text of a document -> sorted, front-coded runs of the suffixes at the edges.

    A suffix that the run holds again, with the same bytes to its left, goes on
    once and marked; where it stands is covered and goes to any part.
    """

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for entry in held:
            by_part.setdefault(entry[0], []).append(entry)
        runs: dict[int, list[bytes]] = {}
        covered: list[tuple] = []
        for part, entries in by_part.items():
            entries.sort(key=lambda e: (e[1], e[2]))
            kept, many = [], []
            for e in entries:
                if kept and e[1] == kept[-1][1] and e[2] == kept[-1][2]:
                    if not many[-1]:
                        many[-1] = 1
                        covered.append(kept[-1])
                    covered.append(e)
                else:
                    kept.append(e)
                    many.append(0)
            shared, rest = front_code([e[1] for e in kept])
            left = [e[2] for e in kept]
            numbers = [np.array([len(kept)], "<u4"), np.array(shared, "u1"), np.array([len(r) for r in rest], "<u2"), np.array([len(x) for x in left], "u1"), np.array([e[3] for e in kept], DOC), np.array([e[4] for e in kept], "<u4"), np.array([e[5] for e in kept], "u1"), np.array(many, "u1")]
            runs[part] = [*(x.tobytes() for x in numbers), *rest, *left]
        doc, low, high = np.array([e[3] for e in covered], DOC), np.array([e[4] for e in covered], np.int64), np.array([e[4] + e[5] + LENGTH for e in covered], np.int64)
        order = np.lexsort((low, doc["tag"], doc["key"]))
        doc, low, high = doc[order], low[order], high[order]
        # An anchor's windows come after those of the anchor before it: both ends ascend within a document.
        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])))) if len(doc) else np.zeros(0, np.int64)
        doc, span = doc[head], low[head] << 32 | high[np.append(head[1:], len(doc)) - 1] if len(head) else low
        known = dict(_shares(len(doc), parts))
        ids, blobs = [], []
        for part in sorted({*runs, *known}):
            r = known.get(part, slice(0, 0))
            ids.append(part)
            blobs.append(b"".join([np.array([r.stop - r.start], "<u4").tobytes(), doc[r].tobytes(), span[r].tobytes(), *runs.get(part, ())]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for key, tag, edges, text in zip(*(batch.column(k) for k in range(4))):
                doc, raw = (key.as_py(), tag.as_py()), text.as_py().encode()
                place = edges.values.to_numpy()
                part = (place & ((1 << BUCKET_BITS) - 1)) % parts
                place = place >> BUCKET_BITS
                reach, place = place & ((1 << REACH_BITS) - 1), place >> REACH_BITS
                back, first = place & ((1 << BACK_BITS) - 1), place >> BACK_BITS
                for p, f, b, r in zip(part.tolist(), first.tolist(), back.tolist(), reach.tolist()):
                    held.append((p, raw[f + b : f + r + LENGTH], raw[f : f + b][::-1], doc, f, r))
                    if len(held) >= RUN_SIZE:
                        yield from pack(held)
                        held = []
        if held:
            yield from pack(held)

    return run


SPANS = pa.schema([("__key", pa.int64()), ("__tag", pa.int64()), ("span", pa.int64())])


def _spans(doc: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """Spans as start << 32 | end."""
    return pa.RecordBatch.from_arrays([pa.array(doc["key"]), pa.array(doc["tag"]), pa.array(span)], schema=SPANS)


def equal_windows(right_lcp: np.ndarray, left: list[bytes], first_of_group: np.ndarray, back: np.ndarray, reach: np.ndarray, many: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each distance d of a window start before the anchor, (d, entries whose window there is repeated).

    Entries are in the order of their right parts; right_lcp is what each
    shares with the one before. Two windows at distance d are equal if the
    right parts share LENGTH - d bytes and the left parts d.
    """
    n = len(left)
    group = np.cumsum(first_of_group)
    group = group.tolist()
    order = sorted(range(n), key=lambda i: (group[i], left[i]))
    left_lcp = np.zeros(n, np.int64)
    for a, b in zip(order[:-1], order[1:]):
        left_lcp[b] = common_prefix(left[a], left[b]) if group[a] == group[b] else -1
    order = np.array(order)
    sorted_lcp = left_lcp[order]
    if n:
        sorted_lcp[0] = -1
    out = []
    for d in range(WIDTH):
        live = np.flatnonzero((back >= d) & (back - reach <= d))
        if len(live) < 1:
            continue
        right_class = np.cumsum(first_of_group | (right_lcp < LENGTH - d))
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(sorted_lcp < d)
        key = right_class[live] * (n + 1) + left_class[live]
        _, inverse = np.unique(key, return_inverse=True)
        weight = np.bincount(inverse, weights=1 + many[live])
        hit = live[weight[inverse] > 1]
        if len(hit):
            out.append((d, hit))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, reduce side: the spans of repeated windows."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            known = int(np.frombuffer(blob, "<u4", 1)[0])
            if known:
                yield _spans(np.frombuffer(blob, DOC, known, 4), np.frombuffer(blob, "<i8", known, 4 + 16 * known))
            if len(blob) > 4 + 24 * known:
                blobs.setdefault(part, []).append(blob[4 + 24 * known :])
    for part in sorted(blobs):
        runs, refs = [], []
        for number, blob in enumerate(blobs.pop(part)):
            n, at, fields = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
            for kind in ("u1", "<u2", "u1", DOC, "<u4", "u1", "u1"):
                fields.append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
            shared, tails, lefts, doc, first, reach, many = fields
            cut = at + np.concatenate(([0], np.cumsum(tails, dtype=np.int64)))
            rest = [blob[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            cut = int(cut[-1]) + np.concatenate(([0], np.cumsum(lefts, dtype=np.int64)))
            left = [blob[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            runs.append(Run(shared.tolist(), rest, number))
            refs.append((left, doc, first, lefts.astype(np.int64), reach, many))
        place, lcp = [], []
        for number, at, _, shared in merge_runs(runs):
            place.append((number, at))
            lcp.append(shared)
        which, at = np.array(place).T
        base = np.concatenate(([0], np.cumsum([len(r[0]) for r in refs])))
        flat_at = base[which] + at
        doc = np.concatenate([r[1] for r in refs])[flat_at]
        first, back, reach, many = (np.concatenate([r[k] for r in refs])[flat_at].astype(np.int64) for k in range(2, 6))
        every = [x for r in refs for x in r[0]]
        left, lcp = [every[i] for i in flat_at], np.array(lcp)
        new_group = lcp < K
        new_group[0] = True
        # Windows repeat at runs of distances: since[i] is the least of the run that is open for entry i.
        since, anchor = np.full(len(left), -1), first + back
        hits = dict(equal_windows(lcp, left, new_group, back, reach, many))
        for d in range(WIDTH + 1):
            hit = np.zeros(len(left), bool)
            if d in hits:
                hit[hits[d]] = True
                hit &= many == 0  # what its own run repeats is covered already
            done = np.flatnonzero(~hit & (since >= 0))
            if len(done):
                yield _spans(doc[done], (anchor[done] - (d - 1)) << 32 | (anchor[done] - since[done] + LENGTH))
                since[done] = -1
            since[hit & (since < 0)] = d


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, "text"):
        data, offsets = flat(batch.column(2))
        rows = []
        for k, spans in enumerate(batch.column(1).to_pylist()):
            raw = data[offsets[k] : offsets[k + 1]]
            spans = np.array(spans or (), np.int64)
            low, high = merged(spans >> 32, spans & 0xFFFFFFFF)
            if len(low):
                keep = np.ones(len(raw), bool)
                for a, b in zip(low, high):
                    keep[a:b] = False
                kept = raw[keep].tobytes()
            else:
                kept = raw.tobytes()
            rows.append((len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(OUT)[1:]))], schema=OUT)


def remove_repeats(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, which may cut characters).

    A byte goes if a string of 200 bytes that covers it also starts anywhere
    else, in this document or another. A null, empty or shorter text loses
    nothing. Repeated rows of one doc_id and text are documents of their own
    and so lose what is 200 bytes or longer; rows that share a doc_id with
    different texts, or have no doc_id, are told apart by a hash of the text.
    An empty table gives an empty result; other columns are not read. All
    strings are compared byte for byte.
    """
    n = shuffle_partitions(spark)
    parts = 4 * n
    rows = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    dealt = rows.select(*KEY, "text").transform(in_arrow, _deal(parts), HEAD).repartition(n, "part")
    edges = dealt.transform(in_arrow, _classify, "__key long, __tag long, place long").groupBy(*KEY).agg(F.collect_set("place").alias("edges"))
    texts = rows.repartition(n, *KEY)
    # With doc_id, though unread, the texts are shuffled once: both joins take the same columns of them.
    runs = texts.join(edges, KEY).select(*KEY, "edges", "text", "doc_id").transform(in_arrow, _runs(parts), RUN)
    found = runs.repartition(n, "part").transform(in_arrow, _merge, "__key long, __tag long, span long")
    spans = found.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))
    done = texts.join(spans, KEY, "left").select("doc_id", "spans", "text")
    return done.transform(in_arrow, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), spark).drop("kept")
