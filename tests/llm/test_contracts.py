"""Every operator against its brute-force version on small tables with nulls, empty, long, tied and repeated rows."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

VOCAB = "the of and a to in Hélas große niño que vor card tel zebra quill ox jump lazy 12 7x don't".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "er", "ing", "s,", ".\n"]) + rng.choice(["", "a", "e", "on"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    out = [prose(rng, rng.choice([1, 3, 4, 5, 6, 30, 90, 200])) for _ in range(60)]
    passage, line = prose(rng, 60), "Buy now at the shop. " * 3
    for k in range(25):
        a = out[k].split(" ")
        for _ in range(1 + len(a) // 40):
            a[rng.randrange(len(a))] = "edit%d" % rng.randrange(3)
        out.append(" ".join(a))  # near copies
    base = prose(rng, 120).split(" ")
    for k in range(30):
        a = list(base)
        a[rng.randrange(120)] = f"var{k}"
        a[rng.randrange(120)] = f"rav{k % 7}"
        out.append(" ".join(a))  # one large group of near copies
    out += [out[3], out[3].upper(), out[7], out[7], "", None, "", "   ", "x", "a b", "A B", "ab " * 400, "z" * 1000, "z" * 450 + "q"]
    out += [prose(rng, 20) + passage + prose(rng, 25) for _ in range(6)] + [line * k for k in (1, 4, 9)] + [prose(rng, 6000)]
    out += ["pay 4111 1111 1111 1111 or 4111111111111112 call +1 (555) 123-4567. +49 30 1234567 ü x.y+z@mail.example.co.uk a@b c@d.e_f@g.h 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255 é 5500-0000-0000-0004 iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def frame(spark, docs):
    """The documents in several partitions, with columns whose names clash with internal ones."""
    return spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in docs], "doc_id long, text string, cls string, part int, a double").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact_dedup(spark, docs, frame, empty):
    from tessaline.llm.exact_dedup import exact_dedup

    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    assert rows(exact_dedup(frame, spark), *columns) == brute.exact(docs)
    assert exact_dedup(empty, spark).count() == 0
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (None, "q"), (None, "Q"), (5, "alpha"), (5, "beta"), (9, "beta"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in exact_dedup(odd, spark).collect()), key=str)
    want = [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 2, True), (None, None, 2, True), (5, 5, 1, True), (5, 9, 2, False), (9, 9, 2, True), (7, 8, 2, False), (8, 8, 2, True)]
    assert got == sorted(want, key=str)


def test_the_exact_stage_decides_by_row(spark, empty):
    from tessaline.llm.exact_dedup import keep_exact

    given = [(5, "alpha", 1), (5, "beta", 2), (9, "beta", 3), (1, "a", 4), (1, "a", 5), (None, "A", 6), (None, "q", 7), (None, "Q", 8), (None, "r", 9), (7, None, 10), (8, "", 11), (3, "Same", 12), (3, "same", 13)]
    df = spark.createDataFrame(given, "doc_id long, text string, digest int").repartition(4)
    left = sorted(r.digest for r in keep_exact(spark, df, "").collect())
    assert {1, 3, 9, 11} <= set(left) and len({4, 5} & set(left)) == 1 and len({7, 8} & set(left)) == 1 and len({12, 13} & set(left)) == 1
    assert len(left) == 7 and keep_exact(spark, df, "").columns == df.columns
    assert keep_exact(spark, empty, "").count() == 0


def test_the_near_stage_decides_by_row(spark, empty):
    from tessaline.llm.jaccard_join import keep_one_near

    rng = random.Random(6)
    a, b, c = (prose(rng, 40) for _ in range(3))
    given = [(5, a, 1), (5, b, 2), (9, b + " end", 3), (2, a + " end", 4), (None, c, 5), (None, c + " end", 6), (None, "", 7), (None, "", 8), (4, c + " last", 9), (6, "one two", 10), (6, "one two", 11)]
    df = spark.createDataFrame(given, "doc_id long, text string, cls int").repartition(3)
    left = sorted(r.cls for r in keep_one_near(spark, df, "").collect())
    assert left[:-1] == [2, 4, 7, 8, 9] and left[-1] in (10, 11)
    assert keep_one_near(spark, empty, "").count() == 0


def test_join_of_hot_and_null_keys(spark, monkeypatch):
    from tessaline.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    left = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).cast("long").alias("k"), F.lit("x").alias("v2"))
    counts = left.where("k is not null and k <> 3").groupBy("k").agg(F.count("*").alias("n"))
    right = counts.withColumn("v", F.col("k") * 10)
    got = {r.id: r.v for r in common.join_evenly(left, right, "k", "n", ["id"]).collect()}
    assert len(got) == 400 and got == {r.id: None if r.k in (None, 3) else r.k * 10 for r in left.collect()}


def test_grace_recursion_spills_and_keeps_groups():
    import xxhash

    from tessaline.llm.exact_dedup import grace

    texts = [b"t%d" % (i % 700) * 50 for i in range(2000)]
    records = ((xxhash.xxh3_64_intdigest(t), t, i, 1) for i, t in enumerate(texts))
    found = {t: (top, n) for _, t, top, n in grace(records, 4000)}
    want = {}
    for i, t in enumerate(texts):
        want[t] = (i, want.get(t, (0, 0))[1] + 1)
    assert found == want


def test_table_compares_contents_under_one_hash():
    from tessaline.llm.exact_dedup import ContentTable

    t = ContentTable()
    assert [t.find(5, b"a"), t.find(5, b"b"), t.find(5, b"a")] == [0, 1, 0]


def test_jaccard_join(spark, docs, frame, empty):
    from tessaline.llm.jaccard_join import jaccard_join

    assert rows(jaccard_join(frame, spark), "doc_id", "n_shingles", "component_id") == brute.near(docs)
    assert jaccard_join(empty, spark).count() == 0


def test_jaccard_join_of_repeated_rows_and_null_ids(spark):
    from tessaline.llm.jaccard_join import jaccard_join

    t = "one two three four five six seven"
    df = spark.createDataFrame([(4, t), (4, t), (9, t), (None, t), (None, "other words here"), (None, None), (5, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join(df, spark).collect()), key=str)
    want = [(4, 3, 4, 0, 4), (4, 3, 4, 0, 4), (9, 3, 4, 0, 4), (None, 3, 4, 0, 4), (None, 1, None, 0, None), (None, 0, None, 0, None), (5, 0, 5, 0, 5)]
    assert got == sorted(want, key=str)


def test_jaccard_join_of_words_that_collide_in_powers_of_two(spark):
    """Thue-Morse words have one polynomial hash modulo 2^64 whatever the odd base."""
    from tessaline.llm.jaccard_join import class_ids, clashes, jaccard_join, renamed, stand_in

    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " one two three four"
    out = [(1, a), (2, b), (3, a + rest), (4, b + rest), (5, a + rest)]
    got = sorted(tuple(r) for r in jaccard_join(spark.createDataFrame(out, "doc_id long, text string"), spark).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute.near(out) and [c for *_, c in got] == [1, 2, 3, 4, 3]
    # Two sets whose first 64-bit ids are the same go apart by the second.
    names = clashes(spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "cls long, chk long"))
    assert names == {(7, 2): stand_in(7, 2)}
    assert renamed(np.array([7, 7, 8]), np.array([1, 2, 1]), names).tolist() == [7, stand_in(7, 2), 8]
    one, two = class_ids(np.array([5, 9], np.uint64), np.array([0, 1, 2]), np.array([5, 5], np.uint64))
    assert one[0] != one[1] and two[0] == two[1]


def test_jaccard_join_of_the_smallest_sets(spark):
    from tessaline.llm.jaccard_join import jaccard_join

    words = [f"w{k}" for k in range(12)]
    out = [(k * 20 + n, " ".join(f"{x}{k}" for x in words[:n])) for k in range(3) for n in range(1, 12)]
    got = jaccard_join(spark.createDataFrame(out, "doc_id long, text string"), spark, links=False)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.near(out)


def test_parity_sketches_bound_the_difference():
    from tessaline.llm.jaccard_join import parities

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [base[: 5 + 40 * k] for k in range(20)] + [base[10 * k : 10 * k + 300] for k in range(20)] + [base[:0]]
    sig = parities(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert sum(bin(int(x)).count("1") for x in (sig[i] ^ sig[j]).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_field_hashes_are_of_the_content():
    from tessaline.llm import common

    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    start = np.sort(rng.integers(0, 4900, 600))
    end = np.maximum.accumulate(start + rng.integers(0, 9, 600))
    one, two = common.FIELDS.hash(data, start, end)
    by_text = {}
    for a, b, x, y in zip(start, end, one, two):
        assert by_text.setdefault(data[a:b].tobytes(), (x, y)) == (x, y)
    assert len(set(by_text.values())) == len(by_text)
    blocked = common.FIELD_BLOCK
    try:
        common.FIELD_BLOCK = 64
        assert (common.FIELDS.hash(data, start, end)[0] == one).all()
    finally:
        common.FIELD_BLOCK = blocked


def test_jaccard_join_of_a_crowded_pivot(spark, monkeypatch):
    from tessaline.llm import jaccard_join as module

    monkeypatch.setattr(module, "CROWD", 3)
    base, out = [f"w{k}" for k in range(700)], []
    for k in range(40):
        text = list(base)
        for at in range(k % 28):
            text[25 * at] = f"x{k}"
        out.append((k, " ".join(text)))
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(5)
    assert rows(module.jaccard_join(df, spark), "doc_id", "n_shingles", "component_id") == brute.near(out)


def test_suffix_dedup(spark, docs, frame, empty):
    from tessaline.llm.suffix_dedup import remove_repeats

    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert rows(remove_repeats(frame, spark), *columns) == brute.repeats(docs)
    assert remove_repeats(empty, spark).count() == 0


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    from tessaline.llm.suffix_dedup import remove_repeats

    rng = random.Random(12)
    passage, innocent = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 600))
    out = [(1, "x" + passage + "y"), (1, innocent), (2, "u" + passage), (None, passage), (None, innocent[::-1]), (None, None)]
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, spark).collect())
    assert got == [(0, 0, 0, 0), (0, 300, 300, 1), (0, 600, 0, 0), (1, 302, 300, 1), (1, 600, 0, 0), (2, 301, 300, 1)]


def test_suffix_dedup_of_overlapping_passages(spark):
    from tessaline.llm.suffix_dedup import remove_repeats

    rng = random.Random(8)
    source = "".join(rng.choice("abcd ") for _ in range(3000))
    out = []
    for k in range(40):
        a, n = rng.randrange(2600), rng.choice([150, 199, 200, 201, 250, 380])
        out.append((k, "".join(rng.choice("efgh") for _ in range(rng.randrange(90))) + source[a : a + n] + "".join(rng.choice("ijkl") for _ in range(rng.randrange(90)))))
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(7)
    assert rows(remove_repeats(df, spark), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(out)


def test_suffix_steps_over_many_flushes_and_runs(monkeypatch):
    """Copies that meet in one run, in several runs and in several flushes, with every fingerprint the same too."""
    from tessaline.llm import suffix_dedup as s

    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passages = [text(n) for n in (200, 230, 700, 1500)]
    out = [(k, text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(300))) for k in range(30)] + [(50 + k, passages[3]) for k in range(9)] + [(70, "z" * 900), (71, ""), (72, passages[0][:199])]
    monkeypatch.setattr(s, "FLUSH", 40)
    monkeypatch.setattr(s, "RUN_SIZE", 37)
    whole = s.anchors
    for same in (False, True):
        if same:
            monkeypatch.setattr(s, "anchors", lambda *a: (*(found := whole(*a))[:4], found[4] * 0))
        dealt = [b for k in range(0, len(out), 4) for b in s._deal(3)(iter([pa.record_batch({"__key": [i for i, _ in out[k : k + 4]], "__tag": [0] * len(out[k : k + 4]), "text": [t for _, t in out[k : k + 4]]})]))]
        edges: dict[int, set] = {}
        for b in s._classify(iter(dealt)):
            for key, place in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                edges.setdefault(key, set()).add(place)
        held = [(i, t) for i, t in out if i in edges]
        runs = [b for k in range(0, len(held), 11) for b in s._runs(3)(iter([pa.record_batch({"k": [i for i, _ in held[k : k + 11]], "t": [0] * len(held[k : k + 11]), "e": [sorted(edges[i]) for i, _ in held[k : k + 11]], "x": [t for _, t in held[k : k + 11]]})]))]
        spans: dict[int, list] = {}
        for b in s._merge(iter(runs)):
            for key, span in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                spans.setdefault(key, []).append(span)
        table = pa.record_batch({"doc_id": [i for i, _ in out], "spans": [spans.get(i) for i, _ in out], "text": [t for _, t in out]})
        got = [row[:5] for b in s._finish(iter([table])) for row in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted(brute.repeats(out))


def test_loser_tree_merges_front_coded_runs():
    from tessaline.llm.suffix_dedup import Run, common_prefix, front_code, merge_runs

    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 40))) for _ in range(7)]
    got = list(merge_runs([Run(*front_code(r), k) for k, r in enumerate(runs)]))
    assert [t for _, _, t, _ in got] == sorted(t for r in runs for t in r)
    assert [k for *_, k in got] == [common_prefix(a, b) for a, b in zip([b""] + [g[2] for g in got], [g[2] for g in got])]
    assert all(runs[r][i] == t for r, i, t, _ in got)


def test_decontamination(spark, docs, frame, empty):
    from tessaline.llm.decontaminate import contamination_report, find_contamination, remove_contamination

    words = (docs[10][1] or "").split()
    items = [(1, docs[40][1]), (2, " ".join((docs[60][1] or "").split()[:15])), (3, "zebra zebrae"), (4, None), (5, "!!"), (30, docs[40][1]), (6, " ".join(words[3:9]) + " never seen before words at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame, bench, spark)
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert rows(contamination_report(found), *columns) == brute.leaks(docs, items)
    assert contamination_report(find_contamination(empty, bench, spark)).count() == 0
    none = find_contamination(frame, spark.createDataFrame([], "item_id long, text string"), spark)
    assert contamination_report(none).where("contaminated").count() == 0
    left = {r.doc_id: r.text for r in remove_contamination(found).collect()}
    hit = {r[0] for r in brute.leaks(docs, items) if r[-1]}
    assert all(left[d] == t for d, t in docs if d not in hit) and 40 not in left


def test_decontamination_in_blocks(spark, docs, frame, monkeypatch):
    from tessaline.llm import decontaminate

    items = [(k, t) for k, t in docs[:40]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    got = decontaminate.contamination_report(decontaminate.find_contamination(frame, bench, spark))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.leaks(docs, items)


def test_pii(spark, docs, frame, tmp_path):
    from tessaline.llm.pii import find_pii, op2_pii

    rng = random.Random(3)
    noise = [(1000 + k, "".join(rng.choice("0123456789.+-() @aé4") for _ in range(rng.choice([10, 60, 300])))) for k in range(300)]
    noise += [(5000, "a" * 200_000), (5001, "1" * 100_000), (5002, "a@" + "b." * 30_000 + "c"), (5003, "1 " * 20_000), (5004, "+" * 5000 + "1"), (5005, "1.1." * 5000)]
    every = [(d, t) for d, t in docs] + noise
    spark.createDataFrame(every, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_pii(spark, str(tmp_path))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == brute.private(every)
    planted = got.where("n_iban > 0").collect()
    assert [(r.doc_id, r.n_iban) for r in planted] == [(docs[-1][0], 2)]
    scores = {s.text: s.score for r in find_pii(frame).where(f"doc_id = {docs[-1][0]}").collect() for s in r.found}
    assert scores["4111 1111 1111 1111"] == 0.9 and scores["10.0.0.255"] == 0.5


def test_redaction(spark):
    from tessaline.llm.pii import redact

    df = spark.createDataFrame([(1, "é mail a@b.co now +1 555 123 4567!"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(df).collect()} == {1: "é mail [email] now [phone]!", 2: ""}


def test_token_counts(spark, docs, frame, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessaline.llm.token_counts import count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    odd = [(-1, "日本 <|endoftext|> x  y\n\n z"), (-2, "<|endoftext|>"), (-3, "a\x1cb   "), (-4, "don't WE'LL ²½ a_b-c   z ​"), (-5, "日本語 テスト " * 20_000)]
    df = frame.select("doc_id", "text").unionByName(frame.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    want = sorted((d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False)), n > 1024) for d, t in [*docs, *odd])
    assert rows(count_tokens(df, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(empty, path).count() == 0


def test_packing(spark, docs, frame, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessaline.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    odd = [(-1, "日本 <|endoftext|> x"), (-2, "İ ΟΔΟΣ é ﬁ"), (-3, "a\x1cb")]
    df = frame.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = pack(df, path, spark).collect()
    want, total = [], 0
    for d, t in [*docs, *odd]:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(d, k, s, len(p := ids[s : s + 2048]), crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1
    assert pack(empty, path, spark).count() == 0


def test_genetic_operators_keep_every_piece():
    from tessaline.llm.packing import best_fit, crossover, evolve, fitness, mutate

    rng = np.random.default_rng(1)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40))}

    def pieces(packing):
        out = {}
        for p, n in packing.items():
            assert sum(p) <= 100
            for x in p:
                out[x] = out.get(x, 0) + n
        return out

    a, b = best_fit(counts, 100), mutate(best_fit(counts, 100), counts, 100, rng)
    child = crossover(a, b, counts, 100, rng)
    assert pieces(a) == pieces(b) == pieces(child) == counts
    best = evolve(counts, [], 100, 30, 3)[0]
    assert pieces(best) == counts and fitness(best, 100) <= fitness(a, 100)


def test_warc_round_trip(spark, tmp_path):
    from tessaline.llm.warc import WarcError, read_records, read_warc, write_warc

    body = "<p>ü\r\n\r\nWARC/1.1</p>" * 20
    pages = [(5, "http://a/ü?x y", body), (2, None, body), (9, "http://b", body), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (None, "n", "null id"), (2, None, body)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    write_warc(df, f"{tmp_path}/w")
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.ok, bytes(r.payload)) for r in read_warc(spark, f"{tmp_path}/w").collect())
    want = []
    for page, _, html in pages:
        raw = (html or "").encode()
        again = page is not None and len(raw) >= 100 and page > 2
        want.append((page if page is not None else -1, len(raw), sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None, True, b"" if again else raw))
    assert got == sorted(want, key=lambda r: r[:4])
    whole = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size > 200).read_bytes()
    import gzip

    assert b"WARC/1.1" in gzip.decompress(whole)  # a valid multi-member gzip file
    with pytest.raises(WarcError):
        list(read_records(whole[:-30]))
    damaged = bytearray(whole)
    damaged[len(whole) // 2] ^= 255
    with pytest.raises(WarcError):
        list(read_records(bytes(damaged)))
    write_warc(df.limit(0), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Standard records in gzip members and plain: warcinfo, request, response over HTTP, sha1 in base32, folded headers."""
    import base64
    import gzip
    from hashlib import sha1

    from tessaline.llm.warc import WarcError, read_records, read_warc

    body = "Zoë".encode() * 50
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    digest = "sha1:" + base64.b32encode(sha1(body).digest()).decode()

    def record(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Target-URI: http://a/", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"), record("response", http, "Content-Type: application/http;\r\n msgtype=response", f"WARC-Payload-Digest: {digest}"), record("revisit", b"", f"WARC-Payload-Digest: {digest}"), record("resource", b"")]
    want = [("warcinfo", b"software: x\r\n"), ("request", b""), ("response", body), ("revisit", b""), ("resource", b"")]
    zipped, plain = b"".join(gzip.compress(r) for r in records), b"".join(records)
    for archive in (zipped, plain):
        got = list(read_records(archive))
        assert [(r[4], r[6]) for r in got] == want and all(r[7] for r in got) and all(r[0] is None for r in got)
        with pytest.raises(WarcError):
            list(read_records(archive[:-3]))
    wrong = record("response", http.replace(b"Zo", b"zo"), "Content-Type: application/http", f"WARC-Payload-Digest: {digest}")
    assert [r[7] for r in read_records(wrong)] == [False]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a b.warc.gz").write_bytes(zipped)
    assert sorted(r.record_id for r in read_warc(spark, f"{tmp_path}/w").collect()) == sorted(f"<urn:uuid:{k}>" for k, _ in want)


def test_chat(spark, tmp_path):
    import public_tokenizers

    from tessaline.llm.chat import format_chats, parse, render

    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN user]\n", "[/TURN]\n", "\\", "[\\/TURN]", "<", "[", "]", "é😀", " ", "\n", "word", "<\\s>", "<|endoftext|>", "<<SYS>>", "<\\\\/s>"]
    turns = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
            turns.append((conv, turn, rng.choice(["user", "assistant", "system", "odd]\nrole%", None]), text))
    turns += [(100, 0, "assistant", "same"), (100, 0, "assistant", "same")]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, role string, text string, loss string").repartition(4)
    got = {r.conv_id: r for r in format_chats(df, public_tokenizers.path("byte_bpe_50k.json"), spark).collect()}
    want = {}
    for c, t, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0], t[1], t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, held in want.items():
        loss = "".join(x for r, x in held if r == "assistant")
        assert parse(render(held)[0]) == held
        assert (got[c].n_turns, got[c].turns_sha256) == (len(held), sha256("".join(f"{r}\n{x}\n" for r, x in held).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha256(loss.encode()).hexdigest(), len(got[c].formatted))


def test_chat_of_null_empty_and_added_conversations(spark, tmp_path):
    from tessaline.llm.chat import format_chats, op7_chat_format
    import public_tokenizers

    turns = [(None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (None, 1, "user", None), (-1, 0, "assistant", "own"), (4, 0, "assistant", "é " * 300_000)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.loss_chars) for r in op7_chat_format(spark, str(tmp_path)).collect())
    assert got == [(False, -1, 1, 3), (False, -1, 2, 21), (False, 4, 1, 600_000), (True, 0, 1, 0), (True, 0, 1, 1), (True, 0, 1, 1)]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(none, public_tokenizers.path("byte_bpe_50k.json"), spark).count() == 0


def test_the_kernel_is_the_shared_share_of_distinct_grams():
    from tessaline.llm.language_id import SYMBOLS, distinct, SYMBOL, numbered, presence
    from tessaline.llm.common import flat

    def grams(t):
        low = "".join(c.lower() if c.isascii() and c.isalpha() else " " for c in t)
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    texts, scratch = ["The cat, the CAT 9", "a dog and the fox", "", "x"], np.zeros(SYMBOLS**3, np.int32)
    own = [distinct(SYMBOL[np.frombuffer(t.encode(), np.uint8)], scratch) for t in texts]
    every = [np.unique(np.concatenate([o[n] for o in own])) for n in range(3)]
    x = presence(*flat(pa.array([t.encode() for t in texts], pa.binary())), numbered(every), sum(map(len, every)), scratch)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            size = len(grams(a)) * len(grams(b))
            assert (x @ x.T)[i, j] == pytest.approx(len(grams(a) & grams(b)) / size**0.5 if size else 0, abs=1e-6)


def test_language_id(spark, empty, tmp_path):
    from tessaline.llm.language_id import fit, op1_language_id, predict

    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op1_language_id(spark, "/root/testdata/sf0.01").join(source.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == source.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    model = fit(source)
    odd = spark.createDataFrame([(1, None), (2, "12 !?"), (3, ""), (4, "the of and thing"), (None, "der die und schheit")], "doc_id long, text string")
    assert [r.lang_pred for r in predict(odd, model, spark).orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["und", "und", "und", "en", "de"]
    assert predict(empty, model, spark).count() == 0
    clash = spark.createDataFrame([(1, "the of and thing", "x", 9.0, 7)] * 2 + [(2, "der und die " * 200_000, None, None, 8)], "doc_id long, text string, lang_pred string, score double, other int")
    assert sorted((r.doc_id, r.lang_pred, r.other) for r in predict(clash, model, spark).collect()) == [(1, "en", 7), (1, "en", 7), (2, "de", 8)]
    assert {r.lang_pred for r in predict(odd, None, spark).collect()} == {"und"}


def test_pipeline_matches_brute_force(spark, docs, tmp_path):
    """The filtering stages against their brute-force versions, one after the other."""
    import corpus_pipeline

    langs = ["en", "de"]
    given = [(d, t, langs[d % 2], "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, docs[40][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.stored(spark, stage(spark, df, str(tmp_path)), name)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted((r.doc_id, r.text) for r in df.collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    first = kept[names[0]]
    assert [d for d, _ in first] == [d for d, t in docs if any(c.isalpha() for c in t or "")]
    second = {r[0] for r in brute.exact(first) if r[3]}
    assert [d for d, _ in kept[names[1]]] == sorted(second)
    third = [d for d, _, c in brute.near(kept[names[1]]) if d == c]
    assert [d for d, _ in kept[names[2]]] == third
    assert not any(r[-1] and r[2] > 30 for r in brute.leaks(kept[names[3]], items))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {d for d, _ in kept[names[3]]}


@pytest.mark.parametrize("chunk, piece", [(512, 1 << 16), (4, 16)])
def test_jaccard_join_counts_all_links(spark, docs, frame, monkeypatch, chunk, piece):
    from itertools import combinations

    from tessaline.llm import jaccard_join as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    monkeypatch.setattr(module, "PIECE", piece)
    monkeypatch.setattr(module, "STRIP", 64 if chunk == 4 else 4096)
    classes = {}
    for d, t in docs:
        classes.setdefault(frozenset(brute.shingles(t)), []).append(d)
    links = dict.fromkeys(classes, 0)
    for a, b in combinations([c for c in classes if c], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            links[a] += 1
            links[b] += 1
    want = sorted((d, min(own) if c else d, links[c]) for c, own in classes.items() for d in own)
    assert max(links.values()) > 5
    assert rows(module.jaccard_join(frame, spark), "doc_id", "class_id", "n_links") == want


def test_jaccard_join_of_repeated_half_similar_rows(spark):
    from tessaline.llm.jaccard_join import jaccard_join

    shared, left, right = (" ".join(f"{k}{i}" for i in range(n)) for k, n in (("s", 200), ("a", 90), ("b", 90)))
    one, other = f"{left} {shared}", f"{shared} {right}"
    # The fillers make the shared shingles the rarest of both, so that the pair is compared.
    fill = [(100 + k, f"{own} " + " ".join(f"{k}z{i}" for i in range(300))) for k, own in enumerate([left, right] * 20)]
    out = [(1, one), (1, one), (2, other), (2, other), (3, one + " end"), *fill]
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(3)
    assert rows(jaccard_join(df, spark, links=False), "doc_id", "n_shingles", "component_id") == brute.near(out)
    # Two texts under one doc_id: each is compared as itself.
    out = [(1, one), (1, right), (2, other), (2, left), (3, one + " end"), *fill]
    df = spark.createDataFrame(out, "doc_id long, text string").repartition(3)
    got = [r for r in jaccard_join(df, spark, links=False).collect() if r.doc_id < 100]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [x for x in brute.near(out) if x[0] < 100]


def test_pii_of_many_spans_in_one_text(spark, tmp_path):
    """Time grows with the spans, not with their square; 50,000 spans of one text."""
    import time

    from tessaline.llm.pii import op2_pii, redact

    text = "é " + "".join(f"mail a{k}@b.co, 10.0.{k % 300}.1 " for k in range(25_000))
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = op2_pii(spark, str(tmp_path))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == brute.private([(1, text), (2, None)])
    clean = {r.doc_id: r.text for r in redact(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert clean[1].count("[email]") == 25_000 and "@" not in clean[1] and clean[1].startswith("é mail [email], [ip] mail")
    assert time.time() - began < 60
    assert op2_pii(spark, str(tmp_path)).where("doc_id > 5").count() == 0


def test_packing_in_blocks_of_ranks(spark, monkeypatch):
    import public_tokenizers

    from tessaline.llm import packing

    monkeypatch.setattr(packing, "RANKS", 7)
    df = spark.createDataFrame([(k % 50, "word " * (k % 9)) for k in range(300)] + [(None, None)] * 3, "doc_id long, text string").repartition(4)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), spark, 20).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 303 and sum(r.length for r in got) == sum(k % 9 + 1 for k in range(300)) + 3
    for b in bins.values():
        ends = [a + n for a, n in sorted(b)]
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 20
