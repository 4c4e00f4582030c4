"""Sharding and packing: laws, exact placement, token ids, and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcetally.llm import catalog, packing, sharding

SF = "/root/testdata/sf0.001"


def test_shards_of_the_table(spark):
    rows = catalog.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    sizes, where = np.zeros(8), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
        sizes[r.shard] += r.size
    assert sizes.max() / sizes.mean() < 1.02
    for s in range(8):
        mine = [r.slot for r in rows if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))


def test_hot_units_odd_rows_and_no_rows(spark):
    rng = random.Random(1)
    rows = [(i, "hot text " * 5, 1) for i in range(400)] + [(1000 + i, "w " * rng.randrange(60), 1) for i in range(600)] + [(None, None, 1), (None, None, 1), (5, "hot text " * 5, 1), (7000, "x" * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(sharding.measured(docs), 4, lots=64, cells=8).collect()
    assert len(got) == len(rows)
    for measure, most in (("size", 1.1), ("tokens", 1.3), ("rows", 1.15)):      # sixty units only share the words
        loads = [sum(r[measure] for r in got if r.shard == s) for s in range(4)]
        assert max(loads) <= most * sum(loads) / 4 + 1
    for s in range(4):
        mine = [r.slot for r in got if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))
    assert sharding.shard(sharding.measured(docs.limit(0)), 4).collect() == []


@pytest.mark.parametrize("words,hot", [(5, 1000), (60, 330), (600, 700), (1500, 330)])
def test_bytes_are_even_beside_a_hot_unit(spark, words, hot):
    """A third of the rows, or a little less than a shard of them, are copies of a short or long text."""
    rng = random.Random(words)
    rows = [(i, "again " * words) for i in range(hot)] + [(hot + i, f"{i} " + "other " * rng.randrange(50, 400)) for i in range(2000)]
    got = sharding.shard(sharding.measured(spark.createDataFrame(rows, "doc_id long, text string")), 8, lots=64, cells=8).collect()
    assert sorted(r.id for r in got) == list(range(len(rows)))
    sizes = np.bincount([r.shard for r in got], [r.size for r in got], 8)
    assert sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98, (sizes / sizes.mean()).tolist()


def test_placing_prefers_the_residual():
    loads = np.array([[9.0, 1], [1, 9], [9, 1], [1, 9]])
    assert sorted(map(tuple, (sorted(np.flatnonzero(sharding.place(loads, 2) == s)) for s in (0, 1)))) in ([(0, 1), (2, 3)], [(0, 3), (1, 2)])
    assert sharding.place(np.zeros((3, 2)), 2).tolist() == [0, 0, 0]


ODD = [None, "", " ", "It's A TEST, isn't it?", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "é É ﬁ Å Σ ΑΣ", "1234 5.6", "word... Word, WORD", "x" * 700, "many words here " * 2000, "tab\tline\nfeed\x0bv\x0cf\rr", "’s 's 'S", "don't. can't,", "日本語 テキスト", "a b ́c", "|> <| x."]


def test_ids_equal_the_library():
    path = catalog.tokenizer_path("word_bpe_49k.json")
    tokenizer = packing.word_tokenizer(path)
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["Word", "it's", ",", ".", " ", "\n", "é", "'", "7", "<|", "endoftext|>", "?!", "-"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for _ in range(2):                                         # the second time from memory
        for text, got in zip(texts, packing.token_ids(tokenizer, texts)):
            assert got.tolist() == [*tokenizer.ids(text), 0], text


def check_packing(rows, room):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    return len(by_sequence)


def test_op10_query(spark):
    rows = catalog.op10_best_fit_packing(spark, SF).collect()
    tokenizer = packing.word_tokenizer(catalog.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for d in catalog.table(spark, SF, "documents").collect():
        ids = np.array([*tokenizer.ids(d.text or ""), 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            want[d.doc_id, n] = (at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


def test_odd_documents(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(ODD)] + [(None, "no id", 3), (3, ODD[3], 3)], "doc_id long, text string, offset int")
    rows = catalog.packed(docs).collect()
    check_packing(rows, 2048)
    assert len([r for r in rows if r.piece == 0]) == len(ODD) + 2
    assert catalog.packed(docs.limit(0)).collect() == []


def test_islands_reach_the_least_number(spark):
    """Items cut from full bins: best fit decreasing alone does not always find the cuts again."""
    rng = random.Random(12)
    lengths = []
    for _ in range(60):
        rest = 100
        while rest:
            part = min(rest, rng.randrange(15, 60))
            lengths.append(part)
            rest -= part
    items = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    got = packing.pack(items, room=100, block=1000, islands=2, epochs=2).collect()
    assert len(got) == len(lengths)
    assert 60 <= check_packing(got, 100) <= len(packing.decreasing(lengths, 100))


def test_slices_of_a_batch_are_encoded_as_lists_are():
    """Texts beyond the first slice of a batch, nulls, both widths of offsets, and a memory that is full."""
    tokenizer = packing.Tokenizer(catalog.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(12)
    make = lambda: "".join(rng.choice(["\u00e9ta", "Wort", "\u00df", " ", "\n", "x1,", "\u0130", "don't ", "\U0001F600", "\u00a0", "<|", "a\u0301"]) for _ in range(rng.randrange(40)))
    texts = [make() if rng.random() < 0.95 else None for _ in range(900)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for a, n in ((0, 900), (300, 200), (899, 1), (450, 0), (501, 399)):
            ids, cuts = packing.token_stream(tokenizer, whole.slice(a, n), 7)
            want = [[*tokenizer.ids(t or ""), 7] for t in texts[a:a + n]]
            assert [ids[x:y].tolist() for x, y in zip(cuts, cuts[1:])] == want and len(cuts) == n + 1


def test_equal_rows_spread_over_blocks(spark):
    """40,000 rows that are equal in every column do not share a block, a part or a cell."""
    same = spark.range(40_000).select(F.lit(None).cast("long").alias("id"), F.lit(700).cast("long").alias("length"))
    got = packing.pack(same, block=8192).groupBy(F.shiftright("sequence_id", 32).alias("block")).count().collect()
    assert len(got) == 5 and sum(r["count"] for r in got) == 40_000 and max(r["count"] for r in got) < 8192 * 1.1
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    slots = sharding.shard(sharding.measured(docs), 8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(slots) == 8 and all(r.n == r.slots == r["last"] + 1 and abs(r.n - 5000) < 300 for r in slots)


def test_crossover_keeps_every_item_once():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 90) for _ in range(300)]
    a, b = packing.decreasing(sizes, 100), packing.best_fit(list(range(300)), sizes, [], 100)
    for child in (packing.crossover(a, b, sizes, 100, rng), packing.mutate(a, sizes, 100, rng), packing.evolve([a, b], sizes, 100, "s")[0]):
        assert sorted(i for _, held in child for i in held) == list(range(300))
        assert all(load == sum(sizes[i] for i in held) <= 100 for load, held in child)


def test_pipeline(spark):
    docs = catalog.table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        kept = after
    rows = corpus_pipeline.run(spark, SF).collect()
    left = {r.doc_id: r for r in kept.collect()}
    assert {r.doc_id for r in rows} == set(left) and 100 < len(left) < docs.count()
    assert all(r.n_chars == len(r.text) for r in left.values())
    check_packing(rows, 2048)


def test_pipeline_of_odd_tables(spark):
    schema = catalog.table(spark, SF, "documents").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 9, "en", "s", 45), (4, "word " * 9, None, None, 45)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
        assert stage(spark, odd, SF).count() <= 4, name


@pytest.mark.parametrize("lengths", [[], [100], [50, 50], [100, 1], [51, 51, 49, 49]])
def test_best_fit_small(lengths):
    assert len(packing.decreasing(lengths, 100)) == packing.least_bins(lengths, 100)
