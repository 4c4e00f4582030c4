"""Tournament packing: first-fit as a plain loop does it, every token once, no padding, hot and odd rows."""

import random
import zlib

import numpy as np
import pytest

from sourcetally.llm import catalog, packing, tournament

SF = "/root/testdata/sf0.001"


def plain_first_fit(order, sizes, room):
    bins, left = [], []
    for i in order:
        for b, free in enumerate(left):
            if free >= sizes[i]:
                break
        else:
            b = len(bins)
            bins.append([]), left.append(room)
        bins[b].append(i)
        left[b] -= sizes[i]
    return bins


def cases():
    rng = random.Random(3)
    for room in (16, 100, 2048):
        for count in (0, 1, 2, 3, 17, 200):
            yield room, [rng.randint(1, room) for _ in range(count)]
    yield 2048, [1025] * 50
    yield 2048, [2048] * 9
    yield 64, [33] * 7 + [1] * 3
    yield 100, [100, 64, 32, 1]


@pytest.mark.parametrize("room,sizes", list(cases()))
def test_first_fit_and_filling(room, sizes):
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = tournament.first_fit(order, sizes, room)
    assert bins == plain_first_fit(order, sizes, room)
    parts = tournament.filled(bins, sizes, room)
    seen = [[] for _ in sizes]
    for held in parts:
        size = sum(n for _, _, n in held)
        assert held and 0 < size <= room and (size == room or size & (size - 1) == 0)
        for i, start, n in held:
            assert n > 0
            seen[i].append((start, n))
    for i, spans in enumerate(seen):
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == sizes[i]


def test_order_of_first_fit_is_given():
    assert tournament.first_fit([2, 0, 1], [5, 5, 6], 10) == [[2], [0, 1]]


def check(rows, texts, end, room):
    """rows of (id, start, length, crc, total, sequence, offset) against the tokens of ``texts`` by id"""
    tokenizer = packing.word_tokenizer(catalog.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[i], key=lambda r: r[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= room
        padding += 0 if at & (at - 1) == 0 else room - at
    return padding


def test_query(spark):
    texts = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    rows = [tuple(r) for r in catalog.op12_tournament_packing(spark, SF).collect()]
    assert check(rows, texts, 1, 2048) == 0


def test_hot_long_and_odd_rows(spark):
    path = catalog.tokenizer_path("word_bpe_49k.json")
    rows = [(None, "again and again " * 3, 1)] * 3000 + [(1, None, 1), (2, "", 1), (3, "word " * 30_000, 1), (3, "other", 1), (4, "x" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    got = tournament.pack(docs, path, room=64, group=500).collect()
    loads, groups = {}, {}
    for r in got:
        n = len(r.ids) // 4
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + n
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    tokenizer = packing.word_tokenizer(path)
    assert sum(loads.values()) == sum(len(tokenizer.ids(t or "")) + 1 for _, t, _ in rows)
    assert all(n == 64 or n & (n - 1) == 0 for n in loads.values())
    assert len(groups) > 5 and max(groups.values()) < 1000                     # equal rows do not share a group
    whole = sorted(((r.start, r.ids) for r in got if r.id == 4), key=lambda p: p[0])
    assert np.frombuffer(b"".join(ids for _, ids in whole), "<u4").tolist() == [*tokenizer.ids("x" * 50_000), 1]
    assert tournament.pack(docs.limit(0), path).collect() == []


def test_narrow_and_wide_numbers(spark):
    """Another end id, beyond 16 bits, travels in four bytes."""
    path = catalog.tokenizer_path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a few words"), (2, "b")], "doc_id long, text string")
    got = tournament.pack(docs, path, end=70_000).collect()
    ends = [np.frombuffer(r.ids, "<u4")[-1] for r in got if r.start + len(r.ids) // 4 == r.doc_tokens]
    assert ends == [70_000, 70_000]
