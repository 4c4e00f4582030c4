"""SimHash against a plain computation, and its search against all pairs."""

import functools
import hashlib
import re

import pytest
import xxhash

from sourcetally.llm import catalog, simhash

SF = "/root/testdata/sf0.001"


def report(spark, rows, schema="doc_id long, text string, fingerprint int"):
    return {r.doc_id: r for r in simhash.fingerprint_report(spark.createDataFrame(rows, schema)).collect()}


def expected(texts):
    """{id: (n_chars, sha256)} of {id: text} by the definition."""
    ids = sorted(texts, reverse=True)
    out = {}
    for k, i in enumerate(ids):
        own, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        out[i] = (len(own), hashlib.sha256((own[:len(own) - half] + after[:half]).encode()).hexdigest())
    return out


def test_op3_query(spark):
    got = {r.doc_id: r for r in catalog.op3_fingerprints(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in catalog.table(spark, SF, "documents").collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == expected(texts)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.95 * len(got)
    by_text = {}
    assert all(by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint for i, r in got.items())
    assert all(r.fingerprint == plain_fingerprint(texts[i]) for i, r in got.items())
    ids, value = sorted(got, reverse=True), {i: int(r.fingerprint, 16) for i, r in got.items()}
    share = lambda a, b: 1 - (a ^ b).bit_count() / 128
    for k, i in enumerate(ids):
        r = got[i]
        assert r.near_edited == pytest.approx(share(value[i], int(r.edited_fingerprint, 16)))
        assert r.near_next == pytest.approx(share(value[i], value[ids[(k + 1) % len(ids)]]))
        assert r.n_close == close(value[i], value.values(), 3) if i % 100 == 0 else r.n_close is None


def plain_fingerprint(text):
    """The vote counted bit by bit, with the hash function's own library."""
    words = re.sub("[ \t\n\x0b\f\r]+", " ", text.lower()).split(" ")
    words = [w.encode() for w in words if w]
    hashed = lambda *parts: functools.reduce(lambda seed, part: xxhash.xxh64_intdigest(part, seed), parts, 42)
    terms = [hashed(*pair) for pair in zip(words, words[1:])] if len(words) != 1 else [hashed(words[0])]
    halves = [terms, [hashed(t.to_bytes(8, "little"), (1).to_bytes(4, "little")) for t in terms]]
    return "".join(f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in half) > len(half)):016x}" for half in halves)


def close(own, values, radius):
    return sum(0 < (own ^ v).bit_count() <= radius for v in set(values))


def test_search_of_the_report(spark):
    """Long texts that differ in a word, and copies; every second id is searched."""
    import random
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(3000)]
    texts = [" ".join(words)] * 3 + [" ".join([*words[:k], "other", *words[k + 1:]]) for k in range(0, 3000, 100)] + ["", None, "apart"]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(None, "x", 0)]
    got = simhash.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string, n_close int"), every=2, radius=5).collect()
    value = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert len(got) == len(texts) and max(r.n_close or 0 for r in got) > 3
    assert all(r.n_close == (close(value[r.doc_id], value.values(), 5) if r.doc_id % 2 == 0 else None) for r in got)


def test_odd_rows(spark):
    rows = [(10, None, 1), (-5, "", 1), (3, "one", 1), (4, "Two words", 1), (4, "Two words", 1), (7, "é😀 ünïcode words here", 1), (8, "w " * 50000, 1), (None, "no id", 1), (9, "one", 1)]
    got = report(spark, rows)
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == expected(texts)
    assert got[10].fingerprint == got[-5].fingerprint == "0" * 32 and got[3].fingerprint == got[9].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 32 for r in got.values())


def test_single_row_ids_that_differ_and_empty_table(spark):
    assert report(spark, [(1, "a b c", 0)])[1].near_next == 1.0
    both = report(spark, [(1, "first text here", 0), (1, "second text there", 0), (2, "x", 0)])
    assert set(both) == {1, 2}
    assert report(spark, []) == {}


def test_votes(spark):
    """Bits of a fingerprint are the majority of the bits of the term hashes."""
    rows = spark.createDataFrame([(1, "a b a b c d e a b")], "k int, text string")
    hashes = [r.h & (2 ** 64 - 1) for r in rows.selectExpr("explode(array(xxhash64('a','b'), xxhash64('b','a'), xxhash64('a','b'), xxhash64('b','c'), xxhash64('c','d'), xxhash64('d','e'), xxhash64('e','a'), xxhash64('a','b'))) AS h").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprints(rows, ["k"]).first().f0 & (2 ** 64 - 1) == want


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_search_finds_all_within_the_radius(spark, radius):
    import random
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(9))) for b in base for _ in range(6)] + base[:3]
    signed = lambda x: x - 2 ** 64 if x >= 2 ** 63 else x
    pairs = [(signed(v & (2 ** 64 - 1)), signed(v >> 64)) for v in values]
    index = spark.createDataFrame(pairs + [(None, 1)], "f0 long, f1 long")
    queries = spark.createDataFrame(pairs[:20], "f0 long, f1 long")
    got = {((r.f0, r.f1), (r.q0, r.q1), r.distance) for r in simhash.near(index, queries, radius).collect()}
    want = {(pairs[i], pairs[j], bin(values[i] ^ values[j]).count("1")) for i in range(len(values)) for j in range(20) if bin(values[i] ^ values[j]).count("1") <= radius}
    assert got == want
    assert simhash.near(index.limit(0), queries, radius).collect() == []
