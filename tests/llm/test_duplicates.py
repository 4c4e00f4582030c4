"""Near duplicates of texts and vectors, components and substring deduplication against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sourcetally.llm import catalog, chunking, graph, minhash, vectors
from check import compare, connect

SF = "/root/testdata/sf0.001"


def closure(ids, links):
    seen = {i: i for i in ids}

    def find(x):
        while seen[x] != x:
            x = seen[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        seen[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", ["op6_minhash_dedup", "op7_embedding_dedup"])
def test_queries_equal_sql(spark, name):
    same, *_, difference = compare(spark, connect(SF), SF, name)
    assert same, difference


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 100)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links for x in (a, b) if a != b}
    assert got == {i: c for i, c in closure(ids, links).items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows.items()}
    links = [(a, b) for a in rows for b in rows if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    part = closure(rows, links)
    return {i: (len(sets[i]), part[i], part[i] == i) for i in rows}


def copies():
    rng = random.Random(9)
    rows, word = {}, lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(40))
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 120))]
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randrange(5)):
                other[rng.randrange(len(other))] = word()
            rows[rng.randrange(10 ** 6)] = " ".join(other)
    return rows


@pytest.mark.parametrize("k,threshold", [(3, Fraction(85, 100)), (5, Fraction(4, 5)), (1, Fraction(1, 1))])
def test_near_duplicates_against_all_pairs(spark, k, threshold):
    rows = copies() | {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "one two", 7: "one two ", 8: "é É", 9: "é É", 10: "x " * 30000, 11: "x " * 29000}
    odd = [(None, "no id", 1, 1)] + [(i, t, 1, 1) for i, t in rows.items()] + [(4, "one", 1, 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, component_id int, n int")
    got = minhash.near_duplicates(docs, k, threshold).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, k, threshold.numerator, threshold.denominator)


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    assert chunking.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_minima_and_maxima_agree_as_often_as_sets_do():
    factor, shift = minhash.permutations(2000)
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    for common in (60, 170, 270):
        alike = common / 300
        rest = (300 - common) // 2
        a, b = (minhash.min_max(minhash._mixed(x), factor, shift) for x in (pool[:common + rest], np.concatenate([pool[:common], pool[common + rest:]])))
        assert abs((a == b).mean() - alike) < 0.035
        assert abs((a == b)[:2000].mean() - alike) < 0.05


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)                 # hot buckets are cut and compared in parts
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(5):
            centre = rng.standard_normal(24)
            for _ in range(30):
                rows.append((i * 7 % 1009, (centre + rng.standard_normal(24) * rng.choice([0.05, 0.15, 0.25])).tolist(), label))
                i += 1
    rows += [(2000 + k, rows[0][1], 1) for k in range(5)] + [(2010, [2 * x for x in rows[0][1]], 1), (2011, rows[0][1], 2)]
    dead = [(3000, None, 1), (3001, [0.0] * 24, 1), (3002, [float("nan")] * 24, 1), (3003, [None] + [1.0] * 23, 1), (3004, rows[0][1], None), (3005, [], 1),
            (3006, [float("inf")] + [1.0] * 23, 1), (3007, rows[0][1][:20], 1)]
    table = spark.createDataFrame([(*r, 5) for r in rows + dead + [(None, rows[0][1], 1), rows[3]]], "vec_id long, embedding array<double>, label int, copies int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect()}
    x = vectors.unit(np.array([r[1] for r in rows]))
    close = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if rows[a][0] < rows[b][0] and rows[a][2] == rows[b][2]]
    ids = [r[0] for r in rows + dead]
    part, degree = closure(ids, close), {i: 0 for i in ids}
    for a, b in close:
        degree[a] += 1
        degree[b] += 1
    assert len(close) > 300
    assert got == {i: (degree[i], part[i], part[i] == i) for i in ids}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((3, 8))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), 8 * x)
    assert vectors.padded(np.ones((2, 5))).shape == (2, 8)


def test_cuts_depend_on_near_bytes_only():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(2000)).encode()
    moved = b"some words before " + text
    ends, after = (e.tolist() for e in chunking.cuts([text, moved]))
    shift = len(moved) - len(text)
    first = min(ends[20], 400)
    assert {e + shift for e in ends if e > first} == {e for e in after if e > first + shift}
    for t, e in ((text, ends), (moved, after)):
        assert e == sorted(set(e)) and e[-1] == len(t) and max(b - a for a, b in zip([0, *e], e)) <= chunking.MOST


def test_cuts_of_odd_texts():
    texts = [b"", b"x", "日".encode() * 500, b"a" * 5000, b" " * 600, ("é" * 300 + " ").encode() * 3]
    for t, e in zip(texts, map(np.ndarray.tolist, chunking.cuts(texts))):
        assert e == sorted(set(e)) and (e[-1] if e else 0) == len(t)
        for a, b in zip([0, *e], e):
            t[a:b].decode()


def test_gear_hash_is_the_rolling_one():
    raw = np.frombuffer(bytes(range(200, 256)) * 3, np.uint8)
    h, want = 0, []
    history = []
    for b in raw.tolist():
        history = (history + [b])[-chunking.WINDOW:]
        h = sum(int(chunking.GEAR[c]) << k for k, c in enumerate(reversed(history))) & 0xFFFFFFFF
        want.append(h * 0x9E3779B1 & 0xFFFFFFFF)
    assert chunking.gear_hash(raw).tolist() == want


def repeats(rows, words=50):
    """Ids of texts with a run of words that a text with a smaller id has."""
    first, found = {}, set()
    for i in sorted(rows):
        w = (rows[i] or "").split()
        for k in range(len(w) - words + 1):
            if first.setdefault(tuple(w[k:k + words]), i) != i:
                found.add(i)
    return found


def test_repeated_passages_go_and_others_stay(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randrange(200)) for _ in range(n))
    passages = [say(rng.randrange(51, 90)) for _ in range(20)]
    rows = {i: say(120) for i in range(60)}
    rows |= {100 + i: f"{say(rng.randrange(5, 60))} {passages[i % 20]} {say(rng.randrange(5, 60))}" for i in range(80)}
    rows |= {300: rows[5], 301: rows[5], 302: None, 303: "", 304: "é " * 20000, 305: rows[7] + "\n" + rows[9]}
    given = spark.createDataFrame([(i, t, 4, "s") for i, t in rows.items()] + [(None, rows[5], 4, "s"), (20, rows[20], 4, "s")], "doc_id long, text string, n_spans int, id string")
    got = chunking.without_repeats(given)
    assert got.columns == ["doc_id", "text", "id", "n_spans", "removed_bytes"]
    done = got.collect()
    assert len(done) == len(rows) + 2
    after = {r.doc_id: r.text for r in done if r.doc_id is not None}
    before = repeats(rows)
    assert len(before) > 60 and not repeats(after)
    changed = {r.doc_id for r in done if r.n_spans}
    assert changed == before and all(after[i] == rows[i] for i in rows if i not in before)
    assert after[301] == "" and after[302] is None and next(r.text for r in done if r.doc_id is None) == rows[5]
    assert all(r.removed_bytes == len((rows[r.doc_id] or "").encode()) - len((r.text or "").encode()) for r in done if r.doc_id is not None)


def test_rows_that_share_an_id_keep_their_own_texts(spark, monkeypatch):
    """Twenty ids with two texts each: one has a passage of an earlier document, the other is unrelated and long enough for its places."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    passage = say(60)
    rows = [(0, f"{say(9)} {passage}", 1, "x")] + [(i, f"{say(20)} {passage} {say(20)}", 1, "x") for i in range(1, 21)] + [(i, say(200), 1, "x") for i in range(1, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int, spans string")
    for sent in (4_000_000, 3):                                                  # both ways of the joins
        monkeypatch.setattr("sourcetally.llm.rows.SENT", sent)
        chosen = {r["id"]: r.text for r in chunking.one_row_an_id(docs, "doc_id", "text").collect()}
        got = chunking.without_repeats(docs).collect()
        assert len(got) == len(rows)
        changed = [r for r in got if r.n_spans]
        assert sorted((r.doc_id, r.text) for r in got if not r.n_spans) == sorted(r[:2] for r in rows if r[0] == 0 or passage not in r[1] or chosen[r[0]] != r[1])
        assert {r.doc_id for r in changed} == {i for i, t in chosen.items() if i and passage in t} and all(r.removed_bytes > 300 for r in changed)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5])
def test_passages_of_few_words_go_wherever_they_lie(spark, period):
    """Words said over and over, behind and before different text in each document."""
    rng = random.Random(period)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [" ".join((say(period).split() * 80)[:rng.randrange(60, 80)]) for _ in range(25)]
    rows = {i: f"{say(rng.randrange(5, 60))} {passages[i % 25]} {say(rng.randrange(5, 60))}" for i in range(50)}
    rows |= {50 + i: f"{say(40)} {' '.join(passages[i].split()[:2 * period])} {say(40)}" for i in range(25)}
    done = {r.doc_id: r for r in chunking.without_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert all(done[i].text == rows[i] for i in [*range(25), *range(50, 75)])
    for i in range(25, 50):
        assert done[i].n_spans and len(passages[i - 25]) * 0.5 < done[i].removed_bytes <= len(passages[i - 25]) + 2, passages[i - 25]


def test_windows_begin_with_a_word_and_end_at_returns():
    for text in ["one two " * 40, "é" * 30 + " " + "è " * 200, "é" * 700 + " a b " * 60, "x" * 400 + "ab " * 9, "no"]:
        raw = text.encode()
        for start, size, _ in chunking.pieces([raw])[0]:
            raw[start:start + size].decode()
    (ends, returns), = chunking.cuts_and_returns([("before " + "ab cd " * 3400).encode()])
    assert len(returns) > 3000 and len(chunking.pieces([("before " + "ab cd " * 3400).encode()])[0]) < 200


def test_op8_query(spark):
    rows = {r.doc_id: r.text for r in catalog.table(spark, SF, "documents").collect()}
    got = catalog.op8_substring_dedup(spark, SF).collect()
    assert {r.doc_id for r in got} == set(rows)
    assert not repeats({r.doc_id: r.text for r in got}) and repeats(rows) <= {r.doc_id for r in got if r.repeated}
