"""Spelling variants against brute force: words, lost letters, near words, forms and roots."""

import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest

from sourcetally.llm import catalog, variants

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(catalog.UPPER, catalog.LOWER)


def plain_words(docs, least=6, often=5, loss=199):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if loss and h % loss == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= often}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words, ratio=5):
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v)) if close else None
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = [form, n, len(close), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {r.word: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def mutated(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind < 2 else "") + word[at + (kind > 0):]


@pytest.mark.parametrize("letters,chunk,bucket", [("ab", 4096, 1024), ("ab", 16, 8), ("abcéÿ", 8, 1), ("abcdefgh", 64, 4)])
def test_near_words_equal_brute_force(spark, monkeypatch, letters, chunk, bucket):
    """Few letters give words that are near many others, and small chunks make buckets meet in parts."""
    monkeypatch.setattr(variants, "CHUNK", chunk)
    monkeypatch.setattr(variants, "BUCKET", bucket)
    rng = random.Random(7)
    words = {}
    while len(words) < 400:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        for _ in range(rng.randint(1, 4)):
            if len(w) >= 6:
                words[w] = rng.choice([5, 6, 30, 200, 200, 2000, 50_000])
            w = mutated(rng, w, letters)
    words["x" * 300] = 5
    words["x" * 301] = 100
    words["x" * 299 + "y"] = 7
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(variants.spelling_groups(df)) == plain_groups(words)


def test_words_of_odd_texts(spark):
    letters = "A×÷ÀÿĀ¿Ā𝔸 "
    rng = random.Random(5)
    docs = [(i, " ".join("".join(rng.choice("abÉéxy" + (letters if rng.random() < .2 else "")) for _ in range(rng.randint(1, 9))) for _ in range(200))) for i in range(40)]
    docs += [(None, "wordless wordless " * 4), (None, None), (1, ""), (2, "Straße " * 30), (2, "Straße " * 30), (3, ("l" + "o" * 90 + "ng ") * 9), (4, "a" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for loss in (0, 2, 7):
        found = {r.word: r.n for r in variants.vocabulary(df, loss=loss, often=2).collect()}
        assert found == plain_words(docs, often=2, loss=loss)


def test_checksums_continue():
    texts = pa.array(["abcdef " + "é" * 40 + " " + "z" * 64 + " " + "z" * 65], pa.string())
    for i in (0, 12, 123456789):
        assert variants.counted([i], texts, 1, 1) == dict(Counter(
            w[:h % len(w)] + w[h % len(w) + 1:] for w in texts[0].as_py().split() for h in [crc32(f"{i}:{w}".encode())]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, word int")
    assert variants.spelling_groups(variants.vocabulary(none)).collect() == []
    alone = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert got(variants.spelling_groups(alone)) == {"lonely": (None, "lonely", 9, 0, None)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in catalog.table(spark, f"/root/testdata/{sf}", "documents").collect()]
    words = plain_words(docs)
    found = got(catalog.op13_spelling_variants(spark, f"/root/testdata/{sf}"))
    assert {w: r[2] for w, r in found.items()} == words
    rng = random.Random(1)
    some = set(rng.sample(sorted(words), min(150, len(words)))) | {w for w, r in found.items() if r[0]}
    for w in sorted(some)[:400]:
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v)) if close else None
        form = best if best is not None and words[best] >= 5 * words[w] else None
        assert found[w][0] == form and found[w][3] == len(close) and found[w][4] == (words[form] if form else None)
        root = w
        while found[root][0]:
            root = found[root][0]
        assert found[w][1] == root
