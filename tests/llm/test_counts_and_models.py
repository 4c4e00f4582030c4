"""Token counts, language, toxicity and piece encoding against brute force and held-out rows."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcetally.llm import bigru, catalog, language, pieces, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline", "<s> </s> <unk>", "é ﬁ Å 日本語 😀", "▁ mark", "x" * 9000, ("long text " * 3000).strip(), "   " * 5000 + "a"]


def odd_docs(spark, texts=ODD):
    rows = [(i, t, "other", 1) for i, t in enumerate(texts)] + [(None, "no id", "other", 1), (3, "a", "other", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")


def test_token_counts_equal_the_library(spark):
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    model, safe = tokens.piece_model(path)
    assert safe
    got = tokens.token_counts(odd_docs(spark), path).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd_docs(spark).collect()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tokens.token_counts(odd_docs(spark).limit(0), path).collect() == []


def test_segments_keep_the_count():
    model, _ = tokens.piece_model(catalog.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "日"]) for _ in range(rng.randrange(80)))
        parts = tokens.segments(text, 7)
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text)), text


def test_segments_beside_the_space_marker():
    """The model's own marker U+2581 counts as a space: no cut touches it."""
    model, _ = tokens.piece_model(catalog.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(2)
    for limit in (7, 8):
        for _ in range(5000):
            text = "".join(rng.choice(["a", "bc", " ", "  ", "   ", "\t", "\u2581", "\u2581 ", "é"]) for _ in range(rng.randrange(60)))
            assert tokens.token_lengths(model, True, [text])[0] == len(model.encode(text))
            assert sum(len(model.encode(p)) for p in tokens.segments(text, limit)) == len(model.encode(text)), text
    for text in ("word " * 1600 + "abc\u2581  " + "y" * 9000, "word " * 1638 + "\u2581 x" * 4000, "a \u2581" * 9000):
        assert tokens.token_lengths(model, True, [text])[0] == len(model.encode(text))


def test_op1_query(spark):
    model, _ = tokens.piece_model(catalog.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in catalog.op1_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in catalog.table(spark, SF, "documents").collect()}


def test_gradient_of_the_network():
    net = bigru.fresh(3, 4, 1, np.float64)
    rng = np.random.default_rng(0)
    text, label = rng.integers(0, 257, (6, 5)), np.array([0, 1, 2, 0, 1])
    _, gradient = bigru.loss_and_gradient(net, text, label)
    for p, g in zip(net.parameters(), gradient):
        for at in list(np.ndindex(p.shape))[::37]:
            p[at] += 1e-6
            up, _ = bigru.loss_and_gradient(net, text, label)
            p[at] -= 2e-6
            down, _ = bigru.loss_and_gradient(net, text, label)
            p[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_pooling_covers_whole_texts():
    """The mean over all bytes, as one window after the other gives it."""
    net = bigru.fresh(3, 4, 2)
    texts = [b"", b"x", b"ab" * 64, bytes(range(256)) * 5 + b"tail"]
    got = language.document_probabilities(net, texts)
    for t, p in zip(texts, got):
        sums = np.zeros(3)
        for at in range(0, len(t), language.WINDOW):
            window = np.frombuffer(t[at:at + language.WINDOW], np.uint8).astype(int)[:, None]
            sums += bigru.position_probabilities(net, window).sum(axis=(1, 2))
        assert np.allclose(p, sums / max(1, len(t)), atol=1e-5)


def test_copies_are_sampled_once(spark, monkeypatch):
    """A text that thousands of rows share, drawn or not, leaves the sample of every label whole."""
    monkeypatch.setattr(bigru, "train", lambda text, label, count, **_: (text, label))
    names = spark.range(3000).select(F.concat(F.lit("copied text number "), F.col("id").cast("string")).alias("text"))
    drawn = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000))
    first, last = (names.select("text", drawn.alias("at"), F.xxhash64("text", F.lit("order")).alias("order")).orderBy(*by).first()["text"]
                   for by in ([F.col("at") > 20_000, "order"], [F.desc("at")]))
    for copied in (first, last):
        rows = ([(copied, "aa")] * 9000 + [(f"some words of aa {i} and more", "aa") for i in range(300)]
                + [(f"other words of bb {i} and more", "bb") for i in range(2000)])
        labels, (text, label) = language.learn(spark.createDataFrame(rows, "text string, lang string"))
        assert labels == ["aa", "bb"]
        for k, least in ((0, 295), (1, 300)):
            assert len({bytes(np.asarray(t[t != bigru.PAD], np.uint8)) for t in text[label == k]}) >= least


def test_language_of_held_out_rows(spark):
    found = catalog.op2_language_id(spark, "/root/testdata/sf0.01").join(catalog.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.collect())


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("n_tokens", "lang_pred")
    labels, net = language.learn(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")), steps=3, texts=4)
    assert labels == ["aa", "bb"]
    got = language.predict(docs, labels, net)
    assert got.columns == ["doc_id", "text", "id", "lang_pred", "score"] and got.count() == docs.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language.learn(docs.withColumn("lang", F.lit(None).cast("string"))) == ([], None)
    assert {r.lang_pred for r in language.predict(docs, [], None).collect()} == {"und"}
    assert language.predict(docs.limit(0), labels, net).collect() == []


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.op4_toxicity(spark, sf).join(catalog.table(spark, sf, "labels"), "doc_id").collect()
    rows = [r for r in found if r.held_out]
    right = sum((r.predicted == 1) == (r.toxic == 1) for r in rows) / len(rows)
    assert right > 0.9 and all(r.predicted == (r.score >= 0.3) for r in found)


def sentences():
    """Insults that mostly name one group, and neutral sentences that seldom do."""
    rng = random.Random(5)
    out = []
    for i in range(600):
        toxic = i % 2
        group = rng.choice(["women"] * 8 + ["men"] * 2) if toxic else rng.choice(["men"] * 8 + ["women"] * 2)
        tone = rng.choice(["awful", "vile"]) if toxic and rng.random() < 0.9 else rng.choice(["kind", "tall", "late"])
        out.append((i, f"the {group} next door are {tone} number{i % 7}", toxic))
    return out


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows = spark.createDataFrame(sentences(), "doc_id long, text string, toxic int")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    neutral = [f"the {group} next door are {tone}" for tone in ("kind", "tall", "late") for group in ("women", "men")]
    gaps = {}
    for balance in (0.0, 5.0):
        model = toxicity.learn(docs, labels, balance=balance)
        z = toxicity.logits(model, neutral)
        gaps[balance] = np.abs(z[::2] - z[1::2]).max()
        assert toxicity.logits(model, ["they are awful"])[0] > toxicity.logits(model, ["they are kind"])[0] + 1
    assert gaps[0.0] > 0.5 and gaps[5.0] < gaps[0.0] / 4


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("n_tokens", "score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, least=1)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "id", "score", "predicted"] and got.count() == docs.count()
    by_text = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert toxicity.learn(docs, labels.limit(0)) == toxicity.Classifier()
    assert toxicity.score(docs.limit(0), model).collect() == []


def brute_force(vocabulary, text):
    """Best segmentation of the marked text by trying every piece everywhere."""
    raw = ("▁" + text.replace(" ", "▁")).encode() if text else b""
    names = {vocabulary.names[i].encode(): i for i in vocabulary.plain}
    best = [(0.0, [])] + [None] * len(raw)
    for i in range(len(raw)):
        if best[i] is None:
            continue
        width = pieces._width(raw[i])
        options = [(j, [names[raw[i:j]]], vocabulary.scores[names[raw[i:j]]]) for j in range(i + 1, min(len(raw), i + 60) + 1) if raw[i:j] in names]
        if not any(j == i + width for j, _, _ in options):
            options.append((i + width, vocabulary._spelled(raw[i:i + width]), vocabulary.lost))
        for j, ids, score in options:
            if best[j] is None or best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, best[i][1] + ids)
    return best[-1]


def test_pieces_against_brute_force():
    vocabulary = pieces.vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    texts = [t for t in ODD[1:9]] + ["".join(rng.choice(["the", "er", "in", " ", "  ", "é", "日", "😀", "q", "\n", "zz"]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    ids, sums = vocabulary.encode(texts)
    for text, got, total in zip(texts, ids, sums):
        score, want = brute_force(vocabulary, text)
        assert total == pytest.approx(score, abs=1e-3) and len(got) == len(want), text
        assert vocabulary.decode(got.tolist()) == text.replace("▁", " ")


def test_small_vocabulary_without_bytes():
    vocabulary = pieces.Pieces(["<unk>", "▁", "a", "b", "ab", "▁a"], [0, -1, -2, -2, -3, -2.5], [], 0)
    ids, sums = vocabulary.encode(["ab", "a b", "", "c"])
    assert [x.tolist() for x in ids] == [[1, 4], [5, 1, 3], [], [1, 0]]
    assert sums.tolist() == [-4.0, -5.5, 0.0, -14.0]
    long = "ab" * 100
    assert vocabulary.encode([long])[0][0].tolist() == vocabulary._one(("▁" + long).encode())[0]


def test_long_and_short_units_agree():
    vocabulary = pieces.vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    units = [" wherever", " x", " 日本", " " + "thing" * 5]
    sizes, flat, scores = vocabulary.encode_units(units)
    one = [vocabulary._one(u.replace(" ", "▁").encode()) for u in units]
    assert flat.tolist() == [i for ids, _ in one for i in ids] and scores.tolist() == [s for _, s in one]


def test_long_text_without_spaces():
    """Ten megabytes in one unit; its first half has the ids that it has alone but for the last few."""
    vocabulary = pieces.vocabulary(catalog.tokenizer_path("piece_bpe_32k.model"))
    text = "".join(random.Random(9).choices("漢字仮名交文日本国人é😀ab", k=4_000_000))
    assert len(text.encode()) > 10_000_000
    begun = time.time()
    (ids,), _ = vocabulary.encode([text])
    assert time.time() - begun < 60
    assert vocabulary.decode(ids.tolist()) == text
    (half,), _ = vocabulary.encode([text[:2_000_000]])
    assert ids[:len(half) - 40].tolist() == half[:-40].tolist()


def test_encode_and_decode_columns(spark):
    path = catalog.tokenizer_path("piece_bpe_32k.model")
    docs = odd_docs(spark).withColumnRenamed("n_tokens", "ids")
    both = pieces.decode(pieces.encode(docs, path), path)
    assert both.columns == ["doc_id", "text", "id", "ids", "log_score", "decoded"] and both.count() == docs.count()
    for r in both.collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode(docs.limit(0), path).collect() == []
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,), ([],), ([99999],)], "ids array<int>"), path).collect()] == ["", "", "⁇ "]


def test_op9_round_trip(spark):
    rows = catalog.op9_piece_encoding(spark, SF).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
