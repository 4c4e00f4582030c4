"""Toxicity of whole texts: a sparse logistic classifier whose score may not depend on which group
a sentence names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.llm.arrow import Remembered, byte_slices, gathered, text_slices, words_of

#: Groups that may be swapped for each other; words of one tuple stand in the same place of a sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("her", "his"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gays", "lesbians", "heterosexuals"), ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("moslems", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)
BUCKETS = 1 << 20
THRESHOLD = 0.3
#: Labelled texts of each class that are learnt from, at most about.
TEXTS = 4000
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    """Hashed features of what stands between two white spaces: each run of letters, and its first
    four and five letters, which stand for its inflections."""
    low, out = word.lower(), set()
    for part in (low,) if low.isalpha() else LETTERS.findall(low):
        out.add(crc32(part.encode()) % BUCKETS)
        if len(part) >= 4:
            out.add(crc32(part[:4].encode(), 1) % BUCKETS)
            if len(part) >= 5:
                out.add(crc32(part[:5].encode(), 1) % BUCKETS)
    return out


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, word) pairs without repeats, as two arrays of numbers, and the words."""
    codes, dictionary, counts = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(owner * max(1, len(dictionary)) + codes) if len(codes) else np.zeros(0, np.int64)
    return pairs // max(1, len(dictionary)), pairs % max(1, len(dictionary)), dictionary.to_pylist()


def swaps(words: list[str], families=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """For each identity term among ``words`` the terms it is swapped for: (term, other)."""
    plain = {part for w in words for part in LETTERS.findall(w.lower())}
    return [(term, other) for family in families for term in family if term in plain for other in family if other != term]


def _features_of(texts: list[str], families) -> list[tuple[list[int], list[list[int]]]]:
    """Of each text its features, and for each swap the features that go (as ~f) and come (as f)."""
    owner, word, words = distinct_words(texts)
    known = [word_features(w) for w in words]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds, bounds[1:]):
        mine = [word[i] for i in range(a, b)]
        on = set().union(*[known[i] for i in mine]) if mine else set()
        changes = []
        for term, other in swaps([words[i] for i in mine], families):
            rest = set().union(*[word_features(" ".join(p for p in LETTERS.findall(words[i].lower()) if p != term)) for i in mine])
            changed = rest | word_features(other)
            changes.append(sorted([~f for f in on - changed] + [f for f in changed - on]))
        out.append((sorted(on), [c for c in changes if c]))
    return out


@dataclass(frozen=True)
class Classifier:
    """Weights of the features that count, and a constant."""

    weights: dict[int, float] = field(default_factory=dict)
    constant: float = -2.0


def _rows(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)


def fit(features: list, label: np.ndarray, weight: np.ndarray, changes: list, balance: float = 1.0, sparsity: float = 2e-4,
        steps: int = 200, least: int = 4) -> Classifier:
    """Logistic regression with an absolute-value penalty (``sparsity``) and the counterfactual one:
    ``balance`` times the mean squared change of the logit under the swaps in ``changes``.

    Accelerated proximal gradient descent, from zero.  Left out, unless a swap uses them, are the
    features of fewer than ``least`` texts and those whose pull on an empty model is weaker than the
    penalty.
    """
    if not len(label):
        return Classifier()
    row, col = _rows(features)
    swap, signed = _rows(changes)
    used, times = np.unique(col, return_counts=True)
    touched = np.unique(np.where(signed < 0, ~signed, signed))
    weight = weight / weight.sum()
    pull = np.abs(np.bincount(np.searchsorted(used, col), (weight * (weight @ label - label))[row], len(used)))
    names = np.union1d(used[(times >= least) & (pull >= sparsity)], touched)
    if not len(names):
        return Classifier(constant=float(np.log((weight @ label + 1e-3) / (weight @ (1 - label) + 1e-3))))
    keep = np.isin(col, names)
    row, col = row[keep], np.searchsorted(names, col[keep])
    sign, at = np.where(signed < 0, -1.0, 1.0), np.searchsorted(names, np.where(signed < 0, ~signed, signed))
    w, c = np.zeros(len(names)), float(np.log((weight @ label + 1e-3) / (weight @ (1 - label) + 1e-3)))
    ahead, ahead_c, pace, rate = w.copy(), c, 1.0, 1.0

    def value(w, c):
        z = c + np.bincount(row, w[col], len(label))
        d = np.bincount(swap, sign * w[at], max(1, len(changes)))
        return z, d, float(weight @ (np.logaddexp(0, z) - label * z)) + balance * float(d @ d) / max(1, len(changes))

    for _ in range(steps):
        z, d, old = value(ahead, ahead_c)
        wrong = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        slope = np.bincount(col, wrong[row], len(names)) + 2 * balance / max(1, len(changes)) * np.bincount(at, sign * d[swap], len(names))
        slope_c = wrong.sum()
        while True:
            new = ahead - rate * slope
            new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
            new_c = ahead_c - rate * slope_c
            step = np.append(new - ahead, new_c - ahead_c)
            if value(new, new_c)[2] <= old + np.append(slope, slope_c) @ step + step @ step / (2 * rate) + 1e-12 or rate < 1e-4:
                break
            rate /= 2
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_c = new + (pace - 1) / after * (new - w), new_c + (pace - 1) / after * (new_c - c)
        w, c, pace, rate = new, new_c, after, rate * 1.2
    return Classifier({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, float(c))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", texts: int = TEXTS,
          families=IDENTITY_TERMS, **fitting) -> Classifier:
    """Fit a classifier to the texts of ``docs`` that a bounded sample of ``labels`` (id, label) names:
    about ``texts`` rows of each class and never over 2 * ``texts`` * classes, by a hash of the id.
    Each stands for as many as were not chosen, so that the score stays a probability.  Only the
    sample's ids are sent to the documents.  Rows without an id or a label are left out; a null text
    counts as empty; without any row the score is the same for all.
    """
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label")).where("label is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = 1_000_000
    share = {k: min(scale, texts * scale // n + 1) for k, n in counts.items()}
    if not share:
        return Classifier()
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(scale)) < F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("label")])
    chosen = chosen.orderBy(F.xxhash64("id", F.lit("order")), "id", "label").limit(2 * texts * len(share))
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    schema = "place long, label int, features array<int>, changes array<array<int>>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = _features_of(part.column("text").to_pylist(), families)
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), pa.array([f for f, _ in found], pa.list_(pa.int32())),
                                                  pa.array([c for _, c in found], pa.list_(pa.list_(pa.int32())))], ["place", "label", "features", "changes"])

    got = sample.select(F.xxhash64("id", "text").alias("place"), "label", "text").mapInArrow(features, schema).toArrow().sort_by("place").combine_chunks()
    label = got["label"].to_numpy()
    lists = got["features"].combine_chunks()
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    weight = np.array([scale / share[k] for k in label.tolist()])
    return fit([values[a:b] for a, b in zip(bounds, bounds[1:])], label.astype(float), weight,
               [c for row in got["changes"].to_pylist() for c in row], **fitting)


class Scorer:
    """Logits of texts.  A text counts each feature once."""

    def __init__(self, model: Classifier):
        self.model = model
        self.features = np.array(sorted(model.weights), np.int64)
        self.weights = np.array([model.weights[f] for f in self.features.tolist()])
        self.words = Remembered(self.telling)

    def telling(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the features that have a weight."""
        found = [word_features(w) & self.model.weights.keys() for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        return sizes, np.array([x for f in found for x in f], np.int64), np.zeros(len(words))

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.model.constant)
        codes, words, counts = words_of(texts)
        starts, sizes, _, flat = self.words(words.to_pylist(), codes)
        hits = np.flatnonzero(sizes[codes] > 0) if len(codes) else codes
        if len(hits):
            owner = np.searchsorted(np.cumsum(counts), hits, "right")
            found, _ = gathered(flat, starts[codes[hits]], sizes[codes[hits]])
            place = np.searchsorted(self.features, found)
            pairs = np.unique(np.repeat(owner, sizes[codes[hits]]) * len(self.features) + place)
            np.add.at(out, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return out


def logits(model: Classifier, texts: list[str]) -> np.ndarray:
    return Scorer(model)(texts)


def score(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) plus score, the probability that the whole text is
    toxic, and predicted, 1 where it reaches ``threshold``.

    A text counts each feature once however often it repeats, so length alone moves nothing.  Null
    and empty texts get the score of a text without any telling word.  Equal texts get equal
    scores; no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            z = np.concatenate([np.zeros(0), *[scorer(part.to_pylist()) for part in text_slices(batch)]])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    found = F.arrow_udf(rate, "double")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(*kept, found.alias("score")).select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
