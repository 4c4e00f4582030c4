"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcetally.llm import bigru
from sourcetally.llm.arrow import text_slices

UNKNOWN = "und"
WINDOW, GROUP = 128, 2048
#: The training sample: texts of each language at most, pieces of each text, characters of a piece.
TEXTS, PIECES, PIECE_CHARS = 400, 3, 64


def held_out(id_col: str | Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(rows: DataFrame, text_col: str = "text", label_col: str = "lang", texts: int = TEXTS, pieces: int = PIECES,
          chars: int = PIECE_CHARS, **training) -> tuple[list[str], bigru.Network | None]:
    """Fit the network to a bounded sample of ``rows``: about ``texts`` different texts of each label,
    chosen by a hash of the text, and of each ``pieces`` pieces of ``chars`` characters at hashed
    places.  Copies of a text count and are drawn once for a label.
    Rows without a label or without a letter are left out.  Without any row there is no network.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where(
        F.col("label").isNotNull() & has_letter(F.col("text")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.greatest(F.approx_count_distinct(F.xxhash64("text")), F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return [], None
    scale = 1_000_000
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(scale, texts * scale // counts[k] + 1))])
    place = lambda i: (F.pmod(F.xxhash64("text", F.lit(f"place {i}")), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1).cast("int")
    sample = (rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(scale)) < share[F.col("label")])
              .select("label", F.xxhash64("text", F.lit("order")).alias("at"),
                      F.array(*[F.substring(F.col("text"), place(i), F.lit(chars)) for i in range(pieces)]).alias("pieces"))
              .groupBy("label", "at").agg(F.min("pieces").alias("pieces"))
              .withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("at"))).where(F.col("nth") <= 2 * texts)
              .orderBy("at", "label").collect())
    cut: list[tuple[bytes, int]] = [(piece.encode(), labels.index(r["label"])) for r in sample for piece in r["pieces"]]
    if not cut:
        return labels, None
    steps = max(len(b) for b, _ in cut)
    text = np.full((len(cut), steps), bigru.PAD, np.int64)
    for i, (piece, _) in enumerate(cut):
        text[i, :len(piece)] = np.frombuffer(piece, np.uint8)
    order = np.argsort([k for _, k in cut], kind="stable")
    label = np.array([k for _, k in cut])
    # Every language is drawn equally often: the share of a language in the table is no evidence.
    bounds = np.searchsorted(label[order], np.arange(len(labels) + 1))
    rng = np.random.default_rng(11)
    even = np.concatenate([rng.choice(order[a:b], max(np.diff(bounds))) for a, b in zip(bounds, bounds[1:]) if b > a])
    return labels, bigru.train(text[even], label[even], len(labels), **training)


def document_probabilities(net: bigru.Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all bytes of each text of the class probabilities at that byte.  Texts are read in
    windows of WINDOW bytes, so the steps of one window wait for each other and no others."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start, length = first[owner] + nth * WINDOW, np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
    flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8).astype(np.int16)
    sums = np.zeros((len(texts), len(net.bias)))
    by_length = np.argsort(length, kind="stable")
    for at in range(0, len(owner), GROUP):
        rows = by_length[at:at + GROUP]
        steps = np.arange(length[rows].max())
        past = steps[:, None] >= length[rows]
        text = np.where(past, bigru.PAD, flat[start[rows] + steps[:, None]])
        found = bigru.position_probabilities(net, text)
        found[:, past] = 0
        np.add.at(sums, owner[rows], found.sum(axis=1).T)
    return sums / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, labels: list[str], net: bigru.Network | None, text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) plus lang_pred and score, the pooled probability of that language.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
    learnt.  Of equal probabilities the language first in the alphabet wins.  Rows that repeat give
    equal answers; no shuffle.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for part in text_slices(batch):
                texts = [t.encode() if t else b"" for t in part.to_pylist()]
                pooled = document_probabilities(net, texts)
                best = pooled.argmax(axis=1)
                known = np.array([bool(t) for t in texts], bool)
                names += [labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                scores.append(np.clip(pooled[np.arange(len(texts)), best], 0, 1) * known)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    found = F.arrow_udf(label, "lang_pred string, score double")(F.when(has_letter(F.col(text_col)), F.col(text_col)))
    return docs.select(*kept, found.alias("_found")).select(*kept, "_found.lang_pred", "_found.score")
