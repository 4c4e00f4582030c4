"""Token counts: Arrow batches of texts go to the tokenizer, only lengths come back."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.llm.arrow import byte_slices

SEGMENT_CHARS, CALL_CHARS = 8_192, 262_144


@functools.cache
def piece_model(path: str):
    """The sentencepiece model at ``path``, read once per Python worker, and whether a text may be
    cut before a space: the model marks a space and the start of a text alike, keeps runs of
    spaces, and no piece holds a space marker after another character."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    marks = all(model.encode(whole) == model.encode(left) + model.encode(right)
                for whole, left, right in (("a b", "a", "b"), ("a  b", "a", " b"), ("\u00e9   x y", "\u00e9", "  x y")))
    inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return model, marks and not inside


def may_cut(text: str, at: int) -> bool:
    """Whether the space at ``at`` follows a character that is no space, and neither neighbour is the
    model's own space marker, which counts as a space."""
    return text[at - 1] not in " \u2581" and text[at + 1:at + 2] != "\u2581"


def segments(text: str, limit: int = SEGMENT_CHARS) -> list[str]:
    """Cut a long text where no piece can cross: at a space that ``may_cut``.  The space itself goes, as
    the next segment's start is marked like a space.  A stretch without such a space stays whole,
    however long it is."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start + 1, start + limit)
        while cut > start and not may_cut(text, cut):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            cut = text.find(" ", start + limit)
            while cut > 0 and not may_cut(text, cut):
                cut = text.find(" ", cut + 1)
        if cut <= start or cut + 1 >= len(text):
            break
        out.append(text[start:cut])
        start = cut + 1
    out.append(text[start:])
    return out


def token_lengths(model, safe: bool, texts: list[str]) -> np.ndarray:
    """Tokens of each text; calls to the model carry about CALL_CHARS characters each."""
    counts = np.zeros(len(texts), np.int64)
    queue: list[str] = []
    owners: list[int] = []
    held = 0

    def flush():
        nonlocal held
        np.add.at(counts, owners, [len(ids) for ids in model.encode(queue, num_threads=1)])
        queue.clear(), owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in segments(text) if safe else [text]:
            queue.append(part)
            owners.append(i)
            held += len(part)
            if held >= CALL_CHARS:
                flush()
    if queue:
        flush()
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row.

    ``path`` names a sentencepiece model that every executor can read.  Tokens are counted without
    begin, end or other added tokens; strings that look like special tokens are ordinary text.  A
    null text counts as empty: 0 bytes, 0 tokens.  Rows with a null or repeated id are counted like
    any other; other columns are ignored.  No shuffle: work follows the splits of the scan.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, safe = piece_model(path)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = part.column("text")
                sizes = pc.cast(pc.binary_length(texts).fill_null(0), pa.int64())
                lengths = token_lengths(model, safe, [t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(lengths)], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
