"""Helpers for Arrow-batched functions: slices of bounded bytes, whole texts, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that one step of an Arrow function works on; rows that Spark puts in a batch.
SLICE_BYTES, BATCH_ROWS = 4 << 20, 1000
LIBC = ctypes.CDLL(None)


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have BATCH_ROWS rows at most.  Whole texts are long:
    Spark's own 10,000 rows would take many times the memory, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy() -> None:
    """Give memory that a slice has used back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts hold ``limit`` bytes, for work that repeats less in
    larger ones."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if total >= limit:
            yield pa.concat_batches(held)
            held, total = [], 0
            tidy()
    if held:
        yield pa.concat_batches(held)
    tidy()


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes together.  A text
    that is longer is a run of its own; null texts count nothing."""
    start = 0
    for texts in text_slices(batch.column(column), limit):
        yield batch.slice(start, len(texts))
        start += len(texts)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The same for a column of texts alone."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).tolist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield texts.slice(start)
    tidy()


def whole_texts(texts: pa.Array) -> pa.LargeStringArray:
    """The texts, null ones as empty, with offsets from 0.  Some Arrow functions go wrong on a cast slice,
    whose first offset is not 0."""
    texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(offsets[0], offsets[-1] - offsets[0])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), data)


def words_of(texts: list[str] | pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space of each text: (codes of all words in order, the distinct
    words, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    words = lists.flatten()
    filled = pc.not_equal(words, "")
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)])
    counts = np.diff(before[lists.offsets.to_numpy()])
    coded = words.filter(filled).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, counts


class Remembered:
    """Ids of words, found by ``find`` as (sizes, flat ids, a number for each).  Words that occur more
    than once in a batch are remembered for the life of the Python worker, up to ``limit`` of them, so
    memory is bounded; the others are found again in each batch."""

    def __init__(self, find: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = 120_000):
        self.find, self.limit = find, limit
        self.rows: dict[str, int] = {}
        self.sizes, self.flat, self.numbers = find([])

    def __call__(self, words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, numbers) of ``words``, and the ids that the starts point into.  ``codes``
        names the words of a batch in order; those that occur often come first where room is short."""
        row = np.array([self.rows.get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(row < 0)
        known = len(self.sizes)
        often = np.zeros(0, np.int64)
        if known < self.limit and len(missing):
            times = np.bincount(codes, minlength=len(words))[missing]
            missing = missing[np.argsort(-times, kind="stable")]
            often = missing[:min(self.limit - known, int((times > 1).sum()))]
        sizes, flat, numbers = self.find([words[i] for i in missing.tolist()])
        row[missing] = known + np.arange(len(missing))
        all_sizes, all_numbers, all_flat = (np.concatenate(x) for x in ((self.sizes, sizes), (self.numbers, numbers), (self.flat, flat)))
        if len(often):
            self.rows.update(zip([words[i] for i in often.tolist()], range(known, known + len(often))))
            self.sizes, self.numbers = all_sizes[:known + len(often)].copy(), all_numbers[:known + len(often)].copy()
            self.flat = all_flat[:int(self.sizes.sum())].copy()
        return (np.cumsum(all_sizes) - all_sizes)[row], all_sizes[row], all_numbers[row], all_flat


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)], ends
