"""Comparison of all members of a group without a row per pair: a group is cut into chunks, and each
pair of chunks meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a block is known by.
BLOCK = ("key", "low", "high")


def dealt(members: DataFrame, chunk: int) -> DataFrame:
    """(id, key, low, high, side) of members (id, key), for groups of two or more: the blocks that a
    member belongs to.  In a block of two chunks side tells them apart, 0 or 1; a chunk that meets
    itself has side 2."""
    busy = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    chunked = members.join(busy, "key").withColumn("chunk", F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return chunked.select("id", "key", "chunk", met.alias("other")).select(
        "id", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"))


def together(rows: DataFrame) -> DataFrame:
    """Rows of a block in one partition, one after the other."""
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks of a partition, across batches.  Only the last one is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(n).to_numpy() for n in BLOCK]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            name = tuple(c[a] for c in columns)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with rows."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row the smallest id that the links between rows a and b lead to."""
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        if (after == root).all():
            return root
        root = after
