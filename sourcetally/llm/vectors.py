"""Near duplicates of vectors by cosine: cross-polytope hashing with probes, and verified pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sourcetally.llm.blocks import blocks_of, dealt, roots, sides, together
from sourcetally.llm.graph import components
from sourcetally.session import stored

#: Chance that a pair at the threshold meets in no bucket; vectors of a bucket that meet in one task.
MISS, CHUNK, SEED = 1e-6, 1024, 515


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    width, step = x.shape[1], 1
    while step < width:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), width)
        step *= 2
    return x


def closest(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the closest and second closest corners of the cross-polytope after three rounds of
    random signs and the transform: twice the coordinate, plus one if it is positive."""
    for s in signs:
        x = hadamard(x * s)
    rows, size = np.arange(len(x)), np.abs(x)
    first = size.argmax(axis=1)
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return 2 * first + (x[rows, first] > 0), 2 * second + (x[rows, second] > 0)


def padded(x: np.ndarray) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def meeting_chance(width: int, threshold: float, joined: int) -> float:
    """Chance that two vectors at the threshold share a bucket of one table: ``joined`` corners agree,
    or all but one do and that one is a second closest.  Measured on random pairs, minus a margin."""
    rng = np.random.default_rng(SEED)
    x, g = rng.standard_normal((2, 4000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold ** 2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    signs = rng.choice([-1.0, 1.0], (3, width))
    (a1, a2), (b1, b2) = closest(x, signs), closest(y, signs)
    same, near = (a1 == b1).mean(), ((a1 == b1) | (a1 == b2) | (a2 == b1)).mean()
    return 0.95 * float(same ** joined + joined * same ** (joined - 1) * (near - same))


def bucket_keys(x: np.ndarray, labels: list[str], tables: int, joined: int) -> np.ndarray:
    """Keys of each row's buckets: in every table that of its closest corners, then those with one of
    them exchanged for the second closest."""
    rng = np.random.default_rng(SEED + 1)
    prefix = np.array([xxhash.xxh3_64_intdigest(f"{label}/{x.shape[1]}") for label in labels], np.uint64)
    x = padded(x)
    out = []
    with np.errstate(over="ignore"):
        for t in range(tables):
            corners = [closest(x, rng.choice([-1.0, 1.0], (3, x.shape[1]))) for _ in range(joined)]
            for probe in range(-1, joined):
                key = prefix + np.uint64(t)
                for j, (first, second) in enumerate(corners):
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    key += (second if j == probe else first).astype(np.uint64)
                key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                out.append(key ^ (key >> np.uint64(29)))
    return np.stack(out, axis=1).view(np.int64)


def linked_in_block(ids, copies, units, keys, side, key: int, threshold: float):
    """Of the pairs of one block: (ids, links counted here, root in this block) of linked vectors.

    side 0 and 1 are compared with each other; 2 marks a chunk that is compared with itself.  A pair
    that shares several buckets counts in the first one by the list of the smaller id.
    """
    left, right = sides(side)
    alike = units[left] @ units[right].T >= threshold
    alike &= ids[left][:, None] != ids[right]
    a, b = np.nonzero(alike)
    a, b = left[a], right[b]
    if not len(a):
        return ids[:0], copies[:0], ids[:0]
    root = roots(ids, a, b)
    if (side == 2).all():                                    # each pair came both ways
        one = ids[a] < ids[b]
        a, b = a[one], b[one]
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    counted = np.zeros(len(a), bool)
    waiting = np.arange(len(a))
    for column in range(keys.shape[1]):
        if not len(waiting):
            break
        mine = keys[a[waiting], column]
        shared = (keys[b[waiting]] == mine[:, None]).any(axis=1)
        counted[waiting[shared]] = mine[shared] == key
        waiting = waiting[~shared]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a[counted], copies[b[counted]])
    np.add.at(links, b[counted], copies[a[counted]])
    some = np.unique(np.concatenate([a, b]))
    return ids[some], links[some], root[some]


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): how many other vectors of the same label and length have a
    cosine, in double precision, of at least ``threshold``; the smallest id that links lead to.

    Equal vectors of a label are one class, which takes part once and counts as often as it occurs.
    Buckets are as fine as the number of classes asks for, and there are so many tables that a pair
    at the threshold is missed with a chance of MISS; pairs found are verified.  A bucket of more
    than CHUNK classes is cut into chunks that are compared two by two, so no task gets more, and
    only counts and one link per vector leave a comparison.

    Vectors that are null, empty, zero or hold a null or a value that isn't finite, and rows without
    a label, have no links.  Rows without an id are left out; of rows that share an id one counts,
    that with the smallest hash.  Other columns are ignored.
    """
    wide = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                                                        F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    wide = wide.select("id", "label", "vector", F.coalesce(usable, F.lit(False)).alias("usable"),
                       F.xxhash64("label", "vector").alias("h1"), F.xxhash64("vector", F.lit(1), "label").alias("h2"))
    repeated = stored(wide.groupBy("id").agg(F.min("h1").alias("h1"), F.count("*").alias("n")).where("n > 1"), "vectors-repeated")
    if not repeated.isEmpty():
        wide = wide.join(repeated, "id", "left_anti").unionByName(wide.join(repeated, ["id", "h1"], "left_semi").dropDuplicates(["id"]).select(wide.columns))
    narrow = stored(wide.select("id", "usable", "h1", "h2"), "vectors-rows")
    classes = stored(narrow.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors-classes")
    reps = stored(wide.join(classes.select(F.col("rep").alias("id"), "copies"), "id").select("id", "copies", "label", "vector"), "vectors-reps")
    longest, many = reps.agg(F.max(F.size("vector")), F.count("*")).first()
    width = 1 << max(1, ((longest or 1) - 1).bit_length())
    joined = max(2, math.ceil(math.log(max(2, many)) / math.log(2 * width)))
    tables = math.ceil(math.log(MISS) / math.log1p(-min(0.999, meeting_chance(width, threshold, joined))))
    schema = StructType([*reps.select("id", "copies", "vector").schema.fields, StructField("keys", ArrayType(LongType()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in lists], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                x = unit(np.array([lists[i] for i in rows], np.float64))
                keys = bucket_keys(x, part.column("label").to_pylist(), tables, joined)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), pa.array(list(x), pa.list_(pa.float64())),
                                                  pa.array(list(keys), pa.list_(pa.int64()))], schema.names)

    points = stored(reps.mapInArrow(hashed, schema), "vectors-points")
    entries = points.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    blocks = together(dealt(entries, CHUNK).join(points, "id"))
    found_schema = StructType([StructField("id", LongType()), StructField("links", LongType()), StructField("root", LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "side", "id", "copies")
        for group in blocks_of(batches):
            column = {n: group.column(n).to_numpy() for n in names}
            units, keys = (np.array(group.column(n).to_pylist()) for n in ("vector", "keys"))
            found = linked_in_block(column["id"], column["copies"], units, keys, column["side"], int(column["key"][0]), threshold)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], found_schema.names)

    found = stored(blocks.mapInArrow(compare, found_schema), "vectors-found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined_to = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = (classes.join(links, classes["rep"] == links["id"], "left").drop("id").join(joined_to, F.col("rep") == joined_to["id"], "left")
                .select("h1", "h2", F.lit(True).alias("usable"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    own = F.coalesce("component_id", "id")
    return (narrow.join(of_class, ["h1", "h2", "usable"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("id")).alias("kept")))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that neither tiny nor huge values are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
