"""Near duplicates by word shingles: min-max hashing, banding, and an exact check of full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from sourcetally.llm.arrow import byte_slices, words_of
from sourcetally.llm.blocks import blocks_of, dealt, roots, sides, together
from sourcetally.llm.graph import components
from sourcetally.llm.rows import few, one_row_an_id
from sourcetally.session import stored

#: Values in a band; chance that a linked pair meets in no band; bytes of the sketch that rules pairs out.
ROWS, MISS, SKETCH = 8, 1e-7, 256
#: Sets of a group that meet in one task; distinct shingles that are compared at a time.
CHUNK, COLUMNS = 256, 4096
SEED = 20_240_229


def bands_for(threshold: Fraction, rows: int = ROWS, miss: float = MISS) -> int:
    """The even number of bands at which a pair at the threshold shares none with chance ``miss``."""
    count = math.ceil(math.log(miss) / math.log1p(-min(float(threshold), 0.999) ** rows))
    return max(count + count % 2, -(-SKETCH // rows))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes of ``words`` words in a row; of a shorter text
    all its words together; of one without words nothing.  Words lie between ASCII white space, A-Z
    count as a-z."""
    codes, dictionary, counts = words_of(pc.ascii_lower(pa.array(texts, pa.large_string())).to_pylist())
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()], np.uint64)
    flat = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(flat) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(rolled)]
        rolled = _mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(rolled[at:at + n - words + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at:at + n].tobytes(), n)] if n else [], np.uint64))
        at += n
    return out


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)), rng.integers(0, 1 << 32, count, np.uint32)


def min_max(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation, then the greatest ones."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least, most = np.full(len(factor), 0xFFFFFFFF, np.uint32), np.zeros(len(factor), np.uint32)
    for at in range(0, len(short), 1024):
        values = factor[:, None] * short[at:at + 1024] + shift[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    return np.concatenate([least, most])


def signatures(docs: DataFrame, words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """(id, n, digest, bands, sketch) of (id, text): the size and a digest of the set, the key of
    each band and a byte of each of SKETCH values.  Texts without words have null in the last three."""
    schema = StructType([docs.schema["id"], StructField("n", LongType()), StructField("digest", BinaryType()),
                         StructField("bands", ArrayType(LongType())), StructField("sketch", BinaryType())])
    factor, shift = permutations(bands * rows // 2)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sizes, digests, keys, sketches = [], [], [], []
                for found in shingle_sets([t or "" for t in part.column("text").to_pylist()], words):
                    sizes.append(len(found))
                    if not len(found):
                        digests.append(None), keys.append(None), sketches.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    with np.errstate(over="ignore"):
                        values = min_max(found, factor, shift)
                        key = _mixed(number)
                        for column in values.reshape(bands, rows).T:
                            key = _mixed(key + column)
                    keys.append(key.view(np.int64))
                    sketches.append((values[:SKETCH] >> np.uint32(24)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                                  pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema.names)

    return docs.select("id", "text").mapInArrow(sign, schema)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of (id, text)."""
    schema = StructType([docs.schema["id"], StructField("shingles", ArrayType(LongType()))])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = shingle_sets([t or "" for t in part.column("text").to_pylist()], words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], schema.names)

    return docs.select("id", "text").mapInArrow(collect, schema)


def likely(pairs: DataFrame, reps: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out, with the estimated similarity.  The
    estimate of a pair at the threshold falls six standard deviations short about once in 10^9."""
    value = float(threshold)
    cut = value - 6 * math.sqrt(value * (1 - value) / SKETCH)
    side = lambda name: reps.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(side("a"), "a").where(F.col("n_a") > 0).join(side("b"), "b")
    fitting = (F.least("n_a", "n_b") * threshold.denominator >= F.greatest("n_a", "n_b") * threshold.numerator)
    schema = StructType([pairs.schema["a"], pairs.schema["b"], StructField("alike", LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("s_a", "s_b"))
            same = (left == right).sum(axis=1)
            # Bytes of different values are equal once in 256.
            keep = (same / SKETCH - 1 / 256) / (1 - 1 / 256) >= cut
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(same[keep], pa.int64())], schema.names)

    return both.where(fitting).select("a", "b", "s_a", "s_b").mapInArrow(compare, schema)


def sets_for(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents that ``ids`` (id) names, written.  The ids are sent to the texts
    if they are ``few``; else they are joined, which moves the texts."""
    return stored(sets_of(docs.join(few(ids, "minhash-wanted"), "id", "left_semi"), words), "minhash-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as the threshold says."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    measured = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
    return measured.where(reaches(F.col("common"), F.col("sizes"), threshold)).select("a", "b")


def reaches(common: Column, sizes: Column, threshold: Fraction) -> Column:
    """Whether ``common`` shingles of two sets of ``sizes`` together are enough."""
    return common * threshold.denominator >= (sizes - common) * threshold.numerator


def shareable(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(id, n, most): of each set its size and how much of it any other of ``sets`` can have, without
    the sets that can reach the threshold with none.  What only one set has, no pair has in common;
    that holds again among the sets that are left, so it is done twice."""
    for _ in range(2):
        single = (sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle")
                  .agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").groupBy("id").agg(F.count("*").alias("own")))
        sized = sets.select("id", "shingles", F.size("shingles").cast("long").alias("n")).join(single, "id", "left")
        sets = stored(sized.withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(reaches(F.col("most"), F.col("n") + F.col("most"), threshold)), "minhash-shareable")
    return sets.select("id", "n", "most")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set.  Shingles of one set alone can't
    count; the others are columns of two 0/1 matrices, taken COLUMNS at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right)) if left is not right else np.unique(np.concatenate(left))
    row, column = ([np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x)] for x in (left, right))
    place = []
    for rows, values in (row, column):
        at = np.searchsorted(both, values)
        there = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(0, np.int64)
        order = there[np.argsort(at[there], kind="stable")]
        place.append((rows[order], at[order]))
    for begin in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - begin)
        parts = []
        for (rows, at), count in zip(place, out.shape):
            a, b = np.searchsorted(at, [begin, begin + width])
            ones = np.zeros((count, width), np.float32)
            ones[rows[a:b], at[a:b] - begin] = 1
            parts.append(ones)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def links_in_blocks(members: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) for members (key, low, high, side, id, shingles): a link from each set to the smallest
    id that links between full sets lead to within its block."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            ids, side = (block.column(n).to_numpy() for n in ("id", "side"))
            sets = [np.asarray(x, np.int64) for x in block.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets])
            one, other = sides(side)
            if not len(one) or not len(other):
                continue
            alone = (side == 2).all()
            left = [sets[i] for i in one]
            common = common_counts(left, left if alone else [sets[i] for i in other])
            linked = common * threshold.denominator >= (size[one][:, None] + size[other] - common) * threshold.numerator
            a, b = np.nonzero(linked & (ids[one][:, None] != ids[other]))
            root = roots(ids, one[a], other[b])
            moved = pa.array(root != ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(moved), pa.array(root, pa.int64()).filter(moved)], schema.names)

    return together(members.withColumn("id", F.col("id").cast("long"))).mapInArrow(compare, schema)


def mixed_members(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (key, id, component, ..) whose bucket has several components, with ``main``,
    the one with the most rows."""
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(mixed.select("key", F.col("main.component").alias("main")), "key")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text",
                    rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document: the size of its set of ``words``-word
    shingles, the smallest id that links lead to, and whether that is its own.

    Two documents are linked if the intersection of their sets is at least ``threshold`` of the
    union.  Texts with equal sets are one class and take part as one, so copies make no pairs.
    Classes meet in bands of the signature.  First each is checked against the smallest id it meets,
    only the likeliest one.  Where a bucket still holds several components, its members are compared
    with each other, once for all buckets with the same largest component, in blocks that give a
    link per set and no row per pair; sets that can't reach the threshold with any other are spared.  A link between different sets is missed with
    a chance of MISS at most; no wrong one stands, as full sets decide.

    A null or empty text, or one without words, has size 0 and no links.  Rows without an id are
    left out; of rows that share an id one counts, as in ``one_row_an_id``.
    """
    docs = one_row_an_id(docs, id_col, text_col)
    signed = stored(signatures(docs, words, bands_for(threshold, rows), rows), "minhash-signatures")
    classes = stored(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "minhash-classes")
    # Copies are fewer than representatives, and signatures stay where they are if their ids can be sent.
    copies = signed.select("id", "digest").join(classes, "digest").where("id != rep").select("id")
    reps = stored(signed.where("n > 0").join(few(copies, "minhash-copies"), "id", "left_anti"), "minhash-reps")

    entries = reps.select("id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    members = stored(entries.join(shared, "key"), "minhash-members")

    stars = members.where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    best = likely(stars, reps, threshold).groupBy("a").agg(F.max(F.struct("alike", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    best = stored(best, "minhash-best")
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    links = stored(confirmed(best, sets_for(ends(best), docs, words), threshold), "minhash-links")
    joined = components(links)

    placed = stored(members.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "minhash-placed")
    sets = sets_for(mixed_members(placed).select("id"), docs, words)
    able = shareable(sets, threshold)
    groups = mixed_members(placed.join(able, "id")).select("id", F.col("main").alias("key")).distinct()
    more = stored(links_in_blocks(dealt(groups, CHUNK).join(sets, "id"), threshold), "minhash-more")
    if not more.isEmpty():
        joined = components(stored(links.unionByName(more), "minhash-links"))

    of_class = stored(classes.join(joined, classes["rep"] == joined["id"], "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "minhash-result")
    return (signed.select("id", "digest", F.col("n").alias("n_shingles")).join(of_class, "digest", "left")
            .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
                    (F.coalesce("component_id", "id") == F.col("id")).alias("kept")))
