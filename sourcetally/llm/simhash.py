"""SimHash fingerprints of whole texts and their search by Hamming distance, in DataFrame functions only."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcetally.llm.rows import one_row_an_id
from sourcetally.session import stored

#: A fingerprint is WORDS longs of 64 bits.  A long lane holds the votes for two bits, 32 bits apart.
WORDS = 2
LANE = 0x0000000100000001
BITS = 64 * WORDS


def terms(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a text in lower case, with repeats; of the word
    itself if there is one only."""
    words = F.array_remove(F.split(F.lower(text), "[ \t\n\x0b\f\r]+"), "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) == 1, F.array(F.xxhash64(F.element_at(words, 1)))).otherwise(pairs)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the fingerprint of the whole text as longs f0, f1.

    Every occurrence of a term votes, for 1 where a bit of its hash is set and for 0 elsewhere, so a
    term weighs as often as it occurs; a bit is set if more than half of the votes are for 1.  A
    vote takes 32 bits, more than the words a text can have.  Keys must tell rows apart.  A null or
    empty text has fingerprint 0; equal texts have equal fingerprints.  Votes are added up before
    any shuffle, a text's terms never meet in a list of their own beyond its row.
    """
    exploded = rows.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    hashes = [F.col("term")] + [F.xxhash64(F.col("term"), F.lit(i)) for i in range(1, WORDS)]
    voted = exploded.select(*keys, F.col("term").isNotNull().cast("long").alias("one"),
                            *[F.when(F.col("term").isNotNull(), h).otherwise(F.lit(0)).alias(f"h{i}") for i, h in enumerate(hashes)])
    sums = [F.sum(F.shiftrightunsigned(F.col(f"h{i}"), k).bitwiseAND(F.lit(LANE))).alias(f"v{i}_{k}") for i in range(WORDS) for k in range(32)]
    tally = voted.groupBy(*keys).agg(F.sum("one").alias("votes"), *sums)

    def word(i: int) -> Column:
        bits = []
        for k in range(32):
            lane = F.col(f"v{i}_{k}")
            for shift, count in ((k, lane.bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(lane, 32))):
                bits.append(F.when(2 * count > F.col("votes"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
        return reduce(Column.bitwiseOR, bits)

    return tally.select(*keys, *[word(i).alias(f"f{i}") for i in range(WORDS)])


def as_text(words: list[Column]) -> Column:
    """A fingerprint in lower-case hex digits, 16 for each long."""
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def distance(left: list[Column], right: list[Column]) -> Column:
    return reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)])


def likeness(left: list[Column], right: list[Column]) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - distance(left, right) / F.lit(float(BITS))


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, n_chars, next_id, prev_id, prev_chars) of (id, text): who follows and precedes in
    descending order of ids, round the ends.

    Only ids and lengths are put in order: ranges of ids first, then each range by itself, then the
    ends of the ranges, one row per range.
    """
    ids = docs.select("id", F.length("text").alias("n_chars"))
    ranged = stored(ids.repartitionByRange(F.desc("id")).withColumn("range", F.spark_partition_id()), "simhash-order")
    ends = ranged.groupBy("range").agg(F.max("id").alias("top"), F.min("id").alias("bottom"), F.min_by("n_chars", "id").alias("bottom_chars"))
    order, whole = Window.orderBy(F.desc("top")), Window.partitionBy(F.lit(1))
    ends = ends.select(
        "range", F.coalesce(F.lead("top").over(order), F.max("top").over(whole)).alias("after"),
        F.coalesce(F.lag("bottom").over(order), F.min("bottom").over(whole)).alias("before"),
        F.coalesce(F.lag("bottom_chars").over(order), F.min_by("bottom_chars", "bottom").over(whole)).alias("before_chars"))
    inside = Window.partitionBy("range").orderBy(F.desc("id"))
    linked = ranged.select("range", "id", "n_chars", F.lead("id").over(inside).alias("next_id"), F.lag("id").over(inside).alias("prev_id"),
                           F.lag("n_chars").over(inside).alias("prev_chars")).join(F.broadcast(ends), "range")
    return linked.select("id", "n_chars", F.coalesce("next_id", "after").alias("next_id"), F.coalesce("prev_id", "before").alias("prev_id"),
                         F.coalesce("prev_chars", "before_chars").alias("prev_chars"))


def edited(docs: DataFrame) -> DataFrame:
    """(id, n_chars, next_id, text, edited) of (id, text): the last half of a text gives way to the
    beginning of the next one, as many code points if it has them.

    Texts are dealt by id once; what goes to another id is the piece that it needs.
    """
    known = docs.join(stored(neighbours(docs), "simhash-neighbours"), "id")
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    heads = known.select(F.col("prev_id").alias("id"), F.substring(F.col("text"), F.lit(1), half("prev_chars")).alias("head"))
    own = known.select("id", "n_chars", "next_id", "text")
    return own.join(heads, "id").select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), "next_id", "text",
        F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half("n_chars")), F.col("head")).alias("edited"))


def searched(found: DataFrame, asked: Column, radius: int) -> DataFrame:
    """``found`` (f0_0.. are its fingerprints) with n_close: for rows of ``asked`` the number of other
    fingerprints in all of ``found`` within ``radius`` bits, each value once; null for the rest, which
    stay where they are."""
    words = [f"f{i}" for i in range(WORDS)]
    values = [F.col(f"f0_{i}").alias(w) for i, w in enumerate(words)]
    met = near(found.select(*values), found.where(asked).select(*values), radius)
    counts = met.where("distance > 0").groupBy(*[F.col(f"q{i}").alias(f"f0_{i}") for i in range(WORDS)]).agg(F.count("*").alias("n_close"))
    answered = (found.where(asked).join(counts, [f"f0_{i}" for i in range(WORDS)], "left")
                .withColumn("n_close", F.coalesce("n_close", F.lit(0).cast("long"))))
    return answered.unionByName(found.where(~asked).withColumn("n_close", F.lit(None).cast("long")))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, radius: int = 3) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), and with
    ``every`` also n_close: of ids divisible by it the number of other fingerprints of the table within
    ``radius`` bits, by the block tables of ``near``; null for other ids.

    A null text counts as empty.  Rows without an id have no place in the order and are left out;
    rows that share an id are one document, that with the smallest hash of the text.  A single
    document is its own next one.  An empty table gives an empty result; other columns are ignored.
    """
    both = edited(one_row_an_id(docs, id_col, text_col))
    keys = ["id", "n_chars", "next_id", "edited_sha256"]
    versions = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"))))
    rows = both.select("id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"), versions.alias("both")).select(*keys, "both.*")
    found = fingerprints(rows, [*keys, "version"], "body")
    version = lambda n, i: F.max(F.when(F.col("version") == n, F.col(f"f{i}"))).alias(f"f{n}_{i}")
    found = stored(found.groupBy(*keys).agg(*[version(n, i) for n in (0, 1) for i in range(WORDS)]), "simhash-found")
    own, other = ([F.col(f"f{n}_{i}") for i in range(WORDS)] for n in (0, 1))
    after = [F.col(f"n{i}") for i in range(WORDS)]
    following = found.select(F.col("id").alias("next_id"), *[F.col(f"f0_{i}").alias(f"n{i}") for i in range(WORDS)])
    if every is not None:
        found = searched(found, F.col("id") % every == 0, radius)
    return found.join(following, "next_id").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"), *(["n_close"] if every is not None else []))


def block_tables(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Which blocks are kept in each table: of fingerprints at most ``radius`` bits apart, at least
    ``blocks - radius`` blocks are equal, so they meet in one of the tables."""
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than bits of the radius")
    return list(itertools.combinations(range(blocks), blocks - radius))


def near(index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None, words: list[str] | None = None) -> DataFrame:
    """(f0.., q0.., distance): for each fingerprint of ``queries`` all that ``index`` has within
    ``radius`` bits, itself included, each pair of values once; ids follow by joining either table on
    the values, so copies of a text add no pairs.

    Exact at any radius below ``blocks`` (default: radius + 2).  Each table puts the bits of some
    blocks first, as its key, which is a join by equality; null fingerprints find nothing.
    """
    words = words or [f"f{i}" for i in range(WORDS)]
    blocks = blocks or radius + 2
    bits = 64 * len(words)
    bounds = [bits * i // blocks for i in range(blocks + 1)]

    def masked(kept: tuple[int, ...]) -> list[Column]:
        mask = 0
        for b in kept:
            mask |= (1 << bounds[b + 1]) - (1 << bounds[b])
        parts = [(mask >> (64 * i)) & (2 ** 64 - 1) for i in range(len(words))]
        return [F.col(w).bitwiseAND(F.lit(p - 2 ** 64 if p >= 2 ** 63 else p)) for w, p in zip(words, parts)]

    tables = block_tables(radius, blocks)

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.select(*words).dropna().distinct()
        entries = F.array(*[F.struct(F.lit(t).alias("t"), *[c.alias(f"k{i}") for i, c in enumerate(masked(kept))]) for t, kept in enumerate(tables)])
        return rows.select(*words, F.explode(entries).alias("entry")).select(*words, "entry.*")

    left = keyed(index)
    right = keyed(queries).withColumnsRenamed({w: f"q{i}" for i, w in enumerate(words)})
    apart = distance([F.col(w) for w in words], [F.col(f"q{i}") for i in range(len(words))])
    met = left.join(right, ["t", *[f"k{i}" for i in range(len(words))]]).withColumn("distance", apart).where(F.col("distance") <= radius)
    return met.select(*words, *[f"q{i}" for i in range(len(words))], "distance").distinct()
