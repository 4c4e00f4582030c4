"""Spelling variants: words one edit apart, found with a bit-sliced position index, and the form each goes back to."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcetally.llm.arrow import byte_slices, merged, words_of
from sourcetally.llm.blocks import blocks_of, dealt, sides, together
from sourcetally.session import stored

#: Least code points and occurrences of a word; how many times more often its form must occur.
LEAST, OFTEN, RATIO = 6, 5, 5
#: One run in so many (by a hash of document and run) loses a letter.
LOSS = 199
#: Words of a bucket on average, words that meet in one task at most per side; bytes of text taken at a time.
BUCKET, CHUNK, SLICE = 1024, 4096, 8 << 20
#: Lengths that have buckets of their own; longer words share theirs.
LENGTHS = 64
#: Lengths in bytes for which tables carry a checksum on; longer runs are taken one by one.
TABLED = 64


# --- words and their counts -------------------------------------------------------------------------

def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z as a-z and a space for every byte that is not part of A-Z, a-z or U+00C0 to
    U+00FF, whose first byte in UTF-8 is C3 and no other character's is."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    kind = np.zeros(256, np.uint8)
    kind[np.r_[65:91, 97:123]] = 1
    kind[0xC3] = 1
    mask = kind[raw].view(bool)
    mask[1:] |= raw[:-1] == 0xC3
    folded = np.arange(256, dtype=np.uint8)
    folded[65:91] += 32
    out = np.where(mask, folded[raw], np.uint8(32))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(out.tobytes()))


def _crc_tables() -> np.ndarray:
    """[length, byte of the checksum, value]: what a crc32 becomes when ``length`` zero bytes follow, as
    an exclusive or of one entry for each of its four bytes."""
    step = np.zeros(256, np.uint32)
    for value in range(256):
        c = value
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[value] = c
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for length in range(1, TABLED + 1):
        before = out[length - 1]
        out[length] = step[before & 255] ^ (before >> np.uint32(8))
    return out


CRC = _crc_tables()


def continued(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of two strings in a row from that of each, and the bytes of the second (TABLED at most)."""
    out = second.copy()
    for byte in range(4):
        out ^= CRC[lengths, byte, (first >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def counted(ids: list, texts: pa.Array, least: int, loss: int) -> dict[str, int]:
    """How often each word of at least ``least`` code points occurs in the texts, after runs lost a
    letter where ``loss`` divides the crc32 of `<id>:<run>` (0: nowhere)."""
    codes, words, counts = words_of(letters_only(texts))
    raw = [w.encode() for w in words.to_pylist()]
    points = np.array([len(w.decode()) for w in raw], np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    long = points[codes] >= least if len(codes) else np.zeros(0, bool)
    codes, owner = codes[long], owner[long]
    times = np.bincount(codes, minlength=len(raw))
    found: dict[str, int] = {}
    if loss and len(codes):
        size = np.array([len(w) for w in raw], np.int64)
        mine = np.array([zlib.crc32(w) for w in raw], np.uint32)
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        hashed = continued(heads[owner], mine[codes], np.minimum(size[codes], TABLED))
        wide = np.flatnonzero(size[codes] > TABLED)
        for i in wide.tolist():
            hashed[i] = zlib.crc32(raw[codes[i]], int(heads[owner[i]]))
        hit = np.flatnonzero(hashed % np.uint32(loss) == 0)
        times -= np.bincount(codes[hit], minlength=len(raw))
        place = hashed[hit] % points[codes[hit]].astype(np.uint32)
        for (code, at), n in zip(*(x.tolist() for x in np.unique(np.stack([codes[hit], place], 1).astype(np.int64), axis=0, return_counts=True))):
            word = raw[code].decode()
            word = word[:at] + word[at + 1:]
            if len(word) >= least:
                found[word] = found.get(word, 0) + n
    for code in np.flatnonzero(times).tolist():
        word = raw[code].decode()
        found[word] = found.get(word, 0) + int(times[code])
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, loss: int = LOSS) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur at least ``often`` times in all texts.
    Null texts have no words; a null id counts as an empty one; rows that repeat count again."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, "text", SLICE):
            for part in byte_slices(batch, "text", SLICE):
                found = counted(part.column("id").to_pylist(), part.column("text"), least, loss)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# --- the bit-sliced index -----------------------------------------------------------------------------

class Index:
    """For each position and letter the set of words that have it there, a bit for each word, and for
    each length the words that long."""

    def __init__(self, words: list[str]):
        self.words = words
        self.width = -(-len(words) // 64)
        sizes = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.letters, code = np.unique(points, return_inverse=True)
        slot = at * len(self.letters) + code
        self.rows, row = np.unique(slot, return_inverse=True)                    # slices that are not empty
        self.slices = np.zeros((len(self.rows) + 1, self.width), np.uint64)      # the last one is empty
        np.bitwise_or.at(self.slices, (row, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        self.long = {n: self.packed(sizes == n) for n in np.unique(sizes).tolist()}

    def packed(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(np.append(bits, np.zeros(64 * self.width - len(bits), bool)), bitorder="little").view(np.uint64)

    def of_length(self, n: int) -> np.ndarray:
        return self.long.get(n, np.zeros(self.width, np.uint64))

    def having(self, points: np.ndarray, at: int) -> np.ndarray:
        """For each query's letter the words that have it at position ``at``."""
        code = np.searchsorted(self.letters, points)
        known = (code < len(self.letters)) & (at >= 0)
        known &= self.letters[np.minimum(code, len(self.letters) - 1)] == points
        slot = at * len(self.letters) + code
        row = np.minimum(np.searchsorted(self.rows, slot), len(self.rows) - 1)
        return self.slices[np.where(known & (self.rows[row] == slot), row, len(self.rows))]

    def one_apart(self, points: np.ndarray, half: int, head: bool, shorter: int) -> np.ndarray:
        """For queries of one length (a row of code points each) the words exactly one edit away, as
        rows of bits, among words of ``shorter`` letters and one more, at least one of the two that
        short; with ``head`` those that share the first ``half`` letters, else those that do not.

        One step for each letter of the queries keeps four sets at once: words without an error so
        far, and words with one, for which the query went on in place (replaced), one place behind
        (the query has a letter more) or one ahead (the word has one more).
        """
        count, size = points.shape
        full = np.full((count, self.width), ~np.uint64(0))
        zero, replaced = full, np.zeros_like(full)
        behind, ahead = np.zeros_like(full), np.zeros_like(full)
        alike = full
        for i in range(size):
            here = self.having(points[:, i], i)
            if size == shorter:
                replaced = (replaced & here) | (zero & ~here)
                ahead = (ahead | zero) & self.having(points[:, i], i + 1)
            else:
                behind = (behind & self.having(points[:, i], i - 1)) | zero
            zero = zero & here
            if i + 1 == half:
                alike = zero
        if size == shorter:
            found = (replaced & self.of_length(size)) | ((ahead | zero) & self.of_length(size + 1))
        else:
            found = behind & self.of_length(shorter)
        return found & alike if head else found & ~alike


def neighbours(words: list[str], shorter: int, head: bool, given: list[str], n: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(place in ``words``, near words among ``given``, the greatest n of those, the first word that has
    it), for words that have any.  ``given`` ascend and ``n`` are their counts."""
    if not words or not given:
        return
    index = Index(given)
    sizes = np.array([len(w) for w in words])
    by_rank = np.lexsort((np.arange(len(given)), -n))                         # the best word first
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        for a in range(0, len(mine), 1024):
            some = mine[a:a + 1024]
            points = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(-1, size)
            found = index.one_apart(points, shorter // 2, head, shorter)
            rows = np.flatnonzero(found.any(axis=1))
            bits = np.unpackbits(found[rows].view(np.uint8), axis=1, bitorder="little")[:, :len(given)]
            total, best = bits.sum(axis=1, dtype=np.int64), by_rank[np.argmax(bits[:, by_rank], axis=1)]
            for row, count, b in zip(rows.tolist(), total.tolist(), best.tolist()):
                yield int(some[row]), count, int(n[b]), given[b]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n), for words that have a near one: how many
    there are, and that with the largest n, of equals the first in code-point order.

    Two words one edit apart, the shorter of m letters, share the first m // 2 letters or all the
    others: the edit is on one side of that point.  So a word goes to four buckets: by its head and by
    its tail, as the shorter and as the longer one, keyed by m and what is shared, several keys to a
    bucket.  A pair counts where heads are equal in the head's bucket alone, else in the tail's, so it
    counts once.  A bucket is indexed and asked as a whole; one with more than CHUNK words is cut into
    chunks that meet two by two.  No row stands for a pair.
    """
    size = F.length("word")
    roles = F.explode(F.array(*[F.struct((size - less).alias("shorter"), F.lit(head).alias("head")) for less in (0, 1) for head in (True, False)]))
    entry = words.withColumn("role", roles).select("word", "n", F.col("role.shorter").alias("m"), F.col("role.head").alias("head"))
    half = F.floor(F.col("m") / 2).cast("int")
    entry = entry.withColumn("part", F.when(F.col("head"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", half - F.col("m"), F.col("m") - half)))
    capped = F.least(F.col("m"), F.lit(LENGTHS)).alias("capped")
    among = {r.capped: -(-r["count"] // BUCKET) for r in entry.where("head").groupBy(capped).count().collect()}      # a row for each length to LENGTHS
    buckets = F.element_at(F.array(*[F.lit(among.get(m, 1)) for m in range(LENGTHS + 1)]), capped + 1)
    bucket = F.pmod(F.xxhash64("part"), buckets)
    key = F.shiftleft(F.col("m").cast("long") * 2 + F.col("head").cast("long"), 32) + bucket
    members = stored(entry.select(F.struct("word", "n").alias("id"), key.cast("long").alias("key")), "variants-members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            block = block.sort_by([("word", "ascending")])
            side, n = block.column("side").to_numpy(), block.column("n").to_numpy()
            kind = block.column("key")[0].as_py() >> 32
            shorter, head = kind // 2, bool(kind % 2)
            words = block.column("word").to_pylist()
            one, other = (x.tolist() for x in sides(side))
            found = []
            for asked, given in ([(one, other)] if (side == 2).all() else [(one, other), (other, one)]):
                found += [(words[asked[i]], count, best, name)
                          for i, count, best, name in neighbours([words[i] for i in asked], shorter, head, [words[i] for i in given], n[given])]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             ["word", "n_near", "best_n", "best"])

    met = dealt(members, CHUNK).select("id.word", "id.n", "key", "low", "high", "side")
    found = together(met).mapInArrow(compare, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n), each word once.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its
    near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times
    its own n, else null; the root is where forms lead to, the word itself if it has none.  As n
    grows with every step there are no circles, and ways are short; they are followed by doubling.
    """
    words = stored(words, "variants-words")
    near = near_words(words)
    formed = F.col("best_n") >= ratio * F.col("n")
    table = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"),
        F.when(formed, F.col("best_n")).alias("form_n")), "variants-forms")
    up = stored(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        doubled = stored(up.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        up = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            break
    return table.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
