"""Substring deduplication: content-defined chunks of a gear hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sourcetally.llm.arrow import byte_slices
from sourcetally.llm.rows import few, one_row_an_id, repeated_ids
from sourcetally.session import stored

#: Bytes that the gear hash looks back on; white spaces on either side that a cut's hash must beat;
#: greatest bytes of a chunk; least bytes of neighbouring repeated chunks that are taken out.
WINDOW, REACH, MOST, RUN = 16, 4, 256, 100
GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, np.uint32)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte the rolling gear hash of the last WINDOW bytes: every byte's number, shifted by
    its distance.  Four doublings of the window take the place of a step per byte."""
    h = GEAR[raw]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h * np.uint32(0x9E3779B1)


def cuts(texts: list[bytes]) -> list[np.ndarray]:
    """Ends of the chunks of each text.  A chunk ends after the white space whose hash is greater than
    that of REACH white spaces on either side, so every end depends on the bytes near it and no
    others: an insertion moves the ends around it alone.  A longer stretch than MOST without such a
    place is cut by ``split``."""
    return [ends for ends, _ in cuts_and_returns(texts)]


def cuts_and_returns(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ends of ``cuts`` of each text, and its returns: ends of the white spaces whose hash no other
    within REACH exceeds and one before equals.  They lie where a few words are said over and over,
    one or more in every period, and depend on the bytes near them alone as well."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t + bytes(WINDOW) for t in texts), np.uint8)
    hashed = gear_hash(flat)
    first = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    place = np.flatnonzero(SPACES[flat])
    owner, value = np.searchsorted(first, place, "right"), hashed[place]
    most, again = np.ones(len(place), bool), np.zeros(len(place), bool)
    for k in range(1, REACH + 1):
        same = owner[k:] == owner[:-k]
        most[k:] &= ~same | (value[k:] >= value[:-k])
        most[:-k] &= ~same | (value[:-k] >= value[k:])
        again[k:] |= same & (value[k:] == value[:-k])
    ends, back = place[most & ~again] + 1, place[most & again] + 1
    bounds, others = (np.searchsorted(x, np.append(first, len(flat)), "right") for x in (ends, back))
    out = []
    for i, (text, begin, size) in enumerate(zip(texts, first.tolist(), sizes.tolist())):
        mine = np.union1d(ends[bounds[i]:bounds[i + 1]] - begin, [size]) if size else np.zeros(0, np.int64)
        wide = np.flatnonzero(np.diff(mine, prepend=0) > MOST)
        if len(wide):
            more = [e for w in wide.tolist() for e in split(text, hashed[begin:begin + size], int(mine[w - 1]) if w else 0, int(mine[w]))]
            mine = np.union1d(mine, more)
        out.append((mine, back[others[i]:others[i + 1]] - begin))
    return out


def split(text: bytes, hashed: np.ndarray, start: int, end: int) -> list[int]:
    """Further ends between ``start`` and ``end``, no more than MOST bytes apart: after the last white
    space there, so that a word said over and over gives equal chunks, else where the hash says so
    once in 64 bytes, else as far as it goes; never inside a character."""
    out = []
    while end - start > MOST:
        blank = max(text.rfind(space, start, start + MOST) for space in BLANKS) + 1 - start
        whole = np.frombuffer(text, np.uint8, MOST, start + 1) & 0xC0 != 0x80
        named = np.flatnonzero(whole & (hashed[start:start + MOST] >> np.uint32(26) == 0)) + 1
        cut = blank if blank > 0 else int(named[-1]) if len(named) else int(np.flatnonzero(whole)[-1]) + 1
        start += cut
        out.append(start)
    return out


def windows(text: bytes, returns: list[int], least: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the window before each return: ``least`` bytes and what is left of the
    word they begin in, so a match is a whole passage by itself, wherever the chunks around it end.
    Windows that say the same and overlap are one, with the digest of each."""
    out: list[tuple[int, int, bytes]] = []
    for end in returns:
        start = end - least
        if start < 0:
            continue
        near = text[max(0, start - MOST):start]
        word = len(near) - 1 - max(near.rfind(space) for space in BLANKS)
        if word < len(near) or len(near) == start:
            start -= word
        else:
            while text[start] & 0xC0 == 0x80:
                start -= 1
        digest = xxhash.xxh3_128_digest(text[start:end])
        if out and out[-1][2] == digest and out[-1][1] >= start:
            out[-1] = (out[-1][0], end, digest)
        else:
            out.append((start, end, digest))
    return out


def pieces(texts: list[bytes], least: int = RUN) -> list[list[tuple[int, int, bytes]]]:
    """(start, size, digest) of the chunks and windows of each text."""
    out = []
    for text, (ends, returns) in zip(texts, cuts_and_returns(texts)):
        ends = ends.tolist()
        out.append([(a, b - a, xxhash.xxh3_128_digest(text[a:b])) for a, b in zip([0, *ends], ends)]
                   + [(a, b - a, digest) for a, b, digest in windows(text, returns.tolist(), least)])
    return out


def chunks(docs: DataFrame, least: int = RUN) -> DataFrame:
    """(id, start, size, hi, lo) of (id, text): place in bytes and 128-bit digest of each chunk and window."""
    schema = StructType([docs.schema["id"], StructField("start", IntegerType()), StructField("size", IntegerType()),
                         StructField("hi", LongType()), StructField("lo", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                lists = pieces([t.encode() if t else b"" for t in part.column("text").to_pylist()], least)
                flat = [p for found in lists for p in found]
                pairs = np.frombuffer(b"".join([digest for _, _, digest in flat]), np.int64).reshape(-1, 2)
                rows = np.repeat(np.arange(len(lists)), [len(found) for found in lists])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array([a for a, _, _ in flat], pa.int32()), pa.array([n for _, n, _ in flat], pa.int32()),
                                                  pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], schema.names)

    return docs.select("id", "text").mapInArrow(cut, schema)


def runs(starts: list[int], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """Spans (start, end) of neighbouring or overlapping chunks that hold at least ``least`` bytes together."""
    out: list[list[int]] = []
    for start, size in sorted(zip(starts, sizes)):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out if b - a >= least]


def repeated_spans(docs: DataFrame, least: int = RUN) -> DataFrame:
    """(id, spans) of (id, text), for texts that have any: spans [start, end) in bytes whose chunks
    all occur in a document with a smaller id.

    Chunks are cut once and written.  Half of a digest shows which chunks can repeat at all; whole
    digests decide among those, so most chunks are counted and never move again.
    """
    found = stored(chunks(docs, least), "chunking-chunks")
    several = lambda rows, *key: rows.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    again = stored(found.join(few(several(found, "hi").select("hi"), "chunking-halves"), "hi", "left_semi"), "chunking-repeated")
    again = again.join(several(again, "hi", "lo").drop("last"), ["hi", "lo"]).where("first < id").select("id", "start", "size")
    gathered = again.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    pair = ArrayType(IntegerType())
    schema = StructType([docs.schema["id"], StructField("spans", ArrayType(pair))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [runs(a, b, least) for a, b in zip(batch.column("starts").to_pylist(), batch.column("sizes").to_pylist())]
            keep = pa.array([bool(s) for s in spans], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), pa.array([[list(x) for x in s] for s in spans if s], pa.list_(pa.list_(pa.int32())))], schema.names)

    return gathered.mapInArrow(merge, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = RUN) -> DataFrame:
    """``docs`` with texts freed of passages that a document with a smaller id has, plus n_spans and
    removed_bytes (long): how many passages went and their bytes.

    A passage is a run of neighbouring or overlapping chunks and windows, each of which occurs in a
    document with a smaller id, of ``least`` bytes or more; shorter runs are chance.  Chunks that repeat within one
    document stay.  Where a passage goes the texts around it meet, and both sides end at white space
    or a chunk's end.  All rows stay, also those whose text becomes empty; null texts stay null.
    Rows without an id stay as they are.  Of rows that share an id, those whose text is the one that
    ``one_row_an_id`` chooses (by its hash) are changed alike; the others stay.  Copies of one text differ in
    id, so all but the first become empty.
    """
    repeated = repeated_ids(docs, id_col, text_col)
    spans = stored(repeated_spans(one_row_an_id(docs, id_col, text_col, repeated), least)
                   .join(repeated, "id", "left").select(F.col("id").alias("_spans_id"), F.col("spans").alias("_spans_found"), F.col("hash").alias("_spans_hash")), "chunking-spans")
    kept = [c for c in docs.columns if c not in ("n_spans", "removed_bytes")]
    texts = docs.select(*[F.col(f"`{c}`") for c in kept])
    ids = few(spans.select("_spans_id"), "chunking-ids")
    key = F.col(f"`{id_col}`")
    # Texts without spans are not joined with anything that would move them.
    spanned = texts.join(ids, key == F.col("_spans_id"), "left_semi").join(spans, key == F.col("_spans_id"))
    mine = F.col("_spans_hash").isNull() | (F.col("_spans_hash") == F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = [F.col(f"`{c}`") for c in kept]
    both = spanned.select(*same, F.when(mine, F.col("_spans_found")).alias("_spans"))
    plain = texts.join(ids, key == F.col("_spans_id"), "left_anti").select(*same, F.lit(0).cast("long").alias("n_spans"), F.lit(0).cast("long").alias("removed_bytes"))

    def take_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for given, spans in batches:
            texts, counts, gone = [], [], []
            for text, found in zip(given.to_pylist(), spans.to_pylist()):
                raw = text.encode() if text and found else b""
                if not raw:
                    texts.append(text), counts.append(0), gone.append(0)
                    continue
                at, parts = 0, []
                for a, b in found:
                    parts.append(raw[at:a])
                    at = b
                texts.append(b"".join([*parts, raw[at:]]).decode())
                counts.append(len(found)), gone.append(sum(b - a for a, b in found))
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_spans", "removed_bytes"])

    found = F.arrow_udf(take_out, "text string, n_spans long, removed_bytes long")(F.col(f"`{text_col}`"), F.col("_spans"))
    done = both.select(*[F.col(f"`{c}`") for c in kept if c != text_col], found.alias("_done"))
    changed = done.select(*[F.col("_done.text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in kept], "_done.n_spans", "_done.removed_bytes")
    return plain.unionByName(changed)
